"""Fixed-length sequences of feature vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertmill.operators.ordered import core, part_window, ranked, running


def vector(features: Sequence[str]) -> Column:
    return F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])


def _gap_minutes(ts: str, w) -> Column:
    return (F.unix_micros(ts) - F.lag(F.unix_micros(ts)).over(w)) / 60e6


def sliding_sequences(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    features: Sequence[str],
    length: int = 10,
    ts: str | None = None,
    max_gap_min: float = 120.0,
) -> DataFrame:
    """Every run of ``length`` consecutive rows, stride 1, named after its last row.

    ``end_id`` is the 0-based place of the last row. With ``ts`` a sequence with
    a longer gap inside is dropped.
    """
    rows = ranked(df.withColumn("_v", vector(features)), keys, order, before=length - 1)
    w = part_window(keys)
    rows = rows.withColumn("sequence", F.collect_list("_v").over(w.rowsBetween(-(length - 1), 0)))
    keep = F.col("_rank") >= length
    if ts:
        rows = rows.withColumn("_gap", _gap_minutes(ts, w))
        rows = rows.withColumn("_worst", F.max("_gap").over(w.rowsBetween(-(length - 2), 0)))
        keep = keep & (F.col("_worst") <= max_gap_min)
    out = rows.filter(keep).withColumn("end_id", F.col("_rank") - 1)
    return core(out).drop("_v", "_gap", "_worst")


def padded_sequences(
    df: DataFrame, key: str, order: Sequence[str], features: Sequence[str], length: int = 10
) -> DataFrame:
    """One sequence per row; rows near the start repeat the first row of the dataset."""
    rows = ranked(df.withColumn("_v", vector(features)), [key], order, before=length - 1)
    seq = F.collect_list("_v").over(part_window([key]).rowsBetween(-(length - 1), 0))
    rows = core(rows.withColumn("sequence", seq), keep=["_rank"])
    firsts = rows.filter("_rank = 1").select(key, F.col("_v").alias("_first"))
    pad = F.array_repeat(F.col("_first"), F.lit(length) - F.size("sequence"))
    return rows.join(firsts, key).withColumn("sequence", F.concat(pad, F.col("sequence"))).drop("_v", "_first", "_rank")


def disjoint_sequence_ends(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    ts: str,
    length: int = 10,
    max_gap_min: float = 120.0,
) -> DataFrame:
    """Last rows of back-to-back sequences that never span a long gap.

    Taking greedily from the left is the same as cutting every gap-free
    stretch into whole pieces, so no loop over rows is needed.
    """
    rows = ranked(df, keys, order, before=1)
    rows = rows.withColumn("_gap", _gap_minutes(ts, part_window(keys)))
    rows = core(rows, keep=["_rank", "_part", "_all"])
    opens = F.when((F.col("_rank") == 1) | (F.col("_gap") > max_gap_min), F.col("_rank"))
    rows = running(rows, keys, ["_rank"], maxima={"_begin": opens})
    place = F.col("_rank") - F.col("_begin")
    return (
        rows.filter(place % length == length - 1)
        .withColumn("end_id", F.col("_rank") - 1)
        .drop("_rank", "_part", "_gap", "_begin", "_all")
    )


def collect_disjoint(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    features: Sequence[str],
    ts: str,
    length: int = 10,
    max_gap_min: float = 120.0,
) -> DataFrame:
    """The sequences that end at ``disjoint_sequence_ends``."""
    slides = sliding_sequences(df, keys, order, features, length, ts, max_gap_min)
    ends = disjoint_sequence_ends(df, keys, order, ts, length, max_gap_min).select(*keys, "end_id")
    return slides.join(ends, [*keys, "end_id"], "left_semi")
