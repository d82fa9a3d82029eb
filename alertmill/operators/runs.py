"""Contiguous attack runs, detection delay and special rows of a score table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertmill.operators.ordered import core, part_window, quantiles, ranked, running


def mark_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], inside: Column) -> DataFrame:
    """Add ``run_start`` (rank of the first row of the run) and ``run_pos`` (1-based).

    Both are NULL outside runs. The start is carried as a running maximum, so a
    run of any length crosses partitions without being gathered.
    """
    rows = ranked(df.withColumn("_in", inside), keys, order, before=1)
    before = F.coalesce(F.lag("_in").over(part_window(keys)), F.lit(False))
    rows = core(rows.withColumn("_opens", F.col("_in") & ~before), keep=["_rank", "_part", "_all"])
    rows = running(rows, keys, ["_rank"], maxima={"_begin": F.when(F.col("_opens"), F.col("_rank"))})
    return rows.withColumn("run_start", F.when(F.col("_in"), F.col("_begin"))).withColumn(
        "run_pos", F.when(F.col("_in"), F.col("_rank") - F.col("_begin") + 1)
    ).drop("_in", "_opens", "_begin", "_part", "_all", "_rank")


def detection_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], alarm: Column) -> DataFrame:
    """One row per attack run: length, delay in windows, detected. Needs ``y`` (0 attack).

    A run without an alarm counts its whole length as delay.
    """
    rows = mark_runs(df.withColumn("_alarm", alarm), keys, order, F.col("y") == 0)
    per_run = (
        rows.filter(F.col("run_start").isNotNull())
        .groupBy(*keys, "run_start")
        .agg(F.max("run_pos").alias("run_length"), F.min(F.when(F.col("_alarm"), F.col("run_pos") - 1)).alias("_hit"))
    )
    return per_run.select(
        *keys,
        "run_start",
        "run_length",
        F.coalesce("_hit", "run_length").alias("delay"),
        F.col("_hit").isNotNull().alias("detected"),
    )


def summarise_runs(runs: DataFrame, keys: Sequence[str], step_minutes: int = 10) -> DataFrame:
    """Runs, detections, rate, median and 90 % delay, and hits within one step."""
    timed = runs.withColumn("_delay", (F.col("delay") * step_minutes).cast("double"))
    counts = [
        F.count(F.lit(1)).alias("n_runs"),
        F.count_if("detected").alias("n_detected"),
        (F.count_if("detected") / F.count(F.lit(1))).alias("detection_rate"),
        F.count_if(F.col("_delay") <= step_minutes).alias("early_detect_1w"),
    ]
    probs = {"median_delay_min": 0.5, "p90_delay_min": 0.9}
    if keys:
        return timed.groupBy(*keys).agg(*counts).join(quantiles(timed, keys, "_delay", probs), list(keys))
    one = timed.withColumn("_all", F.lit(0))
    return one.groupBy("_all").agg(*counts).join(quantiles(one, ["_all"], "_delay", probs), "_all").drop("_all")


def cold_starts(df: DataFrame, keys: Sequence[str], order: str = "end_id") -> DataFrame:
    """The first row and every row after a break in the numbering of sequence ends."""
    rows = ranked(df, keys, [order], before=1)
    prev = F.lag(order).over(part_window(keys))
    return core(rows.withColumn("_cold", prev.isNull() | (F.col(order) - prev > 1))).filter("_cold").drop("_cold")


def isolated_attacks(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], preceding: int = 5, least: int = 3
) -> DataFrame:
    """Attacks whose up to ``preceding`` (at least ``least``) earlier rows are all normal."""
    rows = ranked(df, keys, order, before=preceding)
    w = part_window(keys).rowsBetween(-preceding, -1)
    quiet = (F.count("y").over(w) >= least) & (F.min("y").over(w) == 1)
    return core(rows.withColumn("_quiet", quiet)).filter((F.col("y") == 0) & F.col("_quiet")).drop("_quiet")


def early_run_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], inside: Column, first: int = 5) -> DataFrame:
    """The first rows of each run, such as the onset of a slow attack."""
    rows = mark_runs(df, keys, order, inside)
    return rows.filter(F.col("run_pos") <= first).drop("run_start", "run_pos")
