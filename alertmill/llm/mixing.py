"""Mixing sources to target weights by weighted fair queueing.

Every source has a share of a word budget. A document's virtual finish time is
the words of its source up to and with it, in a seeded random order, divided by
the source's target; a second pass over the source continues the count. All
copies are then range-sorted by finish time and taken until the budget is full,
so the sources reach their targets together.

Targets: the budget is shared by weight; where a share exceeds ``PASSES``
times the source's words it stops there and the excess is shared again among
the others, until none is above.

No step gathers a source in one task: sums run over range partitions and are
carried by a table with one row per partition (``ordered.running``).

Defined cases: a null text has no words and is never counted but stays in the
result; the null source is one source, last in order; rows that repeat are
drawn one by one; an empty table gives an empty result; a table without any
word has targets 0. Reruns agree: the order is that of a digest of doc_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertmill.llm import words as W
from alertmill.llm.common import join_small, numbered, packed
from alertmill.operators import ordered
from alertmill.session import settle

SEED = 17
WEIGHTS = (3, 1, 2)
#: The budget is BUDGET[0]/BUDGET[1] of all words.
BUDGET = (3, 2)
PASSES = 2


def n_words(text: Column) -> Column:
    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        parts = [np.diff(W.word_spans(part)[2]) for part in W.slices(texts)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())

    return count(text)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """From (source, size): one row per source with source_size, weight and target."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranks = ordered.ranked(totals.withColumn("_last", F.col("source").isNull()), [], ["_last", "source"])
    weight = F.get(F.array(*[F.lit(w) for w in weights]), ((F.col("_rank") - 1) % len(weights)).cast("int"))
    table = settle(ranks.select("source", "source_size", weight.cast("bigint").alias("weight")), "sources")
    num, den = BUDGET
    cap, level, stopped = F.col("source_size") * PASSES, 0.0, -1
    while True:
        above = cap < F.col("weight") * F.lit(level)
        row = table.agg(
            F.count(F.when(above, 1)).alias("n"),
            F.sum("source_size").alias("all"),
            F.sum(F.when(above, cap)).alias("spent"),
            F.sum(F.when(~above, F.col("weight"))).alias("weight"),
        ).first()
        if row["n"] == stopped or not row["weight"]:
            break
        stopped = row["n"]
        level = (num * row["all"] - den * (row["spent"] or 0)) / (den * row["weight"])
    target = F.when(above, cap.cast("double")).otherwise(F.col("weight") * F.lit(level))
    return table.withColumn("target", target)


def mixed(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Add source_size, target and copies (0 to PASSES) to rows of (doc_id, source, size, ...), ``_row`` unique."""
    targets = source_targets(rows, weights)
    rows = rows.withColumn("_token", ordered.shuffle_token(SEED, "doc_id"))
    slim = rows.select("_row", F.struct(F.col("source").isNull().alias("last"), "source").alias("_src"), "size", "_token", "doc_id")
    order = ["_token", "doc_id", "size", "_row"]
    queue = ordered.running(ordered.spread(slim, ["_src"], order), ["_src"], order, {"_cum": F.col("size")})
    keyed = targets.select(
        F.struct(F.col("source").isNull().alias("last"), "source").alias("_of"), "source_size", "target"
    )
    queue = join_small(queue.drop("_part"), keyed, F.col("_src") == F.col("_of"))
    finish = (F.col("_cum") + F.col("_pass") * F.col("source_size")).cast("double") / F.col("target")
    copies = (
        queue.withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(PASSES - 1))))
        .filter(F.col("size") > 0)
        .withColumn("_finish", finish)
        .select("_row", "size", "_finish", "_src", "_token", "doc_id", "_pass")
    )
    line = ["_finish", "_src", "_token", "doc_id", "size", "_row", "_pass"]
    num, den = BUDGET
    sorted_copies = ordered.running(ordered.spread(copies, [], line), [], line, {"_run": F.col("size")})
    budget = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("all")).first()["all"] * num
    taken = sorted_copies.filter(F.col("_run") * den <= budget).groupBy("_row").agg(F.count(F.lit(1)).alias("copies"))
    base = queue.select("_row", "doc_id", "size", "source_size", "target")
    return base.join(taken, "_row", "left").withColumn("copies", F.coalesce("copies", F.lit(0)))


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "source", n_words(F.col("text")).alias("size"))


def mix_report(docs: DataFrame) -> DataFrame:
    rows = mixed(settle(_sized(docs), "sizes"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The mixture itself: each document as often as it is taken, with all its columns."""
    own = numbered(packed(docs))
    sizes = settle(own.select("_row", "_doc.doc_id", "_doc.source", n_words(F.col("_doc.text")).alias("size")), "sizes")
    taken = mixed(sizes).filter("copies > 0").select(F.col("_row").alias("_taken"), "copies")
    out = own.join(taken, F.col("_row") == F.col("_taken"))
    repeats = F.sequence(F.lit(1), F.col("copies").cast("int"))
    return out.select("_doc", F.explode(repeats).alias("_copy")).select("_doc.*")
