"""Connected components by alternating large and small stars, all in joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertmill.session import settle


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """From links (u, v) of two longs: (node, root), root the least id reachable; nodes without links are absent.

    Edges end up as stars around the roots. A hub's edges are joined to the one
    row of its minimum, so a shuffle of a hub can be split.
    """
    edges = settle(edges.filter("u != v").select("u", "v").distinct(), "links")
    seen = _state(edges)
    while seen[0]:
        edges = settle(_small_star(_large_star(edges).distinct()).distinct(), "stars")
        now = _state(edges)
        if now == seen:
            break
        seen = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def no_labels(df: DataFrame) -> DataFrame:
    """Labels before any link is known."""
    return df.sparkSession.createDataFrame([], "node bigint, root bigint")


def extended(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, root), as ``components`` gives them, once the links (u, v) are added.

    Only the roots that a new link joins are searched, so a round costs what it
    adds and not what was found before it.
    """
    ends = [labels.select(F.col("node").alias(c), F.col("root").alias(f"_{c}")) for c in ("u", "v")]
    lifted = links.join(ends[0], "u", "left").join(ends[1], "v", "left")
    step = components(lifted.select(F.coalesce("_u", "u").alias("u"), F.coalesce("_v", "v").alias("v")))
    nodes = links.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    fresh = nodes.join(labels, "node", "left_anti").select("node", F.col("node").alias("root"))
    moved = step.select(F.col("node").alias("root"), F.col("root").alias("_to"))
    every = labels.unionByName(fresh).join(moved, "root", "left")
    return settle(every.select("node", F.coalesce("_to", "root").alias("root")), "labels")
