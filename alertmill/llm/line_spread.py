"""Removing lines that many sites share.

A line (between newlines, with a word in it) on ``SITES`` or more distinct
sites is boilerplate and is cut from every document. A line cannot be on more
sites than it has occurrences, so lines with fewer occurrences than ``SITES``
need no sketch. For the others a HyperLogLog sketch of the sites is merged by
aggregation; where the estimate is within ``SIGMAS`` standard errors (and one
site) of the threshold, the distinct sites are counted exactly. Sketches and
exact counts are grouped sums with partial aggregation, so a line that a third
of all documents hold reaches its task as one row per map task.

Defined cases: a null or empty text has no line; a null site is no site; lines
of spaces are never boilerplate and stay; repeated rows and repeated lines are
cut alike; an empty table gives an empty result. Columns other than those named
are not read, and ``without_boilerplate`` keeps all. No Python runs on the
executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertmill.llm.common import join_small, packed, text_key, text_or_empty
from alertmill.session import settle

SITES = 10
LOG_REGISTERS = 12
SIGMAS = 6
_WORD = r"[^\x20\x09-\x0D]"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _hashes(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("ha"), F.xxhash64(F.lit(1), line).alias("hb")]


def boilerplate(docs: DataFrame, site: str, sites: int = SITES) -> DataFrame:
    """Hashes (ha, hb) of the lines on ``sites`` or more distinct sites."""
    lines = docs.select(F.col(f"`{site}`").alias("site"), F.explode(_lines(text_or_empty("text"))).alias("line"))
    lines = lines.filter(F.col("line").rlike(_WORD)).select("site", *_hashes(F.col("line")))
    often = lines.groupBy("ha", "hb").agg(F.count("site").alias("n")).filter(F.col("n") >= sites)
    often = settle(often.select(F.col("ha").alias("oa"), F.col("hb").alias("ob")), "often")
    mine = join_small(lines, often, (F.col("ha") == F.col("oa")) & (F.col("hb") == F.col("ob"))).select("ha", "hb", "site")
    spread = mine.groupBy("ha", "hb").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LOG_REGISTERS))).alias("about"))
    spread = settle(spread, "spread")
    margin = 1 + math.ceil(sites * SIGMAS * 1.04 / math.sqrt(2**LOG_REGISTERS))
    sure = spread.filter(F.col("about") > sites + margin).select("ha", "hb")
    close = spread.filter(F.abs(F.col("about") - sites) <= margin).select(F.col("ha").alias("oa"), F.col("hb").alias("ob"))
    counted = join_small(mine, close, (F.col("ha") == F.col("oa")) & (F.col("hb") == F.col("ob")))
    exact = counted.groupBy("ha", "hb").agg(F.countDistinct("site").alias("n")).filter(F.col("n") >= sites)
    return settle(sure.unionByName(exact.select("ha", "hb")), "boilerplate")


def _removed(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Per distinct text with boilerplate: _key and the places of the lines to cut."""
    text = text_or_empty("text")
    lines = docs.select(text_key("text").alias("_key"), F.posexplode(_lines(text)).alias("place", "line"))
    lines = lines.select("_key", "place", *_hashes(F.col("line")))
    known = known.select(F.col("ha").alias("oa"), F.col("hb").alias("ob"))
    hits = join_small(lines, known, (F.col("ha") == F.col("oa")) & (F.col("hb") == F.col("ob")))
    return settle(hits.groupBy("_key").agg(F.collect_set("place").alias("_cut")), "removed")


def _with_cut(docs: DataFrame, site: str, sites: int) -> DataFrame:
    own = packed(docs).withColumn("_own", text_key("_doc.text"))
    return join_small(own, _removed(docs, boilerplate(docs, site, sites)), F.col("_own") == F.col("_key"), "left")


def _kept() -> Column:
    kept = F.filter(_lines(F.col("_doc.text")), lambda line, place: ~F.array_contains(F.col("_cut"), place))
    return F.when(F.col("_cut").isNull(), F.col("_doc.text")).otherwise(F.array_join(kept, "\n"))


def without_boilerplate(docs: DataFrame, site: str = "source", sites: int = SITES) -> DataFrame:
    """All documents with their columns; boilerplate lines are cut from ``text``."""
    return _with_cut(docs, site, sites).select(F.col("_doc").withField("text", _kept()).alias("_doc")).select("_doc.*")


def line_report(docs: DataFrame, site: str = "source", sites: int = SITES) -> DataFrame:
    slim = docs.select("doc_id", F.col(f"`{site}`").alias("site"), text_or_empty("text").alias("text"))
    own = _with_cut(slim, "site", sites)
    return own.select(
        "_doc.doc_id",
        F.size(F.filter(_lines(F.col("_doc.text")), lambda line: line.rlike(_WORD))).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("_cut"), F.lit(0)).cast("bigint").alias("n_removed"),
        F.sha2(_kept(), 256).alias("kept_sha256"),
    )
