"""Benchmark decontamination: a broadcast hash set of test n-grams against all training windows.

Words are ``TOKEN`` runs after A-Z are lower-cased. An item's windows are its
runs of ``N_WORDS`` words; an item with fewer, but not none, is one window.
Every position of every document is hashed (its next ``N_WORDS`` words, and as
many as each shorter item has), looked up in the set, and a hit is verified
word by word. All of it is DataFrame expressions inside one generated stage.

The set is counted first and broadcast in blocks of at most ``BLOCK_WINDOWS``
windows, so its size on an executor is bounded whatever the benchmark holds.

Defined cases: a null or empty text has no words, hits nothing and is clean; a
null item has no window; repeated documents are judged each on its own, equal
items both count; columns other than doc_id, text and item_id are not read,
except that the functions which return documents keep all of theirs.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertmill.llm.common import join_small, packed, text_key
from alertmill.session import settle

N_WORDS = 13
#: A document is contaminated if one word in so many, or more, is hit.
SHARE = 20
BLOCK_WINDOWS = 500_000
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_END = -1


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does this, and faster, where there is nothing but ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATOR), lambda w: w != "")


def _digest(ws: Column, at: Column, n: int) -> Column:
    return F.xxhash64(F.lit(n), *[F.get(ws, at + k) for k in range(n)])


def item_windows(benchmark: DataFrame) -> DataFrame:
    """One row per distinct window: h, n, gram, items (as strings)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("ws"))
    items = items.filter(F.size("ws") > 0).withColumn("n", F.least(F.size("ws"), F.lit(N_WORDS)))
    grams = items.select("item", "n", F.explode(F.expr("transform(sequence(1, size(ws) - n + 1), i -> slice(ws, i, n))")).alias("gram"))
    keyed = grams.groupBy("n", "gram").agg(F.sort_array(F.collect_set("item")).alias("items"))
    digest = F.lit(None).cast("bigint")
    for n in range(1, N_WORDS + 1):
        digest = F.when(F.col("n") == n, _digest(F.col("gram"), F.lit(0), n)).otherwise(digest)
    return keyed.select(digest.alias("h"), "n", "gram", "items")


def _scan(docs: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """Verified hits, and one row at the end of each document (n null), by a lookup in the broadcast set."""
    at = docs.select("*", F.explode(F.sequence(F.lit(0), F.size("_ws"))).alias("_at"))
    ws, end = F.col("_ws"), F.col("_at") == F.size("_ws")
    keys = [F.when(end, F.lit(_END) if n == lengths[0] else F.lit(None)).otherwise(_digest(ws, F.col("_at"), n)) for n in lengths]
    keyed = at.withColumn("_h", keys[0] if len(keys) == 1 else F.explode(F.array(*keys)))
    ends = docs.sparkSession.range(1).select(
        F.lit(_END).cast("bigint").alias("h"),
        F.lit(None).cast("int").alias("n"),
        F.lit(None).cast("array<string>").alias("gram"),
        F.lit(None).cast("array<string>").alias("items"),
    )
    known = F.broadcast(windows.unionByName(ends))
    same = F.col("n").isNotNull() & (F.slice("_ws", F.col("_at") + 1, F.col("n")) == F.col("gram"))
    joined = keyed.join(known, F.col("_h") == F.col("h"))
    return joined.filter((end & F.col("n").isNull()) | (~end & same))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, _key (of its text), n_words, hit (word positions), items (sorted ids)."""
    windows = settle(item_windows(benchmark), "windows")
    sizes = windows.groupBy("n").count().collect()  # at most N_WORDS rows
    lengths = sorted((r["n"] for r in sizes), reverse=True) or [N_WORDS]
    blocks = max(1, -(-sum(r["count"] for r in sizes) // BLOCK_WINDOWS))
    rows = docs.select("doc_id", text_key("text").alias("_key"), F.monotonically_increasing_id().alias("_row"), words(F.col("text")).alias("_ws"))
    scans = [_scan(rows, windows.filter(F.pmod("h", F.lit(blocks)) == b), lengths) for b in range(blocks)]
    found = functools.reduce(DataFrame.unionByName, scans)
    per_row = found.groupBy("_row", "_key", "doc_id", F.size("_ws").alias("n_words")).agg(
        F.collect_set(F.when(F.col("n").isNotNull(), F.struct("_at", "n"))).alias("runs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    covered = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["_at"], r["_at"] + r["n"] - 1))))
    return per_row.select("doc_id", "_key", F.col("n_words").cast("bigint").alias("n_words"), covered.alias("hit"), "items")


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (n_hit * SHARE >= n_words)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    n_hit = F.size("hit").cast("bigint")
    return contamination(docs, benchmark).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        is_contaminated(n_hit, F.col("n_words")).alias("contaminated"),
    )


def _matched(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    return join_small(packed(docs).withColumn("_own", text_key("_doc.text")), found, F.col("_own") == F.col("_key"), how)


def without_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with all their columns. The verdict depends on the text alone."""
    bad = contamination(docs, benchmark).filter(is_contaminated(F.size("hit"), F.col("n_words"))).select("_key").distinct()
    bad = settle(bad, "contaminated")  # counted and joined, but scanned for once
    return _matched(docs, bad, "left_anti").select("_doc.*")


def without_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All documents; hit words are cut from ``text`` together with the separators behind them."""
    found = contamination(docs, benchmark).filter(F.size("hit") > 0).select("_key", "hit").dropDuplicates(["_key"])
    found = settle(found, "hits")
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    gap = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
    text = F.col("_doc.text")
    pieces = F.regexp_extract_all(text, F.lit(f"({word}{gap})"), F.lit(1))
    kept = F.filter(pieces, lambda p, i: ~F.array_contains(F.col("hit"), i))
    rest = F.concat(F.regexp_extract(text, f"^({gap})", 1), F.array_join(kept, ""))
    out = _matched(docs, found, "left")
    return out.select(F.col("_doc").withField("text", F.when(F.col("hit").isNull(), text).otherwise(rest)).alias("_doc")).select("_doc.*")
