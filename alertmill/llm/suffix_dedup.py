"""Removing every byte of a string of ``LENGTH`` bytes that also starts elsewhere.

Cutting. The windows of ``LENGTH`` bytes of a text are cut into segments of
consecutive starts whose least ``GRAM``-byte hash is the same. Equal windows
have equal least hashes, so they are in segments of the same hash, and each
window is in one segment only. A hash that stands alone, and whose gram does not
recur in its text, cannot hold a repeat.
Segments of a shared hash are compared by their bytes (a second hash): if all
are equal, all their windows repeat and no text is looked at.

Merging. Otherwise the distinct segment texts of the hash go to a bucket of
bounded size. Its texts are dealt to shards, each shard gets its Burrows-Wheeler
transform, and the transforms are merged: the interleaving of the shards' rows
starts as one block and is refined for every two bytes, by a stable pass over the
transforms' symbols along their LF mapping. Each round leads two places to the left,
so it starts from the rows with ``LENGTH`` bytes of their text before them; no other
row ends as a window. The round in which two rows part
tells their common prefix, so rows that are in one block after ``LENGTH`` bytes
are a repeated interval. Rows alone in their block are left out of later rounds; no
suffix of the union is sorted.

A hash with more than ``GROUP`` distinct texts would outgrow a bucket. Its
windows are counted by 128-bit hash instead, by grouped sums with partial
aggregation, which is exact and bounded for any number of texts.

Row identity is the text itself (128 bits): equal texts have equal results, and
copies of a text count as occurrences.

Defined cases: a null text is empty; texts shorter than ``LENGTH`` keep all
bytes; equal texts of at least that length lose all; repeated rows are copies;
an empty table gives an empty result. Columns other than doc_id and text are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertmill.llm import words as W
from alertmill.llm.common import join_small, packed, text_key, text_or_empty
from alertmill.session import settle

LENGTH = 200
GRAM = 100
#: k-grams in a window.
SPAN = LENGTH - GRAM + 1
GROUP = 2048
BUCKET_BYTES = 1 << 20
SHARD_BYTES = 1 << 16


def _sliding(best: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """Least or greatest of each ``width`` neighbours, by doubling."""
    step = 1
    while 2 * step <= width:
        values = best(values[:-step], values[step:])
        step *= 2
    rest = width - step
    return best(values[: len(values) - rest], values[rest:]) if rest else values


def _recurring(grams: np.ndarray, least: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorted (row, value) keys of least hashes that stand at two places of a row."""
    padded = np.concatenate([np.zeros(SPAN - 1, np.uint64), least, np.zeros(SPAN - 1, np.uint64)])
    chosen = np.flatnonzero(grams == _sliding(np.maximum, padded, SPAN))
    keys = np.sort(_keys(np.searchsorted(offsets, chosen, side="right"), grams[chosen]))
    return np.unique(keys[1:][keys[1:] == keys[:-1]])


def _keys(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    return W.mix(values ^ W.mix(rows.astype(np.uint64)))


def segments(part: W.Slice) -> tuple[np.ndarray, ...]:
    """(row, start in the row, number of window starts, least hash, hash of the bytes, weight) of each segment.

    The weight is 2 where the least hash recurs in the row, so that windows may repeat inside the segment.
    """
    n = len(part.data)
    none = (np.zeros(0, np.int64),) * 6
    if n < LENGTH:
        return none
    prefix = W.byte_prefix(part.data, lower=False)
    grams = W.windows_hash(prefix, GRAM)
    least = _sliding(np.minimum, grams, SPAN)
    ends = part.offsets[:-1] + np.maximum(np.diff(part.offsets) - LENGTH + 1, 0)
    fresh = np.ones(len(least) + 1, bool)
    fresh[1:-1] = least[1:] != least[:-1]
    fresh[part.offsets[:-1][part.offsets[:-1] < len(least)]] = True
    fresh[ends[ends < len(least)]] = True
    begin = np.flatnonzero(fresh)
    begin, count = begin[:-1], np.diff(begin)
    rows = np.searchsorted(part.offsets, begin, side="right") - 1
    inside = begin < ends[rows]  # what follows a text's last window start is cut off as a run of its own
    rows, begin, count = rows[inside], begin[inside], count[inside]
    if not len(begin):
        return none
    # a repetitive text keeps one least hash for long; such runs are cut into segments of bounded length
    pieces = -(-count // SPAN)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    own, begin, count = (np.repeat(x, pieces) for x in (rows, begin, count))
    begin, count = begin + nth * SPAN, np.minimum(count - nth * SPAN, SPAN)
    value = least[begin]
    body = W.spans_hash(prefix, begin, begin + count + LENGTH - 1)
    twice = _recurring(grams, least, part.offsets)
    mine = _keys(own + 1, value)
    again = np.zeros(len(begin), bool)
    if len(twice):
        again = twice[np.minimum(np.searchsorted(twice, mine), len(twice) - 1)] == mine
    return own, begin - part.offsets[:-1][own], count, value.view(np.int64), W.mix(body).view(np.int64), 1 + again


_SEGMENT = "h bigint, c bigint, ka bigint, kb bigint, start int, starts int, weight int"


def _segment_rows(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ka, kb = (batch.column(i).to_numpy() for i in (0, 1))
            for part in W.slices(batch.column(2)):
                rows, start, count, h, c, weight = segments(part)
                own = rows + part.first
                columns = [h, c, ka[own], kb[own], *(x.astype(np.int32) for x in (start, count, weight))]
                names = ["h", "c", "ka", "kb", "start", "starts", "weight"]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=names)

    keyed = docs.select(text_key("text").alias("k"), text_or_empty("text").alias("text"))
    return keyed.filter(F.octet_length("text") >= LENGTH).select("k.a", "k.b", "text").mapInArrow(run, _SEGMENT)


# --- Burrows-Wheeler transforms of shards and their merge


def _following(values: np.ndarray, left: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The value ``width`` after each place ``at``, 0 beyond the end of the text."""
    return np.where(left.take(at) > width, values.take(at + width, mode="clip"), 0)


def _refined(rank: np.ndarray, tied: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Rank whole blocks of suffixes, ``tied``, by ``key``, which orders by their old rank first.

    A rank is the number of suffixes in lower blocks. Changes ``rank``; returns the suffixes that still tie.
    """
    turn = np.argsort(key)
    tied, key = tied.take(turn), key.take(turn)
    old, at = rank.take(tied), np.arange(len(tied))
    new, block = np.ones((2, len(tied)), bool)
    new[1:], block[1:] = key[1:] != key[:-1], old[1:] != old[:-1]
    rank[tied] = old + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(block, at, 0))
    return tied[~(new & np.append(new[1:], True))]


def transform(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the shard's suffixes in order of their first ``LENGTH`` bytes.

    Returns per row: the symbol before the suffix (-1 at a text's start), the
    row of the suffix that begins with that symbol (LF, -1 at a start), the
    text and the place in it. Every text is followed by its empty suffix.
    """
    sizes = np.array([len(t) + 1 for t in texts])
    owner = np.repeat(np.arange(len(texts)), sizes)
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(owner)) - first[owner]
    symbols = np.zeros(len(owner), np.int64)
    symbols[place < sizes[owner] - 1] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
    left = sizes[owner] - place
    every = np.arange(len(symbols))
    # the first symbols as one number, in a base as small as the shard's alphabet
    used = np.bincount(symbols, minlength=257) > 0
    used[0] = False
    key, base, width = np.cumsum(used)[symbols], int(used.sum()) + 1, 1
    while width < LENGTH and base ** (2 * width) < 1 << 63:
        key, width = key * base**width + _following(key, left, every, width), 2 * width
    rank = np.zeros(len(symbols), np.int64)
    tied = _refined(rank, every, key)
    while width < LENGTH and len(tied):
        # only suffixes that still tie are sorted again, by the rank of what follows
        key = rank.take(tied) * (len(rank) + 1) + _following(rank + 1, left, tied, width)
        tied, width = _refined(rank, tied, key), 2 * width
    _refined(rank, tied, rank.take(tied) * len(rank) + tied)  # equal suffixes in their order in the shard
    order = np.empty(len(rank), np.int64)
    order[rank] = every
    before = np.where(place[order] > 0, symbols[order - 1] - 1, -1)
    return before, np.where(place[order] > 0, rank[order - 1], -1), owner[order], place[order]


def merged_repeats(shards: list[list[bytes]]) -> list[tuple[int, np.ndarray]]:
    """(text number over all shards, places) of the ``LENGTH``-byte strings that stand at two places or more."""
    parts = [transform(s) for s in shards if s]
    rows = np.cumsum([0] + [len(p[0]) for p in parts])
    texts = np.cumsum([0] + [len(s) for s in shards if s])
    symbol = np.concatenate([p[0] for p in parts])
    lf = np.concatenate([np.where(p[1] >= 0, p[1] + rows[i], -1) for i, p in enumerate(parts)])
    owner = np.concatenate([p[2] + texts[i] for i, p in enumerate(parts)])
    place = np.concatenate([p[3] for p in parts])
    # two symbols at a time: along LF twice, with the pair of symbols passed in the low bits
    back = np.where(lf >= 0, lf.take(lf, mode="clip"), 0)
    step = back << 16 | (symbol.take(lf, mode="clip") & 255) << 8 | symbol & 255
    # a round goes two places to the left, so only rows with LENGTH bytes before them become a window
    inter = np.flatnonzero(place >= LENGTH)
    block = np.zeros(len(inter), np.int32)
    for _ in range(LENGTH // 2):
        passed = step.take(inter)
        turn = np.argsort(passed.astype(np.uint16), kind="stable")
        passed, block = passed.take(turn), block.take(turn)
        inter, pair = passed >> 16, passed.astype(np.uint16)
        new = np.ones(len(inter), bool)
        new[1:] = (pair[1:] != pair[:-1]) | (block[1:] != block[:-1])
        # a row whose neighbours are in other blocks is alone: its common prefix is known
        kept = np.flatnonzero(~(new & np.append(new[1:], True)))
        inter, block = inter.take(kept), np.cumsum(new, dtype=np.int32).take(kept)
        if not len(inter):
            return []
    found = np.lexsort((place[inter], owner[inter]))
    who, where = owner[inter][found], place[inter][found]
    cuts = np.flatnonzero(np.diff(who)) + 1
    return list(zip(who[np.append(0, cuts)].tolist(), np.split(where, cuts)))


_COVER = "h bigint, c bigint, ranges array<struct<s: int, e: int>>"


def _merge_bucket(table: pa.Table) -> pa.Table:
    """Byte ranges of each text that are covered by its repeated windows."""
    shards: list[list[bytes]] = [[]]
    size = 0
    for b in table["body"].to_pylist():
        if size > SHARD_BYTES:
            shards.append([])
            size = 0
        shards[-1].append(b)
        size += len(b)
    found = merged_repeats(shards)
    # the ranges of all texts at once: one begins with a text's first place and after a gap
    first = np.cumsum([0] + [len(places) for _, places in found])
    where = np.concatenate([np.zeros(0, np.int64), *(places for _, places in found)])
    fresh = np.append(True, np.diff(where) > LENGTH)[: len(where)]
    fresh[first[:-1]] = True
    cuts = np.append(np.flatnonzero(fresh), len(where))
    span = [where[cuts[:-1]], where[cuts[1:] - 1] + LENGTH]
    ranges = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in span], names=["s", "e"])
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(cuts, first).astype(np.int32)), ranges)
    return table.select(["h", "c"]).take(pa.array([i for i, _ in found], pa.int64())).append_column("ranges", lists)


def _bodies(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, c, body) of the segments in ``wanted`` (one row per (h, c), with ka, kb, start, starts)."""
    lists = wanted.groupBy("ka", "kb").agg(F.collect_list(F.struct("h", "c", "start", "starts")).alias("cuts"))
    keyed = docs.select(text_key("text").alias("k"), text_or_empty("text").alias("text"))
    both = join_small(keyed, lists, (F.col("k.a") == F.col("ka")) & (F.col("k.b") == F.col("kb")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                key = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                if key in seen:
                    continue
                seen.add(key)
                text = batch.column(2)[i].as_py().encode()
                for cut in batch.column(3)[i].as_py():
                    rows.append((cut["h"], cut["c"], text[cut["start"] : cut["start"] + cut["starts"] + LENGTH - 1]))
            columns = [[r[j] for r in rows] for j in range(3)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], names=["h", "c", "body"]
            )

    found = both.select("ka", "kb", "text", "cuts").mapInArrow(run, "h bigint, c bigint, body binary")
    return found.dropDuplicates(["h", "c"])  # copies of a text in other tasks


def _counted(bodies: DataFrame, weights: DataFrame) -> DataFrame:
    """Ranges of segments of crowded hashes, by counting their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, c, body in zip(*(x.to_pylist() for x in batch.columns)):
                data = np.frombuffer(body, np.uint8)
                at = np.arange(len(data) - LENGTH + 1)
                one = W.spans_hash(W.byte_prefix(data, lower=False), at, at + LENGTH)
                two = W.spans_hash(W.byte_prefix(data ^ np.uint8(0x5A), lower=False), at, at + LENGTH)
                columns = [np.full(len(at), h), np.full(len(at), c), at, one.view(np.int64), two.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["h", "c", "at", "wa", "wb"])

    windows = bodies.mapInArrow(run, "h bigint, c bigint, at bigint, wa bigint, wb bigint").join(weights, ["h", "c"])
    often = windows.groupBy("wa", "wb").agg(F.sum("n").alias("times")).filter("times > 1").select("wa", "wb")
    hits = windows.join(often, ["wa", "wb"]).groupBy("h", "c").agg(F.collect_set("at").alias("places"))
    return hits.select("h", "c", F.expr(f"transform(places, p -> struct(cast(p as int) as s, cast(p + {LENGTH} as int) as e)) AS ranges"))


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(ka, kb, ranges): for each text with repeats, byte ranges (may overlap) that are covered."""
    # one shuffle: segments are weighed where those of a hash meet
    weighed = _segment_rows(docs).withColumn("df", F.sum("weight").over(Window.partitionBy("h")))
    found = settle(weighed.filter("df > 1").drop("df"), "segments")
    bodies = found.groupBy("h", "c").agg(
        F.count(F.lit(1)).alias("n"), F.max("weight").alias("weight"), F.min(F.struct("ka", "kb", "start", "starts")).alias("one")
    )
    bodies = settle(bodies, "bodies")
    groups = bodies.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.max("weight").alias("w")).filter("m > 1 OR w > 1")
    several = settle(bodies.join(groups, "h").select("h", "c", "n", "m", "one.*"), "several")
    total = several.filter(F.col("m") <= GROUP).agg(F.sum(F.col("starts") + LENGTH)).first()[0] or 0
    texts = _bodies(docs, several.filter(F.col("m") <= GROUP))
    buckets = F.pmod("h", F.lit(max(1, -(-total // BUCKET_BYTES)))).alias("bucket")
    merged = texts.select(buckets, "h", "c", "body").groupBy("bucket").applyInArrow(_merge_bucket, _COVER)
    crowded = several.filter(F.col("m") > GROUP)
    if crowded.limit(1).count():
        merged = merged.unionByName(_counted(_bodies(docs, crowded), crowded.select("h", "c", "n")))
    whole = bodies.filter("n > 1").select(
        "h", "c", F.array(F.struct(F.lit(0).alias("s"), (F.col("one.starts") + LENGTH - 1).cast("int").alias("e"))).alias("ranges")
    )
    merged = merged.join(whole.select("h", "c"), ["h", "c"], "left_anti")
    cover = settle(whole.unionByName(merged), "cover")
    spans = found.select("h", "c", "ka", "kb", "start").distinct().join(cover, ["h", "c"]).select("ka", "kb", "start", F.explode("ranges").alias("r"))
    moved = spans.select("ka", "kb", F.struct((F.col("start") + F.col("r.s")).alias("s"), (F.col("start") + F.col("r.e")).alias("e")).alias("r"))
    return settle(moved.groupBy("ka", "kb").agg(F.collect_set("r").alias("ranges")), "ranges")


def _kept(text: str | None, ranges: list[dict] | None) -> tuple[bytes, int, int]:
    """The bytes that stay, how many go, and in how many runs."""
    data = (text or "").encode()
    if not ranges:
        return data, 0, 0
    edge = np.zeros(len(data) + 1, np.int64)
    np.add.at(edge, [r["s"] for r in ranges], 1)
    np.add.at(edge, [r["e"] for r in ranges], -1)
    gone = np.cumsum(edge[:-1]) > 0
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum())


def _digests(text: Column, ranges: Column) -> Column:
    @F.arrow_udf("struct<n_bytes: bigint, n_removed: bigint, n_spans: bigint, kept_sha256: string>")
    def digest(texts: pa.Array, lists: pa.Array) -> pa.Array:
        rows = []
        for text, own in zip(texts, lists):
            kept, removed, spans = _kept(text.as_py(), own.as_py())
            rows.append((len(kept) + removed, removed, spans, hashlib.sha256(kept).hexdigest()))
        columns = [pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
        return pa.StructArray.from_arrays(columns, names=["n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return digest(text, ranges)


def _with_ranges(docs: DataFrame) -> DataFrame:
    own = packed(docs).withColumn("_own", text_key("_doc.text"))
    found = repeated_ranges(docs.select("text"))
    return join_small(own, found, (F.col("_own.a") == F.col("ka")) & (F.col("_own.b") == F.col("kb")), "left")


def repeat_report(docs: DataFrame) -> DataFrame:
    rows = _with_ranges(docs.select("doc_id", "text"))
    return rows.select("_doc.doc_id", _digests(F.col("_doc.text"), F.col("ranges")).alias("d")).select("doc_id", "d.*")


def without_repeats(docs: DataFrame) -> DataFrame:
    """All documents; ``kept_bytes`` holds the bytes of ``text`` that stay (a cut may fall inside a character)."""

    @F.arrow_udf("binary")
    def kept(texts: pa.Array, lists: pa.Array) -> pa.Array:
        return pa.array([_kept(t.as_py(), r.as_py())[0] for t, r in zip(texts, lists)], pa.binary())

    return _with_ranges(docs).select("_doc.*", kept("_doc.text", "ranges").alias("kept_bytes"))
