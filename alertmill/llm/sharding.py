"""Packing indivisible groups into shards by best fit decreasing.

Documents with equal texts are one group. A group of more than 1/``FINE`` of
an even shard is an item of its own; there are at most ``FINE`` times as many
as shards. The smaller ones are bundled by hash into ``FINE`` bundles per
shard, so the driver packs a number of items that depends on the shards only.

Items enter, largest first, the bin with the least remaining capacity that
still holds them; remaining capacities stand in a balanced tree. ``pack``
opens bins as needed for a given capacity; ``even_pack`` searches the smallest
capacity that needs no more than the given bins, after groups larger than an
even share of what is left got bins of their own.

Slots number the rows of a shard by doc_id over range partitions, so neither a
shard nor a group meets in one task.

Defined cases: a null text has no bytes and is grouped with the empty text;
null doc_ids come first; repeated rows get slots of their own; an empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertmill.llm.common import text_key, text_or_empty
from alertmill.operators import ordered
from alertmill.session import settle

SHARDS = 24
FINE = 256
OVERHEAD = 8
_SEARCH_STEPS = 40


class FreeSpace:
    """Remaining capacities as a treap of (free, bin): add and take the tightest fit in logarithmic time."""

    def __init__(self) -> None:
        self._root: list | None = None
        self._state = 0x2545F491

    def _priority(self) -> int:
        self._state = (self._state * 1_103_515_245 + 12_345) & 0x7FFFFFFF
        return self._state

    @classmethod
    def _split(cls, node, key):
        """Nodes below ``key`` and the rest. A node is [key, priority, left, right]."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = cls._split(node[3], key)
            node[3] = low
            return node, high
        low, high = cls._split(node[2], key)
        node[2] = high
        return low, node

    @classmethod
    def _join(cls, low, high):
        if low is None or high is None:
            return low or high
        if low[1] > high[1]:
            low[3] = cls._join(low[3], high)
            return low
        high[2] = cls._join(low, high[2])
        return high

    def add(self, free: int, number: int) -> None:
        low, high = self._split(self._root, (free, number))
        self._root = self._join(self._join(low, [(free, number), self._priority(), None, None]), high)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least free space of at least ``size``."""
        low, high = self._split(self._root, (size, -1))
        if high is None:
            self._root = low
            return None
        parent, node = None, high
        while node[2] is not None:
            parent, node = node, node[2]
        if parent is None:
            high = node[3]
        else:
            parent[2] = node[3]
        self._root = self._join(low, high)
        return node[0]


def pack(sizes: Sequence[int], capacity: int, at_most: int | None = None) -> list[int] | None:
    """A bin number per item by best fit decreasing; None if more than ``at_most`` bins are needed."""
    bins, space = [0] * len(sizes), FreeSpace()
    opened = 0
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        if sizes[i] > capacity:
            raise ValueError("an item exceeds the capacity of a shard")
        found = space.take(sizes[i])
        if found is None:
            if opened == at_most:
                return None
            found, opened = (capacity, opened), opened + 1
        bins[i] = found[1]
        space.add(found[0] - sizes[i], found[1])
    return bins


def even_pack(sizes: Sequence[int], shards: int) -> list[int]:
    """A shard per item so that the fullest shard is as small as best fit decreasing can make it."""
    order = sorted(range(len(sizes)), key=lambda k: (-sizes[k], k))
    left, alone = sum(sizes), 0
    while alone < min(shards - 1, len(order)) and sizes[order[alone]] * (shards - alone) > left:
        left -= sizes[order[alone]]
        alone += 1
    out = [0] * len(sizes)
    for shard, i in enumerate(order[:alone]):
        out[i] = shard
    rest = order[alone:]
    if not rest:
        return out
    values, bins = [sizes[i] for i in rest], shards - alone
    low = max(max(values), -(-left // bins))
    high, best = low, None
    while best is None:
        best = pack(values, high, bins)
        if best is None:
            low, high = high + 1, high + max(1, high // 64)
    for _ in range(_SEARCH_STEPS):
        if low >= high:
            break
        middle = (low + high) // 2
        found = pack(values, middle, bins)
        if found is None:
            low = middle + 1
        else:
            best, high = found, middle
    for i, b in zip(rest, best, strict=True):
        out[i] = alone + b
    return out


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per row: doc_id, size, text_crc32, shard and slot."""
    text = text_or_empty("text")
    slim = docs.select(
        "doc_id",
        (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        text_key("text").alias("_key"),
    )
    slim = settle(slim.withColumn("_bundle", F.pmod(F.col("_key.a"), F.lit(shards * FINE)).cast("int")), "sizes")
    groups = settle(slim.groupBy("_key", "_bundle").agg(F.sum("size").alias("bytes")), "groups")
    whole = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()["b"]
    large = F.col("bytes") * (shards * FINE) > whole
    heavy = groups.filter(large).select("_key", "bytes").collect()  # fewer than shards * FINE by definition
    light = groups.filter(~large).groupBy("_bundle").agg(F.sum("bytes").alias("bytes")).collect()  # as many at most
    heavy.sort(key=lambda r: (-r["bytes"], r["_key"]["a"], r["_key"]["b"]))
    light.sort(key=lambda r: (-r["bytes"], r["_bundle"]))
    placed = even_pack([r["bytes"] for r in heavy + light], shards)
    spark = docs.sparkSession
    of_key = spark.createDataFrame(
        [(r["_key"]["a"], r["_key"]["b"], s) for r, s in zip(heavy, placed)], "a bigint, b bigint, _own int"
    )
    of_bundle = spark.createDataFrame(
        [(r["_bundle"], s) for r, s in zip(light, placed[len(heavy) :])], "_of int, _shared int"
    )
    out = slim.join(F.broadcast(of_key), (F.col("_key.a") == F.col("a")) & (F.col("_key.b") == F.col("b")), "left")
    out = out.join(F.broadcast(of_bundle), F.col("_bundle") == F.col("_of"), "left")
    out = out.select("doc_id", "size", "text_crc32", F.col("_key.a").alias("_tie"), F.coalesce("_own", "_shared").alias("shard"))
    ranked = ordered.ranked(out, ["shard"], ["doc_id", "_tie"])
    return ranked.select("doc_id", "size", "text_crc32", "shard", (F.col("_rank") - 1).cast("bigint").alias("slot"))


def shard_report(docs: DataFrame) -> DataFrame:
    return sharded(docs).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
