"""Near copies by fast similarity sketches, banding and exact verification.

A document is its set of distinct shingles of ``Rule.k`` words. Its sketch has
``COORDINATES`` bins. In round i every shingle is thrown into a hashed bin with
a hashed value; a bin keeps i plus the least value of the first round that hits
it. From round ``COORDINATES`` on, round i throws all shingles into one fixed
bin, so every bin is full after twice as many rounds; a set whose bins are full
takes no part in later ones. Two sets agree in a bin with the probability of
their similarity, and the number of agreements is concentrated around its mean
as if the bins were independent. Long sets fill in a few rounds, so the cost is
about that of hashing each shingle a few times, not ``COORDINATES`` times.

Banding. ``BANDS`` bands of ``ROWS`` bins: classes (documents of equal sets are
one) that agree in a whole band are in one bucket. A pair at 0.85 has no common
bucket with a probability of 7e-9, at 0.8 of 3e-6.

Buckets without all pairs. Every bucket that holds more than one component names
a pivot, that of its classes that meets most others (in a group of edited copies
this is the common original). The pivot is compared with the bucket's members of
other components and leaves the bucket; links merge components, and a bucket
that has become one component costs nothing more. This is repeated while one
pair in ``PRODUCTIVE`` is a link. What then still meets another component, groups
of copies just below the threshold among it, is not compared pair by pair: these
classes go through the exact lists of rare shingles of ``ngram_join``. Links are
confirmed on whole sets in both.

Defined cases: a null or empty text, or one of spaces, has no shingle and stands
alone; fewer than ``k`` words are one shingle; repeated rows are in one class;
null doc_ids are ignored when a component is named, and one that has no other
keeps all of its rows under a null name; an empty table gives an empty result.
Columns other than doc_id and text are not read, but ``without_copies`` returns
all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from alertmill.llm import words as W
from alertmill.llm.common import drop_settled, packed, rows_of
from alertmill.llm.components import extended, no_labels
from alertmill.llm.ngram_join import Rule, by_pivots, postings, sets, verified
from alertmill.session import scratch_path, settle

BANDS, ROWS = 32, 5
COORDINATES = BANDS * ROWS
#: Pivots go on while one pair in so many, or more, is a link.
PRODUCTIVE = 20
#: Sets sketched at a time.
CHUNK_SETS = 4096
REPORT = Rule(3, 17, 20)
STAGE = Rule(5, 4, 5)
_VALUE_BITS = np.uint64(48)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def sketches(runs: np.ndarray, bounds: np.ndarray, bins: int = COORDINATES) -> np.ndarray:
    """Sets by bins; equal entries of a bin stand for the same shingle. An empty set has all bins empty."""
    sets_ = len(bounds) - 1
    out = np.full(sets_ * bins, _EMPTY)
    owner, element = W.row_of(bounds), runs
    for i in range(2 * bins):
        if not len(element):
            break
        h = W.mix(element ^ W.mix(np.array([i + 1], np.uint64)))
        place = (h >> _VALUE_BITS).astype(np.int64) % bins if i < bins else i - bins
        slot = owner * bins + place
        value = (h & np.uint64((1 << 48) - 1)) | (np.uint64(i) << _VALUE_BITS)
        fresh = out[slot] == _EMPTY  # full bins hold values of earlier rounds, which are lower
        np.minimum.at(out, slot[fresh], value[fresh])
        full = (out.reshape(sets_, bins) != _EMPTY).all(axis=1)
        going = ~full[owner]
        if not going.all():
            owner, element = owner[going], element[going]
    return out.reshape(sets_, bins)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """Sets by bands: a hash of the band's number and bins."""
    cut = sketch.reshape(len(sketch), BANDS, -1)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), cut.shape[:2])
    for j in range(cut.shape[2]):
        key = W.mix(key ^ W.mix(cut[:, :, j] + np.uint64(j + 1)))
    return key.view(np.int64)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums per set, modulo 2^64."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return (total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)


def sketch(text: Column, k: int) -> Column:
    """n and two sums of mixed hashes, equal for equal sets, and the keys of the set's bands."""

    @F.arrow_udf("struct<n: bigint, a: bigint, b: bigint, keys: array<bigint>>")
    def run(texts: pa.Array) -> pa.Array:
        found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3 + (np.zeros((0, BANDS), np.int64),)]
        for part in W.slices(texts):
            runs, bounds = sets(part, k)
            for low in range(0, part.rows, CHUNK_SETS):
                own = bounds[low : low + CHUNK_SETS + 1]
                mine, own = runs[own[0] : own[-1]], own - own[0]
                keys = band_keys(sketches(mine, own))
                found.append((np.diff(own), _sums(W.mix(mine ^ np.uint64(11)), own), _sums(W.mix(mine ^ np.uint64(23)), own), keys))
        n, a, b, keys = (np.concatenate(c) for c in zip(*found))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * BANDS, pa.int32()), pa.array(keys.ravel()))
        return pa.StructArray.from_arrays([*(pa.array(x.astype(np.int64)) for x in (n, a, b)), lists], names=["n", "a", "b", "keys"])

    return run(text)


def buckets(classes: DataFrame) -> DataFrame:
    """(key, cid, n, met): the classes of every bucket with several, ``met`` the members of all buckets of a class."""
    # one shuffle: a bucket is counted where its rows meet, and most hold one class and end there
    rows = classes.select("cid", F.explode("keys").alias("key"))
    several = rows.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter("c > 1")
    several = settle(several, "buckets")
    met = several.groupBy("cid").agg(F.sum("c").alias("met"))
    sizes = met.join(classes.select("cid", "n"), "cid")
    return settle(several.join(sizes, "cid").select("key", "cid", "n", "met"), "buckets")


def linked(own: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """(node, root) of all classes that have a link; ``own`` has (_row, text) of the classes."""
    labels = no_labels(own)
    entries = buckets(classes)
    texts = settle(rows_of(own, entries.select("cid").distinct()), "texts")
    productive = True
    while True:
        rooted = entries.join(labels, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid"))
        mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
        rows = settle(rooted.join(mixed, "key").select("key", "cid", "n", "met", "root"), "open")
        drop_settled(entries)
        if not productive or rows.isEmpty():
            break
        heads = rows.groupBy("key").agg(F.max(F.struct("met", "cid", "n", "root")).alias("p"))
        near = F.least("n", "p.n") * rule.den >= F.greatest("n", "p.n") * rule.num
        stars = rows.join(heads, "key")
        pairs = stars.filter((F.col("root") != F.col("p.root")) & near).select(F.col("p.cid").alias("pivot"), "cid").distinct()
        pairs = settle(pairs, "pairs")
        links = settle(verified(pairs, texts, rule), "links")
        new = links.count()
        labels = extended(labels, links) if new else labels
        entries = settle(stars.filter(F.col("cid") != F.col("p.cid")).select("key", "cid", "n", "met"), "buckets")
        productive = new * PRODUCTIVE >= pairs.count()
    left = settle(rows.select("cid").distinct(), "left")
    if left.isEmpty():
        return labels
    texts = settle(rows_of(texts, left), "texts")
    whole = F.array(F.col("n"), *[F.lit(0).cast("bigint")] * 3)
    lists = postings(texts, classes.join(left, "cid", "left_semi").withColumn("brings", whole), rule, whole=True)
    return by_pivots(settle(lists, "postings"), texts, labels, rule, last=True)[0]


def grouped(docs: DataFrame, rule: Rule) -> DataFrame:
    """Per row: _row, _doc (all columns), doc_id, n_shingles, component (a number of the group). Rows are written once."""
    rows = packed(docs).select("_doc", F.monotonically_increasing_id().alias("_row"), sketch(F.col("_doc.text"), rule.k).alias("s"))
    path = scratch_path(docs.sparkSession, "sketched")
    rows.write.option("compression", "zstd").parquet(path)  # holds whole texts, so the denser codec
    own = docs.sparkSession.read.schema(rows.schema).parquet(path)
    key = [F.col(f"s.{c}").alias(c) for c in "nab"]
    classes = own.filter("s.n > 0").groupBy(*key).agg(F.min("_row").alias("cid"))
    classes = settle(classes, "classes")
    keys = own.select(F.col("_row").alias("cid"), F.col("s.keys").alias("keys"))
    labels = linked(own.select("_row", "_doc.text"), classes.join(keys, "cid"), rule)
    of_class = classes.join(labels, F.col("cid") == F.col("node"), "left").select("n", "a", "b", F.coalesce("root", "cid").alias("root"))
    slim = own.select("_row", "_doc.doc_id", *key)
    joined = slim.join(of_class, ["n", "a", "b"], "left")
    found = joined.select("_row", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "_row").alias("component"))
    return own.select("_row", "_doc"), settle(found, "grouped")


def dedup_report(docs: DataFrame) -> DataFrame:
    _, rows = grouped(docs.select("doc_id", "text"), REPORT)
    names = rows.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = rows.join(names, "component")
    kept = F.col("component_id").isNull() | F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return named.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def without_copies(docs: DataFrame, rule: Rule = STAGE) -> DataFrame:
    """One document of each group, that with the least doc_id (null last), with all its columns."""
    own, rows = grouped(docs, rule)
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("first"))
    return rows_of(own, first.select("first._row"), rows.select("_row")).select("_doc.*")
