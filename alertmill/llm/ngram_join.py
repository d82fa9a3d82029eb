"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is its set of distinct shingles of ``k`` words (64-bit hashes).
Documents with equal sets are one class; classes are joined. Shingle length and
threshold are a ``Rule``: ``REPORT`` (4 words, 0.85) for the report, ``STAGE``
(5 words, 0.8) for removing near copies.

Order and prefixes. All tokens have one global order, rare first. If two sets
reach the threshold, their prefixes of n - ceil(t n) + m tokens share at least
m tokens, for any m. Each class picks its own m from 1 to ``MOST_MATCHES``: a
longer prefix reads more posting entries, but asks for more shared tokens, so
fewer pairs are verified; the cheapest sum of both is taken. Two classes are
candidates if they share as many prefix tokens as the smaller of their two m.

Only tokens that occur twice have postings; those that occur once take their
places in the prefix without a row. Two bands of sizes use separate orders, and
sizes near the border are in both, so no link is lost. In the band of long sets
frequencies are counted for every ``STRIDE``-th token by hash; these come first
in its order, and the others follow only in sets that have too few of them.

Candidates without pairs inside a group. The rarest token that two sets share
must leave both enough tokens behind it, which bounds the size of the other set
(``most``); entries without such a partner in their list are set aside. Per list
one pivot is compared with the members of other components; links found are
merged; the pivot, now compared with everybody in it, leaves the list. This
repeats while one pair in ``PRODUCTIVE`` is a link and the pairs of different
components that are left are more than ``DIRECT`` times the entries. The classes
then still in a list with another component, a small rest, are ordered anew by
the frequencies of all of their tokens, and go through pivots until no list holds
two components; there the pivots of a list grow from round to round, so a list
of any size takes a logarithm of rounds and its pairs are never made at once.
Every pair, of a pivot or not, is verified only if it shares as many prefix
tokens as asked. Pairs inside a component are never made. Verification compares
whole sets.

Defined cases: a null or empty text, or one of spaces, has no shingle and is a
component of its own; fewer than ``k`` words are one shingle; repeated
rows are in one class; null doc_ids are ignored when a component is named, and
name it null if it has no other; an empty table gives an empty result. Columns
other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from alertmill.llm import words as W
from alertmill.llm.common import BROADCAST_ROWS, numbered, packed, rows_of
from alertmill.llm.components import extended, no_labels
from alertmill.session import settle

MOST_MATCHES = 4
#: Cost of verifying a pair, in posting entries read.
VERIFY_COST = 16
BORDER = 256
STRIDE = 4
DIRECT = 4
#: Pivots of a list in the first round of the second order.
PIVOTS = 4
GROWTH = 16
#: Pivots go on while one pair in so many, or more, is a link.
PRODUCTIVE = 20
#: Members compared with a pivot in one verification group.
CHUNK = 64


class Rule(NamedTuple):
    """Words of a shingle, and the threshold as a fraction."""

    k: int
    num: int
    den: int

    def needed(self, n: int) -> int:
        """ceil(t n)."""
        return (n * self.num + self.den - 1) // self.den


REPORT = Rule(4, 17, 20)
STAGE = Rule(5, 4, 5)


def sets(part: W.Slice, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted by hash within the row, and the rows' bounds."""
    starts, ends, bounds = W.word_spans(part)
    hashes = W.spans_hash(W.byte_prefix(part.data, lower=True), starts, ends)
    runs, run_bounds = W.shingles(hashes, bounds, k)
    rows = W.row_of(run_bounds)
    order = np.lexsort((runs, rows))
    runs, rows = runs[order], rows[order]
    fresh = np.ones(len(runs), bool)
    fresh[1:] = (runs[1:] != runs[:-1]) | (rows[1:] != rows[:-1])
    runs, rows = runs[fresh], rows[fresh]
    return runs, np.searchsorted(rows, np.arange(part.rows + 1))


def _wrapping_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return (total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)


def signature(text: Column, rule: Rule) -> Column:
    """n and two sums of mixed hashes, equal for equal sets whatever their order, and how many tokens a set brings.

    ``brings`` is [band 0, band 0 late, band 1, band 1 late].
    """

    @F.arrow_udf("struct<n: bigint, a: bigint, b: bigint, brings: array<bigint>>")
    def sign(texts: pa.Array) -> pa.Array:
        found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3 + (np.zeros((0, 4), np.int64),)]
        for part in W.slices(texts):
            runs, bounds = sets(part, rule.k)
            brings = np.zeros((part.rows, 4), np.int64)
            for row, band, _, late in _submitted(runs, bounds, rule):
                brings[row, band * 2 : band * 2 + 2] = (~late).sum(), late.sum()
            sums = [_wrapping_sums(W.mix(runs ^ np.uint64(salt)), bounds) for salt in (11, 23)]
            found.append((np.diff(bounds), *sums, brings))
        n, a, b, brings = (np.concatenate(c).astype(np.int64) for c in zip(*found))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * 4, pa.int32()), pa.array(brings.ravel()))
        return pa.StructArray.from_arrays([*map(pa.array, (n, a, b)), lists], names=["n", "a", "b", "brings"])

    return sign(text)


def _submitted(runs: np.ndarray, bounds: np.ndarray, rule: Rule, whole: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row, band, tokens, late): what each row brings to each of its bands; ``late`` marks the second class of the order."""
    for row in range(len(bounds) - 1):
        tokens = runs[bounds[row] : bounds[row + 1]]
        n = len(tokens)
        if n == 0:
            continue
        if whole or n <= BORDER:
            yield row, 0, tokens, np.zeros(n, bool)
        if not whole and n > rule.needed(BORDER + 1) - 1:
            late = tokens % np.uint64(STRIDE) != 0
            if n - int(late.sum()) >= n - rule.needed(n) + MOST_MATCHES:
                tokens, late = tokens[~late], np.zeros(n - int(late.sum()), bool)
            yield row, 1, tokens, late


def submissions(own: DataFrame, rule: Rule, whole: bool) -> DataFrame:
    """(h, place, cid): one row per token a row brings; ``place`` is twice the band, and one more for the second class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for part in W.slices(batch.column(1)):
                runs, bounds = sets(part, rule.k)
                found = list(_submitted(runs, bounds, rule, whole))
                if not found:
                    continue
                sizes = [len(t) for _, _, t, _ in found]
                column = [
                    np.concatenate([t for _, _, t, _ in found]).view(np.int64),
                    np.repeat([b for _, b, _, _ in found], sizes) * 2 + np.concatenate([x for _, _, _, x in found]),
                    np.repeat(ids[[part.first + r for r, _, _, _ in found]], sizes),
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column[0]), pa.array(column[1].astype(np.int8)), pa.array(column[2].astype(np.int64))], names=["h", "place", "cid"]
                )

    return own.select("_row", "text").mapInArrow(run, "h bigint, place tinyint, cid bigint")


def postings(own: DataFrame, classes: DataFrame, rule: Rule, whole: bool = False) -> DataFrame:
    """Prefix tokens that occur more than once: (band, h, cid, n, m, rare, most, first). ``whole``: one band with all tokens.

    ``most`` is the largest set that can still reach the threshold with this one
    if they share no rarer token; ``first`` tells whether the list has any such.
    """
    # one shuffle: a token is counted where its rows meet, and most occur once and end there
    times = F.count(F.lit(1)).over(Window.partitionBy("h", "place"))
    shared = submissions(own, rule, whole).withColumn("df", times).filter("df > 1")
    reps = classes.select("cid", "n", "brings")
    shared = shared.join(reps, "cid").select(
        "cid", "n", "h", "df", "brings", F.expr("place div 2").cast("int").alias("band"), F.expr("place % 2").cast("int").alias("late")
    )
    doc = Window.partitionBy("cid", "band")
    line = doc.orderBy("late", "df", "h")
    early = F.count(F.when(F.col("late") == 0, 1)).over(doc)
    both = F.count(F.lit(1)).over(doc)
    brought = F.element_at("brings", F.col("band") * 2 + 1)
    brought_late = F.element_at("brings", F.col("band") * 2 + 2)
    # tokens that occur once come before the others of their class and have no row
    alone = (brought - early) + F.when(F.col("late") == 1, brought_late - (both - early)).otherwise(0)
    ranked = shared.withColumn("rank", F.row_number().over(line) + alone).withColumn(
        "rare", (brought + brought_late - both) * 1000 / F.col("n")
    )
    base = F.col("n") - F.expr(f"(n * {rule.num} + {rule.den - 1}) div {rule.den}")
    near = ranked.withColumn("base", base).filter(F.col("rank") <= F.col("base") + MOST_MATCHES)
    reads = [F.sum(F.when(F.col("rank") <= F.col("base") + m, F.col("df") - 1).otherwise(0)).over(doc) for m in range(1, MOST_MATCHES + 1)]
    costs = F.array(*[F.struct((r * (1 + VERIFY_COST / m)).alias("cost"), F.lit(m).alias("m")) for m, r in enumerate(reads, 1)])
    most = F.least(F.lit(MOST_MATCHES), F.col("n") - F.col("base"))
    chosen = F.array_min(F.filter(costs, lambda c: c["m"] <= most))["m"]
    entries = (
        near.withColumn("m", chosen)
        .filter(F.col("rank") <= F.col("base") + F.col("m"))
        .select("band", "h", "cid", "n", "m", "rare", F.expr(f"(n - rank + 1) * {rule.num + rule.den} div {rule.num} - n").alias("most"))
    )
    # the first token that two sets share leaves each too little if the other is larger than ``most``
    sizes = entries.groupBy("band", "h").agg(F.min("n").alias("least_n"), F.max("most").alias("most_n"))
    first = (F.col("most") >= F.col("least_n")) & (F.col("n") <= F.col("most_n"))
    return entries.join(sizes, ["band", "h"]).withColumn("first", first).drop("least_n", "most_n")


def fits(left: str, right: str, rule: Rule) -> Column:
    """Whether two entries of a list can be the first token of a pair that reaches the threshold."""
    n, o = F.col(f"{left}n"), F.col(f"{right}n")
    return (F.least(n, o) * rule.den >= F.greatest(n, o) * rule.num) & (o <= F.col(f"{left}most")) & (n <= F.col(f"{right}most"))


def _links(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(list(batches))
    cids, pivots = rows["cid"].to_numpy(), rows["pivot"].to_numpy()
    found: dict[int, list[np.ndarray]] = {}
    bodies: list[np.ndarray] = []
    for part in W.slices(rows["text"].combine_chunks()):
        runs, bounds = sets(part, rule.k)
        bodies += [runs[bounds[i] : bounds[i + 1]].copy() for i in range(part.rows)]
    at = {int(c): i for i, c in enumerate(cids) if c == pivots[i]}
    out = []
    for i, (c, p) in enumerate(zip(cids.tolist(), pivots.tolist())):
        if c != p:
            a, b = bodies[at[p]], bodies[i]
            common = len(np.intersect1d(a, b, assume_unique=True))
            if common * rule.den >= (len(a) + len(b) - common) * rule.num:
                out.append((p, c))
    yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.int64()) for j in (0, 1)], names=["u", "v"])


def verified(pairs: DataFrame, own: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (pivot, cid) whose whole sets reach the threshold, as links (u, v). Pairs must be distinct and settled."""
    total = pairs.count()
    chunk = F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int")
    spread = pairs.join(pairs.groupBy("pivot").agg(F.expr(f"count(*) div {CHUNK} + 1").alias("chunks")), "pivot")
    members = settle(spread.select("pivot", chunk.alias("chunk"), "cid"), "members")
    heads = members.select("pivot", "chunk", F.col("pivot").alias("cid")).distinct()
    wanted = members.unionByName(heads)
    small = 2 * total <= BROADCAST_ROWS
    texts = own.select(F.col("_row").alias("cid"), "text").join(F.broadcast(wanted) if small else wanted, "cid")
    groups = max(1, -(-2 * total // (4 * CHUNK)))
    bucket = F.pmod(F.xxhash64("pivot", "chunk"), F.lit(groups)).alias("bucket")
    schema = "u bigint, v bigint"

    def check(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(_links(iter(_by_chunk(table)), rule))

    return texts.select(bucket, "pivot", "chunk", "cid", "text").groupBy("bucket").applyInArrow(check, schema)


def _by_chunk(table: pa.Table) -> list[pa.RecordBatch]:
    return table.drop_columns(["bucket"]).to_batches()


def _open(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """Entries of lists that hold several components, with ``root``, the list's largest component ``main`` and its ``cross`` pairs."""
    rows = entries.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    per_root = rows.groupBy("band", "h", "root").agg(F.count(F.lit(1)).alias("c"))
    lists = per_root.groupBy("band", "h").agg(
        F.sum("c").alias("members"), F.sum(F.col("c") * F.col("c")).alias("squares"), F.max(F.struct("c", "root"))["root"].alias("main")
    )
    lists = lists.filter(F.col("squares") < F.col("members") * F.col("members"))
    cross = F.expr("(members * members - squares) / 2 / members").alias("cross")
    return settle(rows.join(lists.select("band", "h", "main", cross), ["band", "h"]), "open")


def _asked(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """Those of the distinct ``pairs`` that share, in some band, as many prefix tokens as the smaller m of the two."""
    mine = entries.select("band", "h", F.col("cid").alias("pivot"), F.col("m").alias("o_m"))
    both = pairs.join(mine, "pivot").join(entries.select("band", "h", "cid", "m"), ["band", "h", "cid"])
    shared = both.groupBy("pivot", "cid", "band").agg(F.count(F.lit(1)).alias("shared"), F.min(F.least("m", "o_m")).alias("asked"))
    return settle(shared.filter("shared >= asked").select("pivot", "cid").distinct(), "matches")


def by_pivots(entries: DataFrame, own: DataFrame, labels: DataFrame, rule: Rule, last: bool) -> tuple[DataFrame, DataFrame]:
    """``labels`` with the links found by comparing pivots, and the entries still open.

    The ``last`` order goes on until none is open, the other while that finds links.
    """
    prefixes, entries = entries, entries.filter("first")
    pivots = PIVOTS if last else 1
    while True:
        rows = _open(entries, labels)
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("cross").alias("cross")).first()
        if not size["n"] or (not last and size["cross"] <= DIRECT * size["n"]):
            return labels, rows
        line = Window.partitionBy("band", "h").orderBy("rare", "cid")
        heads = rows.withColumn("turn", F.row_number().over(line)).filter(F.col("turn") <= pivots)
        heads = settle(heads.select("band", "h", *[F.col(c).alias(f"p_{c}") for c in ("cid", "n", "root", "most")]), "pivots")
        stars = rows.join(heads, ["band", "h"]).filter((F.col("root") != F.col("p_root")) & fits("", "p_", rule))
        pairs = stars.select(F.least("p_cid", "cid").alias("pivot"), F.greatest("p_cid", "cid").alias("cid")).distinct()
        pairs = _asked(settle(pairs, "pairs"), prefixes)
        new = settle(verified(pairs, own, rule), "links")
        if not new.isEmpty():
            labels = extended(labels, new)
        gone = heads.select("band", "h", F.col("p_cid").alias("cid"))
        entries = settle(rows.select(*entries.columns).join(gone, ["band", "h", "cid"], "left_anti"), "entries")
        if last:
            pivots *= GROWTH
        elif new.count() * PRODUCTIVE < pairs.count():
            return labels, _open(entries, labels)


def linked(entries: DataFrame, own: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """(node, root) of the classes with a link, as full comparison would connect them."""
    labels, rows = by_pivots(entries, own, no_labels(own), rule, last=False)
    left = settle(rows.select("cid").distinct(), "left")
    if left.isEmpty():
        return labels
    # what is left once more, in one order by the frequencies of all of its tokens
    own = settle(rows_of(own, left), "texts")
    whole = F.array(F.col("n"), *[F.lit(0).cast("bigint")] * 3)
    classes = classes.join(left, "cid", "left_semi").withColumn("brings", whole)
    entries = settle(postings(own, classes, rule, whole=True), "postings")
    return by_pivots(entries, own, labels, rule, last=True)[0]


def joined(own: DataFrame, rule: Rule = REPORT) -> DataFrame:
    """Per row of a ``numbered`` table: _row, doc_id, n_shingles, class (least _row of its set) and component (least _row)."""
    rows = settle(own.select("_row", "doc_id", signature(F.col("text"), rule).alias("s")), "signatures")
    key = [F.col("s.n").alias("n"), F.col("s.a").alias("a"), F.col("s.b").alias("b")]
    classes = rows.filter("s.n > 0").groupBy(*key).agg(F.min(F.struct("_row", "s.brings")).alias("least"))
    classes = settle(classes.select("n", "a", "b", F.col("least._row").alias("cid"), F.col("least.brings").alias("brings")), "classes")
    entries = settle(postings(own, classes, rule), "postings")
    labels = linked(entries, own, classes, rule)
    of_class = classes.join(labels.withColumnRenamed("node", "cid"), "cid", "left").select(
        "n", "a", "b", "cid", F.coalesce("root", "cid").alias("root")
    )
    return rows.select("_row", "doc_id", *key).join(of_class, ["n", "a", "b"], "left").select(
        "_row",
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("cid", "_row").alias("class"),
        F.coalesce("root", "_row").alias("component"),
    )


def join_report(docs: DataFrame) -> DataFrame:
    rows = settle(joined(numbered(docs.select("doc_id", "text"))), "joined")
    names = rows.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return rows.join(names, "component").select("doc_id", "n_shingles", "component_id")


def without_copies(docs: DataFrame, rule: Rule = STAGE) -> DataFrame:
    """One document of each component, that with the least doc_id, with all its columns."""
    own = numbered(packed(docs))
    rows = joined(own.select("_row", "_doc.doc_id", "_doc.text"), rule)
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row")).alias("first"))
    kept = settle(first.select("first._row"), "kept")
    return rows_of(own, kept, own.select("_row")).select("_doc.*")
