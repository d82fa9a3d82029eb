"""Ranked lexical search by reads in order of impact, with no random access (NRA).

Terms are runs of letters, digits and characters beyond ASCII, A-Z lower-cased.
A term's weight falls with the documents that hold it; what an occurrence adds
(its impact) is the weight times a saturating share of the term's count, damped
by the document's length. All of it is integer arithmetic but for the logarithm.

Index. One scan turns each document into a bag: its length and the counts of
the terms that some query holds. Document counts, the mean length and document
frequencies are grouped sums over the bags.

Search. Each task cuts its bags into segments of bounded size and builds a list
per term, highest impact first. A query reads its lists from the top, in
rounds: each round reads all that is left above a falling impact. Every
document then has a lower score (what has been read of it) and an upper one
(plus the next impact of each list in which it has not turned up). Documents
whose upper score is below the k-th best lower score are out; once even an
unseen document would be, no new one is admitted. Reading goes on until the
documents left have equal bounds. The k-th best score so far carries over to the
next segment. What a task returns is at most k documents a query; a window over
those ranks them.

Queries go to the tasks in blocks of about ``BLOCK_TERMS`` (query, term) pairs,
so that what is sent has a bound; each block is one pass over the documents.

Defined cases: a null or empty text has no terms, is no document of the counts
and is never found; a query without terms finds nothing; repeated queries are
ranked each on its own, and repeated documents each take a rank; equal scores go
by ascending doc_id, null last; an empty table gives an empty result. Columns
other than doc_id, text and item_id are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertmill.llm import words as W
from alertmill.session import settle

TOP = 20
BLOCK_TERMS = 200_000
SEGMENT_DOCS = 4096
SEGMENT_POSTINGS = 1 << 20
#: Rounds that halve the impact read down to; the next one reads to the end.
HALVINGS = 6

IS_BREAK = np.zeros(256, bool)
IS_BREAK[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def _terms(part: W.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms, and the rows' bounds among them."""
    starts, ends, bounds = W.word_spans(part, IS_BREAK)
    return W.spans_hash(W.byte_prefix(part.data, lower=True), starts, ends), bounds


def query_terms(queries: DataFrame) -> DataFrame:
    """(query, h, q): how often each distinct term stands in each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for part in W.slices(batch.column(1)):
                hashes, bounds = _terms(part)
                own = np.stack([W.row_of(bounds).astype(np.uint64), hashes])
                (rows, found), times = np.unique(own, axis=1, return_counts=True)
                columns = [ids[part.first + rows.astype(np.int64)], found.view(np.int64), times]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query", "h", "q"])

    return queries.select("query", "text").mapInArrow(run, "query bigint, h bigint, q bigint")


def bags(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(doc_id, n, terms, counts) of every document; ``terms`` are places in the sorted ``vocabulary``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch.column(1)):
                hashes, bounds = _terms(part)
                at = np.searchsorted(vocabulary, hashes)
                at[at == len(vocabulary)] = 0
                known = vocabulary[at] == hashes
                keys = W.row_of(bounds)[known] * len(vocabulary) + at[known]
                keys, counts = np.unique(keys, return_counts=True)
                ends = pa.array(np.searchsorted(keys, np.arange(part.rows + 1) * len(vocabulary)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (keys % len(vocabulary), counts)]
                ids = batch.column(0).slice(part.first, part.rows)
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(bounds)), *lists], names=["doc_id", "n", "terms", "counts"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, counts array<int>")


@dataclass
class Query:
    """Places of its terms in the vocabulary, and their weights times their repeats."""

    number: int
    terms: np.ndarray
    weights: np.ndarray


def share(counts: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What a term's weight is multiplied with, for its count in a document of ``n`` terms."""
    m = 75 + (25 * n * documents) // total
    return (1_000_000_000 * counts) // (1000 * counts + 12 * m)


def nra(lists: list[tuple[np.ndarray, np.ndarray]], docs: int, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents that may be among the k best with at least ``least``, and their whole scores.

    ``lists`` holds per term the documents and falling impacts. All documents at
    the k-th best score are returned, so ties can be settled by the caller.
    """
    lower, read = np.zeros(docs, np.int64), np.zeros(len(lists), np.int64)
    following = np.array([impacts[0] for _, impacts in lists], np.int64)
    open_docs: np.ndarray | None = None
    level = int(following.max())
    for turn in range(HALVINGS + 1):
        level = level // 2 if turn < HALVINGS else 0
        for i, (which, impacts) in enumerate(lists):
            if not following[i] or following[i] < level:
                continue
            # impacts fall, so those read next are a run from here
            upto = read[i] + np.searchsorted(-impacts[read[i] :], -level, side="right")
            now, gain = which[read[i] : upto], impacts[read[i] : upto]
            if open_docs is not None:
                wanted = open_docs[now]
                now, gain = now[wanted], gain[wanted]
            lower[now] += gain
            read[i] = upto
            following[i] = impacts[upto] if upto < len(impacts) else 0
        best = max(least, int(np.partition(lower, docs - k)[docs - k]) if docs >= k else 0)
        unseen = int(following.sum())
        if unseen >= best and level:
            continue
        # no document that has not turned up can reach the k-th best any more
        upper = lower + unseen
        for i, (which, _) in enumerate(lists):
            if following[i]:
                upper[which[: read[i]]] -= following[i]
        now_open = (upper >= best) & (lower > 0)
        open_docs = now_open if open_docs is None else open_docs & now_open
        if not (upper[open_docs] > lower[open_docs]).any():
            break
    found = np.flatnonzero((lower >= best) & open_docs)
    return found, lower[found]


class Best:
    """The k best documents of each query so far."""

    def __init__(self, queries: list[Query], k: int):
        self.queries, self.k = queries, k
        self.kept: list[list[tuple[int, bool, int]]] = [[] for _ in queries]

    def take(self, ids: list[int | None], n: np.ndarray, bounds: np.ndarray, terms: np.ndarray, counts: np.ndarray, scale: tuple[int, int]) -> None:
        """Search one segment: documents ``ids`` with ``n`` terms and their bags between ``bounds``."""
        rows = W.row_of(bounds)
        shares = share(counts.astype(np.int64), n[rows], *scale)
        order = np.lexsort((-shares, terms))
        terms, rows, shares = terms[order], rows[order], shares[order]
        for at, query in enumerate(self.queries):
            first, last = np.searchsorted(terms, query.terms), np.searchsorted(terms, query.terms, side="right")
            lists = [(rows[a:b], w * shares[a:b]) for a, b, w in zip(first, last, query.weights) if b > a and w]
            if not lists:
                continue
            kept = self.kept[at]
            least = -kept[self.k - 1][0] if len(kept) >= self.k else 1
            found, scores = nra(lists, len(ids), self.k, least)
            new = [(-int(s), ids[d] is None, ids[d] or 0) for d, s in zip(found, scores)]
            self.kept[at] = sorted(kept + new)[: self.k]

    def rows(self) -> pa.RecordBatch:
        out = [(q.number, None if none else i, -s) for q, kept in zip(self.queries, self.kept) for s, none, i in kept]
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], pa.int64()) for j in range(3)], names=["query", "doc_id", "score"])


def _search(own: DataFrame, queries: list[Query], scale: tuple[int, int], k: int) -> DataFrame:
    """(query, doc_id, score): the k best of each task's bags."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(queries, k)
        held: list[pa.RecordBatch] = []

        def search() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            terms, counts = (table[c].combine_chunks() for c in ("terms", "counts"))
            bounds = terms.offsets.to_numpy()
            own = terms.flatten().to_numpy(), counts.flatten().to_numpy()
            best.take(table["doc_id"].to_pylist(), table["n"].to_numpy(), bounds - bounds[0], *own, scale)
            held.clear()

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= SEGMENT_DOCS or sum(len(b.column(2).flatten()) for b in held) >= SEGMENT_POSTINGS:
                search()
        if held:
            search()
        yield best.rows()

    return own.select("doc_id", "n", "terms", "counts").mapInArrow(run, "query bigint, doc_id bigint, score bigint")


def _block(docs: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """The k best of each task for the queries of one block, whose terms fit the driver."""
    pairs = terms.orderBy("query", "h").toArrow()  # about BLOCK_TERMS rows
    query, h, q = (pairs[c].to_numpy() for c in ("query", "h", "q"))
    vocabulary, at = np.unique(h.view(np.uint64), return_inverse=True)
    own = settle(bags(docs, vocabulary), "bags")
    size = own.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in own.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # as long as the vocabulary
        df[r["t"]] = r["count"]
    weight = np.array([math.floor(1000 * math.log((2 * size["documents"] + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    cuts = np.flatnonzero(np.diff(query)) + 1
    queries = [Query(int(query[i[0]]), at[i], q[i] * weight[at[i]]) for i in np.split(np.arange(len(query)), cuts)]
    return _search(own.filter("size(terms) > 0"), queries, (size["documents"], max(size["total"], 1)), k)


def ranked(docs: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """The k documents of highest positive score for each query: item_id, rank, doc_id, score."""
    numbered = queries.select("item_id", "text", F.monotonically_increasing_id().alias("query"))
    numbered = settle(numbered, "queries")
    terms = settle(query_terms(numbered), "query-terms")
    blocks = max(1, -(-terms.count() // BLOCK_TERMS))
    block = F.pmod(F.xxhash64("query"), F.lit(blocks))
    found = [_block(docs, part, k) for b in range(blocks) if not (part := terms.filter(block == b)).isEmpty()]
    names = numbered.select("query", "item_id")
    if not found:
        none = F.lit(None).cast("bigint")
        return names.limit(0).select("item_id", F.lit(0).alias("rank"), none.alias("doc_id"), none.alias("score"))
    all_found = functools.reduce(DataFrame.unionByName, found)
    line = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    top = all_found.withColumn("rank", F.row_number().over(line)).filter(F.col("rank") <= k)
    return top.join(names, "query").select("item_id", "rank", "doc_id", "score")
