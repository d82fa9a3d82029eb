"""Codes for vectors: each part's codebook is trained by ball k-means in integers.

A component x becomes floor(``SCALE`` x). Vectors are cut into ``PARTS`` equal
parts; a part's codebook starts as that part of the vectors with the least ids
and is moved to the floored means of its members in each round. Everything is
exact: nearest by squared distance, ties to the lower index.

Balls. The members of an entry lie in a ball around it. Its radius is bounded by
the largest distance at the last assignment plus the way the entry has moved.
Only entries nearer than twice that radius are its neighbours. If neither an
entry nor a neighbour has moved, its members stay without a look at them.
Otherwise a member's own distance decides: nearer than half the way to the next
neighbour it is in the stable core and stays; in the ring between half the way
to the i-th and to the next neighbour it is compared with the first i alone. Each
of these tests is an inequality between integer squares, so none loses a tie.

A round is one pass over rows that hold components and present codes, written
anew for the next round (the table before is dropped), and one pass of sums per
part and entry; only those sums, as many numbers as the codebooks hold, reach the
driver.

Defined cases: vectors that are null, hold null or non-finite components, or are
not as long as that of the least vec_id (a positive multiple of ``PARTS``) are
dropped; components beyond +-``LIMIT`` / ``SCALE`` count as that; with fewer vectors
than entries there are fewer entries; a null vec_id sorts last; repeated rows are
coded each on its own; equal vec_ids are ordered by their components; an empty
table gives an empty result. Columns other than vec_id, embedding and label are
not read. A sum of errors that a long cannot hold is null.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertmill.llm.common import drop_settled, packed
from alertmill.session import settle

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Keeps the squared distances of vectors of up to 4096 components in a long.
LIMIT = 1 << 24
BATCH_ROWS = 1 << 15


def integers(vector: Column) -> Column:
    scaled = F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))))
    return F.transform(scaled, lambda x: x.cast("int"))


def usable(rows: DataFrame, vector: str, order: list[str], parts: int) -> DataFrame:
    """Rows with finite vectors as long as the first one's, with their integers in ``_q``."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    size = F.size(vector)
    fine = rows.filter(F.col(vector).isNotNull() & (size > 0) & (size % parts == 0) & ~bad).withColumn("_q", integers(F.col(vector)))
    first = fine.orderBy(*[F.col(c).asc_nulls_last() for c in order]).select(F.size("_q")).first()
    return fine.filter(F.size("_q") == (first[0] if first else 0))


@dataclass
class Ball:
    """An entry with the neighbours that a member may have to be compared with, nearest first."""

    centre: np.ndarray
    #: Squared distances to the neighbours, rising.
    gaps: np.ndarray
    others: np.ndarray
    still: bool


def balls(centres: np.ndarray, radius: list[int | None], moved: np.ndarray) -> list[Ball]:
    """``radius``: a bound of each ball's radius; None where nothing is known, so that all entries are neighbours."""
    out = []
    for e, centre in enumerate(centres):
        gaps = ((centres - centre) ** 2).sum(axis=1)
        near = np.ones(len(centres), bool) if radius[e] is None else gaps <= 4 * radius[e] * radius[e]
        near[e] = False
        others = np.flatnonzero(near)
        others = others[np.argsort(gaps[others], kind="stable")]
        still = radius[e] is not None and not moved[e] and not moved[others].any()
        out.append(Ball(centre, gaps[others], others, still))
    return out


def reassigned(x: np.ndarray, codes: np.ndarray, all_balls: list[Ball]) -> tuple[np.ndarray, int]:
    """New codes of the part ``x`` (rows by components) and how many distances were worked out."""
    new, work = codes.copy(), 0
    for e, ball in enumerate(all_balls):
        if ball.still or not len(ball.others):
            continue
        members = np.flatnonzero(codes == e)
        best = ((x[members] - ball.centre) ** 2).sum(axis=1)
        work += len(members)
        ring = np.searchsorted(ball.gaps, 4 * best, side="right")
        outside = ring > 0  # the others are in the stable core
        members, best, ring = members[outside], best[outside], ring[outside]
        chosen = np.full(len(members), e)
        for i in range(int(ring.max(initial=0))):
            reached = np.flatnonzero(ring > i)
            other = ball.others[i]
            d = ((x[members[reached]] - all_balls[other].centre) ** 2).sum(axis=1)
            work += len(reached)
            better = (d < best[reached]) | ((d == best[reached]) & (other < chosen[reached]))
            best[reached[better]], chosen[reached[better]] = d[better], other
        new[members] = chosen
    return new, work


def _matrix(batches: list[pa.RecordBatch], column: int, dtype: type) -> np.ndarray:
    rows = sum(b.num_rows for b in batches)
    values = np.concatenate([b.column(column).flatten().to_numpy() for b in batches])
    return values.reshape(rows, -1).astype(dtype)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held += [batch] if batch.num_rows else []
        if sum(b.num_rows for b in held) >= BATCH_ROWS:
            yield held
            held = []
    if held:
        yield held


class Codebooks:
    """The entries of every part: parts x entries x components."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.balls = [balls(c, [None] * len(c), np.ones(len(c), bool)) for c in entries]

    def moved_to(self, entries: np.ndarray, far: np.ndarray) -> Codebooks:
        """``far``: the largest squared distance of a member to its entry before the move; -1 without members."""
        out = Codebooks(entries)
        ways = ((entries - self.entries) ** 2).sum(axis=2)
        out.balls = []
        for p, centres in enumerate(entries):
            radius = [math.isqrt(max(int(f), 0)) + 1 + (math.isqrt(int(w)) + 1 if w else 0) for f, w in zip(far[p], ways[p])]
            out.balls.append(balls(centres, radius, ways[p] > 0))
        return out

    def parts_of(self, q: np.ndarray) -> np.ndarray:
        return q.reshape(len(q), len(self.entries), -1).transpose(1, 0, 2)

    def assign(self, rows: DataFrame) -> DataFrame:
        """(_doc, _q, _codes) with the codes brought up to these entries."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for held in _gathered(batches):
                q, codes = _matrix(held, 1, np.int64), _matrix(held, 2, np.int8)
                new = [reassigned(x, codes[:, p], self.balls[p])[0] for p, x in enumerate(self.parts_of(q))]
                flat, at = np.stack(new, axis=1).ravel(), 0
                for batch in held:
                    n = batch.num_rows * len(new)
                    ends = pa.array(np.arange(0, n + 1, len(new)), pa.int32())
                    column = pa.ListArray.from_arrays(ends, pa.array(flat[at : at + n], pa.int8()))
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), column], schema=batch.schema)
                    at += n

        return rows.mapInArrow(run, rows.schema)

    def distances(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared distances to the own entries, rows by parts."""
        return np.stack([((x - self.entries[p][codes[:, p]]) ** 2).sum(axis=1) for p, x in enumerate(self.parts_of(q))], axis=1)

    def means(self, rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Floored means of the members (unused entries stay) and the largest squared distance in each ball."""
        parts, entries, width = self.entries.shape

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, far = np.zeros((parts, entries, width + 1), np.int64), np.full((parts, entries), -1, np.int64)
            for held in _gathered(batches):
                q, codes = _matrix(held, 0, np.int64), _matrix(held, 1, np.int64)
                d = self.distances(q, codes)
                for p, x in enumerate(self.parts_of(q)):
                    order = np.argsort(codes[:, p], kind="stable")
                    own, first = np.unique(codes[order, p], return_index=True)
                    sums[p, own, :width] += np.add.reduceat(x[order], first, axis=0)
                    sums[p, own, width] += np.diff(np.append(first, len(order)))
                    far[p, own] = np.maximum(far[p, own], np.maximum.reduceat(d[order, p], first))
            where = np.indices(sums.shape).reshape(3, -1)
            columns = [*where, sums.ravel(), np.repeat(far.ravel(), width + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["p", "e", "i", "s", "far"])

        total = rows.select("_q", "_codes").mapInArrow(run, "p bigint, e bigint, i bigint, s bigint, far bigint")
        total = total.groupBy("p", "e", "i").agg(F.sum("s").alias("s"), F.max("far").alias("far")).toArrow()  # the size of the codebooks
        new, far = self.entries.copy(), np.full((parts, entries), -1, np.int64)
        sums = np.zeros((parts, entries, width + 1), np.int64)
        p, e, i = (total[c].to_numpy() for c in ("p", "e", "i"))
        sums[p, e, i], far[p, e] = total["s"].to_numpy(), total["far"].to_numpy()
        used = sums[..., width] > 0
        new[used] = sums[used][:, :width] // sums[used][:, width:]
        return new, far

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def trained(rows: DataFrame, seeds: list[list[int]], parts: int, rounds: int) -> tuple[DataFrame, Codebooks]:
    """Rows (_doc, _q, _codes) with their last codes, and the codebooks. ``rows`` has (_doc, _q)."""
    first = np.array(seeds, np.int64).reshape(len(seeds), parts, -1).transpose(1, 0, 2)
    books = Codebooks(first)
    zero = F.array(*[F.lit(0).cast("tinyint")] * parts)
    now = settle(books.assign(rows.select("_doc", "_q", zero.alias("_codes"))), "codes")
    for _ in range(rounds):
        books = books.moved_to(*books.means(now))
        before, now = now, settle(books.assign(now), "codes")
        drop_settled(before)
    return now, books


def coded(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """Rows (_doc, code, error) of the usable vectors, ``_doc`` being the whole row, and the codebooks (None without vectors)."""
    own = packed(vectors).withColumn("_vector", F.col("_doc.embedding")).withColumn("_id", F.col("_doc.vec_id"))
    own = usable(own, "_vector", ["_id"], parts).select("_doc", "_id", "_q")
    order = [F.col("_id").asc_nulls_last(), F.col("_q")]
    seeds = [r["_q"] for r in own.orderBy(*order).limit(entries).collect()]
    if not seeds:
        none = own.limit(0).select("_doc", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"))
        return none, None
    rows, books = trained(own.select("_doc", "_q"), seeds, parts, rounds)

    @F.arrow_udf("struct<code: string, error: bigint>")
    def finish(q: pa.Array, codes: pa.Array) -> pa.Array:
        x = q.flatten().to_numpy().reshape(len(q), -1).astype(np.int64)
        own = codes.flatten().to_numpy().reshape(len(codes), -1)
        error = books.distances(x, own).sum(axis=1) if len(x) else np.zeros(0, np.int64)
        text = [bytes(c).hex() for c in own.astype(np.uint8)]
        return pa.StructArray.from_arrays([pa.array(text, pa.string()), pa.array(error, pa.int64())], names=["code", "error"])

    return rows.select("_doc", finish("_q", "_codes").alias("f")).select("_doc", "f.*"), books


def code_report(vectors: DataFrame) -> DataFrame:
    rows, books = coded(vectors.select("vec_id", "embedding", "label"))
    rows = rows.select("_doc.vec_id", "_doc.label", "code", "error")
    rows = settle(rows, "coded")
    sums = rows.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    digest = books.digest() if books else hashlib.sha256(b"").hexdigest()
    return rows.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )
