"""Toxicity by logistic regression, fitted with FTRL-proximal over hashed n-grams and skip-grams.

A text's features are its distinct words, pairs of neighbours and pairs of
words with one between (A-Z lower-cased, punctuation separates), hashed into
``BUCKETS``. Each coordinate has its own rate; L1 keeps only the coordinates
that earn their place, so the fitted model is a short list of (bucket, weight)
that is broadcast to score every text.

Fitting reads a bounded sample: labelled rows outside the held-out fold whose
digest falls under FIT_ROWS / (number of such rows), so about ``FIT_ROWS``
documents whatever the table holds. They are written once, dealt to ``WORKERS``
shares; each round a task reads its share, without a shuffle, and runs it
through FTRL from the common state, and the states are averaged.

Defined cases: a null or empty text is scored by the bias alone; null labels
and labels of unknown documents are not used; repeated labels count as often as
they are given; without any usable label every score is 0.5; a null doc_id is
treated as an empty one, which is held out; an empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertmill.llm import words as W
from alertmill.session import scratch_path

BITS = 18
BUCKETS = 1 << BITS
FIT_ROWS = 16_000
WORKERS = 4
ROUNDS = 8
FOLDS = 5
ALPHA, BETA, L1, L2 = 1.5, 1.0, 4.0, 0.02

_SPLIT = np.ones(256, dtype=bool)
_SPLIT[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_SALT = np.uint64(0xA0761D6478BD642F)


def _hashed(part: W.Slice) -> tuple[np.ndarray, np.ndarray]:
    """All features of a slice with repeats, and their rows."""
    starts, ends, bounds = W.word_spans(part, _SPLIT)
    h = W.spans_hash(W.byte_prefix(part.data, lower=True), starts, ends)
    rows = W.row_of(bounds)
    found, owners = [h], [rows]
    for gap in (1, 2):
        same = rows[gap:] == rows[:-gap]
        found.append(W.mix(h[:-gap] * _SALT + h[gap:] + np.uint64(gap))[same])
        owners.append(rows[gap:][same])
    return (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(owners)


def _distinct(features: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.unique(rows << BITS | features)
    return keys & (BUCKETS - 1), keys >> BITS


def features(text: Column) -> Column:
    @F.arrow_udf("array<int>")
    def hashed(texts: pa.Array) -> pa.Array:
        out = [pa.array([], pa.list_(pa.int32()))]
        for part in W.slices(texts):
            found, rows = _distinct(*_hashed(part))
            offsets = np.searchsorted(rows, np.arange(part.rows + 1)).astype(np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.astype(np.int32))))
        return pa.concat_arrays(out)

    return hashed(text)


@dataclass
class State:
    """FTRL accumulators; the last place is the bias, which has no L1."""

    z: np.ndarray
    n: np.ndarray

    @classmethod
    def fresh(cls) -> State:
        return cls(np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1))

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(np.arange(BUCKETS + 1)[at] == BUCKETS, 0.0, L1)
        shrunk = np.sign(z) * np.maximum(np.abs(z) - l1, 0.0)
        return -shrunk / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        root = np.sqrt(self.n[at])
        self.n[at] += g * g
        self.z[at] += g - (np.sqrt(self.n[at]) - root) / ALPHA * w


@dataclass
class Model:
    """The weights that are not zero, by bucket; ``bias`` apart."""

    buckets: np.ndarray
    values: np.ndarray
    bias: float

    def score(self, text: Column) -> Column:
        buckets, values, bias = self.buckets, self.values, self.bias

        @F.arrow_udf("double")
        def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            table = np.zeros(BUCKETS)
            table[buckets] = values
            for texts in batches:
                out = [np.zeros(0)]
                for part in W.slices(texts):
                    found, rows = _hashed(part)
                    live = table[found] != 0
                    found, rows = _distinct(found[live], rows[live])
                    out.append(bias + np.bincount(rows, table[found], minlength=part.rows))
                yield pa.array(1.0 / (1.0 + np.exp(-np.clip(np.concatenate(out), -35, 35))), pa.float64())

        return scored(text)


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def _sample(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """(place, label, x, share) of about ``fit_rows`` labelled rows outside the held-out fold, written in folders by share."""
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    total = usable.count()
    digest = F.xxhash64("doc_id", F.lit(7))
    limit = int(min(1.0, fit_rows / max(1, total)) * (1 << 31))
    picked = usable.filter(F.pmod(digest, F.lit(1 << 31)) < limit).select(
        F.col("doc_id").alias("_of"), F.col("toxic").alias("label"), digest.alias("place")
    )
    # bounded by fit_rows, so the labels can be sent to the documents
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_of"))
    share = F.pmod(F.shiftright("place", 33), F.lit(WORKERS)).cast("int")
    rows = rows.select("place", "label", features(F.col("text")).alias("x"), share.alias("share")).repartition(WORKERS, "share")
    path = scratch_path(docs.sparkSession, "sample")
    rows.write.partitionBy("share").option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def _round(common: State) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's part of a round: each share of the sample that it holds, from the common state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(batches)
        if not sum(b.num_rows for b in found):
            return
        rows = pa.Table.from_batches(found)
        labels, order = rows["label"].to_numpy(), np.argsort(rows["place"].to_numpy(), kind="stable")
        shares = rows["share"].to_numpy()[order]
        x = rows["x"].combine_chunks()
        body, bounds = x.values.to_numpy(), x.offsets.to_numpy()
        for share in np.unique(shares):
            state = State(common.z.copy(), common.n.copy())
            for i in order[shares == share].tolist():
                state.learn(np.append(body[bounds[i] : bounds[i + 1]].astype(np.int64), BUCKETS), int(labels[i] > 0))
            yield pa.RecordBatch.from_pydict({"z": [state.z.tobytes()], "n": [state.n.tobytes()]})

    return run


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    sample = _sample(docs, labels, fit_rows)
    # one partition for each share; the last part has no rows, but without it Spark may merge parts that are all single partitions
    parts = [sample.filter(F.col("share") == i).coalesce(1) for i in range(WORKERS)]
    dealt = reduce(DataFrame.unionAll, [*parts, sample.filter(F.col("share") == WORKERS)])
    state = State.fresh()
    for _ in range(ROUNDS):
        shares = dealt.mapInArrow(_round(state), "z binary, n binary").collect()
        if not shares:
            break
        state = State(*(np.mean([np.frombuffer(r[c], np.float64) for r in shares], axis=0) for c in ("z", "n")))
    w = state.weights(slice(None))
    live = np.flatnonzero(w[:BUCKETS])
    return Model(live, w[live], float(w[BUCKETS]))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    score = fit(docs, labels).score(F.col("text"))
    scored = docs.select("doc_id", held_out().alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
