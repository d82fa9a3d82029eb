"""Language-model scores: a causal self-attention model over subword ids.

A document is its words (A-Z lower-cased) and one end. Every word becomes
subword ids of a public vocabulary (space in front, byte-level merges), so the
ids give the words back. The model's probability of the next id is that of a
count model, reweighted by attention over the ids before it:

    p(id | before) ~ p2(id | last id) * exp(g[class of id]),
    g = (mean of the values of the context, weighted by attention) + skip(last id)

p2 are smoothed bigram counts of all training documents over the ``SYMBOLS``
most frequent ids (the others share a symbol and are told apart by their own
counts). Ids with similar neighbours share one of ``CLASSES`` classes, and g is
a vector over classes, so the probabilities of all ids sum to one at the cost of
a sum over classes. Embeddings are the leading singular vectors of the bigram
counts; the query-key product, values, skip and distance weights are trained in
numpy by Adam on every position of the windows that tile all training documents,
in ``ROUNDS`` rounds over disjoint parts of them: tasks train on their rows from
the common parameters, and the parameters are averaged by positions seen.

Scoring tiles each document with windows of ``STEP`` positions which also see
the ``BACK`` positions before them, so windows overlap and every position is
scored once; attention of a batch of windows is computed under one mask.

Texts are read once, to write their ids. A word is told apart by its run of ids,
so words are counted and looked up from the ids.

Word counts for the base score are gathered by grouped sums. Words that make up
more than one token in ``FREQUENT`` are at most that many and are broadcast; the
rest are joined.

Sizes: what tasks receive is bounded by the vocabulary (a table of SYMBOLS^2
floats) and FREQUENT, whatever the corpus; what the driver collects likewise.

Defined cases: a null or empty text is the end alone; without any training
document counts are zero and the model is the uniform one; repeated rows are
scored and counted each; a null doc_id is treated as an empty one; an empty
table gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertmill.llm import words as W
from alertmill.session import scratch_path, settle

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
FOLDS, HELD_OUT = 7, 2
IDS = 50_257
END = 50_256
SYMBOLS = 1024
CLASSES = 32
WIDTH = 16
STEP, BACK = 16, 8
SPAN = STEP + BACK
ROUNDS = 3
SLICE_IDS = 1 << 19
#: Windows of a training step.
BATCH = 256
RATE = 0.02
SMOOTH = 20.0
#: Logarithm of a weight of attention, relative to the largest, that is lost in any sum.
FADE = -60.0
FREQUENT = 1 << 20
#: Words of which a task keeps the ids.
HELD_WORDS = 1 << 19
#: Query position against key position of a window: whether the key is seen, and how far behind it is (0 if it is not).
_SEEN = np.arange(STEP)[:, None] + BACK >= np.arange(SPAN)[None, :]
_GAP = np.where(_SEEN, np.arange(STEP)[:, None] + BACK - np.arange(SPAN)[None, :], 0)

_pieces: dict[int, Pieces] = {}
_ID_CODE = np.random.default_rng(20_250_117).integers(1, 1 << 63, IDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def ranks_of(vocabulary: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}


def begins_of(ranks: dict[bytes, int]) -> np.ndarray:
    """Whether an id begins a word, for all ids; END does not."""
    begins = np.zeros(IDS, bool)
    begins[[i for piece, i in ranks.items() if piece.startswith(b" ")]] = True
    return begins


class Pieces:
    """Ids of words."""

    def __init__(self, vocabulary: bytes) -> None:
        self._ranks = ranks_of(vocabulary)
        # a word begins at its space; long words are cut so that merging stays linear in the text
        cut = r"\x20[^\x20]{0,63}|[^\x20]{1,64}"
        self._encode = tiktoken.Encoding("words", pat_str=cut, mergeable_ranks=self._ranks, special_tokens={}).encode_ordinary
        self._begins = begins_of(self._ranks)
        self._forget()

    @classmethod
    def of(cls, vocabulary: bytes) -> Pieces:
        key = hash(vocabulary)
        if key not in _pieces:
            _pieces[key] = cls(vocabulary)
        return _pieces[key]

    def _forget(self) -> None:
        # hashes of words in order, and where their ids begin in one array, and how many they are
        self._held, self._flat = np.zeros(0, np.uint64), np.zeros(0, np.uint16)
        self._begin, self._size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _fresh(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self._held):
            return np.ones(len(hashes), bool)
        return self._held[np.minimum(np.searchsorted(self._held, hashes), len(self._held) - 1)] != hashes

    def _line_ids(self, line: bytes) -> list[int]:
        """Ids of words that each stand behind a space. A word that is no UTF-8 is its bytes, so that it stays apart."""
        try:
            return self._encode(line.decode())
        except UnicodeDecodeError:
            found = []
            for word in (b" " + x for x in line.split(b" ")[1:]):
                try:
                    found += self._encode(word.decode())
                except UnicodeDecodeError:
                    found += [self._ranks[word[i : i + 1]] for i in range(len(word))]
            return found

    def _learn(self, lowered: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        """Keep the ids of new words, whose hashes ascend."""
        # the words in one line, each behind a space
        sizes = ends - starts + 1
        to = np.cumsum(sizes) - sizes
        line = lowered[np.maximum(np.repeat(starts - 1 - to, sizes) + np.arange(int(sizes.sum())), 0)]
        line[to] = ord(" ")
        flat = np.array(self._line_ids(line.tobytes()), np.uint16)
        begin = np.flatnonzero(self._begins[flat])
        at = np.searchsorted(self._held, hashes)
        self._held = np.insert(self._held, at, hashes)
        self._begin = np.insert(self._begin, at, begin + len(self._flat))
        self._size = np.insert(self._size, at, np.diff(np.append(begin, len(flat))))
        self._flat = np.concatenate([self._flat, flat])

    def ids(self, lowered: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each word has. Words hold no space."""
        if not len(hashes):
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        words, first, inverse = W.distinct(hashes)
        fresh = self._fresh(words)
        if len(self._held) + int(fresh.sum()) > HELD_WORDS:
            self._forget()
            fresh[:] = True
        if fresh.any():
            new = first[fresh]
            self._learn(lowered, starts[new], ends[new], words[fresh])
        place = np.searchsorted(self._held, words)
        own = self._size[place][inverse]
        at = np.repeat(self._begin[place][inverse] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
        return self._flat[at], own


def read_words(part: W.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of all words, and the rows' bounds among them."""
    starts, ends, bounds = W.word_spans(part)
    return starts, ends, W.spans_hash(W.byte_prefix(part.data, lower=True), starts, ends), bounds


def read_ids(part: W.Slice, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows, each row's followed by END, and the rows' bounds among them."""
    starts, ends, hashes, bounds = read_words(part)
    flat, sizes = pieces.ids(W.LOWER[part.data], starts, ends, hashes)
    total = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=total[1:])
    per_row = total[bounds[1:]] - total[bounds[:-1]]
    id_bounds = np.zeros(part.rows + 1, np.int64)
    np.cumsum(per_row + 1, out=id_bounds[1:])
    ids = np.full(int(id_bounds[-1]), END, np.uint16)
    free = np.ones(len(ids), bool)
    free[id_bounds[1:] - 1] = False
    ids[free] = flat
    return ids, id_bounds


def word_hashes(ids: np.ndarray, bounds: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, of their ids, and the rows' bounds among them."""
    marks = np.flatnonzero(begins[ids] | (ids == END))  # a word ends where the next one begins, or its row ends
    word = ids[marks] != END
    starts = marks[word]
    hashes = W.spans_hash(W.prefix_sums(_ID_CODE[ids]), starts, marks[1:][word[:-1]])
    return hashes.view(np.int64), np.searchsorted(starts, bounds)


def tokenised(docs: DataFrame, vocabulary: bytes) -> DataFrame:
    """Every row with a number, held_out, the round that trains on it, and its ids (two bytes each), written once."""

    @F.arrow_udf("binary")
    def encode(texts: pa.Array) -> pa.Array:
        pieces, found = Pieces.of(vocabulary), []
        for part in W.slices(texts):
            ids, bounds = read_ids(part, pieces)
            body = pa.py_buffer(ids.astype("<u2").tobytes())
            found.append(pa.Array.from_buffers(pa.large_binary(), part.rows, [None, pa.py_buffer((bounds * 2).tobytes()), body]))
        return pa.concat_arrays([x.cast(pa.binary()) for x in found]) if found else pa.array([], pa.binary())

    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        "doc_id",
        (remainder() == HELD_OUT).alias("held_out"),
        F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(ROUNDS)).alias("_round"),
        encode(F.col("text")).alias("ids"),
    )
    path = scratch_path(docs.sparkSession, "tokenised")
    rows.write.option("compression", "zstd").parquet(path)  # the ids give the whole texts, so the denser codec
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


@dataclass
class Stored:
    """The ids of a batch of ``tokenised`` rows."""

    ids: np.ndarray
    bounds: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Stored:
        column = column.cast(pa.large_binary())
        _, where, body = column.buffers()
        bounds = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1] // 2
        return cls(np.frombuffer(body, np.uint8)[: 2 * int(bounds[-1])].view("<u2"), bounds)

    def rows(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        low, high = self.bounds[first], self.bounds[last]
        return self.ids[low:high].astype(np.int64), self.bounds[first : last + 1] - low

    def slices(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """All rows, in slices of about ``SLICE_IDS``, each with its first row; a longer row is a slice of its own."""
        first, n = 0, len(self.bounds) - 1
        while first < n:
            last = int(np.searchsorted(self.bounds, self.bounds[first] + SLICE_IDS, side="right")) - 1
            last = min(max(last, first + 1), n)
            yield first, *self.rows(first, last)
            first = last


# --- counts


class Tally:
    """Counts of keys; what slices add is merged when it has grown to ``hold`` entries, not each time."""

    def __init__(self, hold: int) -> None:
        self._hold, self._parts, self._size = hold, [], 0

    def add(self, keys: np.ndarray) -> None:
        self._parts.append(np.unique(keys, return_counts=True))
        self._size += len(self._parts[-1][0])

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self._parts:
            return np.zeros(0, np.int64), np.zeros(0)
        keys, inverse = np.unique(np.concatenate([p[0] for p in self._parts]), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([p[1] for p in self._parts]), minlength=len(keys))
        self._parts, self._size = [(keys, counts)], len(keys)
        return keys, counts

    def full(self) -> bool:
        """Whether merging no longer helps, so that the counts should be handed on."""
        if self._size <= self._hold:
            return False
        self.merged()
        return self._size > self._hold // 2

    def clear(self) -> None:
        self._parts, self._size = [], 0


def count_events(rows: DataFrame, begins: np.ndarray, hold: int = 1 << 20) -> DataFrame:
    """(kind, key, n): kind 0 counts words by hash, kind 1 pairs of neighbouring ids, over ``tokenised`` training rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [Tally(hold), Tally(hold)]

        def flush(kind: int) -> pa.RecordBatch:
            keys, counts = sums[kind].merged()
            sums[kind].clear()
            columns = [pa.array(np.full(len(keys), kind, np.int8)), pa.array(keys), pa.array(counts.astype(np.int64))]
            return pa.RecordBatch.from_arrays(columns, names=["kind", "key", "n"])

        for batch in batches:
            for _, ids, bounds in Stored.of(batch.column(0)).slices():
                pairs = np.concatenate([[END], ids[:-1]]) << 17 | ids
                for kind, keys in enumerate((word_hashes(ids, bounds, begins)[0], pairs)):
                    sums[kind].add(keys)
                    if sums[kind].full():
                        yield flush(kind)
        yield from (flush(kind) for kind in (0, 1))

    parts = rows.select("ids").mapInArrow(run, "kind tinyint, key bigint, n bigint")
    return parts.groupBy("kind", "key").agg(F.sum("n").alias("n"))


# --- the model


@dataclass
class Model:
    symbol: np.ndarray  # of each id
    within: np.ndarray  # log probability of each id given its symbol
    of_class: np.ndarray  # of each symbol
    log_pair: np.ndarray  # log p2(symbol | symbol)
    by_class: np.ndarray  # p2(class | symbol)
    embed: np.ndarray
    weights: dict[str, np.ndarray]
    _cast: dict[np.dtype, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict, repr=False)

    @cached_property
    def log_class(self) -> np.ndarray:
        return np.log(self.by_class)

    def embeddings(self, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
        """Also with a column of ones, which gives the sums of weights along with the sums of keys."""
        if kind not in self._cast:
            embed = self.embed.astype(kind)
            self._cast[kind] = embed, np.append(embed, np.ones((SYMBOLS, 1), kind), axis=1)
        return self._cast[kind]

    def tables(self) -> dict[str, np.ndarray]:
        """Scores of a pair of positions depend on their symbols and distance only."""
        e, w = self.embed, self.weights
        skip = e @ w["skip"]
        return {
            "ask": (e @ w["product"]).astype(np.float32),
            "near": distance_mask(np.exp(np.clip(w["distance"], -20, 20))).astype(np.float32),
            "key": e.astype(np.float32),
            "value": w["value"].astype(np.float32),
            "pair": self.log_pair + skip[:, self.of_class],
            "open": (self.by_class * np.exp(skip)).astype(np.float32),
        }


def distance_mask(by_distance: np.ndarray) -> np.ndarray:
    """(STEP, SPAN) factors of query position against key position; a key after its query has none."""
    return np.where(_SEEN, by_distance[_GAP], 0.0)


def _initial(width: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    return {
        "product": rng.normal(0, 0.05, (width, width)),
        "value": np.zeros((width, CLASSES)),
        "skip": np.zeros((width, CLASSES)),
        "distance": np.zeros(SPAN),
    }


def _classes(points: np.ndarray, mass: np.ndarray, count: int) -> np.ndarray:
    """Weighted k-means from the heaviest symbols."""
    centre = points[np.argsort(-mass, kind="stable")[:count]].copy()
    for _ in range(15):
        own = ((points[:, None, :] - centre[None]) ** 2).sum(2).argmin(1)
        for c in range(count):
            if mass[own == c].sum() > 0:
                centre[c] = np.average(points[own == c], axis=0, weights=mass[own == c])
    return own


def build(pairs: np.ndarray, id_counts: np.ndarray) -> Model:
    """From counts of symbol pairs and of ids; symbol SYMBOLS - 1 is shared by the rest."""
    symbol = symbols_of(id_counts)
    mass = pairs.sum(0)
    single = (mass + 1) / (mass.sum() + SYMBOLS)
    log_pair = np.log((pairs + SMOOTH * single) / (pairs.sum(1, keepdims=True) + SMOOTH))
    rest = symbol == SYMBOLS - 1
    within = np.zeros(IDS)
    within[rest] = np.log((id_counts[rest] + 1) / (id_counts[rest] + 1).sum())
    lift = np.log1p(pairs) - np.log1p(pairs).mean(1, keepdims=True) - np.log1p(mass)[None] + np.log1p(mass).mean()
    left, size, right = np.linalg.svd(lift, full_matrices=False)
    half = WIDTH // 2
    embed = np.concatenate([left[:, :half], right[:half].T], axis=1)
    embed = embed / (embed.std(0) + 1e-9)
    own = _classes(embed, mass + 1e-3, CLASSES)
    by_class = np.zeros((SYMBOLS, CLASSES))
    np.add.at(by_class.T, own, np.exp(log_pair).T)
    return Model(symbol, within, own, log_pair, by_class, embed, _initial(WIDTH, np.random.default_rng(5)))


def symbols_of(id_counts: np.ndarray) -> np.ndarray:
    top = np.argsort(-id_counts, kind="stable")[: SYMBOLS - 1]
    symbol = np.full(IDS, SYMBOLS - 1)
    symbol[top] = np.arange(SYMBOLS - 1)
    return symbol


# --- windows


def windows(ids: np.ndarray, bounds: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs (windows, SPAN), targets (windows, STEP), the row of each window, and whether it begins its row.

    The input at a position is the symbol before it, END at first. Inputs of
    padded positions are END; their targets are -1.
    """
    sizes = np.diff(bounds)
    per_row = -(-sizes // STEP)
    first_window = np.cumsum(per_row) - per_row
    rows = np.repeat(np.arange(len(sizes)), per_row)
    at = np.arange(len(ids)) + np.repeat(first_window * STEP - bounds[:-1], sizes)
    targets = np.full(int(per_row.sum()) * STEP, -1, np.int64)
    targets[at] = ids
    end = symbol[END]
    inputs = np.full(len(targets) + BACK, end, np.int32)
    at += BACK
    inputs[at[:1]] = end
    inputs[at[1:]] = symbol.astype(np.int32).take(ids[:-1])
    view = np.lib.stride_tricks.sliding_window_view(inputs, SPAN)[::STEP]
    opens = np.zeros(len(rows), bool)
    opens[first_window[sizes > 0]] = True
    return view, targets.reshape(-1, STEP), rows, opens


def score_ids(model: Model, tables: dict[str, np.ndarray], ids: np.ndarray, bounds: np.ndarray, chunk: int = 1024) -> np.ndarray:
    """Natural log probability of each row's ids."""
    inputs, targets, rows, opens = windows(ids, bounds, model.symbol)
    of_window = np.zeros(len(rows))
    pair, within = tables["pair"].ravel(), model.within
    ones = np.ones((max(SPAN, CLASSES), 1), np.float32)
    for a in range(0, len(rows), chunk):
        x, y = inputs[a : a + chunk], targets[a : a + chunk].ravel()
        keys, q = tables["key"].take(x, axis=0), x[:, BACK:]
        weight = tables["ask"].take(q, axis=0) @ np.ascontiguousarray(keys.transpose(0, 2, 1))
        np.clip(weight, -20, 20, out=weight)
        np.exp(weight, out=weight)
        weight *= tables["near"]
        weight[opens[a : a + chunk], :, :BACK] = 0.0
        mean = (weight @ keys).reshape(-1, WIDTH)
        mean /= weight.reshape(-1, SPAN) @ ones[:SPAN]
        g = mean @ tables["value"]
        s, q = model.symbol.take(y), q.ravel()  # a padded position has any symbol, and no part in the sum
        log_p = pair.take(q * np.int64(SYMBOLS) + s) + within.take(y)
        log_p += g.ravel().take(np.arange(0, g.size, CLASSES) + model.of_class.take(s))
        np.exp(g, out=g)
        g *= tables["open"].take(q, axis=0)
        log_p -= np.log((g @ ones[:CLASSES]).ravel())
        log_p[y < 0] = 0.0
        of_window[a : a + chunk] = log_p.reshape(-1, STEP).sum(1)
    return np.bincount(rows, of_window, minlength=len(bounds) - 1)


def row_max(x: np.ndarray) -> np.ndarray:
    """Of many short rows, which are reduced faster as columns."""
    return np.ascontiguousarray(x.T).max(0)


def faded_exp(w: np.ndarray) -> None:
    """exp in place; at FADE and below 0, which no sum with a 1 can tell apart, as subnormal numbers are slow."""
    np.maximum(w, FADE, out=w)
    np.exp(w, out=w)
    w *= w > math.exp(FADE) * (1 + 1e-5)


def window_gradient(model: Model, weights: dict[str, np.ndarray], x: np.ndarray, opens: np.ndarray, goals: np.ndarray):
    """Mean loss and gradients over all positions of the windows that have a goal, a symbol (-1: none)."""
    kind = weights["product"].dtype
    embed, keyed = model.embeddings(kind)
    n, real, q = len(x), goals.ravel() >= 0, x[:, BACK:]
    keys = keyed.take(x, axis=0)
    turned = np.ascontiguousarray(keys.transpose(0, 2, 1))
    w = (embed @ weights["product"]).take(q, axis=0) @ turned[:, :WIDTH]
    w += np.where(_SEEN, weights["distance"][_GAP], -np.inf).astype(kind)
    w[opens, :, :BACK] = -np.inf
    w -= row_max(w.reshape(-1, SPAN)).reshape(n, STEP, 1)
    faded_exp(w)
    sums = (w @ keys).reshape(-1, WIDTH + 1)
    part = 1 / sums[:, WIDTH:]
    # means and queries side by side, for one product with what comes back
    both = np.empty((n * STEP, 2 * WIDTH), kind)
    mean, eq = both[:, :WIDTH], both[:, WIDTH:]
    np.multiply(sums[:, :WIDTH], part, out=mean)
    eq[:] = embed.take(q.ravel(), axis=0)
    p = (model.log_class + embed @ weights["skip"]).astype(kind).take(q.ravel(), axis=0)
    p += mean @ weights["value"]
    np.clip(p, -60, 60, out=p)
    np.exp(p, out=p)
    p /= p @ np.ones((CLASSES, 1), kind)
    at = np.flatnonzero(real)
    c = at * CLASSES + model.of_class[goals.ravel()[at]]
    d = p.ravel()
    of_goal = d[c]
    loss = -np.log(np.maximum(of_goal, 1e-30)).mean(dtype=np.float64)
    d[c] = of_goal - 1
    if len(at) < len(real):
        p[~real] = 0
    p /= len(at)
    pull = np.empty((len(real), WIDTH + 1), kind)
    np.matmul(p, weights["value"].T, out=pull[:, :WIDTH])
    pull[:, WIDTH] = -np.einsum("ij,ij->i", pull[:, :WIDTH], mean)
    pull *= part
    w *= pull.reshape(n, STEP, WIDTH + 1) @ turned
    back = both.T @ p
    return loss, {
        "value": back[:WIDTH],
        "skip": back[WIDTH:],
        "product": eq.T @ (w @ keys[:, :, :WIDTH]).reshape(-1, WIDTH),
        "distance": np.bincount(_GAP.ravel(), w.sum(0).ravel(), minlength=SPAN),
    }


def gradient(model: Model, weights: dict[str, np.ndarray], x: np.ndarray, opens: np.ndarray, place: np.ndarray, target: np.ndarray):
    """The same for one position (0 to STEP - 1) of each window."""
    goals = np.full((len(x), STEP), -1)
    goals[np.arange(len(x)), place] = target
    return window_gradient(model, weights, x, opens, goals)


class Adam:
    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        self.weights = {k: v.astype(np.float32) for k, v in weights.items()}
        self._m = {k: np.zeros_like(v) for k, v in weights.items()}
        self._v = {k: np.zeros_like(v) for k, v in weights.items()}
        self._t = 0

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self._t += 1
        for k, g in grads.items():
            self._m[k] += 0.1 * (g - self._m[k])
            self._v[k] += 0.01 * (g * g - self._v[k])
            up = self._m[k] / (1 - 0.9**self._t)
            self.weights[k] -= RATE * up / (np.sqrt(self._v[k] / (1 - 0.99**self._t)) + 1e-8)


def train_slice(model: Model, adam: Adam, ids: np.ndarray, bounds: np.ndarray, rng: np.random.Generator) -> tuple[float, int]:
    """Every position of every window of some rows. Returns summed loss and the number of positions."""
    inputs, targets, _, opens = windows(ids, bounds, model.symbol)
    goals = np.append(model.symbol, -1)[targets]
    order, lost = rng.permutation(len(inputs)), 0.0
    for a in range(0, len(order), BATCH):
        own = order[a : a + BATCH]
        y = goals[own]
        loss, grads = window_gradient(model, adam.weights, inputs[own], opens[own], y)
        adam.step(grads)
        lost += loss * np.count_nonzero(y >= 0)
    return lost, len(ids)


_NAMES = ["product", "value", "skip", "distance"]


def train_round(rows: DataFrame, model: Model, seed: int) -> tuple[dict[str, np.ndarray], float]:
    """One pass over ``tokenised`` rows; parameters averaged by positions seen, first within groups of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adam, rng = Adam(model.weights), np.random.default_rng(seed)
        loss, seen = 0.0, 0
        for batch in batches:
            for _, ids, bounds in Stored.of(batch.column(0)).slices():
                lost, n = train_slice(model, adam, ids, bounds, rng)
                loss, seen = loss + lost, seen + n
        if seen:
            flat = np.concatenate([adam.weights[k].ravel() for k in _NAMES] + [np.array([loss / seen])])
            columns = [pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat * seen), pa.array(np.full(len(flat), float(seen)))]
            yield pa.RecordBatch.from_arrays(columns, names=["place", "x", "n"])

    parts = rows.select("ids").mapInArrow(run, "place int, x double, n double")
    means = parts.groupBy("place").agg((F.sum("x") / F.sum("n")).alias("x")).orderBy("place").collect()
    if not means:
        return model.weights, 0.0
    flat, out, at = np.array([r["x"] for r in means]), {}, 0
    for k in _NAMES:
        size = model.weights[k].size
        out[k] = flat[at : at + size].reshape(model.weights[k].shape)
        at += size
    return out, float(flat[-1])


# --- the operator


def remainder() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS


@dataclass
class Counts:
    words: DataFrame  # (key, n): word hashes of the training rows
    tokens: int
    kinds: int
    ends: int
    pairs: np.ndarray
    id_counts: np.ndarray


def gather(train: DataFrame, begins: np.ndarray) -> Counts:
    events = settle(count_events(train, begins), "counts")
    words = events.filter("kind = 0").select("key", "n")
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    pairs = events.filter("kind = 1").select(F.shiftright("key", 17).alias("a"), F.col("key").bitwiseAND(F.lit((1 << 17) - 1)).alias("b"), "n")
    id_counts = np.zeros(IDS)
    for r in pairs.groupBy("b").agg(F.sum("n").alias("n")).collect():  # as many as there are ids at most
        id_counts[r["b"]] = r["n"]
    symbol = symbols_of(id_counts)
    names = F.broadcast(train.sparkSession.createDataFrame(list(enumerate(symbol.tolist())), "id bigint, s int"))
    both = pairs.join(names.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
    both = both.join(names.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    cells = both.groupBy("sa", "sb").agg(F.sum("n").alias("n")).toPandas()  # SYMBOLS^2 at most
    table = np.zeros((SYMBOLS, SYMBOLS))
    table[cells["sa"].to_numpy(int), cells["sb"].to_numpy(int)] = cells["n"].to_numpy(float)
    ends = int(id_counts[END])
    return Counts(words, sums["n"] + ends, sums["v"] + (ends > 0), ends, table, id_counts)


def fit(train: DataFrame, counts: Counts) -> Model:
    """``train`` are the ``tokenised`` training rows; every round reads its own."""
    model = build(counts.pairs, counts.id_counts)
    for r in range(ROUNDS):
        model.weights, _ = train_round(train.filter(F.col("_round") == r), model, r)
    return model


_SCORED = (
    "_row bigint, doc_id {id}, held_out boolean, n_tokens bigint, known bigint, base double, score double,"
    " rare array<bigint>, times array<bigint>"
)


def _scored(rows: DataFrame, model: Model, begins: np.ndarray, keys: np.ndarray, logs: np.ndarray, end_log: float) -> DataFrame:
    """Per row what can be told without a join: score, and the base of frequent words; rare words with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables()
        for batch in batches:
            for row, ids, bounds in Stored.of(batch.column(3)).slices():
                score = score_ids(model, tables, ids, bounds) / math.log(10)
                hashes, bounds = word_hashes(ids, bounds, begins)
                n, rows = len(bounds) - 1, W.row_of(bounds)
                kinds, which = np.unique(hashes, return_inverse=True)
                at = np.minimum(np.searchsorted(keys, kinds), max(len(keys) - 1, 0))
                frequent = keys[at] == kinds if len(keys) else np.zeros(len(kinds), bool)
                common = frequent[which]
                known = np.bincount(rows[common], minlength=n)
                base = np.bincount(rows[common], logs[at][which[common]] if len(keys) else None, minlength=n) + end_log
                found, times = np.unique(rows[~common] * len(kinds) + which[~common], return_counts=True)
                r, k = np.divmod(found, max(len(kinds), 1))
                offsets = pa.array(np.searchsorted(r, np.arange(n + 1)).astype(np.int32))
                own = [batch.column(i).slice(row, n) for i in range(3)]
                columns = [
                    *own,
                    pa.array(np.diff(bounds) + 1),
                    pa.array(known.astype(np.int64) + (end_log > 0)),
                    pa.array(base.astype(np.float64)),
                    pa.array(score),
                    pa.ListArray.from_arrays(offsets, pa.array(kinds[k])),
                    pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int64))),
                ]
                names = ["_row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "rare", "times"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    read = rows.select("_row", "doc_id", "held_out", "ids")
    return read.mapInArrow(run, _SCORED.format(id=rows.schema["doc_id"].dataType.simpleString()))


def lm_report(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    with open(path, "rb") as file:
        vocabulary = file.read()
    begins = begins_of(ranks_of(vocabulary))
    read = tokenised(docs, vocabulary)
    train = read.filter(~F.col("held_out"))
    counts = gather(train, begins)
    model = fit(train, counts)
    frequent = F.col("n") * FREQUENT > counts.tokens
    top = counts.words.filter(frequent).toArrow().sort_by("key")  # fewer than FREQUENT
    keys, logs = top["key"].to_numpy(), np.log10(top["n"].to_numpy().astype(float) + 1)
    end_log = math.log10(counts.ends + 1)
    rows = settle(_scored(read, model, begins, keys, logs, end_log), "scored")
    rare = rows.select("_row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("_row", F.col("w.rare").alias("key"), "w.times")
    found = rare.join(counts.words.filter(~frequent), "key").groupBy("_row").agg(
        F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"), F.sum("times").alias("more_known")
    )
    total = math.log10(counts.tokens + counts.kinds + 1)
    zero = F.lit(0)
    return rows.join(found, "_row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", zero)).alias("n_known"),
        F.lit(counts.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * total).alias("base_score"),
        "score",
    )
