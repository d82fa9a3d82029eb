"""The language model and the toxicity model."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from alertmill.llm import lm, toxicity
from alertmill.llm import words as W
from tests.llm import brute
from tests.llm.conftest import SCHEMA, sentence


@pytest.fixture(scope="module")
def small_model():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 1500, 4000)
    id_counts = np.bincount(ids, minlength=lm.IDS).astype(float)
    symbol = lm.symbols_of(id_counts)
    pairs = np.zeros((lm.SYMBOLS, lm.SYMBOLS))
    np.add.at(pairs, (symbol[ids[:-1]], symbol[ids[1:]]), 1)
    model = lm.build(pairs, id_counts)
    for k, w in model.weights.items():
        model.weights[k] = w + rng.normal(0, 0.3, w.shape)
    return model


def test_probabilities_of_all_ids_sum_to_one(small_model):
    tables = small_model.tables()
    before = [5, 17, 300]
    # every other row is an end, which the next row starts from
    ids = np.array([[*before, i, lm.END] for i in range(lm.IDS)]).ravel()
    bounds = np.append((np.arange(lm.IDS)[:, None] * 5 + [0, 4]).ravel(), len(ids))
    log_p = lm.score_ids(small_model, tables, ids, bounds)[::2]
    head = lm.score_ids(small_model, tables, np.array(before), np.array([0, 3]))[0]
    assert np.exp(log_p - head).sum() == pytest.approx(1, abs=1e-3)


def test_each_position_is_scored_once_from_what_stands_before(small_model):
    rng = np.random.default_rng(2)
    tables, ids = small_model.tables(), rng.integers(0, 1500, 100)
    ids[[36, 99]] = lm.END
    whole = lm.score_ids(small_model, tables, ids, np.array([0, 37, 37, 100]))
    assert whole[1] == 0
    assert whole[0] == pytest.approx(lm.score_ids(small_model, tables, ids[:37], np.array([0, 37]))[0], rel=1e-5)
    assert whole[2] == pytest.approx(lm.score_ids(small_model, tables, ids[37:], np.array([0, 63]))[0], rel=1e-5)
    changed = ids.copy()
    changed[80] = 3
    a, b = (lm.score_ids(small_model, tables, x[:60], np.array([0, 60]))[0] for x in (ids, changed))
    assert a == b


def test_gradients(small_model):
    rng = np.random.default_rng(3)
    x, opens = rng.integers(0, lm.SYMBOLS, (6, lm.SPAN)), np.array([True, False] * 3)
    place, target = rng.integers(0, lm.STEP, 6), rng.integers(0, lm.SYMBOLS, 6)
    _, grads = lm.gradient(small_model, small_model.weights, x, opens, place, target)
    for k, g in grads.items():
        at = tuple(rng.integers(0, n) for n in g.shape)
        moved = []
        for step in (1e-5, -1e-5):
            w = {n: v.copy() for n, v in small_model.weights.items()}
            w[k][at] += step
            moved.append(lm.gradient(small_model, w, x, opens, place, target)[0])
        assert (moved[0] - moved[1]) / 2e-5 == pytest.approx(g[at], rel=1e-3, abs=1e-8)


def test_gradient_of_whole_windows(small_model):
    rng = np.random.default_rng(9)
    x, opens = rng.integers(0, lm.SYMBOLS, (4, lm.SPAN)), np.array([True, False] * 2)
    goals = rng.integers(0, lm.SYMBOLS, (4, lm.STEP))
    goals[1, 5:] = -1
    loss, grads = lm.window_gradient(small_model, small_model.weights, x, opens, goals)
    row, place = np.nonzero(goals >= 0)
    alone = [lm.gradient(small_model, small_model.weights, x[[i]], opens[[i]], np.array([j]), goals[i, j]) for i, j in zip(row, place)]
    assert loss == pytest.approx(np.mean([x for x, _ in alone]), rel=1e-9)
    for k, g in grads.items():
        assert g == pytest.approx(np.mean([y[k] for _, y in alone], axis=0), rel=1e-6, abs=1e-12)


def test_attention_weights_are_never_subnormal(small_model, monkeypatch):
    rng, plain, subnormal = np.random.default_rng(4), np.exp, []
    x, opens = rng.integers(0, lm.SYMBOLS, (40, lm.SPAN)), np.array([True, False] * 20)
    goals = rng.integers(0, lm.SYMBOLS, (40, lm.STEP))
    steep = {k: (v * (20 if k == "product" else 1)).astype(np.float32) for k, v in small_model.weights.items()}

    def spy(*args, **named):
        found = plain(*args, **named)
        subnormal.append(np.count_nonzero((found > 0) & (found < np.finfo(np.float32).tiny)))
        return found

    monkeypatch.setattr(np, "exp", spy)
    loss, grads = lm.window_gradient(small_model, steep, x, opens, goals)
    assert subnormal and not any(subnormal)
    monkeypatch.setattr(lm, "FADE", -1e9)  # what is left out changes no sum
    all_loss, all_grads = lm.window_gradient(small_model, steep, x, opens, goals)
    assert any(subnormal) and loss == all_loss
    for k, g in grads.items():
        assert g == pytest.approx(all_grads[k], rel=1e-5, abs=1e-20)


def test_scores_are_those_of_the_formula(small_model):
    rng, m, w = np.random.default_rng(6), small_model, small_model.weights
    bounds = np.concatenate([np.arange(1201), 1200 + np.cumsum([5, 16, 17, 100])])  # more windows than a chunk
    ids = rng.integers(0, 1500, bounds[-1])
    ids[bounds[1:] - 1] = lm.END
    want = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        x, total = m.symbol[np.append(lm.END, ids[a : b - 1])], 0.0
        for j in range(b - a):
            seen = np.arange(max(j - j % lm.STEP - lm.BACK, 0), j + 1)
            e = m.embed[x[seen]]
            weight = np.exp(np.clip(e @ (m.embed[x[j]] @ w["product"]), -20, 20) + np.clip(w["distance"][j - seen], -20, 20))
            g = weight @ e / weight.sum() @ w["value"] + m.embed[x[j]] @ w["skip"]
            s = m.symbol[ids[a + j]]
            norm = np.log(m.by_class[x[j]] @ np.exp(g))
            total += m.log_pair[x[j], s] + g[m.of_class[s]] - norm + m.within[ids[a + j]]
        want.append(total)
    assert lm.score_ids(m, m.tables(), ids, bounds) == pytest.approx(want, rel=1e-5)


def test_distinct_keys():
    keys = np.random.default_rng(7).integers(0, 1 << 63, 50, dtype=np.uint64)[np.random.default_rng(8).integers(0, 50, 400)] * np.uint64(2)
    for some in (keys, keys[:1], keys[:0]):
        for got, want in zip(W.distinct(some), np.unique(some, return_index=True, return_inverse=True)):
            assert got.tolist() == want.tolist()


def test_training_looks_at_every_position_once(small_model, monkeypatch):
    rng, plain, seen = np.random.default_rng(3), lm.window_gradient, []

    def spy(model, weights, x, opens, goals):
        at = np.nonzero(goals >= 0)
        seen.extend(zip(x[:, lm.BACK :][at].tolist(), goals[at].tolist()))
        return plain(model, weights, x, opens, goals)

    monkeypatch.setattr(lm, "window_gradient", spy)
    ids, bounds = rng.integers(0, 5000, 9000), np.array([0, 1, 1, 40, 8000, 9000])
    ids[bounds[1:] - 1] = lm.END
    _, n = lm.train_slice(small_model, lm.Adam(small_model.weights), ids, bounds, rng)
    symbols = small_model.symbol[ids].tolist()
    before = [small_model.symbol[lm.END]] + symbols[:-1]
    assert n == 9000 and sorted(seen) == sorted(zip(before, symbols))


def test_words_are_told_apart_by_their_ids(monkeypatch):
    pieces = lm.Pieces(open(lm.VOCABULARY, "rb").read())
    rng = random.Random(4)
    common = [sentence(rng, 1) for _ in range(40)] + ["é" * 90, "x" * 200, "<|endoftext|>", "Ärger", "$$$", "a"]
    texts = [" ".join(rng.choices([*common, sentence(rng, 1)], k=60)).encode() for _ in range(30)]
    texts += [b"", b"\xff\xfe \xff \xfe\xff A \xff\xfe", b" \t\n", b"\xef\xbf\xbd a\xff a\xfe a"]
    offsets = np.cumsum([0, *map(len, texts)])
    part = W.Slice(0, len(texts), np.frombuffer(b"".join(texts), np.uint8), offsets)
    plain, bounds = lm.read_words(part)[2:]
    first = lm.read_ids(part, pieces)
    for held in (lm.HELD_WORDS, 60):  # the second time ids are forgotten again
        monkeypatch.setattr(lm, "HELD_WORDS", held)
        for _ in range(2):
            ids, id_bounds = lm.read_ids(part, pieces)
            assert ids.tolist() == first[0].tolist() and id_bounds.tolist() == first[1].tolist()
    hashes, own = lm.word_hashes(ids.astype(np.int64), id_bounds, lm.begins_of(lm.ranks_of(open(lm.VOCABULARY, "rb").read())))
    assert own.tolist() == bounds.tolist()
    assert len(set(zip(hashes, plain))) == len(set(hashes)) == len(set(plain))


def test_texts_are_read_once(docs):
    vocabulary = open(lm.VOCABULARY, "rb").read()
    assert lm.tokenised(docs, vocabulary).columns == ["_row", "doc_id", "held_out", "_round", "ids"]


def test_base_score(docs, rows):
    got = sorted((tuple(r) for r in lm.lm_report(docs).collect()), key=repr)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts: Counter = Counter()
    for i, t, *_ in rows:
        if not held(i):
            counts.update([*brute.words(brute.lower(t)), 0])
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t, *_ in rows:
        tokens = [*brute.words(brute.lower(t)), 0]
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens)
        want.append((i, held(i), len(tokens), sum(counts[x] > 0 for x in tokens), n, base))
    for g, w in zip(got, sorted(want, key=repr), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and g[6] < 0


def test_order_of_words_matters_to_the_score(spark):
    rng = random.Random(8)
    cycle = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    rows = []
    for i in range(120):
        k = rng.randrange(6)
        rows.append((i, " ".join(cycle[(k + j) % 6] for j in range(80)), "en", "s", 0))
    mixed = " ".join(rng.choices(cycle, k=80))
    docs = spark.createDataFrame([*rows, (500, mixed, "en", "s", 0)], SCHEMA)
    score = {r["doc_id"]: r["score"] for r in lm.lm_report(docs).collect()}
    assert score[500] < 2 * min(v for k, v in score.items() if k != 500)


def toxic_rows(n, seed):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        ws = sentence(rng, rng.randint(20, 120)).split()
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(2):
                ws.insert(rng.randrange(len(ws)), rng.choice(["moron", "Idiot,", "worthless"]))
        docs.append((i, " ".join(ws), "en", "s", 0))
        labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity_on_held_out_rows(spark):
    docs, labels = toxic_rows(1500, 6)
    report = toxicity.toxicity_report(
        spark.createDataFrame([*docs, (9001, None, "en", "s", 0), (9002, "", "en", "s", 0)], SCHEMA),
        spark.createDataFrame([*labels, (1, None), (77_777, 1)], "doc_id bigint, toxic int"),
    )
    got = {r["doc_id"]: r for r in report.collect()}
    truth = dict(labels)
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in set(held)) for i in truth)
    right = sum(got[i]["predicted"] == truth[i] for i in held)
    assert right >= 0.97 * len(held)
    assert got[9001]["score"] == got[9002]["score"] < 0.5


def test_toxicity_weights_are_sparse_and_labels_of_held_out_rows_unused(spark):
    docs, labels = toxic_rows(600, 7)
    table = spark.createDataFrame(docs, SCHEMA)
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    a, b = (toxicity.fit(table, spark.createDataFrame(x, "doc_id bigint, toxic int")) for x in (labels, flipped))
    assert a.buckets.tolist() == b.buckets.tolist() and np.allclose(a.values, b.values)
    assert 0 < len(a.buckets) < 5000


def test_toxicity_fit_reads_16000_rows_eight_times(spark):
    short = "doc_id bigint, text string"
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(["aa", "bb", "cc", "dd", "vile"], k=4))) for i in range(19_000)]
    flags = spark.createDataFrame([(i, int("vile" in t)) for i, t in rows], "doc_id bigint, toxic int")
    docs = spark.createDataFrame(rows, short)
    sample = toxicity._sample(docs, flags, toxicity.FIT_ROWS)
    used = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i, _ in rows)
    assert 12_500 < used < 16_000 and sample.count() == used
    shares: dict[int, list] = {}
    for r in sample.collect():
        shares.setdefault(r["share"], []).append(r)
    common = toxicity.State.fresh()
    for _ in range(8):
        states = []
        for own in shares.values():
            states.append(toxicity.State(common.z.copy(), common.n.copy()))
            for r in sorted(own, key=lambda r: r["place"]):
                states[-1].learn(np.array([*r["x"], toxicity.BUCKETS]), r["label"])
        common = toxicity.State(*(np.mean([getattr(x, c) for x in states], axis=0) for c in ("z", "n")))
    want = common.weights(slice(None))
    got = toxicity.fit(docs, flags)
    assert got.buckets.tolist() == np.flatnonzero(want[:-1]).tolist()
    assert np.allclose(got.values, want[got.buckets]) and got.bias == pytest.approx(want[-1])


def test_without_labels_or_rows(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r["score"] for r in toxicity.toxicity_report(docs, none).collect()} == {0.5}
    assert toxicity.toxicity_report(empty, none).count() == 0
    assert lm.lm_report(empty).count() == 0
