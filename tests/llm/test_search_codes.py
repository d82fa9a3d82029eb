"""Vector codes, sketch dedup and ranked search against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertmill.llm import ball_codes, ranked_search, sketch_dedup
from alertmill.llm import words as W
from tests.llm import brute
from tests.llm.conftest import SCHEMA, sentence
from tests.llm.test_groups import near_copies

VECTORS = "vec_id bigint, embedding array<float>, label int"


# --- vector codes


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """{vec_id: (code, error)}, the codebooks' numbers in order."""
    fine = [(i, v) for i, v, _ in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    fine = sorted((i, [math.floor(4096 * x) for x in v]) for i, v in fine)
    width = len(fine[0][1]) // parts
    cut = lambda v, p: v[p * width : p * width + width]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    books = [[cut(v, p) for _, v in fine[:entries]] for p in range(parts)]
    for turn in range(rounds + 1):
        near = [[min(range(len(b)), key=lambda e: (gap(cut(v, p), b[e]), e)) for p, b in enumerate(books)] for _, v in fine]
        if turn < rounds:
            for p, b in enumerate(books):
                for e in range(len(b)):
                    own = [cut(v, p) for (_, v), n in zip(fine, near) if n[p] == e]
                    if own:
                        b[e] = [sum(c) // len(own) for c in zip(*own)]
    codes = {i: ("".join(f"{c:02x}" for c in n), sum(gap(cut(v, p), books[p][c]) for p, c in enumerate(n))) for (i, v), n in zip(fine, near)}
    return codes, [x for b in books for c in b for x in c]


def vectors(seed, n, width=16, levels=7):
    """Few distinct values, so that distances tie."""
    rng = random.Random(seed)
    return [(i, [rng.randint(-levels, levels) / 4096 * 3 for _ in range(width)], rng.choice([0, 1, None])) for i in range(n)]


@pytest.mark.parametrize("n", [5, 16, 400])
def test_codes_equal_plain_rounds(spark, n):
    rows = vectors(n, n)
    rows += [(1000, None, 0), (1001, [], 0), (1002, [None] * 16, 0), (1003, [float("nan")] * 16, 1), (1004, [float("inf")] + [0.0] * 15, 1)]
    docs = spark.createDataFrame(rows, VECTORS).repartition(3)
    want, numbers = plain_codes(rows)
    got = ball_codes.code_report(docs).collect()
    assert {r["vec_id"]: (r["code"], r["error"]) for r in got} == want and len(got) == len(want)
    assert {r["codebooks_sha256"] for r in got} == {hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()}
    label = {i: x for i, _, x in rows}
    sums = Counter()
    for i, (_, error) in want.items():
        sums[label[i]] += error
    assert all(r["label_error"] == sums[label[r["vec_id"]]] for r in got)


def test_odd_vectors_and_columns(spark):
    rows = [*vectors(1, 30), (0, [0.5] * 16, 1), (None, [0.25] * 16, 0), (2000, [1.0] * 8, 0), (2001, [1.0] * 7, 0), (2002, [1e30] * 16, 0)]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], f"{VECTORS}, _q int, _doc string, code int")
    got = ball_codes.code_report(docs)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    found = [r["vec_id"] for r in got.collect()]
    assert found.count(0) == 2 and None in found and 2002 in found and not {2000, 2001} & set(found)
    kept, _ = ball_codes.coded(docs)
    assert kept.select("_doc.*").columns == docs.columns
    assert ball_codes.code_report(docs.limit(0)).count() == 0


def test_rings_save_distances_and_lose_none():
    rng = np.random.default_rng(3)
    centres = rng.integers(-2000, 2000, (16, 8))
    x = centres[rng.integers(0, 16, 4000)] + rng.integers(-150, 150, (4000, 8))
    all_gaps = ((x[:, None] - centres) ** 2).sum(axis=2)
    codes = all_gaps.argmin(axis=1)
    moved = centres + rng.integers(-60, 60, centres.shape) * (np.arange(16) % 2)[:, None]
    far = np.array([all_gaps[codes == e, e].max(initial=-1) for e in range(16)])
    books = ball_codes.Codebooks(centres[None]).moved_to(moved[None], far[None])
    new, work = ball_codes.reassigned(x, codes, books.balls[0])
    assert (new == ((x[:, None] - moved) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert work < 4000 * 16 / 4
    still = ball_codes.Codebooks(centres[None]).moved_to(centres[None], far[None])
    assert ball_codes.reassigned(x, codes, still.balls[0])[1] == 0


# --- sketches


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(5)
    pool = np.unique(rng.integers(0, 1 << 63, 4000, dtype=np.uint64))
    for n, shared in ((1, 1), (7, 6), (40, 34), (900, 800)):
        same = []
        for trial in range(40):
            own = rng.permutation(pool)[: 2 * n - shared]
            a, b = np.sort(own[:n]), np.sort(np.r_[own[:shared], own[n:]])
            got = sketch_dedup.sketches(np.r_[a, b], np.array([0, n, 2 * n]))
            assert (got != sketch_dedup._EMPTY).all()
            same.append((got[0] == got[1]).mean())
        jaccard = shared / (2 * n - shared)
        assert abs(np.mean(same) - jaccard) < 0.03
        # agreements are about as concentrated as independent ones
        assert np.std(same) < 1.6 * math.sqrt(jaccard * (1 - jaccard) / sketch_dedup.COORDINATES) + 0.01
    alone = sketch_dedup.sketches(pool[:5], np.array([0, 5]))
    assert (alone == sketch_dedup.sketches(pool[:12], np.array([0, 5, 12]))[:1]).all()


def corpus_with_copies(rows):
    texts = [t for _, t, *_ in rows]
    texts += near_copies(5, 3, 8, 90, 4) + near_copies(6, 2, 6, 400, 12) + near_copies(7, 1, 60, 120, 5) + near_copies(8, 4, 4, 12, 1)
    return texts + [f"{texts[0]} {sentence(random.Random(9), 3)}", "solo", "SOLO", " solo\n", "a b", "a  B", "one two three four"]


def test_dedup_equals_all_pairs(spark, rows, many_parts):
    texts = corpus_with_copies(rows)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA).repartition(4)
    own = [brute.shingle_set(t, 3) for t in texts]
    want = {i: (len(s), c, c == i) for i, (s, c) in enumerate(zip(own, brute.components(own)))}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in sketch_dedup.dedup_report(docs).collect()}
    assert got == want


def test_kept_documents(spark, clashing, rows):
    kept = sketch_dedup.without_copies(clashing)
    assert kept.columns == clashing.columns
    of = brute.components([brute.shingle_set(t, 5) for _, t, *_ in rows], 4, 5)
    ids: dict[int, list] = {}
    for (i, *_), c in zip(rows, of):
        ids.setdefault(c, []).append(i)
    want = [min((x for x in v if x is not None), default=None) for v in ids.values()]
    assert sorted(map(repr, (r["doc_id"] for r in kept.collect()))) == sorted(map(repr, want))
    report = {r["doc_id"]: r["kept"] for r in sketch_dedup.dedup_report(clashing).collect()}
    assert report[None] is True  # a row without id and without a copy


# --- ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_ranks(docs, items, k=20):
    bodies = [(i, TERM.findall(brute.lower(t))) for i, t in docs]
    total, n = sum(len(b) for _, b in bodies), sum(1 for _, b in bodies if b)
    df = Counter(w for _, b in bodies for w in set(b))
    out = []
    for item, text in items:
        scored = []
        for i, b in bodies:
            m = 75 + (25 * len(b) * n) // total
            tf, score = Counter(b), 0
            for w in TERM.findall(brute.lower(text)):
                if tf[w]:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * tf[w]) // (1000 * tf[w] + 12 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def items_of(rows):
    texts = [t or "" for _, t, *_ in rows]
    rng = random.Random(7)
    cuts = [" ".join(t.split()[5:40]) for t in texts[:12]]
    return [(100 + i, t) for i, t in enumerate([*cuts, "the of and", "THE the of", "zzz", None, "", "a1 é-ü_x", sentence(rng, 900)])] + [(100, cuts[0])]


@pytest.mark.parametrize("segment, block", [(4096, 200_000), (7, 60)])
def test_ranks_equal_plain_scores(spark, clashing, rows, monkeypatch, segment, block):
    monkeypatch.setattr(ranked_search, "SEGMENT_DOCS", segment)
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", block)
    items = items_of(rows)
    queries = spark.createDataFrame([(*i, 1, 2) for i in items], "item_id bigint, text string, query int, rank int")
    for k in (20, 3):
        got = ranked_search.ranked(clashing, queries, k)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=repr) == plain_ranks([r[:2] for r in rows], items, k)


def test_reading_stops_before_the_end():
    """A list of small impacts is read only for the documents that are still open."""
    rng = np.random.default_rng(2)
    docs = 5000
    strong = (np.arange(30), np.sort(rng.integers(5_000, 9_000, 30))[::-1].copy())
    weak = (rng.permutation(docs), np.sort(rng.integers(1, 90, docs))[::-1].copy())
    score = np.zeros(docs, np.int64)
    for which, impacts in (strong, weak):
        score[which] += impacts
    found, scores = ranked_search.nra([strong, weak], docs, 20, 1)
    top = set(np.lexsort((np.arange(docs), -score))[:20])
    assert top <= set(found) and (scores == score[found]).all() and len(found) <= 30
    none, _ = ranked_search.nra([strong, weak], docs, 20, 100_000)
    assert not len(none)


def test_search_of_nothing(spark, empty, docs, rows):
    queries = spark.createDataFrame(items_of(rows), "item_id bigint, text string")
    assert ranked_search.ranked(empty, queries).count() == 0
    assert ranked_search.ranked(docs, queries.limit(0)).count() == 0
    assert ranked_search.ranked(docs, queries.filter("text IS NULL")).count() == 0


@pytest.mark.parametrize("run", [sketch_dedup.dedup_report, sketch_dedup.without_copies])
def test_empty_documents(empty, run):
    assert run(empty).count() == 0


def test_very_long_texts(spark):
    """A run of a megabyte of letters, a text of 200 000 words and copies of them."""
    long = ["x" * 1_000_000, sentence(random.Random(3), 200_000), "short text here"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*long, *long])], "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in sketch_dedup.dedup_report(docs).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 0, 4: 1, 5: 2}
    items = docs.filter("doc_id < 3").select(F.col("doc_id").alias("item_id"), "text")
    best = {r["item_id"]: r["doc_id"] for r in ranked_search.ranked(docs, items).filter("rank = 1").collect()}
    assert best[0] == 0 and best[2] == 2
