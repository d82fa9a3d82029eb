"""Join, suffix dedup, mixing and sharding against plain versions."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from alertmill.llm import common, components, mixing, ngram_join, sharding, sketch_dedup, suffix_dedup, words
from tests.llm import brute
from tests.llm.conftest import SCHEMA, sentence


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(120)] + [(300, 300 + k) for k in range(1, 60)]
    edges += [(400 + k, 401 + k) for k in range(40)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()))
    parent: dict[int, int] = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = top(u), top(v)
            parent[max(a, b)] = min(a, b)
    assert got == {x: top(x) for x in parent}


def near_copies(seed, groups, size, words, edits):
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        body = sentence(rng, words).split()
        for _ in range(size):
            own = list(body)
            for _ in range(rng.randint(0, edits)):
                own[rng.randrange(len(own))] = sentence(rng, 1)
            out.append(" ".join(own))
    return out


@pytest.mark.parametrize("direct, pivots", [(4, 4), (0, 1)])
def test_join_equals_all_pairs(spark, rows, monkeypatch, direct, pivots):
    """With direct = 0 the first order takes pivots as long as they find links; with one pivot the last order takes several rounds."""
    monkeypatch.setattr(ngram_join, "DIRECT", direct)
    monkeypatch.setattr(ngram_join, "PIVOTS", pivots)
    texts = [t for _, t, *_ in rows]
    texts += near_copies(5, 3, 8, 90, 4) + near_copies(6, 2, 6, 400, 12) + near_copies(7, 2, 5, 262, 9) + near_copies(8, 4, 4, 12, 1)
    texts += [f"{texts[0]} {sentence(random.Random(9), 3)}", "solo", "SOLO", " solo\n"]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA).repartition(4)
    sets = [brute.shingle_set(t) for t in texts]
    want = {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, brute.components(sets)))}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_report(docs).collect()}
    assert got == want


def test_one_document_of_each_group(clashing, rows):
    kept = ngram_join.without_copies(clashing)
    assert kept.columns == clashing.columns
    texts = [t for _, t, *_ in rows]
    of = brute.components([brute.shingle_set(t) for t in texts])
    ids: dict[int, list] = {}
    for (i, *_), c in zip(rows, of):
        ids.setdefault(c, []).append(i)
    want = [min((x for x in v if x is not None), default=None) for v in ids.values()]
    assert sorted(map(repr, (r["doc_id"] for r in kept.collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("direct", [4, 0])
def test_stage_takes_five_words_and_four_fifths(spark, rows, monkeypatch, direct):
    monkeypatch.setattr(ngram_join, "DIRECT", direct)
    texts = [t for _, t, *_ in rows]
    texts += near_copies(5, 3, 8, 90, 4) + near_copies(6, 2, 6, 400, 12) + near_copies(7, 3, 5, 262, 9) + near_copies(8, 4, 4, 12, 1)
    for seed, n in enumerate((60, 130, 245, 262, 330, 500)):
        body = sentence(random.Random(20 + seed), n).split()
        # one block of new words, on both sides of the threshold
        texts.append(" ".join(body))
        for block in (n // 12, n // 10, n // 8):
            texts.append(" ".join([*body[:20], *sentence(random.Random(30 + seed + block), block).split(), *body[20 + block :]]))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA).repartition(4)
    want, coarse = (set(brute.components([brute.shingle_set(t, k) for t in texts], *share)) for k, share in ((5, (4, 5)), (4, (85, 100))))
    assert len(want) < len(coarse)
    assert {r["doc_id"] for r in ngram_join.without_copies(docs).collect()} == want


@pytest.mark.parametrize("group", [2048, 1])
def test_repeated_bytes(spark, rows, monkeypatch, group):
    """With group = 1 all hashes with several texts are counted instead of merged."""
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    texts = [t for _, t, *_ in rows] + ["x" * 199, "q" * 201, "abc" * 100, "é" * 120 + sentence(random.Random(1), 60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: tuple(r[1:]) for r in suffix_dedup.repeat_report(docs).collect()}
    for i, (removed, runs, kept) in enumerate(brute.without_repeated(texts)):
        assert got[i] == (len((texts[i] or "").encode()), removed, runs, hashlib.sha256(kept).hexdigest())


def test_merge_of_shards_is_that_of_one_shard():
    rng = random.Random(3)
    base = bytes(rng.choices(b"abcd", k=600))
    texts = [base[rng.randrange(100) :][:400] + bytes(rng.choices(b"abcd", k=50)) for _ in range(12)]
    whole = suffix_dedup.merged_repeats([texts])
    dealt = suffix_dedup.merged_repeats([texts[:5], texts[5:6], texts[6:]])
    assert [(i, p.tolist()) for i, p in whole] == [(i, p.tolist()) for i, p in dealt]


def test_merge_visits_only_rows_that_can_become_windows(monkeypatch):
    rng = random.Random(4)
    base = bytes(rng.choices(b"abcdefgh", k=240))
    texts = [bytes(rng.choices(b"abcdefgh", k=20)) + base + bytes(rng.choices(b"abcdefgh", k=20)) for _ in range(40)]
    plain, visited = np.argsort, []

    def counting(values, *args, kind=None, **more):
        if kind == "stable":
            visited.append(len(values))
        return plain(values, *args, kind=kind, **more)

    monkeypatch.setattr(np, "argsort", counting)
    found = suffix_dedup.merged_repeats([texts[:25], texts[25:]])
    places = Counter(t[p : p + 200] for t in texts for p in range(len(t) - 199))
    assert [(i, p.tolist()) for i, p in found] == [(i, [p for p in range(len(t) - 199) if places[t[p : p + 200]] > 1]) for i, t in enumerate(texts)]
    windows = sum(len(t) - 199 for t in texts)
    assert max(visited) <= windows and sum(visited) <= 100 * windows


@pytest.mark.parametrize("letters", [b"a", b"ab", b"the quick brown fox", bytes(range(256))])
def test_transform_orders_suffixes(letters):
    rng = random.Random(5)
    texts = [bytes(rng.choices(letters, k=n)) for n in (1, 7, 0, 180, 150, 63, 64, 65)]
    texts += [texts[3][20:150], texts[3], texts[4] + texts[3][:40]]
    before, lf, owner, place = suffix_dedup.transform(texts)
    want = sorted(((t[p:], i, p) for i, t in enumerate(texts) for p in range(len(t) + 1)))
    assert list(zip(owner.tolist(), place.tolist())) == [(i, p) for _, i, p in want]
    row = {(i, p): r for r, (_, i, p) in enumerate(want)}
    assert before.tolist() == [texts[i][p - 1] if p else -1 for _, i, p in want]
    assert lf.tolist() == [row[i, p - 1] if p else -1 for _, i, p in want]


def test_segments_hold_each_window_once():
    rng = random.Random(6)
    texts = ["", "x" * 199, "y" * 200, "z" * 950, sentence(rng, 300), "", sentence(rng, 90), "é" * 150, sentence(rng, 200) * 2, "x" * 50]
    (part,) = words.slices(pa.array(texts))
    row, start, count, h, c, weight = suffix_dedup.segments(part)
    starts = [(int(r), int(s) + k) for r, s, n in zip(row, start, count) for k in range(n)]
    assert starts == [(r, s) for r, t in enumerate(texts) for s in range(len(t.encode()) - 199)]
    assert count.max() <= suffix_dedup.SPAN
    bodies = [texts[r].encode()[s : s + n + 199] for r, s, n in zip(row, start, count)]
    assert len(set(bodies)) == len(set(c.tolist())) == len(set(zip(bodies, c.tolist())))
    # equal windows are in segments of one hash, of weight 2 if both are in one text
    of: dict[bytes, set] = {}
    times: Counter = Counter()
    heavy: set = set()
    for r, body, own, w in zip(row.tolist(), bodies, h.tolist(), weight.tolist()):
        for k in range(len(body) - 199):
            window = body[k : k + 200]
            of.setdefault(window, set()).add(own)
            times[r, window] += 1
            heavy |= {(r, window)} if w == 2 else set()
    assert all(len(own) == 1 for own in of.values())
    assert {key for key, n in times.items() if n > 1} <= heavy
    assert (weight[row == 4] == 1).all()


def test_kept_bytes(clashing, rows):
    out = suffix_dedup.without_repeats(clashing)
    assert out.columns == [*clashing.columns, "kept_bytes"]
    want = sorted(k for _, _, k in brute.without_repeated([t for _, t, *_ in rows]))
    assert sorted(bytes(r["kept_bytes"]) for r in out.collect()) == want


def targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    budget, stopped = 1.5 * sum(sizes.values()), set()
    while True:
        level = (budget - sum(2 * sizes[s] for s in stopped)) / sum(w for s, w in weight.items() if s not in stopped)
        above = {s for s in names if 2 * sizes[s] < weight[s] * level}
        if above == stopped:
            return {s: 2.0 * sizes[s] if s in stopped else weight[s] * level for s in names}
        stopped = above


def test_mixture(docs, rows, clashing):
    sizes: dict = {}
    for _, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(brute.words(t))
    want = targets(sizes)
    got = mixing.mix_report(docs).collect()
    assert len(got) == len(rows)
    by_id = {r[0]: r[3] for r in rows}
    taken: dict = {}
    for r in got:
        s = by_id[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] = taken.get(s, 0) + r["taken"]
    longest = max(len(brute.words(t)) for _, t, *_ in rows)
    assert all(abs(taken[s] - want[s]) <= longest for s in want)
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix_report(docs.repartition(7)).collect()))
    full = mixing.mix(clashing)
    assert full.columns == clashing.columns
    assert sum(len(brute.words(r["text"])) for r in full.collect()) == sum(taken.values())


def test_free_space_takes_the_tightest():
    rng, space, plain = random.Random(1), sharding.FreeSpace(), []
    for k in range(400):
        if rng.random() < 0.6:
            item = (rng.randint(0, 50), k)
            space.add(*item)
            plain.append(item)
        else:
            size = rng.randint(0, 60)
            fit = min((x for x in plain if x[0] >= size), default=None)
            assert space.take(size) == fit
            if fit:
                plain.remove(fit)


def test_packing():
    rng = random.Random(2)
    sizes = [rng.randint(1, 50) for _ in range(500)]
    bins = sharding.pack(sizes, 100)
    fill: dict[int, int] = {}
    for s, b in zip(sizes, bins):
        fill[b] = fill.get(b, 0) + s
    assert max(fill.values()) <= 100 and len(fill) <= -(-sum(sizes) // 100) + 2
    even = sharding.even_pack([*sizes, 100_000], 7)
    rest = [sum(s for s, b in zip(sizes, even) if b == k) for k in range(7) if k != even[-1]]
    assert max(rest) - min(rest) <= 5 and even.count(even[-1]) == 1
    assert sharding.even_pack([], 24) == [] and set(sharding.even_pack([5, 5], 24)) == {0, 1}
    with pytest.raises(ValueError):
        sharding.pack([5], 4)


def test_shards(clashing, rows):
    got = sharding.shard_report(clashing).collect()
    assert len(got) == len(rows)
    slots: dict[int, list] = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(24))
    text = {r[0]: r[1] for r in rows}
    shard_of: dict = {}
    for r in got:
        body = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(body) + 8, zlib.crc32(body))
        assert shard_of.setdefault(body, r["shard"]) == r["shard"]


@pytest.mark.parametrize(
    "run",
    [ngram_join.join_report, ngram_join.without_copies, suffix_dedup.repeat_report, mixing.mix_report, mixing.mix, sharding.shard_report],
)
def test_empty_tables(empty, run):
    assert run(empty).count() == 0


def test_labels_extended_link_by_link_equal_one_search(spark):
    rng = random.Random(4)
    edges = [(u, v) for u, v in ((rng.randrange(60), rng.randrange(60)) for _ in range(45)) if u != v]
    labels = components.no_labels(spark.range(1))
    for low in range(0, len(edges), 16):
        labels = components.extended(labels, spark.createDataFrame(edges[low : low + 16], "u bigint, v bigint"))
    whole = components.components(spark.createDataFrame(edges, "u bigint, v bigint"))
    assert sorted(map(tuple, labels.collect())) == sorted(map(tuple, whole.collect()))


def test_rows_of_shuffles_no_text_while_few_are_named(spark, monkeypatch):
    own = spark.range(100).select((F.col("id") * 3).alias("_row"), F.col("id").cast("string").alias("text"))
    few = spark.createDataFrame([(3,), (9,), (298,)], "cid bigint")
    many = own.filter("_row % 2 = 0").select("_row")
    got = lambda df: sorted(r["_row"] for r in df.collect())
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    monkeypatch.setattr(common, "BROADCAST_IDS", 60)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wide, rest = common.rows_of(own, few), common.rows_of(own, many, own.select("_row"))
        assert "BroadcastHashJoin" in plan(wide) and "BroadcastHashJoin" in plan(rest)
        assert got(wide) == [3, 9] and got(rest) == list(range(0, 300, 6))
        monkeypatch.setattr(common, "BROADCAST_IDS", 1)
        wide, rest = common.rows_of(own, few), common.rows_of(own, many, own.select("_row"))
        assert "SortMergeJoin" in plan(wide) and "SortMergeJoin" in plan(rest)
        assert got(wide) == [3, 9] and got(rest) == list(range(0, 300, 6))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_buckets_go_through_one_shuffle_of_all_keys(spark, monkeypatch):
    plans, plain = [], sketch_dedup.settle

    def spy(df, label="settled"):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return plain(df, label)

    monkeypatch.setattr(sketch_dedup, "settle", spy)
    classes = spark.createDataFrame([(1, 5, [7, 8]), (2, 6, [7, 9]), (3, 5, [10, 9]), (4, 4, [11, 12])], "cid bigint, n bigint, keys array<bigint>")
    rows = sorted(tuple(r) for r in sketch_dedup.buckets(classes).select("key", "cid", "n", "met").collect())
    assert rows == [(7, 1, 5, 2), (7, 2, 6, 4), (9, 2, 6, 4), (9, 3, 5, 2)]
    assert plans[0].count("explode(") == 1
