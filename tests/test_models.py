"""Detectors and resampling against small restatements."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from alertmill.operators import detectors, forest, fusion, metrics, neighbours, prep, resample, robust, stats
from alertmill.sources import views

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    x[:12] = rng.normal(size=(12, 3)) + 6
    pdf = pd.DataFrame(x, columns=COLS).assign(id=np.arange(400), y=(np.arange(400) >= 12).astype(int))
    return spark.createDataFrame(pdf).repartition(4), pdf


def test_forest_isolates_outliers(cloud):
    df, pdf = cloud
    model = forest.IsolationForest.fit(df, COLS, "id", n_trees=40, sample_fraction=0.5, feature_fraction=1.0)
    s = model.transform(df).toPandas().set_index("id")["score"].sort_index()
    assert s[:12].mean() < s[12:].mean() - 0.1
    assert s.max() < 0 and s.min() > -1
    again = forest.IsolationForest.fit(df.repartition(7), COLS, "id", n_trees=40, sample_fraction=0.5, feature_fraction=1.0)
    assert np.allclose(again.transform(df).toPandas().set_index("id")["score"].sort_index(), s)


def test_forest_leaf_sizes_are_true_counts(cloud):
    df, pdf = cloud
    model = forest.IsolationForest.fit(df, COLS, "id", n_trees=5, feature_fraction=1.0)
    keys = df.select("id", F.xxhash64("id").alias("k")).toPandas().set_index("id")["k"].sort_index().to_numpy()
    for t in model.trees:
        taken = resample.hashed_uniform(keys, t.seed) < t.rate
        at = t.walk(pdf[COLS].to_numpy()[taken])
        n = np.bincount(at, minlength=len(t.feature))
        leaves = np.array(t.feature) < 0
        assert (n[leaves] == np.array(t.size)[leaves]).all()
        assert t.size[0] == taken.sum()


def test_perceptron_weights_are_read_right(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [[float(v) for v in rng.normal(size=2)] for _ in range(3)], int(i % 3 == 0)) for i in range(90)]
    q = spark.createDataFrame(rows, "id int, sequence array<array<double>>, y int")
    data = q.select(F.col("y").cast("double").alias("label"), array_to_vector(F.flatten("sequence")).alias("features"))
    m = MultilayerPerceptronClassifier(layers=[6, 5, 4, 2], maxIter=20, seed=3).fit(data)
    mine = detectors.SequenceClassifier("mlp", [6, 5, 4, 2], m.weights.toArray())
    want = np.array([r[0] for r in m.transform(data).select(vector_to_array("probability")[1]).collect()])
    x = np.array([np.ravel(r[1]) for r in rows])
    assert np.allclose(mine.score_array(x), want, atol=1e-9)


def test_nearest_equals_brute_force(many_parts, monkeypatch):
    monkeypatch.setattr(neighbours, "CHUNK", 40)
    rng = np.random.default_rng(5)
    r, q = rng.normal(size=(300, 4)), rng.normal(size=(60, 4))
    r[:100] = r[0]  # a crowded spot
    refs = many_parts.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(r)], "ref_id long, v array<double>")
    asks = many_parts.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(q)], "query_id long, v array<double>")
    got = {row["query_id"]: row["near"] for row in neighbours.nearest(asks, refs, 7, pivots=10).collect()}
    for i, v in enumerate(q):
        want = np.sort(np.linalg.norm(r - v, axis=1))[:7]
        assert np.allclose([h["dist"] for h in got[i]], want, atol=1e-6)


@pytest.mark.parametrize("least", [1, 6])
def test_each_block_gives_a_query_its_best_hits_once(many_parts, monkeypatch, least):
    """Many equal distances, ids as tie-break, the query itself left out; hits per query grow with blocks, not with cells."""
    monkeypatch.setattr(neighbours, "CHUNK", 400)
    monkeypatch.setattr(neighbours, "LEAST_BLOCKS", least)
    seen, best = [], neighbours._best
    monkeypatch.setattr(neighbours, "_best", lambda hits, k: seen.append(hits) or best(hits, k))
    rng = np.random.default_rng(11)
    x = rng.integers(0, 3, (300, 6)).astype(float)
    ids = rng.permutation(300)
    table = [(int(i), [float(c) for c in v]) for i, v in zip(ids, x, strict=True)]
    refs = many_parts.createDataFrame(table, "ref_id long, v array<double>")
    found = neighbours.nearest(refs.withColumnRenamed("ref_id", "query_id"), refs, 5, pivots=30, skip_self=True).collect()
    assert len(found) == 300
    at = dict(zip(ids.tolist(), x, strict=True))
    for row in found:
        want = sorted((float(np.sqrt(((at[row["query_id"]] - v) ** 2).sum())), i) for i, v in at.items() if i != row["query_id"])[:5]
        assert [h["ref_id"] for h in row["near"]] == [i for _, i in want]
        assert [h["dist"] for h in row["near"]] == pytest.approx([d for d, _ in want])
    # the own cell and the blocks; 30 cells would give up to 150 hits
    assert max(r["count"] for r in seen[0].groupBy("query_id").count().collect()) <= 5 * (1 + least + 2)


def test_outlier_factor_of_several_sets_takes_one_reference(many_parts):
    rng = np.random.default_rng(12)
    r, q = rng.normal(size=(120, 4)), rng.normal(size=(30, 4))
    refs = many_parts.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(r)], "ref_id long, v array<double>")
    asks = many_parts.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(q)], "query_id long, v array<double>")
    known = neighbours.reference_densities(refs, 6, pivots=5)
    alone, shared = neighbours.local_outlier_factor(asks, refs, 6, pivots=5), neighbours.local_outlier_factor(asks, refs, 6, pivots=5, known=known)
    assert alone.orderBy("query_id").collect() == shared.orderBy("query_id").collect()
    among, between = (np.linalg.norm(a[:, None] - r[None], axis=2) for a in (r, q))
    np.fill_diagonal(among, np.inf)
    near, kdist = np.argsort(among, axis=1)[:, :6], np.sort(among, axis=1)[:, 5]
    lrd = 1 / np.maximum(np.take_along_axis(among, near, 1), kdist[near]).mean(axis=1)
    at = np.argsort(between, axis=1)[:, :6]
    mine = 1 / np.maximum(np.take_along_axis(between, at, 1), kdist[at]).mean(axis=1)
    assert [x["score"] for x in shared.orderBy("query_id").collect()] == pytest.approx(list(-lrd[at].mean(axis=1) / mine), rel=1e-6)


def test_poisson_weights_are_poisson():
    w = resample.poisson_weights(np.arange(20000) * 7919, np.arange(5), 42)
    assert np.allclose(w.mean(axis=0), 1.0, atol=0.03)
    assert np.allclose(w.var(axis=0), 1.0, atol=0.05)
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.03


def test_replicate_metrics_equal_direct_weights(many_parts):
    rng = np.random.default_rng(6)
    n = 500
    p, y = rng.random(n).round(2), rng.integers(0, 2, n)
    p[:200] = 0.5  # a hot score
    df = many_parts.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(p, y, strict=True))], "id long, p double, y int")
    got = resample.replicate_metrics(df, "id", replicates=4).toPandas().set_index("replicate")
    keys = df.select("id", F.xxhash64("id").alias("k")).toPandas().set_index("id")["k"].sort_index().to_numpy()
    w = resample.poisson_weights(keys, np.arange(4), 42)
    for b in range(4):
        wp, wn = w[:, b] * (y == 1), w[:, b] * (y == 0)
        higher = (p[:, None] > p[None, :]) + 0.5 * (p[:, None] == p[None, :])
        assert got.loc[b, "auc"] == pytest.approx((wp @ higher @ wn) / (wp.sum() * wn.sum()))
        ap = 0.0
        for v in np.unique(p):
            c0, c1 = wn[p <= v].sum(), wp[p <= v].sum()
            ap += wn[p == v].sum() / wn.sum() * (c0 / (c0 + c1) if c0 + c1 else 0.0)
        assert got.loc[b, "auprc"] == pytest.approx(ap)
        assert got.loc[b, "tpr"] == pytest.approx(wn[p < 0.5].sum() / wn.sum())


def test_drawn_counts_are_those_of_the_weights(monkeypatch):
    keys = np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 40_000)
    for rows in (1, 100, 40_000):
        got = np.concatenate([w.copy() for _, w in resample.drawn(keys[:rows], np.arange(9), 42)])
        assert (got.T == resample.poisson_weights(keys[:rows], np.arange(9), 42)).all()
    # also where the upper bits leave the count open
    monkeypatch.setattr(resample, "_COARSE", np.full(1 << 16, -1, np.float32))
    got = np.concatenate([w.copy() for _, w in resample.drawn(keys[:500], np.arange(9), 42)])
    assert (got.T == resample.poisson_weights(keys[:500], np.arange(9), 42)).all()


@pytest.mark.parametrize("kind", ["few scores", "own scores", "both"])
def test_replicate_metrics_are_dealt_by_rows(many_parts, monkeypatch, kind):
    """Tasks hold even numbers of rows, also where many rows share a score, and no cut shows in the result."""
    monkeypatch.setattr(resample, "PART_ROWS", 50)
    dealt, spread = [], resample.spread
    monkeypatch.setattr(resample, "spread", lambda *a, **b: dealt.append(spread(*a, **b)) or dealt[-1])
    rng = np.random.default_rng(8)
    n = 2000
    p, y, block = rng.random(n), rng.integers(0, 2, n), np.arange(n) // 6
    if kind != "own scores":
        p[: n if kind == "few scores" else n // 2] = rng.integers(0, 100, n)[: n if kind == "few scores" else n // 2] / 100
    p[:30] = p[30]
    table = [(int(k), float(a), int(b)) for k, a, b in zip(block, p, y, strict=True)]
    df = many_parts.createDataFrame(table, "block long, p double, y int")
    got = resample.replicate_metrics(df, "block", replicates=5).toPandas().set_index("replicate")
    assert sorted(got.index) == list(range(5))
    assert max(r["count"] for r in dealt[0].groupBy("_part").count().collect()) <= 3 * 50
    keys = df.select("block", F.xxhash64("block").alias("k")).distinct().toPandas().set_index("block")["k"].loc[block].to_numpy()
    w = resample.poisson_weights(keys, np.arange(5), 42)
    for b in range(5):
        wp, wn = w[:, b] * (y == 1), w[:, b] * (y == 0)
        higher = (p[:, None] > p[None, :]) + 0.5 * (p[:, None] == p[None, :])
        upto = p[:, None] <= p[None, :]
        c0, c1 = wn @ upto, wp @ upto
        assert got.loc[b, "auc"] == pytest.approx((wp @ higher @ wn) / (wp.sum() * wn.sum()))
        assert got.loc[b, "auprc"] == pytest.approx((wn * c0 / np.maximum(c0 + c1, 1)).sum() / wn.sum())
        assert got.loc[b, "tpr"] == pytest.approx(wn[p < 0.5].sum() / wn.sum())
        assert got.loc[b, "fpr"] == pytest.approx(wp[p < 0.5].sum() / wp.sum())


def test_an_interval_evaluates_its_replicates_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def values(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf.assign(**{m: pdf["replicate"] / 100 for m in resample.METRICS})

    made = spark.range(101).selectExpr("CAST(id AS INT) AS replicate").mapInPandas(
        values, "replicate int, auc double, auprc double, tpr double, fpr double"
    )
    for r in resample.bootstrap_interval(made).collect():
        assert (r["n_valid"], r["ci_lo"], r["ci_hi"]) == (101, pytest.approx(0.025), pytest.approx(0.975))
    assert seen.value == 101


def test_replicate_metrics_take_unknown_scores_as_the_highest(many_parts, monkeypatch):
    monkeypatch.setattr(resample, "PART_ROWS", 20)
    table = [(i, None if i % 3 == 0 else float("nan") if i % 3 == 1 else (i % 10) / 10, i % 2) for i in range(300)]
    df = many_parts.createDataFrame(table, "id long, p double, y int")
    got = resample.replicate_metrics(df, "id", replicates=3).orderBy("replicate").collect()
    want = resample.replicate_metrics(df.withColumn("p", F.when(F.col("id") % 3 == 2, F.col("p")).otherwise(9.0)), "id", replicates=3)
    assert got == want.orderBy("replicate").collect()


def test_replicate_moments_equal_direct_weights(cloud):
    df, pdf = cloud
    got = resample.replicate_moments(df, COLS, "y", "id", replicates=3).toPandas().set_index(["replicate", "cls", "feature"])
    keys = df.select("id", F.xxhash64("id").alias("k")).toPandas().set_index("id")["k"].sort_index().to_numpy()
    w = resample.poisson_weights(keys, np.arange(3), 42)
    x, one = pdf["b"].to_numpy(), pdf["y"].to_numpy() == 1
    n = w[one, 2].sum()
    mean = (w[one, 2] * x[one]).sum() / n
    row = got.loc[(2, "1", "b")]
    assert row["n"] == n
    assert row["var"] == pytest.approx((w[one, 2] * (x[one] - mean) ** 2).sum() / (n - 1))


def test_wide_moments_equal_numpy(spark):
    v = views.vectors(spark, "/root/testdata/sf0.001")
    cols = [f"x{i}" for i in range(20)]
    df = v.select(*[F.col("features")[i].alias(c) for i, c in enumerate(cols)])
    x = df.toPandas().to_numpy()
    mean, cov = prep.moments(df, cols)
    assert np.allclose(mean, x.mean(axis=0))
    assert np.allclose(cov, np.cov(x.T))


def test_platt_and_temperature(spark):
    rng = np.random.default_rng(8)
    p = rng.random(3000)
    y = (rng.random(3000) < 1 / (1 + np.exp(-(4 * p - 1)))).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y, strict=True)], "p double, y int")
    m = fusion.Platt.fit(df, "p")
    assert m.slope == pytest.approx(4.0, abs=0.6)
    assert m.intercept == pytest.approx(-1.0, abs=0.35)
    cal = df.withColumn("q", m.apply(F.col("p")))
    assert fusion.fit_temperature(cal, "q") == pytest.approx(1.0, abs=0.02)


def test_one_class_leaves_its_share_outside(cloud):
    df, _ = cloud
    normal = df.filter("y = 1")
    for kernel in ("rbf", "linear"):
        m = detectors.OneClassBoundary.fit(normal, COLS, nu=0.1, kernel=kernel, steps=5)
        out = m.transform(normal).agg(F.avg((F.col("score") < 0).cast("int"))).first()[0]
        assert out == pytest.approx(0.1, abs=0.02)
    m = detectors.OneClassBoundary.fit(normal, COLS, nu=0.1, steps=8)
    s = m.transform(df).withColumn("k", F.lit(0))
    assert metrics.auc(s, ["k"], "score").first()["auc"] > 0.95


def test_noise_is_normal_and_repeatable(spark):
    df = spark.range(20000).select("id", F.lit(1.0).alias("x"))
    a = robust.with_noise(df, ["x"], "id", F.lit(0.1), F.lit(7))
    row = a.agg(F.avg("x").alias("m"), F.stddev("x").alias("s")).first()
    assert row["m"] == pytest.approx(1.0, abs=0.005)
    assert row["s"] == pytest.approx(0.1, abs=0.005)
    b = robust.with_noise(df.repartition(5), ["x"], "id", F.lit(0.1), F.lit(7))
    assert a.join(b.withColumnRenamed("x", "z"), "id").filter("x <> z").count() == 0


def test_hot_values_keep_their_rank(many_parts):
    rng = np.random.default_rng(9)
    x = np.where(rng.random(500) < 0.5, 0.0, rng.normal(size=500))
    df = many_parts.createDataFrame([(i, float(v), float(-v)) for i, v in enumerate(x)], "id long, x double, z double")
    got = stats.rank_rows(df, ["x", "z"], "id").toPandas().set_index("id").sort_index()
    assert np.allclose(got["x"], pd.Series(x).rank())
    assert np.allclose(got["z"], pd.Series(-x).rank())


def test_moments_leave_missing_values_out_pair_by_pair(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 20))
    x[rng.random(x.shape) < 0.1] = np.nan
    cols = [f"x{i}" for i in range(20)]
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    mean, cov = prep.moments(spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(7), cols)
    assert np.allclose(mean, np.nanmean(x, axis=0))
    for i, j in ((0, 0), (0, 1), (4, 19), (7, 3)):
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        assert cov[i, j] == pytest.approx(np.cov(x[both, i], x[both, j])[0, 1])


def test_user_metric_sees_exact_scores_outside_the_unit_range(spark):
    rows = [(i, [-2.5, 0.25, 3.0][i % 3], i % 2) for i in range(60)]
    seen = resample.user_metric_replicates(
        spark.createDataFrame(rows, "id bigint, p double, y int"), lambda p, y, w: float(set(p) <= {-2.5, 0.25, 3.0}), "id", replicates=5
    )
    assert {r["value"] for r in seen.collect()} == {1.0}


def test_forest_height_follows_the_sample():
    assert forest.height(4096) == 12 and forest.height(100_000) == 17 and forest.height(2) == 1


def test_whole_tree_splits_every_leaf_by_its_rows():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3)).round(1)
    t = forest.grow_whole(x, [0, 2], 6, np.random.default_rng(1))
    todo, leaves = [(0, x, 0)], 0
    while todo:
        node, rows, depth = todo.pop()
        assert len(rows)
        f = t["feature"][node]
        if f < 0:
            leaves += 1
            constant = len(np.unique(rows[:, [0, 2]], axis=0)) == 1
            assert depth == 6 or constant
            assert t["path"][node] == pytest.approx(depth + forest.expected_path(np.array([len(rows)]))[0])
            continue
        assert f in (0, 2)
        right = rows[:, f] > t["cut"][node]
        todo += [(t["left"][node], rows[~right], depth + 1), (t["left"][node] + 1, rows[right], depth + 1)]
    assert 2 * leaves - 1 == len(t["feature"])
    walked = forest.path_lengths(x, tuple(t.values()))
    assert walked.mean() > 4 and set(walked) <= set(t["path"])


def test_tuning_scores_every_held_out_row_whatever_the_passes(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, i % 3, *map(float, rng.normal(size=2))) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, fold int, a double, b double")
    grid = {"trees_grid": (3, 7), "feature_grid": (0.5, 1.0), "sample_grid": (0.7, 1.0)}
    got = forest.tune(df, ["a", "b"], "id", **grid).toPandas()
    assert len(got) == 8 and got["mean_lcb"].between(-1, 0).all()
    monkeypatch.setattr(forest, "PASS_BYTES", 1)
    again = forest.tune(df.repartition(5), ["a", "b"], "id", **grid).toPandas()
    on = ["n_trees", "feature_fraction", "sample_fraction"]
    pd.testing.assert_frame_equal(*[g.sort_values(on).reset_index(drop=True) for g in (got, again)])
    pdf = forest.numbered(df, ["a", "b"], "id", "fold").toPandas()
    lcb = []
    for fold in range(3):
        seen, out = pdf[pdf["fold"] != fold], pdf[pdf["fold"] == fold]
        total = np.zeros(len(out))
        for t in forest.plan_trees(2, 7, 1.0, 1.0, 42, skip_fold=fold):
            order = np.argsort(resample.hashed_uniform(seen["key"].to_numpy(), t.seed), kind="stable")
            x = seen[["x0", "x1"]].to_numpy()[order]
            nodes = forest.grow_whole(x, t.allowed, forest.height(len(x)), np.random.default_rng([t.seed, 7]))
            total += forest.path_lengths(out[["x0", "x1"]].to_numpy(), tuple(nodes.values()))
        score = -np.power(2.0, -total / 7 / forest.expected_path(np.array([len(seen)]))[0])
        lcb.append(score.mean() - 2 * score.std())
    whole = got[(got["n_trees"] == 7) & (got["feature_fraction"] == 1.0) & (got["sample_fraction"] == 1.0)]
    assert whole["mean_lcb"].item() == pytest.approx(np.mean(lcb), abs=2e-5)


def test_tuning_of_no_rows_is_empty(spark):
    df = spark.createDataFrame([], "id long, fold int, a double")
    assert forest.tune(df, ["a"], "id", trees_grid=(2,)).count() == 0


def test_wide_linear_map_equals_numpy(spark):
    rng = np.random.default_rng(4)
    x, a = rng.normal(size=(6, 40)), rng.normal(size=(40, 40))
    before, after = rng.normal(size=40), rng.normal(size=40)
    cols = [f"c{i}" for i in range(40)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=cols).assign(id=range(6)))
    got = prep.linear_map(df, cols, a, before, after).toPandas().sort_values("id")
    assert list(got.columns) == ["id", *cols]
    assert np.allclose(got[cols].to_numpy(), (x - before) @ a + after)


def test_reconstruction_error_is_what_the_components_lose(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(80, 30)) @ rng.normal(size=(30, 30))
    cols = [f"c{i}" for i in range(30)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=cols).assign(id=range(80)))
    model = detectors.ReconstructionDetector.fit(df, cols)
    got = model.transform(df).toPandas().sort_values("id")["ae_z"].to_numpy()
    c = x - x.mean(axis=0)
    lost = ((c - c @ model.components @ model.components.T) ** 2).mean(axis=1)
    assert np.allclose(got, -(lost - lost.mean()) / (lost.std() + 1e-9), atol=1e-6)
