"""Ranks, frames, running values and quantiles across partitions, with a hot key."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from alertmill.operators import ordered as O


@pytest.fixture
def skewed(many_parts):
    rng = np.random.default_rng(3)
    keys = ["hot"] * 300 + ["b"] * 7 + ["c"] * 2 + ["d"]
    pdf = pd.DataFrame({"k": keys, "t": rng.permutation(len(keys)), "v": rng.normal(size=len(keys)).round(1)})
    pdf["id"] = np.arange(len(keys))
    return many_parts.createDataFrame(pdf), pdf


def test_rank_and_size(skewed):
    df, pdf = skewed
    got = O.core(O.ranked(df, ["k"], ["t"], parts=6), keep=["_rank", "_n"]).toPandas().set_index("id").sort_index()
    assert (got["_rank"] == pdf.groupby("k")["t"].rank().astype(int)).all()
    assert (got["_n"] == pdf.groupby("k")["t"].transform("size")).all()


def test_no_part_holds_a_hot_key(skewed):
    df, _ = skewed
    assert O.spread(df, ["k"], ["t"], parts=6).groupBy("k", "_part").count().agg(F.max("count")).first()[0] < 120


@pytest.mark.parametrize(("before", "after"), [(4, 0), (0, 3), (5, 5), (40, 0)])
def test_frames_reach_over_parts(skewed, before, after):
    df, pdf = skewed
    rows = O.ranked(df, ["k"], ["t"], before=before, after=after, parts=40)
    w = O.part_window(["k"]).rowsBetween(-before, after)
    got = O.core(rows.withColumn("s", F.sum("v").over(w)).withColumn("c", F.count("v").over(w))).toPandas()
    got = got.set_index("id").sort_index()
    for _, part in pdf.sort_values("t").groupby("k"):
        v = part["v"].to_numpy()
        for i, rid in enumerate(part["id"]):
            inside = v[max(0, i - before) : i + after + 1]
            assert got.loc[rid, "c"] == len(inside)
            assert got.loc[rid, "s"] == pytest.approx(inside.sum())


def test_running_sum_and_max(skewed):
    df, pdf = skewed
    rows = O.spread(df, ["k"], ["t"], parts=5)
    got = O.running(rows, ["k"], ["t"], {"s": F.col("v")}, {"m": F.col("v")}).toPandas().set_index("id").sort_index()
    p = pdf.sort_values("t")
    assert np.allclose(got["s"], p.groupby("k")["v"].cumsum().sort_index())
    assert np.allclose(got["m"], p.groupby("k")["v"].cummax().sort_index())
    assert np.allclose(got["s_total"], pdf.groupby("k")["v"].transform("sum"))


def test_quantiles_equal_numpy(skewed):
    df, pdf = skewed
    probs = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.99, "e": 1.0}
    got = O.quantiles(df, ["k"], "v", probs).toPandas().set_index("k")
    for k, part in pdf.groupby("k"):
        assert np.allclose(got.loc[k, list(probs)].astype(float), np.quantile(part["v"], list(probs.values())))


def test_hashed_rank_is_a_permutation(skewed):
    df, pdf = skewed
    got = O.hashed_rank(df, ["k"], O.shuffle_token(1, "id"), "id").toPandas()
    for _, part in got.groupby("k"):
        assert sorted(part["_rank"]) == list(range(1, len(part) + 1))


def test_quantiles_of_odd_values(spark):
    """Ties, huge ranges, infinities, NaN last, signed zeros, one row and none."""
    inf, nan = float("inf"), float("nan")
    groups = {
        "ties": [1.0] * 50 + [2.0] * 3,
        "wide": [-1.7e308, -1.0, 5e-324, 1e-300, 0.0, 3.0, 1.7e308],
        "tail": [*(i / 1e6 for i in range(2000)), 1e300],
        "inf": [-inf, -inf, 1.0, 2.0, 3.0, inf],
        "nan": [1.0, 2.0, 3.0, nan, nan],
        "one": [7.0],
        "none": [None],
    }
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double").repartition(3)
    got = {r["k"]: r for r in O.quantiles(df, ["k"], "v", {"a": 0.25, "b": 0.5, "c": 0.75}).collect()}
    assert set(got) == set(groups) - {"none"}
    for k in ("ties", "wide", "tail", "one"):
        assert np.allclose([got[k][c] for c in "abc"], np.quantile(groups[k], [0.25, 0.5, 0.75]), rtol=1e-15, atol=0), k
    assert (got["inf"]["b"], got["nan"]["b"]) == (1.5, 3.0) and np.isnan(got["nan"]["c"])
    assert O.quantiles(df.filter("k = 'none'"), [], "v", {"a": 0.5}).collect() == [(None,)]


def test_quantiles_exchange_counts_only(spark):
    """No row is ranged or sorted: the plans hold no range exchange, whatever the values."""
    q = O.quantiles(spark.range(50_000).select((F.col("id") * 37 % 1009).alias("v")), [], "v", {"a": 0.1, "b": 0.9})
    assert "rangepartitioning" not in q._jdf.queryExecution().toString()
    assert np.allclose(list(q.first()), np.quantile(np.arange(50_000) * 37 % 1009, [0.1, 0.9]))
