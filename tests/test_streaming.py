"""Streams must give what the batch gives on closed windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from alertmill.operators import fusion, prep
from alertmill.operators.detectors import SequenceClassifier
from alertmill.operators.forest import IsolationForest
from alertmill.plans.pipeline import Detection
from alertmill.schemas import SELECTED_FEATURES
from alertmill.session import scratch_path
from alertmill.streaming import live, serving

MIN = 60_000_000


@pytest.fixture(scope="module")
def files(spark):
    """Three streams in five files, in time order."""
    rng = np.random.default_rng(11)
    us = np.sort(rng.integers(0, 30 * 60 * MIN, 2500)) + 1_700_000_000_000_000
    us[100:140] = us[100]  # forty messages at one instant
    pdf = pd.DataFrame(
        {
            "us": us,
            "stream": rng.choice(["a", "b", "c"], 2500, p=[0.7, 0.2, 0.1]),
            "type": np.where(rng.random(2500) < 0.3, "emergency", "info"),
            "topic": rng.choice(["x", "y", "z"], 2500),
        }
    )
    df = spark.createDataFrame(pdf).withColumn("timestamp", F.timestamp_micros("us")).drop("us")
    path = scratch_path(spark, "incoming")
    cuts = [int(us[i]) for i in range(0, 2500, 500)] + [int(us[-1]) + 1]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        rows = df.filter((F.unix_micros("timestamp") >= lo) & (F.unix_micros("timestamp") < hi))
        rows.coalesce(1).write.mode("append").parquet(path)
    return path, pdf, df.schema


def truth(pdf: pd.DataFrame, stream: str, start: int) -> dict:
    w = pdf[(pdf["stream"] == stream) & (pdf["us"] >= start) & (pdf["us"] < start + 60 * MIN)].sort_values("us")
    t = w[w["type"] == "emergency"]["us"].to_numpy()
    gaps = np.diff(t) / MIN
    mid = w["us"].min() + 30 * MIN
    return {
        "n": len(w),
        "e": len(t),
        "mean": gaps.mean() if len(t) >= 2 else None,
        "var": gaps.var(ddof=1) if len(t) >= 3 else 0.0,
        "acc": float((t >= mid).sum() - (t < mid).sum()) if len(t) >= 4 else 0.0,
        "burst": np.unique(t // (5 * MIN), return_counts=True)[1].max() if len(t) else 0,
    }


def test_unordered_features(spark, files):
    path, pdf, schema = files
    out = scratch_path(spark, "live")
    stream = live.read_stream(spark, path, schema, files=1)
    live.run_to_table(live.live_windows(stream), out, scratch_path(spark, "state"))
    got = spark.read.parquet(out).withColumn("s", F.unix_micros("window_start_time")).toPandas()
    assert len(got) > 300 and not got.duplicated(["stream", "s"]).any()
    for r in got.itertuples():
        t = truth(pdf, r.stream, r.s)
        assert (r.n_messages, r.n_emergency, r.burst_score) == (t["n"], t["e"], t["burst"])


def test_ordered_features(spark, files):
    path, pdf, schema = files
    cells, out = scratch_path(spark, "cells"), scratch_path(spark, "ordered")
    live.run_to_table(live.second_cells(live.read_stream(spark, path, schema, files=1)), cells, scratch_path(spark, "s1"))
    stream = live.read_stream(spark, cells, spark.read.parquet(cells).schema)
    live.run_to_table(live.ordered_features(stream), out, scratch_path(spark, "s2"))
    got = spark.read.parquet(out).withColumn("s", F.unix_micros("window_start_time")).toPandas()
    assert len(got) > 300 and not got.duplicated(["stream", "s"]).any()
    for r in got.itertuples():
        t = truth(pdf, r.stream, r.s)
        assert (r.n_messages, r.n_emergency) == (t["n"], t["e"])
        assert r.alert_rate_acceleration == t["acc"]
        assert r.inter_interval_variance == pytest.approx(t["var"], abs=1e-6)
        if t["mean"] is None:
            assert pd.isna(r.inter_alert_interval_mean)
        else:
            assert r.inter_alert_interval_mean == pytest.approx(t["mean"])
    for _, part in got.groupby("stream"):
        part = part.sort_values("s").reset_index(drop=True)
        freq = part["n_emergency"].astype(float)
        if (part["s"].diff().dropna() == 10 * MIN).all():
            want = freq.rolling(5, min_periods=3).std()
            assert np.allclose(part["freq_rolling_std_5w"], want, equal_nan=True)


def test_scores_are_routed(spark, files):
    path, _, schema = files
    out = scratch_path(spark, "routed")
    rule = lambda df: df.withColumn("p", F.when(F.col("type") == "emergency", 0.1).otherwise(0.9))
    live.score_stream(live.read_stream(spark, path, schema, files=2), rule, out, scratch_path(spark, "s3")).start().awaitTermination()
    got = {r["route"]: r["count"] for r in spark.read.parquet(out).groupBy("route").count().collect()}
    want = spark.read.schema(schema).parquet(path).groupBy("type").count().collect()
    assert got == {"DROP" if r["type"] == "emergency" else "FORWARD": r["count"] for r in want}


def entropy(pdf, stream, start):
    w = pdf[(pdf["stream"] == stream) & (pdf["us"] >= start) & (pdf["us"] < start + 60 * MIN) & (pdf["type"] == "emergency")]
    blob = b"\0".join(m.encode() for m in "ab\u00e9" + w["topic"])
    n = np.bincount(np.frombuffer(blob, np.uint8)) if blob else np.zeros(0)
    p = n[n > 0] / max(n.sum(), 1)
    return float(-(p * np.log2(p + 1e-12)).sum())


def features(spark, path, schema):
    stream = live.read_stream(spark, path, schema, files=1)
    return serving.live_features(stream.withColumn("message", F.concat(F.lit("ab\u00e9"), F.col("topic"))))


@pytest.fixture(scope="module")
def closed(spark, files):
    """Closed windows with sequences of the streamed files, as a table."""
    out = scratch_path(spark, "served")
    serving.serve(features(spark, files[0], files[2]), out, scratch_path(spark, "served-state")).start().awaitTermination()
    return spark.read.parquet(f"{out}/windows").drop("batch")


def test_live_features_and_sequences(closed, files):
    pdf = files[1]
    got = closed.withColumn("s", F.unix_micros("window_start_time")).toPandas()
    assert len(got) > 300 and not got.duplicated(["stream", "s"]).any()
    for r in got.itertuples():
        t = truth(pdf, r.stream, r.s)
        assert (r.n_messages, r.n_emergency, r.burst_score) == (t["n"], t["e"], t["burst"])
        assert r.alert_rate_acceleration == t["acc"]
        assert r.inter_interval_variance == pytest.approx(t["var"], abs=1e-6)
        assert r.payload_entropy == pytest.approx(entropy(pdf, r.stream, r.s), abs=1e-9)
        assert t["mean"] is None and pd.isna(r.inter_alert_interval_mean) or r.inter_alert_interval_mean == pytest.approx(t["mean"])
    for _, part in got.groupby("stream"):
        part = part.sort_values("s").reset_index(drop=True)
        for i, vectors in enumerate(part["vectors"]):
            ten = part.iloc[max(i - 9, 0) : i + 1]
            whole = len(ten) == 10 and (ten["s"].diff().dropna() <= 120 * MIN).all()
            assert (vectors is not None) == whole
            if whole:
                want = ten[SELECTED_FEATURES].astype(float).to_numpy().ravel()
                assert np.allclose(np.array(vectors, float), want, equal_nan=True)


def detection(spark, closed, seed):
    rows = closed.fillna(0.0).withColumn("id", F.concat_ws(":", "stream", F.col("window_start_time").cast("string")))
    scaler = prep.Standardiser.fit(rows, SELECTED_FEATURES)
    forest = IsolationForest.fit(scaler.transform(rows), SELECTED_FEATURES, "id", n_trees=5, seed=seed)
    weights = np.random.default_rng(seed).normal(0, 0.2, 81)
    sequence = SequenceClassifier("logistic", [80], weights)
    return Detection(
        list(SELECTED_FEATURES), scaler, forest, (-0.7, -0.3), sequence, fusion.Platt(2.0, -1.0), fusion.Platt(1.5, 0.1 * seed), 1.3,
        fusion.Gate(0.1, 0.5, 0.9, 0.8, True), 0.5, closed,
    )


def test_models_are_refreshed_and_windows_scored_once(spark, closed, files):
    path, _, schema = files
    one, two = detection(spark, closed, 1), detection(spark, closed, 2)
    models, incoming, out, state = (scratch_path(spark, n) for n in ("models", "in", "out", "state"))
    alerts = spark.read.schema(schema).parquet(path)
    cut = alerts.select(F.percentile_approx("timestamp", 0.5)).first()[0]
    alerts.filter(F.col("timestamp") < cut).coalesce(1).write.parquet(incoming)

    def run():
        serving.serve(features(spark, incoming, schema), out, state, models).start().awaitTermination()
        return spark.read.parquet(f"{out}/scores")

    assert serving.latest(spark, models) is None
    assert serving.publish(spark, one, models) == 1
    assert {r["version"] for r in run().select("version").distinct().collect()} == {1}
    assert serving.publish(spark, two, models) == 2
    alerts.filter(F.col("timestamp") >= cut).coalesce(1).write.mode("append").parquet(incoming)
    run()
    got = run().toPandas()  # a run without news adds nothing
    assert not got.duplicated(["stream", "window_start_time"]).any() and set(got["version"]) == {1, 2}
    keys = ["stream", "window_start_time"]
    # the same windows as in one run, sequences across the batches included
    assert len(got.merge(closed.filter("vectors IS NOT NULL").select(*keys).toPandas(), on=keys)) == len(got) > 100
    for version, model in ((1, one), (2, two)):
        loaded = serving.load(spark, models, version)
        assert loaded.forest.trees[0].cut == model.forest.trees[0].cut and loaded.gate == model.gate and loaded.scaler == model.scaler
        want = serving.scored(model, closed).select(*keys, "p_forest", "p_sequence", "p").toPandas()
        mine = got[got["version"] == version]
        both = mine.merge(want, on=keys, suffixes=("", "_w"))
        assert len(both) == len(mine) > 20
        for c in ("p_sequence", "p_forest", "p"):
            assert (both[c] - both[f"{c}_w"]).abs().max() < 1e-9, both[(both[c] - both[f"{c}_w"]).abs() > 1e-9][[*keys, c, f"{c}_w"]]
    assert set(got["route"]) <= {"DROP", "FORWARD"}
