"""Literal edge cases of the smaller operators."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertmill.functions import scalars, special
from alertmill.operators import attribution, fusion, metrics, packets, prep, rolling, runs, sensor, sequences, splits, stats
from alertmill.sources import alerts as scans

T0 = dt.datetime(2024, 1, 1)


def readings(spark, rows):
    return spark.createDataFrame(
        [(0, T0 + dt.timedelta(minutes=m), y, t, v) for m, y, t, v in rows],
        "dataset int, timestamp timestamp, label int, type string, value double",
    )


def test_two_attacks_have_no_variance(spark):
    rows = [(i, 1 if i in (3, 7) else 0, "dos", 1.0) for i in range(12)]
    w = sensor.sensor_windows(readings(spark, rows), rolling=False).first()
    assert w["inter_alert_interval_mean"] == pytest.approx(4.0)
    assert w["inter_interval_variance"] is None
    assert w["regularity_coefficient"] == 10.0


def test_tied_types_give_the_smaller_name(spark):
    rows = [(i, 1, "xss" if i % 2 else "ddos", 1.0) for i in range(12)]
    assert sensor.sensor_windows(readings(spark, rows), rolling=False).first()["attack_type"] == "ddos"


def test_reading_at_half_past_counts_twice(spark):
    rows = [(i, 0, "n", 1.0) for i in range(10)] + [(30, 1, "dos", 1.0), (40, 1, "dos", 1.0)]
    assert sensor.sensor_windows(readings(spark, rows), rolling=False).first()["alert_rate_acceleration"] == 1.0


def test_empty_bins_count_in_sensor_clustering(spark):
    rows = [(0, 1, "dos", 1.0)] + [(50, 0, "n", 1.0)] * 10
    # One attack in six ten-minute bins: 1 / (1/6).
    assert sensor.sensor_windows(readings(spark, rows), rolling=False).first()["temporal_clustering_score"] == pytest.approx(6.0)


def test_hours_below_ten_rows_are_dropped(spark):
    assert sensor.sensor_windows(readings(spark, [(i, 0, "n", 1.0) for i in range(9)]), rolling=False).count() == 0


def test_packet_tail_and_cap(many_parts):
    p = many_parts.range(120).select(
        F.col("id").alias("seq"),
        F.lit("3").alias("mqtt.msgtype"),
        F.lit("a").alias("mqtt.topic"),
        F.lit("61 62").alias("mqtt.msg"),
        F.col("id").cast("string").alias("frame.time_epoch"),
    )
    assert packets.packet_windows(p).count() == 100
    f = packets.packet_features(packets.packet_windows(p)).orderBy("window_no").first()
    assert f["payload_entropy"] == pytest.approx(1.0)
    assert f["inter_interval_variance"] == pytest.approx(0.0)
    assert f["alert_rate_acceleration"] == 0.0


def table(spark, freq, cls="a"):
    return spark.createDataFrame(
        [(f"w{i}", cls, T0 + dt.timedelta(minutes=10 * i), float(v), int(v)) for i, v in enumerate(freq)],
        "window_id string, attack_type string, window_start_time timestamp, alert_frequency_per_hour double, n_emergency long",
    )


def test_class_with_two_windows_gets_zeros(spark):
    row = rolling.sequential_features(table(spark, [3, 4])).first()
    assert [row[c] for c in ("freq_persistence_5w", "freq_rolling_mean_5w", "freq_rolling_std_5w")] == [0.0, 0.0, 0.0]


def test_rolling_head_takes_training_median(spark):
    got = rolling.sequential_features(table(spark, [1, 2, 3, 4, 5])).orderBy("window_start_time").collect()
    assert got[0]["freq_rolling_mean_5w"] == pytest.approx(2.0)  # only row 3 of the first three is filled
    assert got[4]["freq_rolling_mean_5w"] == pytest.approx(3.0)
    again = rolling.sequential_features(rolling.sequential_features(table(spark, [1, 2, 3, 4, 5])))
    assert again.agg(F.sum("freq_rolling_std_5w")).first()[0] == pytest.approx(sum(r["freq_rolling_std_5w"] for r in got))


def test_long_gap_drops_the_sequence(spark):
    minutes = [10 * i for i in range(10)]
    late = [m if i < 5 else m + 111 for i, m in enumerate(minutes)]
    for times, kept in ((minutes, 1), (late, 0)):
        df = spark.createDataFrame([(i, T0 + dt.timedelta(minutes=m), 1.0) for i, m in enumerate(times)], "i int, ts timestamp, x double")
        assert sequences.sliding_sequences(df, [], ["i"], ["x"], ts="ts").count() == kept


def test_padding_repeats_the_first_row(spark):
    df = spark.createDataFrame([("d", i, float(i)) for i in range(12)], "d string, i int, x double")
    got = {r["i"]: [v[0] for v in r["sequence"]] for r in sequences.padded_sequences(df, "d", ["i"], ["x"]).collect()}
    assert got[0] == [0.0] * 10
    assert got[3] == [0.0] * 7 + [1.0, 2.0, 3.0]
    assert got[11] == [float(v) for v in range(2, 12)]


def test_disjoint_ends_equal_the_greedy_walk(many_parts):
    rng = np.random.default_rng(0)
    steps = np.where(rng.random(400) < 0.04, 500, 10)
    times = np.cumsum(steps)
    df = many_parts.createDataFrame([(i, T0 + dt.timedelta(minutes=int(m))) for i, m in enumerate(times)], "i int, ts timestamp")
    want, i = [], 9
    while i < len(times):
        if np.diff(times[i - 9 : i + 1]).max() > 120:
            i += 1
        else:
            want.append(i)
            i += 10
    got = sorted(r["end_id"] for r in sequences.disjoint_sequence_ends(df, [], ["i"], "ts").collect())
    assert got == want


def test_undetected_run_counts_its_length(many_parts):
    y = [1, 0, 0, 0, 1, 0, 0, 1]
    alarm = [0, 0, 0, 0, 0, 0, 1, 0]
    df = many_parts.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(y, alarm, strict=True))], "i int, y int, a int")
    got = runs.detection_runs(df, [], ["i"], F.col("a") == 1).orderBy("run_start").collect()
    assert [(r["run_length"], r["delay"], r["detected"]) for r in got] == [(3, 3, False), (2, 1, True)]


def scored(spark, rows):
    return spark.createDataFrame([("k", float(p), y) for p, y in rows], "k string, p double, y int")


def test_one_class_has_no_metrics(spark):
    df = scored(spark, [(0.2, 1), (0.8, 1)])
    assert metrics.auc(df, ["k"]).first()["auc"] is None
    assert metrics.auc(df, ["k"], one_class=0.5).first()["auc"] == 0.5
    assert metrics.confusion(df, ["k"]).first()["tpr"] is None


def test_auc_counts_ties_half_and_ignores_monotone_maps(spark):
    df = scored(spark, [(0.1, 0), (0.5, 0), (0.5, 1), (0.9, 1)])
    assert metrics.auc(df, ["k"]).first()["auc"] == pytest.approx(0.875)
    assert metrics.auc(df.withColumn("p", F.exp("p") * 3), ["k"]).first()["auc"] == pytest.approx(0.875)


def test_top_probability_is_in_no_bin(spark):
    df = scored(spark, [(1.0, 0), (0.95, 1)])
    assert metrics.ece(df, ["k"]).first()["ece"] == pytest.approx(0.05 / 2)


def test_flat_scores_become_one_half(spark):
    df = scored(spark, [(0.3, 0), (0.3, 1)])
    assert {r["q"] for r in prep.percentile_normalise(df, ["k"], "p", "q").collect()} == {0.5}


def test_gate_above_one_returns_the_sequence_score(spark):
    df = spark.createDataFrame([(0.9, 0.1), (0.1, 0.2), (0.3, 0.9)], "f double, s double")
    got = df.select("s", fusion.gate(F.col("f"), F.col("s"), 1.01, 0.5).alias("p")).collect()
    assert all(r["s"] == r["p"] for r in got)


def test_gate_table_equals_direct_counts(many_parts):
    rng = np.random.default_rng(4)
    f, s, y = rng.random(300).round(2), rng.random(300).round(2), rng.integers(0, 2, 300)
    df = many_parts.createDataFrame([(float(a), float(b), int(c)) for a, b, c in zip(f, s, y, strict=True)], "p_if double, p_lstm double, y int")
    for r in fusion.gate_table(df).collect():
        apart = np.abs(s - f) >= r["delta"]
        p = s.copy()
        one = apart & (s < 0.5) & (f >= 0.5)
        p[one] = (1 - r["alpha"]) * s[one] + r["alpha"] * f[one]
        two = apart & (s < 0.5) & (f < 0.5)
        p[two] = 0.6 * s[two] + 0.4 * f[two]
        assert (r["tp"], r["fp"]) == (int(((p < 0.5) & (y == 0)).sum()), int(((p < 0.5) & (y == 1)).sum()))


def test_no_discordant_pairs(spark):
    df = spark.createDataFrame([("k", True), ("k", False)], "k string, r boolean")
    row = stats.mcnemar(df, ["k"], F.col("r"), F.col("r")).first()
    assert (row["chi2"], row["p_value"], row["power"]) == (0.0, 1.0, 0.0)


def test_published_intervals_and_tests(spark):
    """Published counts give the published numbers."""
    lo, hi = special.exact_interval(445, 485)
    assert (round(lo, 4), round(hi, 4)) == (0.8894, 0.9404)
    lo, hi = special.exact_interval(9, 1061)
    assert (round(lo, 4), round(hi, 4)) == (0.0039, 0.0160)
    df = spark.range(23).select(F.lit("k").alias("k"), (F.col("id") < 18).alias("a"))
    row = stats.mcnemar(df, ["k"], F.col("a"), ~F.col("a")).first()
    assert (row["b"], row["c"], round(row["chi2"], 4), round(row["p_value"], 4)) == (18, 5, 6.2609, 0.0123)
    assert special.t_quantile(0.975, 4) == pytest.approx(2.7764451, abs=1e-6)
    assert special.exact_interval(0, 10)[0] == 0.0


def test_split_sizes(spark):
    df = table(spark, range(17))
    got = {r["zone"]: r["count"] for r in splits.zones(df).groupBy("zone").count().collect()}
    assert got == {"A": 10, "B": 3, "C": 4}
    folds = {r["fold"]: r["count"] for r in splits.ordered_folds(df, ["window_id"]).groupBy("fold").count().collect()}
    assert folds == {1: 4, 2: 4, 3: 3, 4: 3, 5: 3}


def test_balance_needs_both_classes(spark):
    df = table(spark, range(5), "flooding")
    assert splits.balance(df, "window_id").count() == 5


def test_integrity_refuses_gaps(spark):
    df = spark.createDataFrame([(1.0, 1), (None, 0)], "x double, label int")
    with pytest.raises(ValueError, match="nans"):
        prep.integrity(df, ["x"])
    with pytest.raises(ValueError, match="missing"):
        prep.require(df, ["x", "z"])


def test_text_and_families(spark):
    df = spark.createDataFrame([(" Slow-Poisoning A5 ",)], "c string")
    row = df.select(scalars.class_text("c").alias("t"), scalars.attack_family("c").alias("f"), scalars.attack_scope(F.lit("XSS ")).alias("s")).first()
    assert tuple(row) == ("slow_poisoning_a5", "slow_poisoning", "auth")


def test_alert_scan_checks_its_input(spark, tmp_path):
    (tmp_path / "a.csv").write_text('type,message\nemergency,"x"\n')
    with pytest.raises(ValueError, match="timestamp"):
        scans.read_alerts(spark, str(tmp_path / "a.csv"))
    (tmp_path / "b.csv").write_text("timestamp,type\n")
    with pytest.raises(ValueError, match="empty"):
        scans.read_alerts(spark, str(tmp_path / "b.csv"))
    (tmp_path / "c.csv").write_text('timestamp,type,message,level\n2024-01-01T01:00:00+01:00,emergency,"say ""hi"", ok",1.5\n')
    row = scans.read_alerts(spark, str(tmp_path / "c.csv")).first()
    assert row["timestamp"] == dt.datetime(2024, 1, 1, 0, 0)
    assert row["message"] == 'say "hi", ok'
    assert row["level"] == 1.5


def test_stored_copy_is_used_until_the_csv_changes(spark, tmp_path):
    csv, copy = tmp_path / "x.csv", str(tmp_path / "x.parquet")
    csv.write_text("timestamp,type\n2024-01-01T00:00:00Z,emergency\n")
    assert scans.landed_or_read(spark, str(csv), copy, "s").count() == 1
    csv.write_text("timestamp,type\n" + "2024-01-01T00:00:00Z,emergency\n" * 2)
    import os
    import time

    os.utime(csv, (time.time() + 60, time.time() + 60))
    assert scans.landed_or_read(spark, str(csv), copy, "s").count() == 2


def test_shapley_adds_up():
    rng = np.random.default_rng(0)
    base, x, w = rng.normal(size=(5, 4)), rng.normal(size=4), rng.normal(size=4)
    score = lambda m: (m @ w) ** 2
    phi = attribution.shapley(x, score, base, [np.array([i]) for i in range(4)])
    assert phi.sum() == pytest.approx(score(x[None])[0] - score(base).mean())
    linear = attribution.shapley(x, lambda m: m @ w, base, [np.array([i]) for i in range(4)])
    assert np.allclose(linear, (x - base.mean(axis=0)) * w)


def test_thresholds_are_placed_exactly(spark):
    for ts in (metrics.F1_GRID, sorted(metrics.FPR_GRID), [0.1, 0.2, 0.9]):
        points = sorted({*ts, *np.nextafter(ts, 0), *np.nextafter(ts, 1), -0.5, 0.0, 1.0, 1.5})
        df = spark.createDataFrame([("k", float(p), i % 2) for i, p in enumerate(points)], "k string, p double, y int")
        for r in metrics.threshold_table(df, ["k"], ts).collect():
            below = [i % 2 for i, p in enumerate(points) if p < r["threshold"]]
            assert (r["detected"], r["false_alarms"]) == (below.count(0), below.count(1))


def test_tails_of_very_large_counts():
    """Both tails around the median, and the hand-over from the fraction to the expansion."""
    for n in (10**8, 10**10, 10**12):
        half = special.binomial_cdf(n // 2, n, 0.5)
        assert half - 0.5 == pytest.approx(0.5 * math.sqrt(2 / (math.pi * n)), rel=1e-3)
        lo, hi = special.exact_interval(n // 2, n)
        assert hi - lo == pytest.approx(2 * 1.959964 * 0.5 / math.sqrt(n), rel=1e-3)
    for p in (0.5, 0.1, 0.003):
        for z in (-4, -1, 0.02, 1, 4):
            n = 2_000_000
            x = p + z * math.sqrt(p * (1 - p) / n)
            expansion = special.beta_cdf(x, p * n, n - p * n)
            special_limit, special.LARGE = special.LARGE, math.inf
            try:
                assert expansion == pytest.approx(special.beta_cdf(x, p * n, n - p * n), abs=1e-7)
            finally:
                special.LARGE = special_limit


def test_sampled_attribution_of_many_features():
    rng = np.random.default_rng(3)
    w, x, base = rng.normal(size=13), rng.normal(size=13), rng.normal(size=(4, 13))
    groups = [np.array([i]) for i in range(13)]
    linear = attribution.sampled_shapley(x, lambda v: v @ w, base, groups, 20)
    assert linear == pytest.approx(w * (x - base.mean(axis=0)))
    product = lambda v: v[:, 0] * v[:, 1] + v[:, 2]
    few = [np.array([i]) for i in range(3)]
    exact = attribution.shapley(x[:3], product, base[:, :3], few)
    sampled = attribution.sampled_shapley(x[:3], product, base[:, :3], few, 400)
    assert sampled == pytest.approx(exact, abs=0.05)
