"""Window features against a direct restatement, and literal edge cases."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest

from alertmill.operators.windows import CAPTURES, WindowConfig, extract_windows

MIN = 60_000_000
BASE = 1_700_000_040_123_457


def brute(pdf: pd.DataFrame, cfg: WindowConfig) -> dict[int, dict]:
    us = pdf["us"].to_numpy()
    size, step = cfg.window_min * MIN, cfg.step_min * MIN
    out = {}
    k = 0
    while us.min() + k * step + size <= us.max():
        start = us.min() + k * step
        win = pdf[(us >= start) & (us < start + size)].sort_values("us")
        emg = win[win["type"] == "emergency"]
        n = len(emg)
        if len(win) and n >= cfg.min_emergency:
            t = emg["us"].to_numpy()
            gaps = np.diff(t) / MIN
            std = gaps.std(ddof=1) if len(gaps) > 1 else 0.0
            mean = gaps.mean() if n >= 2 else None
            b5 = np.unique(t // (5 * MIN), return_counts=True)[1]
            b10 = np.unique(t // (10 * MIN), return_counts=True)[1]
            blob = b"\x00".join(m.encode() for m in emg["message"].dropna())
            p = np.unique(np.frombuffer(blob, np.uint8), return_counts=True)[1] / max(len(blob), 1)
            mid = win["us"].iloc[0] + size // 2
            regular = None
            if n >= 3 and std > 1e-12 and mean:
                regular = 1 / max(std / mean, 0.01)
            elif n >= 2:
                regular = 100.0
            out[k] = {
                "n_messages": len(win),
                "n_emergency": n,
                "normal_emergency_ratio": (len(win) - n) / max(1, n),
                "inter_alert_interval_mean": mean,
                "inter_interval_variance": std**2,
                "burst_score": float(b5.max()) if n else 0.0,
                "topic_diversity": float(emg["topic"].nunique()),
                "payload_entropy": float(-(p * np.log2(p + 1e-12)).sum()) if len(blob) else 0.0,
                "alert_rate_acceleration": float((t >= mid).sum() - (t < mid).sum()) if n >= 4 else 0.0,
                "regularity_coefficient": regular,
                "temporal_clustering_score": float(b10.max() / b10.mean()) if n >= 3 else 1.0,
            }
        k += 1
    return out


def frame(spark, pdf: pd.DataFrame):
    rows = pdf.assign(timestamp=pd.to_datetime(pdf["us"], unit="us"))[["stream", "timestamp", "type", "topic", "message"]]
    rows = [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows.itertuples(index=False)]
    return spark.createDataFrame(
        [(s, t.to_pydatetime(), *rest) for s, t, *rest in rows],
        "stream string, timestamp timestamp, type string, topic string, message string",
    )


def random_log(seed: int, stream: str, n: int) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    us = np.sort(rng.integers(0, 8 * 60 * MIN, n))
    burst = rng.random(n) < 0.4
    us[burst] = us[burst] // (7 * MIN) * (7 * MIN)  # equal instants and dense seconds
    return pd.DataFrame(
        {
            "stream": stream,
            "us": np.sort(us) + BASE,
            "type": np.where(rng.random(n) < 0.6, "emergency", "info"),
            "topic": [None if x < 0.1 else f"t{int(x * 5)}" for x in rng.random(n)],
            "message": [None if x < 0.2 else "é" * int(x * 4) + "ab" for x in rng.random(n)],
        }
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_features_equal_brute_force(many_parts, seed):
    logs = {c.stream: random_log(seed * 10 + i, c.stream, 150) for i, c in enumerate(CAPTURES)}
    got = extract_windows(frame(many_parts, pd.concat(logs.values())), CAPTURES).toPandas()
    for cfg in CAPTURES:
        want = brute(logs[cfg.stream], cfg)
        mine = got[got["stream"] == cfg.stream].set_index("window_no")
        assert sorted(mine.index) == sorted(want)
        for k, row in want.items():
            for name, value in row.items():
                x = mine.loc[k, name]
                if value is None:
                    assert pd.isna(x), (k, name)
                else:
                    assert x == pytest.approx(value, abs=1e-6), (cfg.stream, k, name)


def alerts_at(minutes: list[float], span: float = 130.0) -> pd.DataFrame:
    """Emergencies at the given minutes, and quiet messages at both ends."""
    rows = [(0.0, "info"), *[(m, "emergency") for m in minutes], (span, "info")]
    return pd.DataFrame(
        [("normal", BASE + int(m * MIN), t, "a", None) for m, t in rows],
        columns=["stream", "us", "type", "topic", "message"],
    )


def first_window(spark, minutes, **kw):
    cfg = WindowConfig("normal", label=1, **kw)
    return extract_windows(frame(spark, alerts_at(minutes)), [cfg]).filter("window_no = 0").first()


@pytest.mark.parametrize(
    ("minutes", "mean", "regular"), [([], None, None), ([5], None, None), ([5, 9], 4.0, 100.0), ([5, 9, 11], 3.0, None)]
)
def test_few_emergencies(spark, minutes, mean, regular):
    row = first_window(spark, minutes)
    assert row["inter_alert_interval_mean"] == (pytest.approx(mean) if mean else None)
    if len(minutes) < 3:
        assert row["regularity_coefficient"] == regular
        assert row["inter_interval_variance"] == 0.0
    else:
        assert row["regularity_coefficient"] == pytest.approx(3.0 / math.sqrt(2.0))


def test_equal_gaps_are_fully_regular(spark):
    assert first_window(spark, [5, 9, 13, 17])["regularity_coefficient"] == 100.0


def test_message_at_window_end_is_outside(spark):
    assert first_window(spark, [5, 60])["n_emergency"] == 1
    assert first_window(spark, [5, 59.999])["n_emergency"] == 2


def test_no_payload_has_no_entropy(spark):
    assert first_window(spark, [5, 9])["payload_entropy"] == 0.0


def test_window_count_follows_the_formula(spark):
    cfg = WindowConfig("normal", label=1)
    got = extract_windows(frame(spark, alerts_at([float(m) for m in range(1, 130, 3)])), [cfg])
    assert got.count() == (130 - 60) // 10 + 1


def test_step_that_does_not_divide_the_window(spark):
    log = random_log(5, "normal", 120)
    cfg = WindowConfig("normal", label=1, window_min=50, step_min=15)
    got = extract_windows(frame(spark, log), [cfg]).toPandas().set_index("window_no")
    want = brute(log, cfg)
    assert sorted(got.index) == sorted(want)
    assert all(got.loc[k, "n_messages"] == w["n_messages"] for k, w in want.items())
    assert all(got.loc[k, "alert_rate_acceleration"] == w["alert_rate_acceleration"] for k, w in want.items())


def test_bad_settings_are_refused():
    with pytest.raises(ValueError):
        WindowConfig("x", label=1, step_min=60)
    with pytest.raises(ValueError):
        WindowConfig("x", label=1, step_min=0)
    assert WindowConfig("x", label=1, step_min=15).overlap_pct == 75
