"""Sliding-window queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertmill.catalog import register
from alertmill.catalog.views_sql import SPANS, WINDOWS
from alertmill.operators import windows as W
from alertmill.schemas import WINDOW_FEATURES
from alertmill.sources import views

STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


# Means of whole microseconds fall on exact half steps of the sixth place; a
# nudge far below it keeps two engines from rounding such a value differently.
NUDGE = 1e-9


def rounded(df, cols, places=6):
    return df.withColumns({c: F.round(F.col(c) + NUDGE, places) for c in cols})


def _window_query(name: str, features: list[str]) -> None:
    outs = ", ".join(f"round({f} + 1e-9, 6) AS {f}" for f in features)
    sql = f"WITH {WINDOWS} SELECT stream, window_no, {outs} FROM windows"

    @register(name, sql)
    def query(spark, sf_dir):
        w = W.extract_windows(views.alerts(spark, sf_dir), W.CAPTURES, features)
        return rounded(w.select("stream", "window_no", *features), features)


@register(
    "sliding_windows",
    f"""WITH {WINDOWS} SELECT stream, window_no, label, attack_type, n_messages, n_emergency,
        strftime(make_timestamp(ws), '%Y-%m-%d %H:%M:%S.%f') AS window_start,
        strftime(make_timestamp(we), '%Y-%m-%d %H:%M:%S.%f') AS window_end FROM windows""",
)
def sliding_windows(spark, sf_dir):
    w = W.extract_windows(views.alerts(spark, sf_dir), W.CAPTURES, [])
    return w.select(
        "stream",
        "window_no",
        "label",
        "attack_type",
        "n_messages",
        "n_emergency",
        F.date_format("window_start_time", STAMP).alias("window_start"),
        F.date_format("window_end_time", STAMP).alias("window_end"),
    )


_window_query("window_counts", ["alert_frequency_per_hour", "normal_emergency_ratio", "consecutive_emergency_count"])
_window_query(
    "window_intervals", ["inter_alert_interval_mean", "inter_interval_variance", "regularity_coefficient"]
)
_window_query("window_bursts", ["burst_score", "temporal_clustering_score"])
_window_query("window_topics", ["topic_diversity"])
_window_query("window_cyclic_time", ["time_sin", "time_cos"])
_window_query("window_payload_entropy", ["payload_entropy"])
_window_query("window_acceleration", ["alert_rate_acceleration"])
_window_query("window_features", list(WINDOW_FEATURES))


@register(
    "window_settings",
    f"""WITH {SPANS} SELECT stream, step // 60000000 AS step_min,
        CAST(floor(100 * (1 - step / 3600000000)) AS BIGINT) AS overlap_pct,
        CASE WHEN t1 - t0 >= 3600000000 THEN (t1 - t0 - 3600000000) // step + 1 ELSE 0 END AS n_windows
        FROM spans""",
)
def window_settings(spark, sf_dir):
    starts = W.origins(views.alerts(spark, sf_dir), W.CAPTURES)
    return starts.select(
        "stream",
        W.whole(F.col("step_us"), W.MINUTE).alias("step_min"),
        F.col("overlap_pct").cast("bigint").alias("overlap_pct"),
        "n_windows",
    )


@register(
    "windows_deduplicated",
    f"""WITH {WINDOWS} SELECT stream, count(*) AS n_windows, count(DISTINCT ws) AS n_starts
        FROM windows GROUP BY stream""",
)
def windows_deduplicated(spark, sf_dir):
    """Both copies of a capture list collapse to one row per start."""
    w = views.windows(spark, sf_dir)
    kept = W.deduplicate_windows(w.unionByName(w.filter("label = 0")), ["flooding", "slow_poisoning"])
    return kept.groupBy("stream").agg(
        F.count(F.lit(1)).alias("n_windows"), F.count_distinct("window_start_time").alias("n_starts")
    )
