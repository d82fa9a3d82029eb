"""Column names and schemas shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

# The names of the window features, as consumers of the tables expect them.
WINDOW_FEATURES = [
    "alert_frequency_per_hour",
    "normal_emergency_ratio",
    "inter_alert_interval_mean",
    "inter_interval_variance",
    "burst_score",
    "topic_diversity",
    "time_sin",
    "time_cos",
    "payload_entropy",
    "consecutive_emergency_count",
    "alert_rate_acceleration",
    "regularity_coefficient",
    "temporal_clustering_score",
]
SEQUENTIAL_FEATURES = ["freq_persistence_5w", "freq_rolling_mean_5w", "freq_rolling_std_5w"]
SELECTED_FEATURES = [
    "payload_entropy",
    "topic_diversity",
    "temporal_clustering_score",
    "normal_emergency_ratio",
    "inter_alert_interval_mean",
    "freq_rolling_std_5w",
    "inter_interval_variance",
    "alert_rate_acceleration",
]
CANDIDATE_FEATURES = [*WINDOW_FEATURES, "freq_rolling_std_5w"]

SENSOR_SCHEMA = T.StructType(
    [
        T.StructField("date", T.StringType()),
        T.StructField("time", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("type", T.StringType()),
    ]
)
