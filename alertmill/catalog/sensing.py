"""Sensor-hour and packet-window queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertmill.catalog import register
from alertmill.catalog.views_sql import READINGS
from alertmill.catalog.windowing import STAMP, rounded
from alertmill.functions.scalars import attack_scope
from alertmill.operators import packets as P
from alertmill.operators import sensor as S
from alertmill.sources import views

SENSOR_COLS = [
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

HOURS = (
    READINGS
    + """,
hours AS (
  SELECT dataset, us // 3600000000 AS h, count(*) AS n_total, sum(label) AS n_attack,
    sum(CASE WHEN us <= (us // 3600000000) * 3600000000 + 1800000000 THEN label ELSE 0 END) AS w1,
    sum(CASE WHEN us >= (us // 3600000000) * 3600000000 + 1800000000 THEN label ELSE 0 END) AS w2,
    max(us) // 600000000 - min(us) // 600000000 + 1 AS slots
  FROM readings GROUP BY ALL HAVING count(*) >= {least}),
d AS (
  SELECT dataset, us // 3600000000 AS h,
    (us - lag(us) OVER (PARTITION BY dataset, us // 3600000000 ORDER BY us)) / 6e7 AS d
  FROM readings WHERE label = 1),
ds AS (SELECT dataset, h, avg(d) AS mean_d, var_samp(d) AS var_d FROM d WHERE d IS NOT NULL GROUP BY ALL),
b5 AS (SELECT dataset, h, max(n) AS max5 FROM (
  SELECT dataset, us // 3600000000 AS h, us // 300000000 AS b, sum(label) AS n FROM readings GROUP BY ALL)
  GROUP BY ALL),
b10 AS (SELECT dataset, h, max(n) AS max10 FROM (
  SELECT dataset, us // 3600000000 AS h, us // 600000000 AS b, sum(label) AS n FROM readings GROUP BY ALL)
  GROUP BY ALL),
e AS (SELECT dataset, h, -sum(p * log2(p)) AS ent FROM (
  SELECT dataset, h, c / sum(c) OVER (PARTITION BY dataset, h) AS p FROM (
    SELECT dataset, us // 3600000000 AS h, value, count(*) AS c FROM readings WHERE value IS NOT NULL GROUP BY ALL))
  GROUP BY ALL),
m AS (SELECT dataset, h, type AS mode FROM (
  SELECT dataset, us // 3600000000 AS h, type, row_number() OVER (
    PARTITION BY dataset, us // 3600000000 ORDER BY count(*) DESC, type) AS r
  FROM readings WHERE label = 1 GROUP BY dataset, us // 3600000000, type) WHERE r = 1),
feats AS (
  SELECT hours.dataset, hours.h, make_timestamp(hours.h * 3600000000) AS start_ts,
    CAST(n_attack AS DOUBLE) AS alert_frequency_per_hour,
    (n_total - n_attack) / greatest(1, n_attack) AS normal_emergency_ratio,
    CASE WHEN n_attack >= 2 THEN mean_d ELSE 0.05 END AS inter_alert_interval_mean,
    CASE WHEN n_attack >= 2 THEN var_d ELSE 0e0 END AS inter_interval_variance,
    CAST(coalesce(max5, 0) AS DOUBLE) AS burst_score, 1e0 AS topic_diversity,
    sin(2 * pi() * (hours.h % 24) / 24.0) AS time_sin, cos(2 * pi() * (hours.h % 24) / 24.0) AS time_cos,
    coalesce(ent, 0) AS payload_entropy,
    CASE WHEN n_attack > 0 THEN 1e0 ELSE 0e0 END AS consecutive_emergency_count,
    CAST(w2 - w1 AS DOUBLE) AS alert_rate_acceleration,
    CASE WHEN n_attack >= 3 AND mean_d > 0 THEN 1 / (sqrt(var_d) / mean_d + 0.01)
         WHEN n_attack >= 2 THEN 1e1 ELSE 1e0 END AS regularity_coefficient,
    CASE WHEN n_attack > 0 THEN max10 / greatest(0.1, n_attack / slots) ELSE 1e0 END AS temporal_clustering_score,
    CASE WHEN n_attack / n_total > 0.3 THEN 0 ELSE 1 END AS label,
    CASE WHEN n_attack / n_total > 0.3 THEN mode ELSE 'normal' END AS attack_type, n_total AS n_messages
  FROM hours LEFT JOIN ds USING (dataset, h) LEFT JOIN b5 USING (dataset, h) LEFT JOIN b10 USING (dataset, h)
  LEFT JOIN e USING (dataset, h) LEFT JOIN m USING (dataset, h))
"""
)


def _sensor(name: str, cols: list[str], least: int = 3) -> None:
    outs = ", ".join(f"round({c} + 1e-9, 6) AS {c}" for c in cols)
    sql = f"""WITH {HOURS.format(least=least)} SELECT dataset,
              strftime(start_ts, '%Y-%m-%d %H:%M:%S.%f') AS window_start, {outs} FROM feats"""

    @register(name, sql)
    def query(spark, sf_dir):
        w = S.sensor_windows(views.readings(spark, sf_dir), min_rows=least, rolling=False)
        w = w.withColumn("window_start", F.date_format("window_start_time", STAMP))
        return rounded(w.select("dataset", "window_start", *cols), cols)


_sensor("sensor_hour_counts", ["alert_frequency_per_hour", "normal_emergency_ratio", "topic_diversity"], least=10)
_sensor("sensor_intervals", ["inter_alert_interval_mean", "inter_interval_variance", "regularity_coefficient"])
_sensor("sensor_bursts", ["burst_score", "temporal_clustering_score"])
_sensor("sensor_value_entropy", ["payload_entropy"])
_sensor("sensor_acceleration", ["alert_rate_acceleration"])
_sensor("sensor_cyclic_hour", ["time_sin", "time_cos", "consecutive_emergency_count"])


@register(
    "sensor_labels",
    f"""WITH {HOURS.format(least=10)} SELECT dataset, strftime(start_ts, '%Y-%m-%d %H:%M:%S.%f') AS window_start,
        label, attack_type, n_messages FROM feats""",
)
def sensor_labels(spark, sf_dir):
    w = S.sensor_windows(views.readings(spark, sf_dir), rolling=False)
    return w.select(
        "dataset", F.date_format("window_start_time", STAMP).alias("window_start"), "label", "attack_type", "n_messages"
    )


@register(
    "sensor_rolling_std",
    f"""WITH {HOURS.format(least=3)}, r AS (
        SELECT dataset, start_ts, count(*) OVER w AS c, stddev_samp(alert_frequency_per_hour) OVER w AS s
        FROM feats WINDOW w AS (PARTITION BY dataset ORDER BY h ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
        SELECT dataset, strftime(start_ts, '%Y-%m-%d %H:%M:%S.%f') AS window_start,
        round(CASE WHEN c >= 3 THEN s ELSE 0 END, 6) AS freq_rolling_std_5w FROM r""",
)
def sensor_rolling_std(spark, sf_dir):
    w = S.sensor_windows(views.readings(spark, sf_dir), min_rows=3)
    return w.select(
        "dataset",
        F.date_format("window_start_time", STAMP).alias("window_start"),
        F.round("freq_rolling_std_5w", 6).alias("freq_rolling_std_5w"),
    )


@register(
    "sensor_backfill",
    """SELECT event_id AS id,
       round(sin(2 * pi() * (hour(ts) + minute(ts) / 60.0) / 24.0) + 1e-9, 6) AS time_sin,
       round(cos(2 * pi() * (hour(ts) + minute(ts) / 60.0) / 24.0) + 1e-9, 6) AS time_cos,
       0e0 AS freq_rolling_std_5w FROM events""",
)
def sensor_backfill(spark, sf_dir):
    r = S.backfill(views.readings(spark, sf_dir), "timestamp")
    return rounded(r.select("id", "time_sin", "time_cos", "freq_rolling_std_5w"), ["time_sin", "time_cos"]).withColumn(
        "freq_rolling_std_5w", F.col("freq_rolling_std_5w").cast("double")
    )


@register(
    "sensor_attack_taxonomy",
    """SELECT CAST(user_id % 3 AS INTEGER) AS dataset,
       count(*) FILTER (event_id % 4 IN (0, 1)) AS n_behavioral,
       count(*) FILTER (event_id % 4 IN (2, 3)) AS n_auth
       FROM events WHERE event_type = 'error' GROUP BY 1""",
)
def sensor_attack_taxonomy(spark, sf_dir):
    s = views.scores(spark, sf_dir).filter("y = 0").withColumn("scope", attack_scope("attack_type"))
    return s.groupBy("dataset").agg(
        F.count_if(F.col("scope") == "behavioral").alias("n_behavioral"),
        F.count_if(F.col("scope") == "auth").alias("n_auth"),
    )


PACKETS = """
packets AS (
  SELECT event_id AS seq, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN '3'
      WHEN event_type = 'signup' THEN '1' WHEN event_type = 'error' THEN '12' END AS kind,
    'home/' || CAST(CAST(regexp_extract(props, '"k": (\\d+)', 1) AS INTEGER) % 3 AS VARCHAR) AS topic,
    props AS body, epoch_us(ts) / 1e6 AS t FROM events),
cut AS (
  SELECT *, (rn - 1) // 50 AS window_no FROM (
    SELECT *, row_number() OVER (ORDER BY seq) AS rn, count(*) OVER () AS n FROM packets)
  WHERE rn <= n - n % 50),
pubs AS (SELECT *, t - lag(t) OVER (PARTITION BY window_no ORDER BY t) AS d FROM cut WHERE kind = '3'),
mids AS (SELECT window_no, min(t) + (max(t) - min(t)) / 2 AS mid FROM pubs GROUP BY window_no),
pf AS (
  SELECT p.window_no, count(*) AS n_publish, count(DISTINCT topic) / count(topic) AS topic_diversity,
    avg(d) AS mean_d, var_pop(d) AS var_d,
    CAST(sum(CASE WHEN t > mid THEN 1 ELSE -1 END) AS DOUBLE) AS alert_rate_acceleration
  FROM pubs p JOIN mids m ON m.window_no = p.window_no GROUP BY p.window_no),
mg AS (SELECT window_no, sum(CASE WHEN kind IN ('1', '12') THEN 1 ELSE 0 END) AS n_mgmt FROM cut GROUP BY 1),
ent AS (
  SELECT window_no, -sum(p * log2(p)) AS payload_entropy FROM (
    SELECT window_no, n / sum(n) OVER (PARTITION BY window_no) AS p FROM (
      SELECT window_no, b, count(*) AS n FROM (
        SELECT window_no, unnest(regexp_extract_all(hex(body), '..')) AS b FROM pubs) GROUP BY ALL)) GROUP BY 1),
pw AS (
  SELECT mg.window_no, coalesce(payload_entropy, 0) AS payload_entropy,
    coalesce(topic_diversity, 0) AS topic_diversity,
    CASE WHEN n_publish >= 2 AND mean_d > 1e-9 THEN sqrt(var_d) / mean_d
         WHEN coalesce(n_publish, 0) = 0 THEN 0e0 ELSE 1e0 END AS temporal_clustering_score,
    n_mgmt / greatest(1, coalesce(n_publish, 0)) AS normal_emergency_ratio,
    CASE WHEN n_publish >= 2 THEN mean_d ELSE 0e0 END AS inter_alert_interval_mean,
    CASE WHEN n_publish >= 2 THEN var_d ELSE 0e0 END AS inter_interval_variance,
    coalesce(alert_rate_acceleration, 0e0) AS alert_rate_acceleration, coalesce(n_publish, 0) AS n_publish
  FROM mg LEFT JOIN pf USING (window_no) LEFT JOIN ent USING (window_no))
"""

PACKET_COLS = [
    "payload_entropy",
    "topic_diversity",
    "temporal_clustering_score",
    "normal_emergency_ratio",
    "inter_alert_interval_mean",
    "inter_interval_variance",
    "alert_rate_acceleration",
]


@register("packet_windows", f"WITH {PACKETS} SELECT window_no, count(*) AS n, min(seq) AS first_seq FROM cut GROUP BY 1")
def packet_windows(spark, sf_dir):
    cut = P.packet_windows(views.packets(spark, sf_dir))
    return cut.groupBy("window_no").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


def _packet_features(spark, sf_dir):
    return P.packet_features(P.packet_windows(views.packets(spark, sf_dir)))


# Gaps are differences of epoch seconds held as doubles, good to about 1e-7;
# their squares are compared at two places fewer.
PACKET_PLACES = dict.fromkeys(PACKET_COLS, 6) | {"inter_alert_interval_mean": 4, "inter_interval_variance": 2}


@register(
    "packet_features",
    f"WITH {PACKETS} SELECT window_no, n_publish, "
    + ", ".join(f"round({c}, {p}) AS {c}" for c, p in PACKET_PLACES.items())
    + " FROM pw",
)
def packet_features(spark, sf_dir):
    f = _packet_features(spark, sf_dir)
    return f.select("window_no", "n_publish", *[F.round(c, p).alias(c) for c, p in PACKET_PLACES.items()])


@register(
    "packet_payload_entropy", f"WITH {PACKETS} SELECT window_no, round(payload_entropy, 6) AS payload_entropy FROM pw"
)
def packet_payload_entropy(spark, sf_dir):
    return rounded(_packet_features(spark, sf_dir).select("window_no", "payload_entropy"), ["payload_entropy"])


@register(
    "packet_acceleration", f"WITH {PACKETS} SELECT window_no, n_publish, alert_rate_acceleration FROM pw"
)
def packet_acceleration(spark, sf_dir):
    return _packet_features(spark, sf_dir).select("window_no", "n_publish", "alert_rate_acceleration")


@register(
    "packet_rolling_std",
    f"""WITH {PACKETS} SELECT window_no, round(stddev_pop(n_publish) OVER (
        ORDER BY window_no ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS freq_rolling_std_5w FROM pw""",
)
def packet_rolling_std(spark, sf_dir):
    r = P.packet_rolling(_packet_features(spark, sf_dir))
    return r.select("window_no", F.round("freq_rolling_std_5w", 6).alias("freq_rolling_std_5w"))
