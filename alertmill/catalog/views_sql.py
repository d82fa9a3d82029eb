"""SQL forms of the fixture views, built without the Spark operators."""

ALERTS = """
alerts AS (
  SELECT event_id AS id, epoch_us(ts) AS us,
         CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS emg,
         'home/' || CAST(CAST(regexp_extract(props, '"k": (\\d+)', 1) AS INTEGER) % 3 AS VARCHAR) AS topic,
         props AS message,
         CASE user_id % 3 WHEN 0 THEN 'normal' WHEN 1 THEN 'flooding' ELSE 'slow_poisoning' END AS stream
  FROM events)
"""

# W = 60 minutes in microseconds; the step is 10 or 15 minutes.
SPANS = (
    ALERTS
    + """,
cfg AS (
  SELECT * FROM (VALUES ('normal', 1, 600000000, 0), ('flooding', 0, 900000000, 1),
                        ('slow_poisoning', 0, 900000000, 1)) AS t(stream, label, step, least_emg)),
spans AS (
  SELECT a.stream, any_value(label) AS label, any_value(step) AS step, any_value(least_emg) AS least_emg,
         min(us) AS t0, max(us) AS t1
  FROM alerts a JOIN cfg ON cfg.stream = a.stream GROUP BY a.stream),
slots AS (
  SELECT stream, label, least_emg, k, t0 + k * step AS ws, t0 + k * step + 3600000000 AS we
  FROM (SELECT *, unnest(range(0, CASE WHEN t1 - t0 >= 3600000000
                                       THEN (t1 - t0 - 3600000000) // step + 1 ELSE 0 END)) AS k FROM spans)
  WHERE t0 + k * step + 3600000000 <= t1),
inside AS (
  SELECT s.stream, s.label, s.least_emg, s.k, s.ws, s.we, a.id, a.us, a.emg, a.topic, a.message
  FROM slots s JOIN alerts a ON a.stream = s.stream AND a.us >= s.ws AND a.us < s.we)
"""
)

WINDOWS = (
    SPANS
    + """,
base AS (
  SELECT stream, k, ws, we, label, least_emg, count(*) AS n_msg, sum(emg) AS n_emg, min(us) AS first_msg,
         coalesce(min(CASE WHEN emg = 1 THEN us END), min(us)) AS ref_us,
         count(DISTINCT CASE WHEN emg = 1 THEN topic END) AS n_topics
  FROM inside GROUP BY stream, k, ws, we, label, least_emg
  HAVING sum(emg) >= least_emg),
gaps AS (
  SELECT stream, k, (us - lag(us) OVER (PARTITION BY stream, k ORDER BY us, id)) / 60000000.0 AS d
  FROM inside WHERE emg = 1),
gap_stats AS (
  SELECT stream, k, avg(d) AS mean_d, coalesce(stddev_samp(d), 0) AS std_d FROM gaps
  WHERE d IS NOT NULL GROUP BY stream, k),
b5 AS (SELECT stream, k, max(n) AS max5 FROM (
  SELECT stream, k, us // 300000000 AS b, count(*) AS n FROM inside WHERE emg = 1 GROUP BY ALL) GROUP BY ALL),
b10 AS (SELECT stream, k, max(n) AS max10, avg(n) AS mean10 FROM (
  SELECT stream, k, us // 600000000 AS b, count(*) AS n FROM inside WHERE emg = 1 GROUP BY ALL) GROUP BY ALL),
blobs AS (
  SELECT stream, k, string_agg(hex(message), '00') AS blob FROM inside
  WHERE emg = 1 AND message IS NOT NULL GROUP BY stream, k),
byte_counts AS (
  SELECT stream, k, b, count(*) AS n FROM (
    SELECT stream, k, unnest(regexp_extract_all(blob, '..')) AS b FROM blobs) GROUP BY ALL),
entropy AS (
  SELECT stream, k, -sum(p * log2(p + 1e-12)) AS ent FROM (
    SELECT stream, k, n / sum(n) OVER (PARTITION BY stream, k) AS p FROM byte_counts) GROUP BY stream, k),
halves AS (
  SELECT i.stream, i.k, sum(CASE WHEN i.us < b.first_msg + 1800000000 THEN 1 ELSE 0 END) AS n_before
  FROM inside i JOIN base b ON b.stream = i.stream AND b.k = i.k WHERE i.emg = 1 GROUP BY i.stream, i.k),
windows AS (
  SELECT b.stream, b.k AS window_no, b.stream || ':' || CAST(b.k AS VARCHAR) AS window_id,
    CAST(n_emg AS DOUBLE) AS alert_frequency_per_hour,
    (n_msg - n_emg) / greatest(1, n_emg) AS normal_emergency_ratio,
    CASE WHEN n_emg >= 2 THEN mean_d END AS inter_alert_interval_mean,
    coalesce(std_d, 0) * coalesce(std_d, 0) AS inter_interval_variance,
    CAST(coalesce(max5, 0) AS DOUBLE) AS burst_score,
    CAST(n_topics AS DOUBLE) AS topic_diversity,
    sin(2 * pi() * (hour(make_timestamp(ref_us)) + minute(make_timestamp(ref_us)) / 60.0) / 24.0) AS time_sin,
    cos(2 * pi() * (hour(make_timestamp(ref_us)) + minute(make_timestamp(ref_us)) / 60.0) / 24.0) AS time_cos,
    coalesce(ent, 0) AS payload_entropy,
    CASE WHEN n_emg > 0 THEN 1e0 ELSE 0e0 END AS consecutive_emergency_count,
    CASE WHEN n_emg >= 4 THEN CAST(n_emg - 2 * n_before AS DOUBLE) ELSE 0e0 END AS alert_rate_acceleration,
    CASE WHEN n_emg >= 3 AND std_d > 1e-12 AND mean_d <> 0 THEN 1.0 / greatest(std_d / mean_d, 0.01)
         WHEN n_emg >= 2 THEN 1e2 END AS regularity_coefficient,
    CASE WHEN n_emg >= 3 THEN max10 / mean10 ELSE 1e0 END AS temporal_clustering_score,
    label, b.stream AS attack_type, ws, we, n_msg AS n_messages, CAST(n_emg AS BIGINT) AS n_emergency
  FROM base b
  LEFT JOIN gap_stats g ON g.stream = b.stream AND g.k = b.k
  LEFT JOIN b5 ON b5.stream = b.stream AND b5.k = b.k
  LEFT JOIN b10 ON b10.stream = b.stream AND b10.k = b.k
  LEFT JOIN entropy e ON e.stream = b.stream AND e.k = b.k
  LEFT JOIN halves h ON h.stream = b.stream AND h.k = b.k)
"""
)

READINGS = """
readings AS (
  SELECT event_id AS id, ts, epoch_us(ts) AS us, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label,
         event_type AS type, value, CAST(user_id % 3 AS INTEGER) AS dataset
  FROM events)
"""

SCORES = """
scores AS (
  SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS y,
         fmod(value, 97) / 97.0 AS p_if, ((event_id * 37) % 101) / 100.0 AS p_lstm,
         CASE WHEN event_type = 'error' THEN
           CASE event_id % 4 WHEN 0 THEN 'ddos' WHEN 1 THEN 'injection' WHEN 2 THEN 'password' ELSE 'scanning' END
         ELSE 'normal' END AS attack_type,
         CAST(user_id % 3 AS INTEGER) AS dataset
  FROM events)
"""

MATRIX = """
matrix AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_quantity AS quantity,
         l_extendedprice AS price, l_discount AS discount, l_tax AS tax, l_returnflag AS class
  FROM lineitem)
"""

MELTED = (
    MATRIX
    + """,
melted AS (
  SELECT id, class, unnest(['quantity', 'price', 'discount', 'tax']) AS feature,
         unnest([quantity, price, discount, tax]) AS value
  FROM matrix)
"""
)
