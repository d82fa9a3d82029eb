"""Scan, sink, join and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertmill.catalog import register
from alertmill.catalog.modelling import fitted_detection
from alertmill.catalog.scoring import CONFUSION, LONG, MODEL_KEYS, RATES, long_scores
from alertmill.catalog.views_sql import ALERTS, SCORES, WINDOWS
from alertmill.catalog.windowing import STAMP, rounded
from alertmill.functions.scalars import as_utc, finite, finite_or_zero
from alertmill.operators import metrics, prep, splits
from alertmill.operators.windows import CAPTURES, into_windows, origins
from alertmill.schemas import SELECTED_FEATURES
from alertmill.session import scratch_path
from alertmill.sources import alerts as scans
from alertmill.sources import sinks, views
from alertmill.streaming import live, serving


def _fresh(spark, label):
    return scratch_path(spark, label)


@register(
    "alert_scan",
    f"""WITH {ALERTS} SELECT stream, count(*) AS n, sum(emg)::BIGINT AS n_emergency, count(DISTINCT topic) AS topics,
        sum(length(message))::BIGINT AS chars, min(us) AS first_us, max(us) AS last_us FROM alerts GROUP BY stream""",
)
def alert_scan(spark, sf_dir):
    """Through a CSV on disk and back."""
    path = _fresh(spark, "alerts-csv")
    a = views.alerts(spark, sf_dir)
    a.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).drop("id").write.option(
        "header", True
    ).option("escape", '"').partitionBy("stream").csv(path)
    parts = [scans.read_alerts(spark, f"{path}/stream={c.stream}", c.stream) for c in CAPTURES]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy("stream").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("type") == "emergency").alias("n_emergency"),
        F.count_distinct("topic").alias("topics"),
        F.sum(F.length("message")).alias("chars"),
        F.min(F.unix_micros("timestamp")).alias("first_us"),
        F.max(F.unix_micros("timestamp")).alias("last_us"),
    )


@register(
    "landed_alerts",
    f"""WITH {ALERTS} SELECT stream, count(*) AS n, max(us) AS last_us FROM alerts GROUP BY stream""",
)
def landed_alerts(spark, sf_dir):
    a = scans.land(views.alerts(spark, sf_dir), _fresh(spark, "alerts"))
    return a.groupBy("stream").agg(F.count(F.lit(1)).alias("n"), F.max(F.unix_micros("timestamp")).alias("last_us"))


@register(
    "landed_reuse",
    f"""WITH {ALERTS}, n AS (SELECT count(*) AS every, count(*) FILTER (WHERE emg = 1) AS emergency FROM alerts WHERE stream = 'flooding')
        SELECT 1 AS reading, emergency AS n FROM n UNION ALL SELECT 2, emergency FROM n UNION ALL SELECT 3, every FROM n""",
)
def landed_reuse(spark, sf_dir):
    """Land a capture, read it again as it is, change the source, and read again."""
    csv, parquet = _fresh(spark, "source-csv"), _fresh(spark, "landed")
    a = views.alerts(spark, sf_dir).filter("stream = 'flooding'")
    a = a.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).drop("id", "stream")
    counts = []
    for source in (a.filter("type = 'emergency'"), None, a):
        if source is not None:
            source.write.mode("overwrite").option("header", True).option("escape", '"').csv(csv)
        counts.append(scans.landed_or_read(spark, csv, parquet, "flooding").count())
    return spark.createDataFrame(list(enumerate(counts, 1)), "reading int, n bigint")


@register("float_downcast", "SELECT event_id AS id, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value FROM events")
def float_downcast(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "value")
    return scans.downcast(e).withColumn("value", F.col("value").cast("double"))


@register(
    "dataset_discovery",
    """SELECT 'log' || CAST(user_id % 3 AS VARCHAR) AS dataset, count(*) AS n,
       round(sum(value), 2) AS total FROM events GROUP BY 1""",
)
def dataset_discovery(spark, sf_dir):
    """One CSV per dataset in a folder, found and read in one job."""
    folder = _fresh(spark, "sensor-logs")
    r = views.readings(spark, sf_dir)
    r = r.withColumn("date", F.date_format("timestamp", "dd-MMM-yy")).withColumn(
        "time", F.date_format("timestamp", " HH:mm:ss")
    )
    out = r.select("date", "time", "value", "label", "type", F.concat(F.lit("log"), "dataset").alias("log"))
    out.write.partitionBy("log").option("header", True).csv(folder)
    found = scans.read_sensors(spark, folder)
    return found.groupBy(F.col("log").alias("dataset")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")
    )


@register(
    "unlike_sensor_logs",
    """SELECT 'log' || CAST(user_id % 3 AS VARCHAR) AS dataset, count(*) AS n,
       CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS attacks,
       CASE WHEN user_id % 3 = 0 THEN round(sum(value), 2) END AS temperature,
       CASE WHEN user_id % 3 = 1 THEN round(sum(value), 2) END AS pressure,
       CASE WHEN user_id % 3 = 2 THEN round(sum(value), 2) END AS humidity,
       CAST(sum(epoch_us(date_trunc('second', ts)) // 1000000 % 86400) AS BIGINT) AS seconds
       FROM events GROUP BY user_id % 3""",
)
def unlike_sensor_logs(spark, sf_dir):
    """A folder of three logs with other columns in another order, each read by its own header."""
    folder = _fresh(spark, "unlike-logs")
    r = views.readings(spark, sf_dir).withColumns(
        {"date": F.date_format("timestamp", "dd-MMM-yy"), "time": F.date_format("timestamp", " HH:mm:ss")}
    )
    stamp = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("ts")
    logs = [
        r.select("date", "time", F.col("value").alias("temperature"), "label", "type"),
        r.select("label", "type", F.lit("low").alias("condition"), F.col("value").alias("pressure"), "date", "time"),
        r.select(stamp, F.col("value").alias("humidity"), F.lit(0).alias("light"), "type", "label"),
    ]
    for k, log in enumerate(logs):
        log.filter(F.col("dataset") == k).write.option("header", True).csv(f"{folder}/log=log{k}")
    found = scans.read_sensors(spark, folder)
    names = ("temperature", "pressure", "humidity")
    return found.groupBy(F.col("log").alias("dataset")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("label").alias("attacks"),
        *[F.round(F.sum(F.col(c).cast("double")), 2).alias(c) for c in names],
        F.sum(F.unix_timestamp("timestamp") % 86400).alias("seconds"),
    )


@register(
    "sensor_time_parse",
    """SELECT event_id AS id, epoch_us(date_trunc('second', ts)) AS us FROM events WHERE event_type <> 'view'""",
)
def sensor_time_parse(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").withColumn("t", as_utc("ts"))
    raw = e.select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_type") == "view", "not a date").otherwise(F.date_format("t", "d-MMM-yy")).alias("date"),
        F.date_format("t", "' 'HH:mm:ss' '").alias("time"),
    )
    return scans.sensor_time(raw).select("id", F.unix_micros("timestamp").alias("us"))


@register(
    "packet_scan",
    """SELECT CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS day, count(*) AS n, sum(length(props))::BIGINT AS chars
       FROM events GROUP BY 1""",
)
def packet_scan(spark, sf_dir):
    path = _fresh(spark, "packets-csv")
    e = views.table(spark, sf_dir, "events")
    day = (F.unix_micros(as_utc("ts")) / 1_000_000).cast("string")
    e.select(F.lit("3").alias("mqtt.msgtype"), F.base64(F.encode("props", "UTF-8")).alias("mqtt.msg"), day.alias("frame.time_epoch")).write.option(
        "header", True
    ).csv(path)
    read = scans.read_packets(spark, path)
    return read.groupBy(
        F.floor(F.col("`frame.time_epoch`").cast("double") / 86400).cast("bigint").alias("day")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.unbase64("`mqtt.msg`"))).alias("chars"))


PLACED_SPLIT = (
    WINDOWS
    + """,
sp AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY attack_type ORDER BY ws, window_id)
    <= floor(count(*) OVER (PARTITION BY attack_type) * 0.6) THEN 'train' ELSE 'test' END AS split FROM windows)
"""
)


def _split(spark, sf_dir):
    return splits.chronological_split(views.windows(spark, sf_dir))


@register(
    "feature_sinks",
    f"""WITH {PLACED_SPLIT} SELECT 'labelled' AS part, count(*) AS n, sum(n_emergency)::BIGINT AS emergencies FROM sp
        UNION ALL SELECT 'normal', count(*), sum(n_emergency)::BIGINT FROM sp WHERE label = 1
        UNION ALL SELECT split, count(*), sum(n_emergency)::BIGINT FROM sp GROUP BY split""",
)
def feature_sinks(spark, sf_dir):
    path = _fresh(spark, "features")
    sinks.write_features(_split(spark, sf_dir), path)
    out = None
    for part in ("labelled", "normal", "train", "test"):
        row = sinks.read_features(spark, path, part).agg(
            F.lit(part).alias("part"), F.count(F.lit(1)).alias("n"), F.sum("n_emergency").alias("emergencies")
        )
        out = row if out is None else out.unionByName(row)
    return out


@register(
    "enriched_table",
    f"""WITH {WINDOWS}, r AS (SELECT attack_type, avg(alert_frequency_per_hour) OVER w AS m, count(*) OVER w AS c
          FROM windows WINDOW w AS (PARTITION BY attack_type ORDER BY ws, window_id
          ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
        SELECT attack_type, count(*) AS n, round(avg(m) FILTER (c >= 3), 5) AS mean FROM r GROUP BY attack_type""",
)
def enriched_table(spark, sf_dir):
    """Enriched twice, so the second run replaces the columns of the first."""
    first, second, third = (_fresh(spark, f"v{i}") for i in (1, 2, 3))
    views.windows(spark, sf_dir).write.parquet(first)
    sinks.enrich_in_versions(spark, first, second)
    t = sinks.enrich_in_versions(spark, second, third)
    ranks = splits.in_order(t, ["attack_type"], ["window_start_time", "window_id"])
    full = F.col("_rank") >= 3
    return ranks.groupBy("attack_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(full, F.col("freq_rolling_mean_5w"))), 5).alias("mean")
    )


@register(
    "audit_record",
    f"""WITH {PLACED_SPLIT} SELECT count(*) AS total, count(*) FILTER (attack_type = 'normal') AS normal,
        count(*) FILTER (attack_type = 'flooding') AS flooding, count(*) FILTER (split = 'train') AS train,
        count(*) FILTER (split = 'test') AS test FROM sp""",
)
def audit_record(spark, sf_dir):
    path = _fresh(spark, "audit")
    sinks.write_record(sinks.audit(_split(spark, sf_dir)), path)
    return spark.read.json(path).select(
        "total", F.col("classes.normal").alias("normal"), F.col("classes.flooding").alias("flooding"), "splits.train", "splits.test"
    )


@register(
    "result_sink",
    f"""WITH {LONG}, c AS (SELECT dataset, model, {CONFUSION.format(t=0.5)} FROM long GROUP BY ALL), r AS (SELECT *, {RATES} FROM c)
        SELECT CAST(dataset AS INTEGER) AS dataset, count(*) AS models, round(max(f1), 6) AS best_f1 FROM r GROUP BY dataset""",
)
def result_sink(spark, sf_dir):
    path = _fresh(spark, "results")
    r = metrics.confusion(long_scores(spark, sf_dir), MODEL_KEYS)
    sinks.write_results(r.filter("dataset < 2"), path)
    sinks.write_results(r.filter("dataset > 0"), path)
    return spark.read.parquet(path).groupBy("dataset").agg(
        F.count(F.lit(1)).alias("models"), F.round(F.max("f1"), 6).alias("best_f1")
    )


@register("feature_cache", f"WITH {WINDOWS} SELECT stream, count(*) AS n FROM windows GROUP BY stream")
def feature_cache(spark, sf_dir):
    root = _fresh(spark, "cache")
    key = sinks.cache_key(["burst_score"], sf_dir)
    sinks.cached(spark, root, key, lambda: views.windows(spark, sf_dir))

    def again():
        raise AssertionError("the stored copy must be used")

    return sinks.cached(spark, root, key, again).groupBy("stream").agg(F.count(F.lit(1)).alias("n"))


@register(
    "earlier_results",
    f"""WITH {LONG}, a AS (SELECT dataset, avg(p) AS now FROM long WHERE model = 'forest' GROUP BY dataset),
        b AS (SELECT dataset, avg(p) AS old FROM long WHERE model = 'sequence' AND dataset < 2 GROUP BY dataset)
        SELECT a.dataset, round(now, 6) AS value, round(old, 6) AS earlier_value FROM a LEFT JOIN b ON a.dataset = b.dataset""",
)
def earlier_results(spark, sf_dir):
    s = long_scores(spark, sf_dir).groupBy("dataset", "model").agg(F.avg("p").alias("value"))
    now = s.filter("model = 'forest'").drop("model")
    old = s.filter("model = 'sequence' AND dataset < 2").drop("model")
    return rounded(sinks.with_earlier(now, old), ["value", "earlier_value"])


@register(
    "catalogued_datasets",
    f"WITH {SCORES} SELECT dataset, count(*) AS n FROM scores WHERE dataset IN (SELECT user_id % 3 FROM events WHERE user_id < 2) GROUP BY dataset",
)
def catalogued_datasets(spark, sf_dir):
    listed = views.table(spark, sf_dir, "events").filter("user_id < 2").select((F.col("user_id") % 3).cast("int").alias("dataset"))
    s = scans.catalogued(views.scores(spark, sf_dir), listed)
    return s.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


@register(
    "window_membership",
    f"""WITH {WINDOWS} SELECT stream, count(*) AS pairs, sum(emg)::BIGINT AS emergencies, count(DISTINCT k) AS windows
        FROM inside GROUP BY stream""",
)
def window_membership(spark, sf_dir):
    """Every (window, message) pair, by pane instead of by range condition."""
    a = views.alerts(spark, sf_dir)
    starts = origins(a, CAPTURES)
    us = F.unix_micros("timestamp")
    rows = a.join(starts, "stream").withColumn("pane", F.call_function("div", us - F.col("t0"), F.col("pane_us")))
    per_pane = rows.groupBy("stream", "pane").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("type") == "emergency").alias("e")
    )
    return into_windows(per_pane.join(starts, "stream")).groupBy("stream").agg(
        F.sum("n").alias("pairs"), F.sum("e").alias("emergencies"), F.count_distinct("k").alias("windows")
    )


@register(
    "score_alignment",
    f"""WITH {SCORES}, s AS (SELECT dataset, id, p_lstm, row_number() OVER (PARTITION BY dataset ORDER BY id) - 1 AS pos,
          p_if FROM scores)
        SELECT dataset, count(*) AS n, round(sum(p_if * p_lstm), 4) AS product FROM s WHERE pos >= 9 GROUP BY dataset""",
)
def score_alignment(spark, sf_dir):
    """Sequence scores start at the tenth row; both scores are joined on the row they end at."""
    s = views.scores(spark, sf_dir)
    seq = splits.in_order(s, ["dataset"], ["id"]).filter("_rank >= 10").select("id", "p_lstm")
    both = s.select("id", "dataset", "p_if").join(seq, "id")
    return both.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("p_if") * F.col("p_lstm")), 4).alias("product")
    )


@register(
    "scenario_mask",
    f"WITH {SCORES} SELECT attack_type, count(*) AS n FROM scores WHERE y = 1 OR attack_type = 'ddos' GROUP BY attack_type",
)
def scenario_mask(spark, sf_dir):
    s = views.scores(spark, sf_dir).filter((F.col("y") == 1) | (F.col("attack_type") == "ddos"))
    return s.groupBy("attack_type").agg(F.count(F.lit(1)).alias("n"))


@register(
    "index_union",
    f"WITH {SCORES} SELECT DISTINCT id FROM (SELECT id FROM scores WHERE y = 0 UNION SELECT id FROM scores WHERE p_lstm < 0.3)",
)
def index_union(spark, sf_dir):
    s = views.scores(spark, sf_dir)
    return s.filter("y = 0").select("id").union(s.filter("p_lstm < 0.3").select("id")).distinct().orderBy("id")


@register(
    "finite_values",
    """SELECT count(*) AS n, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS missing,
       round(sum(CASE WHEN event_type = 'error' THEN 0 ELSE value END), 2) AS total FROM events""",
)
def finite_values(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    odd = F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 2 == 0, float("inf")).otherwise(float("nan")))
    v = odd.otherwise(F.col("value"))
    return e.select(finite(v).alias("f"), finite_or_zero(v).alias("z")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("f").isNull()).alias("missing"), F.round(F.sum("z"), 2).alias("total")
    )


@register("missing_features", f"WITH {WINDOWS} SELECT window_id, burst_score, 0e0 AS absent_feature FROM windows")
def missing_features(spark, sf_dir):
    w = prep.with_missing_zero(views.windows(spark, sf_dir), ["burst_score", "absent_feature"])
    return w.select("window_id", "burst_score", "absent_feature")


@register("projected_features", f"WITH {WINDOWS} SELECT burst_score, topic_diversity, count(*) AS n FROM windows GROUP BY ALL")
def projected_features(spark, sf_dir):
    p = prep.require(views.windows(spark, sf_dir), ["burst_score", "topic_diversity"])
    return p.groupBy("burst_score", "topic_diversity").agg(F.count(F.lit(1)).alias("n"))


# Streaming.


def _alert_stream(spark, sf_dir, message=False):
    # A pattern, since a stream may not name a single file.
    raw = live.read_stream(spark, f"{sf_dir}/events.parque[t]", views.table(spark, sf_dir, "events").schema)
    k = F.regexp_extract("props", '"k": (\\d+)', 1).cast("int")
    return raw.select(
        as_utc("ts").alias("timestamp"),
        F.when(F.col("event_type") == "error", "emergency").otherwise("normal").alias("type"),
        F.concat(F.lit("home/"), (k % 3).cast("string")).alias("topic"),
        F.when(F.col("user_id") % 3 == 0, "normal").when(F.col("user_id") % 3 == 1, "flooding").otherwise("slow_poisoning").alias("stream"),
        *([F.col("props").alias("message")] if message else []),
    )


LIVE_COLS = ["normal_emergency_ratio", "burst_score", "topic_diversity", "time_sin", "time_cos", "temporal_clustering_score"]

LIVE_SQL = f"""WITH {ALERTS},
g AS (SELECT a.*, unnest(range(us // 600000000 - 5, us // 600000000 + 1)) AS w FROM alerts a),
cl AS (SELECT * FROM g WHERE w * 600000000 + 3600000000 <= (SELECT max(us) - 600000000 FROM alerts)),
b AS (SELECT stream, w, count(*) AS n, sum(emg) AS e, count(DISTINCT CASE WHEN emg = 1 THEN topic END) AS topics,
    make_timestamp(coalesce(min(CASE WHEN emg = 1 THEN us END), min(us))) AS ref FROM cl GROUP BY ALL),
b5 AS (SELECT stream, w, max(c) AS max5 FROM (SELECT stream, w, us // 300000000 AS bin, sum(emg) AS c FROM cl GROUP BY ALL)
  GROUP BY ALL),
b10 AS (SELECT stream, w, max(c) AS m, avg(c) AS a FROM (SELECT stream, w, us // 600000000 AS bin, sum(emg) AS c FROM cl
  WHERE emg = 1 GROUP BY ALL) GROUP BY ALL)
SELECT b.stream, strftime(make_timestamp(b.w * 600000000), '%Y-%m-%d %H:%M:%S.%f') AS window_start, n AS n_messages,
  e::BIGINT AS n_emergency, round((n - e) / greatest(1, e) + 1e-9, 6) AS normal_emergency_ratio,
  round(max5::DOUBLE + 1e-9, 6) AS burst_score, round(topics::DOUBLE + 1e-9, 6) AS topic_diversity,
  round(sin(2 * pi() * (hour(ref) + minute(ref) / 60.0) / 24) + 1e-9, 6) AS time_sin,
  round(cos(2 * pi() * (hour(ref) + minute(ref) / 60.0) / 24) + 1e-9, 6) AS time_cos,
  round(CASE WHEN e >= 3 THEN m / a ELSE 1e0 END + 1e-9, 6) AS temporal_clustering_score
FROM b JOIN b5 ON b5.stream = b.stream AND b5.w = b.w LEFT JOIN b10 ON b10.stream = b.stream AND b10.w = b.w"""


@register("live_windows", LIVE_SQL)
def live_windows(spark, sf_dir):
    """Windows closed by the watermark once the whole table has streamed through."""
    stream = live.live_windows(_alert_stream(spark, sf_dir))
    w = live.run_to_table(stream, _fresh(spark, "live"), _fresh(spark, "live-state"))
    w = w.withColumn("window_start", F.date_format("window_start_time", STAMP))
    return rounded(w.select("stream", "window_start", "n_messages", "n_emergency", *LIVE_COLS), LIVE_COLS)


def _ordered(spark, sf_dir):
    cells = _fresh(spark, "cells")
    first = live.second_cells(_alert_stream(spark, sf_dir))
    live.run_to_table(first, cells, _fresh(spark, "cells-state"))
    second = live.ordered_features(live.read_stream(spark, cells, first.schema))
    return live.run_to_table(second, _fresh(spark, "ordered"), _fresh(spark, "ordered-state"))


ORDERED_SQL = f"""WITH {ALERTS},
wm AS (SELECT max(us // 1000000) FILTER ((us // 1000000 + 1) * 1000000 <= (SELECT max(us) - 600000000 FROM alerts))
    * 1000000 AS done FROM alerts),
g AS (SELECT a.*, unnest(range(us // 600000000 - 5, us // 600000000 + 1)) AS w FROM alerts a),
cl AS (SELECT g.* FROM g, wm WHERE w * 600000000 + 3600000000 <= done),
d AS (SELECT stream, w, (us - lag(us) OVER (PARTITION BY stream, w ORDER BY us)) / 6e7 AS d FROM cl WHERE emg = 1),
ds AS (SELECT stream, w, avg(d) AS mean_d, coalesce(var_samp(d), 0) AS var_d FROM d GROUP BY ALL),
b AS (SELECT stream, w, sum(emg) AS e, min(us) AS first_us FROM cl GROUP BY ALL),
h AS (SELECT b.stream, b.w, count(*) AS early FROM b JOIN cl ON cl.stream = b.stream AND cl.w = b.w
  WHERE emg = 1 AND us < first_us + 1800000000 GROUP BY ALL),
i AS (SELECT b.*, sum(CASE WHEN w - prev <= 12 THEN 0 ELSE 1 END) OVER (PARTITION BY stream ORDER BY w) AS island
  FROM (SELECT *, lag(w) OVER (PARTITION BY stream ORDER BY w) AS prev FROM b) b),
r AS (SELECT stream, w, e, CASE WHEN count(*) OVER x >= 3 THEN stddev_samp(e) OVER x END AS s FROM i
  WINDOW x AS (PARTITION BY stream, island ORDER BY w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT r.stream, strftime(make_timestamp(r.w * 600000000), '%Y-%m-%d %H:%M:%S.%f') AS window_start, e::BIGINT AS n_emergency,
  round(CASE WHEN e >= 2 THEN mean_d END + 1e-9, 6) AS inter_alert_interval_mean,
  round(CASE WHEN e >= 3 THEN var_d ELSE 0 END + 1e-9, 6) AS inter_interval_variance,
  round(CASE WHEN e >= 4 THEN e - 2 * coalesce(early, 0) ELSE 0 END + 1e-9, 6) AS alert_rate_acceleration,
  round(s + 1e-9, 6) AS freq_rolling_std_5w
FROM r LEFT JOIN ds ON ds.stream = r.stream AND ds.w = r.w LEFT JOIN h ON h.stream = r.stream AND h.w = r.w"""


@register("live_ordered_features", ORDERED_SQL)
def live_ordered_features(spark, sf_dir):
    w = _ordered(spark, sf_dir)
    cols = ["inter_alert_interval_mean", "inter_interval_variance", "alert_rate_acceleration", "freq_rolling_std_5w"]
    return rounded(
        w.select("stream", F.date_format("window_start_time", STAMP).alias("window_start"), "n_emergency", *cols), cols
    )


@register(
    "live_scoring",
    f"""WITH {ALERTS},
        g AS (SELECT a.*, unnest(range(us // 600000000 - 5, us // 600000000 + 1)) AS w FROM alerts a),
        b AS (SELECT stream, w, sum(emg) AS e FROM g
          WHERE w * 600000000 + 3600000000 <= (SELECT max(us) - 600000000 FROM alerts) GROUP BY ALL)
        SELECT stream, CASE WHEN 1e0 / (1 + e) < 0.5 THEN 'DROP' ELSE 'FORWARD' END AS route, count(*) AS n FROM b
        GROUP BY ALL""",
)
def live_scoring(spark, sf_dir):
    """Closed windows scored by a simple rate rule and routed in micro-batches."""
    closed, out = _fresh(spark, "closed"), _fresh(spark, "routed")
    windows = live.live_windows(_alert_stream(spark, sf_dir))
    live.run_to_table(windows, closed, _fresh(spark, "closed-state"))
    stream = live.read_stream(spark, closed, windows.schema)
    rule = lambda df: df.withColumn("p", 1.0 / (1.0 + F.col("n_emergency")))
    live.score_stream(stream, rule, out, _fresh(spark, "routed-state")).start().awaitTermination()
    return spark.read.parquet(out).groupBy("stream", "route").agg(F.count(F.lit(1)).alias("n"))


LIVE_ALL = [
    "normal_emergency_ratio", "inter_alert_interval_mean", "inter_interval_variance", "burst_score", "topic_diversity",
    "payload_entropy", "alert_rate_acceleration", "regularity_coefficient", "temporal_clustering_score",
    "freq_persistence_5w", "freq_rolling_mean_5w", "freq_rolling_std_5w",
]


def _served(spark, sf_dir, models=None):
    """Folder of all live windows with their sequences, and of the scores if models are given."""
    out = _fresh(spark, "served")
    features = serving.live_features(_alert_stream(spark, sf_dir, message=True))
    serving.serve(features, out, _fresh(spark, "served-state"), models).start().awaitTermination()
    return out


LIVE_BASE = f"""{ALERTS},
g AS (SELECT a.*, unnest(range(us // 600000000 - 5, us // 600000000 + 1)) AS w FROM alerts a),
cl AS (SELECT * FROM g WHERE w * 600000000 + 3600000000 <= (SELECT max(us) - 600000000 FROM alerts)),
b AS (SELECT stream, w, count(*) AS n, CAST(sum(emg) AS BIGINT) AS e, min(us) AS first_us,
    count(DISTINCT CASE WHEN emg = 1 THEN topic END) AS topics FROM cl GROUP BY stream, w),
i AS (SELECT *, sum(CASE WHEN w - prev <= 12 THEN 0 ELSE 1 END) OVER (PARTITION BY stream ORDER BY w) AS island
  FROM (SELECT *, lag(w) OVER (PARTITION BY stream ORDER BY w) AS prev FROM b) AS b),
r AS (SELECT *, row_number() OVER (PARTITION BY stream, island ORDER BY w) AS place,
    CASE WHEN count(*) OVER x >= 3 THEN stddev_samp(e) OVER x END AS s,
    CASE WHEN count(*) OVER x >= 3 THEN avg(e) OVER x END AS a,
    CASE WHEN count(*) OVER x >= 3 THEN avg(CASE WHEN e > 0 THEN 1e0 ELSE 0e0 END) OVER x END AS h FROM i
  WINDOW x AS (PARTITION BY stream, island ORDER BY w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))"""

LIVE_ALL_SQL = f"""WITH {LIVE_BASE},
b5 AS (SELECT stream, w, max(c) AS max5 FROM (SELECT stream, w, us // 300000000 AS bin, sum(emg) AS c FROM cl GROUP BY ALL)
  GROUP BY stream, w),
b10 AS (SELECT stream, w, max(c) AS m10, avg(c) AS a10 FROM (SELECT stream, w, us // 600000000 AS bin, sum(emg) AS c FROM cl
  WHERE emg = 1 GROUP BY ALL) GROUP BY stream, w),
d AS (SELECT stream, w, (us - lag(us) OVER (PARTITION BY stream, w ORDER BY us)) / 6e7 AS d FROM cl WHERE emg = 1),
ds AS (SELECT stream, w, avg(d) AS mean_d, coalesce(var_samp(d), 0) AS var_d FROM d GROUP BY stream, w),
ea AS (SELECT cl.stream, cl.w, count(*) AS early FROM cl JOIN b ON cl.stream = b.stream AND cl.w = b.w
  WHERE emg = 1 AND us < first_us + 1800000000 GROUP BY cl.stream, cl.w),
bl AS (SELECT stream, w, string_agg(hex(message), '00') AS blob FROM cl WHERE emg = 1 AND message IS NOT NULL GROUP BY stream, w),
bc AS (SELECT stream, w, x, count(*) AS c FROM (SELECT stream, w, unnest(regexp_extract_all(blob, '..')) AS x FROM bl) GROUP BY ALL),
bt AS (SELECT stream, w, sum(c) AS total FROM bc GROUP BY stream, w),
en AS (SELECT bc.stream, bc.w, -sum(c / total * log2(c / total + 1e-12)) AS entropy FROM bc JOIN bt
  ON bc.stream = bt.stream AND bc.w = bt.w GROUP BY bc.stream, bc.w),
f AS (SELECT r.stream, r.w, n, e, place, s, a, h, topics, max5, m10, a10, entropy, early, CASE WHEN e >= 2 THEN mean_d END AS mean_d,
    CASE WHEN e >= 3 THEN var_d ELSE 0 END AS var_d
  FROM r JOIN b5 ON b5.stream = r.stream AND b5.w = r.w LEFT JOIN b10 ON b10.stream = r.stream AND b10.w = r.w
  LEFT JOIN ds ON ds.stream = r.stream AND ds.w = r.w LEFT JOIN ea ON ea.stream = r.stream AND ea.w = r.w
  LEFT JOIN en ON en.stream = r.stream AND en.w = r.w)
SELECT stream, strftime(make_timestamp(w * 600000000), '%Y-%m-%d %H:%M:%S.%f') AS window_start, n AS n_messages, e AS n_emergency,
  round((n - e) / greatest(1, e) + 1e-9, 6) AS normal_emergency_ratio, round(mean_d + 1e-9, 6) AS inter_alert_interval_mean,
  round(var_d + 1e-9, 6) AS inter_interval_variance, round(max5::DOUBLE + 1e-9, 6) AS burst_score,
  round(topics::DOUBLE + 1e-9, 6) AS topic_diversity, round(coalesce(entropy, 0) + 1e-9, 6) AS payload_entropy,
  round(CASE WHEN e >= 4 THEN e - 2 * coalesce(early, 0) ELSE 0 END + 1e-9, 6) AS alert_rate_acceleration,
  round(CASE WHEN e >= 3 AND var_d > 1e-18 AND mean_d > 0 THEN 1 / greatest(sqrt(var_d) / mean_d, 0.01) WHEN e >= 2 THEN 100 END + 1e-9, 6)
    AS regularity_coefficient,
  round(CASE WHEN e >= 3 THEN m10 / a10 ELSE 1e0 END + 1e-9, 6) AS temporal_clustering_score,
  round(h + 1e-9, 6) AS freq_persistence_5w, round(a + 1e-9, 6) AS freq_rolling_mean_5w, round(s + 1e-9, 6) AS freq_rolling_std_5w,
  round(CASE WHEN place >= 10 THEN sum(coalesce(mean_d, 0)) OVER v + 1e-9 END, 5) AS sequence_means
FROM f WINDOW v AS (PARTITION BY stream ORDER BY w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"""


@register("live_features", LIVE_ALL_SQL)
def live_features(spark, sf_dir):
    """Every live feature, and of each sequence the sum of one of its eight features over the ten windows."""
    w = spark.read.parquet(f"{_served(spark, sf_dir)}/windows").withColumn("window_start", F.date_format("window_start_time", STAMP))
    at, width = SELECTED_FEATURES.index("inter_alert_interval_mean"), len(SELECTED_FEATURES)
    ten = F.aggregate(
        F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.get("vectors", i * width + at)),
        F.lit(0.0),
        lambda s, x: s + F.coalesce(F.nanvl(x, F.lit(None)), F.lit(0.0)),
    )
    means = F.when(F.col("vectors").isNotNull(), F.round(ten + 1e-9, 5)).alias("sequence_means")
    return rounded(w.select("stream", "window_start", "n_messages", "n_emergency", *LIVE_ALL, means), LIVE_ALL)


@register(
    "live_model_scoring",
    f"""WITH {LIVE_BASE} SELECT stream, count(*) AS n_live, count(*) AS n_batch, count(*) AS n_equal, 1 AS version
        FROM r WHERE place >= 10 GROUP BY stream""",
)
def live_model_scoring(spark, sf_dir):
    """The stream scored by the published detection, held against the batch scores of the same windows."""
    model, models = fitted_detection(spark, sf_dir), _fresh(spark, "models")
    serving.publish(spark, model, models)
    out = _served(spark, sf_dir, models)
    windows = spark.read.parquet(f"{out}/windows").drop("batch")
    parts = ["p_forest", "p_sequence", "p"]
    mine = spark.read.parquet(f"{out}/scores").select("stream", "window_start_time", "version", *[F.col(c).alias(f"live_{c}") for c in parts])
    named = windows.drop("vectors").withColumn("window_id", F.concat_ws(":", "stream", F.col("window_start_time").cast("string")))
    batch = model.calibrate(model.raw_scores(named, ["stream"])).select("stream", "window_start_time", *parts)
    both = mine.join(batch, ["stream", "window_start_time"], "full")
    apart = F.greatest(*[F.abs(F.col(f"live_{c}") - F.col(c)) for c in parts])
    return both.groupBy("stream").agg(
        F.count("live_p").alias("n_live"),
        F.count("p").alias("n_batch"),
        F.count_if(apart < 1e-9).alias("n_equal"),
        F.max("version").alias("version"),
    )
