"""Rolling, neighbour, sequence and run queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertmill.catalog import register
from alertmill.catalog.sensing import HOURS, PACKETS
from alertmill.catalog.views_sql import SCORES, WINDOWS
from alertmill.catalog.windowing import rounded
from alertmill.functions.scalars import attack_family
from alertmill.operators import packets as P
from alertmill.operators import rolling as R
from alertmill.operators import runs, sensor
from alertmill.operators import sequences as Q
from alertmill.schemas import SEQUENTIAL_FEATURES
from alertmill.sources import views

WINDOW_ORDER = ["window_start_time", "window_id"]

ROLL = (
    WINDOWS
    + """,
roll AS (
  SELECT window_id, attack_type, ws, row_number() OVER o AS rn, count(*) OVER (PARTITION BY attack_type) AS n,
    CASE WHEN count(*) OVER w >= 3 THEN avg(CASE WHEN n_emergency > 0 THEN 1e0 ELSE 0e0 END) OVER w END AS p,
    CASE WHEN count(*) OVER w >= 3 THEN avg(alert_frequency_per_hour) OVER w END AS m,
    CASE WHEN count(*) OVER w >= 3 THEN stddev_samp(alert_frequency_per_hour) OVER w END AS s
  FROM windows
  WINDOW o AS (PARTITION BY attack_type ORDER BY ws, window_id),
         w AS (PARTITION BY attack_type ORDER BY ws, window_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
med AS (
  SELECT attack_type, quantile_cont(p, 0.5) FILTER (rn <= greatest(1, floor(n * 0.6))) AS mp,
    quantile_cont(m, 0.5) FILTER (rn <= greatest(1, floor(n * 0.6))) AS mm,
    quantile_cont(s, 0.5) FILTER (rn <= greatest(1, floor(n * 0.6))) AS ms,
    quantile_cont(p, 0.5) AS ap, quantile_cont(m, 0.5) AS am, quantile_cont(s, 0.5) AS as_
  FROM roll GROUP BY attack_type)
"""
)


def _rolling(name: str, col: str, short: str) -> None:
    @register(name, f"WITH {ROLL} SELECT window_id, round({short}, 6) AS {col} FROM roll")
    def query(spark, sf_dir):
        rows = R.rolling_raw(views.windows(spark, sf_dir))
        return rows.select("window_id", F.round(col, 6).alias(col))


_rolling("rolling_persistence", "freq_persistence_5w", "p")
_rolling("rolling_mean", "freq_rolling_mean_5w", "m")
_rolling("rolling_std", "freq_rolling_std_5w", "s")


@register(
    "sequential_features",
    f"""WITH {ROLL} SELECT window_id, round(coalesce(p, mp, ap, 0), 6) AS freq_persistence_5w,
        round(coalesce(m, mm, am, 0), 6) AS freq_rolling_mean_5w,
        round(coalesce(s, ms, as_, 0), 6) AS freq_rolling_std_5w
        FROM roll JOIN med ON med.attack_type = roll.attack_type""",
)
def sequential_features(spark, sf_dir):
    rows = R.sequential_features(views.windows(spark, sf_dir))
    return rows.select("window_id", *[F.round(c, 6).alias(c) for c in SEQUENTIAL_FEATURES])


@register(
    "rolling_fill_medians",
    f"""WITH {ROLL} SELECT attack_type, 'train' AS scope, round(mp, 6) AS persistence, round(mm, 6) AS mean,
          round(ms, 6) AS std FROM med
        UNION ALL SELECT attack_type, 'all', round(ap, 6), round(am, 6), round(as_, 6) FROM med""",
)
def rolling_fill_medians(spark, sf_dir):
    long = R.fill_medians(R.rolling_raw(views.windows(spark, sf_dir)))
    names = dict(zip(SEQUENTIAL_FEATURES, ["persistence", "mean", "std"], strict=True))
    return long.groupBy("attack_type", "scope").agg(
        *[F.round(F.max(F.when(F.col("feature") == f, F.col("median"))), 6).alias(a) for f, a in names.items()]
    )


TAS_FEATURES = ["alert_frequency_per_hour", "normal_emergency_ratio", "payload_entropy", "alert_rate_acceleration"]


def _near(col: str) -> str:
    w = "PARTITION BY dataset ORDER BY h ROWS BETWEEN"
    return (
        f"list_concat(coalesce(list({col}) OVER ({w} 5 PRECEDING AND 1 PRECEDING), []), "
        f"coalesce(list({col}) OVER ({w} 1 FOLLOWING AND 5 FOLLOWING), []))"
    )


_TAS_SQL = f"""WITH {HOURS.format(least=3)},
near AS (SELECT dataset, h, {", ".join(f"{c} AS x{i}, {_near(c)} AS a{i}" for i, c in enumerate(TAS_FEATURES))}
         FROM feats),
meds AS (SELECT *, {", ".join(f"list_median(a{i}) AS m{i}" for i in range(4))} FROM near),
mads AS (SELECT *, {", ".join(
    f"list_median(list_transform(a{i}, lambda x: abs(x - m{i}))) + 1e-9 AS d{i}" for i in range(4))} FROM meds),
raw AS (SELECT dataset, h, CASE WHEN len(a0) < 2 THEN 0e0
        ELSE ({" + ".join(f"abs(x{i} - m{i}) / d{i}" for i in range(4))}) / 4 END AS tas_raw FROM mads)
SELECT dataset, make_timestamp(h * 3600000000)::VARCHAR AS start,
  round((tas_raw - avg(tas_raw) OVER (PARTITION BY dataset))
        / (stddev_pop(tas_raw) OVER (PARTITION BY dataset) + 1e-9), 5) AS tas FROM raw"""


@register("neighbour_deviation", _TAS_SQL)
def neighbour_deviation(spark, sf_dir):
    w = sensor.sensor_windows(views.readings(spark, sf_dir), min_rows=3, rolling=False)
    rows = R.neighbour_deviation(w, "dataset", ["window_start_time"], TAS_FEATURES)
    return rows.select(
        "dataset",
        F.date_format("window_start_time", "yyyy-MM-dd HH:mm:ss").alias("start"),
        F.round("tas", 5).alias("tas"),
    )


DIST_FEATURES = ["payload_entropy", "topic_diversity", "normal_emergency_ratio", "alert_rate_acceleration"]


@register(
    "neighbour_distance",
    f"""WITH {PACKETS}, m AS (SELECT window_no, {", ".join(
        f"{c} - (sum({c}) OVER w - {c}) / (count(*) OVER w - 1) AS g{i}" for i, c in enumerate(DIST_FEATURES))}
        FROM pw WINDOW w AS (ORDER BY window_no ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING))
        SELECT window_no, round(sqrt({" + ".join(f"g{i} * g{i}" for i in range(4))}), 6) AS tas FROM m""",
)
def neighbour_distance(spark, sf_dir):
    f = P.packet_features(P.packet_windows(views.packets(spark, sf_dir)))
    return R.neighbour_distance(f, [], ["window_no"], DIST_FEATURES).select("window_no", F.round("tas", 6).alias("tas"))


SEQ_FEATURES = ["alert_frequency_per_hour", "burst_score"]

SEQS = (
    WINDOWS
    + """,
o AS (SELECT *, row_number() OVER w AS rn, ws - lag(ws) OVER w AS gap_us
  FROM windows WINDOW w AS (PARTITION BY stream ORDER BY ws, window_id)),
s AS (SELECT stream, window_id, rn, label, gap_us, ws,
    max(gap_us) OVER (PARTITION BY stream ORDER BY rn ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS worst,
    list(alert_frequency_per_hour) OVER w10 AS f, list(burst_score) OVER w10 AS b
  FROM o WINDOW w10 AS (PARTITION BY stream ORDER BY rn ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
"""
)


def _flat(df, *ids):
    return df.select(
        *ids,
        F.concat_ws(",", F.transform("sequence", lambda v: v[0].cast("int").cast("string"))).alias("freq"),
        F.concat_ws(",", F.transform("sequence", lambda v: v[1].cast("int").cast("string"))).alias("burst"),
    )


_TEXT = "array_to_string(list_transform({0}, lambda x: CAST(CAST(x AS INTEGER) AS VARCHAR)), ',')"


@register(
    "sliding_sequences",
    f"""WITH {SEQS} SELECT stream, rn - 1 AS end_id, label, {_TEXT.format("f")} AS freq, {_TEXT.format("b")} AS burst
        FROM s WHERE rn >= 10 AND worst <= 7200000000""",
)
def sliding_sequences(spark, sf_dir):
    q = Q.sliding_sequences(
        views.windows(spark, sf_dir), ["stream"], WINDOW_ORDER, SEQ_FEATURES, ts="window_start_time"
    )
    return _flat(q, "stream", "end_id", "label")


@register(
    "padded_sequences",
    f"""WITH {SEQS}, p AS (SELECT window_id,
        list_concat(list_resize([]::DOUBLE[], greatest(0, 10 - rn), first_value(f[1]) OVER x), f) AS f,
        list_concat(list_resize([]::DOUBLE[], greatest(0, 10 - rn), first_value(b[1]) OVER x), b) AS b
        FROM s WINDOW x AS (PARTITION BY stream ORDER BY rn))
        SELECT window_id, {_TEXT.format("f")} AS freq, {_TEXT.format("b")} AS burst FROM p""",
)
def padded_sequences(spark, sf_dir):
    q = Q.padded_sequences(views.windows(spark, sf_dir), "stream", WINDOW_ORDER, SEQ_FEATURES)
    return _flat(q, "window_id")


@register(
    "disjoint_sequences",
    f"""WITH RECURSIVE {SEQS}, nxt AS (
        SELECT stream, rn, lead(rn) OVER (PARTITION BY stream ORDER BY rn) AS following,
               worst <= 7200000000 AND rn >= 10 AS fits FROM s),
      ok AS (SELECT stream, rn FROM nxt WHERE fits),
      -- independent form: greedy walk, from each taken end to the first fitting end ten or more rows on
      walk AS (
        SELECT stream, min(rn) AS rn FROM ok GROUP BY stream
        UNION ALL
        SELECT w.stream, (SELECT min(k.rn) FROM ok k WHERE k.stream = w.stream AND k.rn >= w.rn + 10) AS rn
        FROM walk w
        WHERE EXISTS (SELECT 1 FROM ok k WHERE k.stream = w.stream AND k.rn >= w.rn + 10))
      SELECT stream, rn - 1 AS end_id FROM walk""",
)
def disjoint_sequences(spark, sf_dir):
    q = Q.disjoint_sequence_ends(views.windows(spark, sf_dir), ["stream"], WINDOW_ORDER, "window_start_time")
    return q.select("stream", "end_id")


# Runs: a score table has an attack in about one row of five; rows are ordered by id within a dataset.
RUNS = (
    SCORES
    + """,
r AS (SELECT dataset, id, y, p_if, p_lstm, attack_type, row_number() OVER (PARTITION BY dataset ORDER BY id) AS rn,
    row_number() OVER (PARTITION BY dataset ORDER BY id)
      - row_number() OVER (PARTITION BY dataset, y ORDER BY id) AS grp FROM scores),
runs AS (
  SELECT dataset, min(rn) AS run_start, count(*) AS run_length,
    coalesce(min(CASE WHEN p_lstm < 0.5 THEN rn END) - min(rn), count(*)) AS delay,
    count(*) FILTER (p_lstm < 0.5) > 0 AS detected
  FROM r WHERE y = 0 GROUP BY dataset, grp)
"""
)


def _runs(spark, sf_dir):
    return runs.detection_runs(views.scores(spark, sf_dir), ["dataset"], ["id"], F.col("p_lstm") < 0.5)


@register(
    "detection_runs",
    f"WITH {RUNS} SELECT dataset, run_start, run_length, delay, CAST(detected AS INTEGER) AS detected FROM runs",
)
def detection_runs(spark, sf_dir):
    return _runs(spark, sf_dir).withColumn("detected", F.col("detected").cast("int"))


@register(
    "detection_delay_summary",
    f"""WITH {RUNS} SELECT dataset, count(*) AS n_runs, count(*) FILTER (detected) AS n_detected,
        round(count(*) FILTER (detected) / count(*), 6) AS detection_rate,
        count(*) FILTER (delay * 10 <= 10) AS early_detect_1w,
        round(quantile_cont(CAST(delay * 10 AS DOUBLE), 0.5), 6) AS median_delay_min,
        round(quantile_cont(CAST(delay * 10 AS DOUBLE), 0.9), 6) AS p90_delay_min FROM runs GROUP BY dataset""",
)
def detection_delay_summary(spark, sf_dir):
    s = runs.summarise_runs(_runs(spark, sf_dir), ["dataset"])
    return rounded(s, ["detection_rate", "median_delay_min", "p90_delay_min"])


@register(
    "cold_start_rows",
    f"""WITH {SCORES}, n AS (SELECT dataset, id, lag(id) OVER (PARTITION BY dataset ORDER BY id) AS prev FROM scores)
        SELECT dataset, id FROM n WHERE prev IS NULL OR id - prev > 1""",
)
def cold_start_rows(spark, sf_dir):
    return runs.cold_starts(views.scores(spark, sf_dir), ["dataset"], "id").select("dataset", "id")


@register(
    "isolated_attacks",
    f"""WITH {SCORES}, n AS (SELECT dataset, id, y, count(y) OVER w AS c, min(y) OVER w AS m FROM scores
        WINDOW w AS (PARTITION BY dataset ORDER BY id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
        SELECT dataset, id FROM n WHERE y = 0 AND c >= 3 AND m = 1""",
)
def isolated_attacks(spark, sf_dir):
    return runs.isolated_attacks(views.scores(spark, sf_dir), ["dataset"], ["id"]).select("dataset", "id")


@register(
    "early_slow_poisoning",
    f"""WITH {WINDOWS}, o AS (SELECT window_id, stream, ws,
          CASE WHEN regexp_matches(attack_type, 'poison|slow|attack5|a5') THEN 1 ELSE 0 END AS slow,
          row_number() OVER (ORDER BY ws, window_id) AS rn FROM windows),
        g AS (SELECT *, rn - row_number() OVER (PARTITION BY slow ORDER BY rn) AS grp FROM o),
        p AS (SELECT window_id, row_number() OVER (PARTITION BY grp ORDER BY rn) AS pos FROM g WHERE slow = 1)
        SELECT window_id FROM p WHERE pos <= 5""",
)
def early_slow_poisoning(spark, sf_dir):
    w = views.windows(spark, sf_dir)
    inside = F.coalesce(attack_family("attack_type") == "slow_poisoning", F.lit(False))
    return runs.early_run_rows(w, [], WINDOW_ORDER, inside).select("window_id")


@register(
    "autocorrelation",
    f"""WITH {SCORES}, c AS (SELECT dataset, id, y - p_lstm - avg(y - p_lstm) OVER (PARTITION BY dataset) AS r
          FROM scores),
        k AS (SELECT dataset, id, r, {", ".join(
            f"lag(r, {k}) OVER (PARTITION BY dataset ORDER BY id) AS r{k}" for k in range(1, 16))} FROM c),
        a AS (SELECT dataset, [{", ".join(f"sum(r * r{k}) / sum(r * r)" for k in range(1, 16))}] AS acf
          FROM k GROUP BY dataset)
        SELECT dataset, CAST(unnest(range(1, 16)) AS INTEGER) AS lag, round(unnest(acf), 6) AS acf FROM a""",
)
def autocorrelation(spark, sf_dir):
    s = views.scores(spark, sf_dir).withColumn("residual", F.col("y") - F.col("p_lstm"))
    return rounded(R.autocorrelation(s, ["dataset"], ["id"], "residual"), ["acf"])
