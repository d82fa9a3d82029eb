"""Detector, robustness, attribution and end-to-end queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from alertmill.catalog import register
from alertmill.catalog.views_sql import WINDOWS
from alertmill.catalog.windowing import rounded
from alertmill.operators import attribution, detectors, forest, metrics, neighbours, prep, robust, splits
from alertmill.operators.sequences import padded_sequences, sliding_sequences, vector
from alertmill.plans import packet_transfer, pipeline, reporting
from alertmill.schemas import SELECTED_FEATURES
from alertmill.session import settle
from alertmill.sources import views

ORDER = ["window_start_time", "window_id"]
_FITTED: dict = {}


def _once(spark, sf_dir, name, build):
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _FITTED:
        _FITTED[key] = build()
    return _FITTED[key]


def features(spark, sf_dir):
    return views.landed(
        spark, sf_dir, "features", lambda: pipeline.build_features(views.alerts(spark, sf_dir)).withColumn("y", F.col("label"))
    )


def _scaler(spark, sf_dir):
    def build():
        normals = features(spark, sf_dir).filter("split = 'train' AND y = 1")
        return prep.Standardiser.fit(normals, SELECTED_FEATURES)

    return _once(spark, sf_dir, "scaler", build)


def _scaled(spark, sf_dir):
    def build():
        return settle(_scaler(spark, sf_dir).transform(features(spark, sf_dir)), "scaled")

    return _once(spark, sf_dir, "scaled", build)


def _forest(spark, sf_dir):
    def build():
        train = _scaled(spark, sf_dir).filter("split = 'train' AND y = 1")
        return forest.IsolationForest.fit(train, SELECTED_FEATURES, "window_id")

    return _once(spark, sf_dir, "forest", build)


def _scored(spark, sf_dir):
    return _once(
        spark,
        sf_dir,
        "forest_scores",
        lambda: settle(_forest(spark, sf_dir).transform(_scaled(spark, sf_dir)), "forest_scores"),
    )


@register("isolation_forest_fit")
def isolation_forest_fit(spark, sf_dir):
    f = _forest(spark, sf_dir)
    depth = F.array(*[F.struct(F.lit(i).alias("tree"), F.lit(len(t.feature)).alias("nodes"), F.lit(t.size[0]).alias("rows")) for i, t in enumerate(f.trees)])
    return _scaled(spark, sf_dir).limit(1).select(F.inline(depth))


@register("isolation_forest_score")
def isolation_forest_score(spark, sf_dir):
    return rounded(_scored(spark, sf_dir).select("window_id", "score"), ["score"])


@register("isolation_forest_rates")
def isolation_forest_rates(spark, sf_dir):
    s = _scored(spark, sf_dir)
    t = forest.empirical_threshold(s.filter("split = 'test' AND y = 1"))
    return rounded(forest.flag_rates(s, ["attack_type", "split"], t), ["rate"])


@register("isolation_forest_diagnostics")
def isolation_forest_diagnostics(spark, sf_dir):
    return rounded(forest.diagnostics(_scored(spark, sf_dir)), ["rate_lcb", "rate_p2", "separation"])


@register("isolation_forest_tuning")
def isolation_forest_tuning(spark, sf_dir):
    def build():
        normal = _scaled(spark, sf_dir).filter("split = 'train' AND y = 1")
        folds = splits.ordered_folds(normal, ORDER)
        return forest.tune(folds, SELECTED_FEATURES, "window_id")

    return _once(spark, sf_dir, "tuning", build)


@register("tuned_setting")
def tuned_setting(spark, sf_dir):
    return forest.best_setting(isolation_forest_tuning(spark, sf_dir))


FIRST = views.VECTOR_DIM
VEC = [f"v{i}" for i in range(FIRST)]
VEC_SQL = "vecs AS (SELECT vec_id, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {c}" for i, c in enumerate(VEC))
VEC_SQL += ", CASE WHEN label < 3 THEN 1 ELSE 0 END AS y FROM embeddings)"


def _vectors(spark, sf_dir):
    v = views.vectors(spark, sf_dir)
    return v.select("vec_id", "y", *[F.col("features")[i].alias(c) for i, c in enumerate(VEC)])


@register(
    "missing_covariance",
    """WITH v AS (SELECT vec_id, k, CASE WHEN (vec_id * 7 + k) % 11 > 0 THEN CAST(embedding[k + 1] AS DOUBLE) END AS x
          FROM (SELECT vec_id, embedding, unnest(range(64)) AS k FROM embeddings))
        SELECT CAST(a.k AS INTEGER) AS i, CAST(b.k AS INTEGER) AS j, round(covar_samp(a.x, b.x) + 1e-9, 6) AS covariance
        FROM v AS a JOIN v AS b ON a.vec_id = b.vec_id AND a.k <= b.k GROUP BY 1, 2""",
)
def missing_covariance(spark, sf_dir):
    """All 64 columns, each with missing values in other rows, over many partitions."""
    cols = [f"v{k}" for k in range(64)]
    gone = [F.when((F.col("vec_id") * 7 + k) % 11 > 0, F.col("features")[k]).alias(c) for k, c in enumerate(cols)]
    _, cov = prep.moments(views.vectors(spark, sf_dir).repartition(16).select(*gone), cols)
    cells = [(i, j, round(float(cov[i, j]) + 1e-9, 6)) for i in range(64) for j in range(i, 64)]
    return spark.createDataFrame(cells, "i int, j int, covariance double")


@register(
    "pseudo_normals",
    f"""WITH {VEC_SQL}, m AS (SELECT {", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in VEC)} FROM vecs),
        d AS (SELECT {", ".join(f"quantile_cont(abs({c} - m_{c}), 0.5) + 1e-9 AS d_{c}" for c in VEC)} FROM vecs, m),
        o AS (SELECT vec_id, ({" + ".join(f"abs({c} - m_{c}) / d_{c}" for c in VEC)}) / {FIRST} AS o FROM vecs, m, d)
        SELECT vec_id, round(o + 1e-9, 6) AS outlyingness,
          CAST(o <= (SELECT quantile_cont(o, 0.72) FROM o) AS INTEGER) AS pseudo_normal FROM o""",
)
def pseudo_normals(spark, sf_dir):
    p = forest.pseudo_normals(_vectors(spark, sf_dir), VEC)
    p = p.select("vec_id", "outlyingness", F.col("pseudo_normal").cast("int").alias("pseudo_normal"))
    return rounded(p, ["outlyingness"])


@register(
    "pseudo_normals_packet",
    f"""WITH {VEC_SQL}, m AS (SELECT {", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in VEC)} FROM vecs),
        o AS (SELECT vec_id, sqrt({" + ".join(f"({c} - m_{c}) ** 2" for c in VEC)}) AS o FROM vecs, m)
        SELECT vec_id, round(o + 1e-9, 6) AS outlyingness,
          CAST(o <= (SELECT quantile_cont(o, 0.72) FROM o) AS INTEGER) AS pseudo_normal FROM o""",
)
def pseudo_normals_packet(spark, sf_dir):
    p = forest.pseudo_normals(_vectors(spark, sf_dir), VEC, euclidean=True)
    p = p.select("vec_id", "outlyingness", F.col("pseudo_normal").cast("int").alias("pseudo_normal"))
    return rounded(p, ["outlyingness"])


@register("target_forest")
def target_forest(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return rounded(forest.target_forest(v, VEC, "vec_id").transform(v).select("vec_id", "score"), ["score"])


@register("target_forest_packet")
def target_forest_packet(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    f = forest.target_forest(v, VEC, "vec_id", euclidean=True)
    return rounded(f.transform(v).select("vec_id", "score"), ["score"])


def _sequences(spark, sf_dir):
    def build():
        s = sliding_sequences(_scaled(spark, sf_dir), [], ORDER, SELECTED_FEATURES, ts="window_start_time")
        return settle(s.select("window_id", "window_start_time", "y", "split", "sequence"), "sequences")

    return _once(spark, sf_dir, "sequences", build)


def _classifier(spark, sf_dir):
    def build():
        train = _sequences(spark, sf_dir).filter("split = 'train'")
        return detectors.SequenceClassifier.fit(train, "window_id")

    return _once(spark, sf_dir, "classifier", build)


@register("sequence_classifier")
def sequence_classifier(spark, sf_dir):
    scored = _classifier(spark, sf_dir).transform(_sequences(spark, sf_dir))
    return rounded(metrics.report(scored, ["split"]).select("split", "auc", "tpr", "fpr", "f1"), ["auc", "tpr", "fpr", "f1"])


@register("sequence_classifier_linear")
def sequence_classifier_linear(spark, sf_dir):
    q = _sequences(spark, sf_dir)
    model = detectors.SequenceClassifier.fit(q.filter("split = 'train'"), "window_id", kind="logistic", max_iter=30)
    return rounded(metrics.report(model.transform(q), ["split"]).select("split", "auc", "tpr", "fpr"), ["auc", "tpr", "fpr"])


@register("temporal_cross_validation")
def temporal_cross_validation(spark, sf_dir):
    train = _sequences(spark, sf_dir).filter("split = 'train'")
    return rounded(
        detectors.temporal_validation(train, "window_id", ORDER, kind="logistic", max_iter=15), ["auc", "tpr", "fpr"]
    )


def _normal_vectors(spark, sf_dir):
    return _vectors(spark, sf_dir).filter("y = 1")


@register("reconstruction_detector")
def reconstruction_detector(spark, sf_dir):
    model = detectors.ReconstructionDetector.fit(_normal_vectors(spark, sf_dir), VEC)
    return rounded(model.transform(_vectors(spark, sf_dir)).select("vec_id", "ae_z"), ["ae_z"])


def _one_class(name: str, nu: float, kernel: str) -> None:
    @register(name)
    def query(spark, sf_dir):
        model = detectors.OneClassBoundary.fit(_normal_vectors(spark, sf_dir), VEC, nu=nu, kernel=kernel)
        return rounded(model.transform(_vectors(spark, sf_dir)).select("vec_id", "score"), ["score"])


_one_class("one_class_rbf_05", 0.05, "rbf")
_one_class("one_class_rbf_10", 0.10, "rbf")
_one_class("one_class_rbf_20", 0.20, "rbf")
_one_class("one_class_linear", 0.05, "linear")

LOF_SQL = """
WITH q AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label < 3 AS ref FROM embeddings),
pairs AS (SELECT a.id AS a, b.id AS b, list_distance(a.v, b.v) AS d,
    row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS r
  FROM q a JOIN q b ON b.ref AND a.id <> b.id WHERE a.ref),
rk AS (SELECT * FROM pairs WHERE r <= 20),
kd AS (SELECT a AS id, max(d) AS kd FROM rk GROUP BY a),
lrd AS (SELECT rk.a AS id, 1 / (avg(greatest(rk.d, kd.kd)) + 1e-10) AS lrd FROM rk JOIN kd ON kd.id = rk.b GROUP BY rk.a),
qp AS (SELECT a.id AS a, b.id AS b, list_distance(a.v, b.v) AS d,
    row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS r
  FROM q a JOIN q b ON b.ref WHERE NOT a.ref),
qk AS (SELECT * FROM qp WHERE r <= 20),
ql AS (SELECT qk.a AS id, 1 / (avg(greatest(qk.d, kd.kd)) + 1e-10) AS lrd FROM qk JOIN kd ON kd.id = qk.b GROUP BY qk.a)
SELECT qk.a AS vec_id, round(-avg(lrd.lrd) / any_value(ql.lrd), 5) AS score
FROM qk JOIN lrd ON lrd.id = qk.b JOIN ql ON ql.id = qk.a GROUP BY qk.a"""


@register("local_outlier_factor", LOF_SQL)
def local_outlier_factor(spark, sf_dir):
    v = views.vectors(spark, sf_dir)
    refs = v.filter("y = 1").select(F.col("vec_id").alias("ref_id"), F.col("features").alias("v"))
    asked = v.filter("y = 0").select(F.col("vec_id").alias("query_id"), F.col("features").alias("v"))
    s = neighbours.local_outlier_factor(asked, refs, 20, pivots=16)
    return s.select(F.col("query_id").alias("vec_id"), F.round("score", 5).alias("score"))


@register("baseline_matrix")
def baseline_matrix(spark, sf_dir):
    """Five detectors, fitted on the even half, over the odd half as it is and aligned to the even one."""
    v = _vectors(spark, sf_dir)
    z = settle(prep.Standardiser.fit(v, VEC).transform(v).withColumn("dataset", F.lit(0)), "baseline_z")
    source, target = z.filter("vec_id % 2 = 0"), z.filter("vec_id % 2 = 1")
    home = source.filter("y = 1")
    aligned = settle(prep.CoralAligner.fit(source, target, VEC).transform(target, VEC), "baseline_aligned")
    steps = padded_sequences(source, "dataset", ["vec_id"], VEC)
    fitted = {
        "forest": forest.IsolationForest.fit(home, VEC, "vec_id"),
        "reconstruction": detectors.ReconstructionDetector.fit(home, VEC),
        "one_class": detectors.OneClassBoundary.fit(home, VEC),
    }
    sequence = detectors.SequenceClassifier.fit(steps, "vec_id")
    refs = home.select(F.col("vec_id").alias("ref_id"), vector(VEC).alias("v"))
    known = neighbours.reference_densities(refs, pivots=16)
    every = None
    for variant, rows in (("plain", target), ("coral", aligned)):
        scored = {name: model.transform(rows, "s") for name, model in fitted.items()}
        scored["sequence"] = sequence.transform(padded_sequences(rows, "dataset", ["vec_id"], VEC), "s")
        asked = rows.select(F.col("vec_id").alias("query_id"), vector(VEC).alias("v"))
        factor = neighbours.local_outlier_factor(asked, refs, pivots=16, known=known).select(F.col("query_id").alias("vec_id"), F.col("score").alias("s"))
        scored["neighbours"] = rows.join(factor, "vec_id")
        for name, found in scored.items():
            s = found.select(F.lit(name).alias("detector"), F.lit(variant).alias("variant"), "dataset", "y", "s")
            every = s if every is None else every.unionByName(s)
    normal = prep.percentile_normalise(settle(every, "baselines"), ["detector", "variant"], "s")
    return rounded(detectors.baseline_matrix(normal), ["auc", "tpr", "fpr", "f1", "threshold"])


def _score_rows(spark, sf_dir):
    f = _forest(spark, sf_dir)
    lo, hi = _once(
        spark,
        sf_dir,
        "forest_bounds",
        lambda: prep.score_bounds(_scored(spark, sf_dir).filter("split = 'train' AND y = 1"), "score"),
    )
    scaler = _scaler(spark, sf_dir)
    return lambda df: f.transform(scaler.transform(df)).withColumn("p", prep.unit_range(F.col("score"), lo, hi))


@register("noise_sweep")
def noise_sweep(spark, sf_dir):
    """Noise goes onto the raw features; scaling is part of scoring."""
    test = features(spark, sf_dir).filter("split = 'test'")
    s = robust.noise_sweep(test, SELECTED_FEATURES, "window_id", _score_rows(spark, sf_dir))
    return rounded(s, ["auc", "tpr", "fpr"])


@register("sequence_noise_sweep")
def sequence_noise_sweep(spark, sf_dir):
    test = _sequences(spark, sf_dir).filter("split = 'test'")
    s = robust.sequence_noise_sweep(
        test, "window_id", _classifier(spark, sf_dir).transform, len(SELECTED_FEATURES)
    )
    return rounded(s, ["auc", "recall_normal", "tpr"])


@register("repeated_noise")
def repeated_noise(spark, sf_dir):
    test = features(spark, sf_dir).filter("split = 'test'")
    s = robust.repeated_noise(test, SELECTED_FEATURES, "window_id", _score_rows(spark, sf_dir))
    return rounded(s, ["auc_mean", "auc_std", "delta"])


@register("jitter_sweep")
def jitter_sweep(spark, sf_dir):
    t = features(spark, sf_dir)
    s = robust.jitter_sweep(
        t.filter("split = 'test' AND attack_type = 'slow_poisoning'"),
        t.filter("split = 'train' AND y = 1"),
        "window_id",
        _score_rows(spark, sf_dir),
    )
    return rounded(s, ["tpr_mean", "tpr_std", "gap_shift", "variance_shift"])


@register(
    "jitter_base_shift",
    f"""WITH {WINDOWS}, n AS (SELECT avg(inter_alert_interval_mean) AS mi, stddev_pop(inter_alert_interval_mean) AS si,
          avg(inter_interval_variance) AS mv, stddev_pop(inter_interval_variance) AS sv FROM windows WHERE label = 1)
        SELECT round(abs(avg(inter_alert_interval_mean) - any_value(mi)) / (any_value(si) + 1e-12), 6) AS gap_shift,
          round(abs(avg(inter_interval_variance) - any_value(mv)) / (any_value(sv) + 1e-12), 6) AS variance_shift
        FROM windows, n WHERE attack_type = 'slow_poisoning'""",
)
def jitter_base_shift(spark, sf_dir):
    w = views.windows(spark, sf_dir)
    s = robust.jitter_sweep(
        w.filter("attack_type = 'slow_poisoning'"),
        w.filter("label = 1"),
        "window_id",
        lambda df: df.withColumn("p", F.lit(0.0)),
        levels=[0.0],
        repeats=1,
    )
    return rounded(s.select("gap_shift", "variance_shift"), ["gap_shift", "variance_shift"])


# Fixed value: seeds of the sweep.
SEEDS = 10


@register("seed_sweep")
def seed_sweep(spark, sf_dir):
    """The sequence model, fitted again with every seed."""
    q = _sequences(spark, sf_dir)
    train, test = q.filter("split = 'train'"), q.filter("split = 'test'")

    def run(seed: int):
        return detectors.SequenceClassifier.fit(train, "window_id", seed=seed).transform(test)

    return rounded(robust.seed_sweep(run, range(1, SEEDS + 1)), ["mean", "std", "ci95_lo", "ci95_hi"])


def _explained(spark, sf_dir, normals: bool, n: int):
    rows = _scaled(spark, sf_dir).filter("split = 'test'").filter("y = 1" if normals else "y = 0")
    picked = splits.even_pick(rows, ORDER, n)
    return picked.withColumn("vector", F.array(*[F.col(f).cast("double") for f in SELECTED_FEATURES]))


def _forest_contributions(spark, sf_dir):
    def build():
        base = attribution.background(_explained(spark, sf_dir, True, 88), "vector", 20)
        rows = _explained(spark, sf_dir, False, 24).repartition(8)
        model = _forest(spark, sf_dir)
        small = forest.IsolationForest(model.features, model.trees[:20], model.sample_size)
        c = attribution.attribute(rows, "window_id", "vector", SELECTED_FEATURES, small.score_array, base)
        return settle(c, "forest_shapley")

    return _once(spark, sf_dir, "forest_shapley", build)


def _sequence_contributions(spark, sf_dir):
    def build():
        q = _sequences(spark, sf_dir).filter("split = 'test'")
        flat = q.withColumn("vector", F.flatten("sequence"))
        base = splits.even_pick(flat.filter("y = 1"), ORDER, 10).select("vector").collect()
        rows = splits.even_pick(flat.filter("y = 0"), ORDER, 20).repartition(8)
        model = _classifier(spark, sf_dir)
        c = attribution.attribute(
            rows, "window_id", "vector", SELECTED_FEATURES, model.score_array, np.array([b["vector"] for b in base]), steps=10
        )
        return settle(c, "sequence_shapley")

    return _once(spark, sf_dir, "sequence_shapley", build)


@register("forest_attribution")
def forest_attribution(spark, sf_dir):
    return rounded(attribution.importance(_forest_contributions(spark, sf_dir)), ["mean_abs", "importance_pct"])


@register("sequence_attribution")
def sequence_attribution(spark, sf_dir):
    return rounded(attribution.importance(_sequence_contributions(spark, sf_dir)), ["mean_abs", "importance_pct"])


@register("attribution_agreement")
def attribution_agreement(spark, sf_dir):
    a = attribution.importance(_forest_contributions(spark, sf_dir))
    b = attribution.importance(_sequence_contributions(spark, sf_dir))
    return rounded(attribution.agreement(a, b), ["first_pct", "second_pct", "gap"])


@register(
    "importance_shares",
    """WITH l AS (SELECT event_type AS feature, CASE WHEN event_id % 2 = 0 THEN value ELSE -value END AS c FROM events),
       m AS (SELECT feature, avg(abs(c)) AS mean_abs FROM l GROUP BY feature)
       SELECT feature, round(mean_abs, 6) AS mean_abs, round(100 * mean_abs / sum(mean_abs) OVER (), 6) AS importance_pct
       FROM m""",
)
def importance_shares(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    signed = F.when(F.col("event_id") % 2 == 0, F.col("value")).otherwise(-F.col("value"))
    c = e.select(F.col("event_type").alias("feature"), signed.alias("contribution"))
    return rounded(attribution.importance(c), ["mean_abs", "importance_pct"])


RAW = [f for f in SELECTED_FEATURES if f != "freq_rolling_std_5w"]

FEATURE_SQL = f"""WITH {WINDOWS},
pl AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY attack_type ORDER BY ws, window_id)
    <= floor(count(*) OVER (PARTITION BY attack_type) * 0.6) THEN 'train' ELSE 'test' END AS split FROM windows),
pk AS (SELECT *, row_number() OVER (PARTITION BY attack_type, split ORDER BY md5('42:' || window_id), window_id) AS pick
  FROM pl),
least AS (SELECT min(c) AS c FROM (SELECT count(*) AS c FROM pl WHERE split = 'train' AND attack_type <> 'normal'
  GROUP BY attack_type)),
bal AS (SELECT pk.* FROM pk, least WHERE split = 'test' OR attack_type = 'normal' OR pick <= least.c),
q AS (SELECT {", ".join(f"quantile_cont({f}, 0.5) AS m_{f}, quantile_cont({f}, 0.99) AS u_{f}"
                        for f in [*RAW, "alert_frequency_per_hour"])} FROM bal WHERE split = 'train'),
cl AS (SELECT split, attack_type, ws, window_id,
    {", ".join(f"least(coalesce({f}, m_{f}), u_{f}) AS {f}" for f in [*RAW, "alert_frequency_per_hour"])} FROM bal, q),
ro AS (SELECT *, row_number() OVER o AS rn, count(*) OVER (PARTITION BY attack_type) AS n,
    CASE WHEN count(*) OVER w >= 3 THEN stddev_samp(alert_frequency_per_hour) OVER w END AS s FROM cl
  WINDOW o AS (PARTITION BY attack_type ORDER BY ws, window_id),
         w AS (PARTITION BY attack_type ORDER BY ws, window_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
md AS (SELECT attack_type, quantile_cont(s, 0.5) FILTER (rn <= greatest(1, floor(n * 0.6))) AS ms FROM ro GROUP BY 1)
SELECT split, ro.attack_type, count(*) AS n, {", ".join(f"round(avg({f}), 4) AS {f}" for f in RAW)},
  round(avg(coalesce(s, ms, 0)), 4) AS freq_rolling_std_5w
FROM ro JOIN md ON md.attack_type = ro.attack_type GROUP BY split, ro.attack_type"""


@register("feature_table", FEATURE_SQL)
def feature_table(spark, sf_dir):
    t = features(spark, sf_dir)
    return t.groupBy("split", "attack_type").agg(
        F.count(F.lit(1)).alias("n"), *[F.round(F.avg(f), 4).alias(f) for f in SELECTED_FEATURES]
    )


def fitted_detection(spark, sf_dir):
    return _once(
        spark,
        sf_dir,
        "detection",
        lambda: pipeline.fit_detection(features(spark, sf_dir).drop("y"), n_trees=30, kind="logistic", max_iter=30),
    )


@register("calibrated_detection")
def calibrated_detection(spark, sf_dir):
    r = pipeline.detection_report(fitted_detection(spark, sf_dir))
    cols = ["auc", "average_precision", "tpr", "fpr", "f1", "ece", "bhattacharyya", "ci_lo", "ci_hi"]
    return rounded(r.select("model", "n_attack", "n_normal", *cols), cols)


@register("foreign_log_transfer")
def foreign_log_transfer(spark, sf_dir):
    home = features(spark, sf_dir)
    r = pipeline.transfer(views.readings(spark, sf_dir), home, fitted_detection(spark, sf_dir), min_rows=3)
    num = [c for c, t in r.dtypes if t == "double"]
    return rounded(r, num)


@register("foreign_log_transfer_parity")
def foreign_log_transfer_parity(spark, sf_dir):
    """The variant that reads target labels for orientation and weights."""
    home = features(spark, sf_dir)
    r = pipeline.transfer(views.readings(spark, sf_dir), home, fitted_detection(spark, sf_dir), min_rows=3, label_free=False)
    num = [c for c, t in r.dtypes if t == "double"]
    return rounded(r, num)


@register("detection_evaluation")
def detection_evaluation(spark, sf_dir):
    r = reporting.detection_evaluation(fitted_detection(spark, sf_dir))
    return rounded(r.select("section", "model", "measure", "value"), ["value"])


@register("packet_log_transfer")
def packet_log_transfer(spark, sf_dir):
    """The variant that reads target labels for orientation and weights."""
    logs = views.packet_captures(spark, sf_dir)
    r = packet_transfer.transfer_packets(logs, features(spark, sf_dir), fitted_detection(spark, sf_dir), label_free=False)
    return rounded(r, [c for c, t in r.dtypes if t == "double"])
