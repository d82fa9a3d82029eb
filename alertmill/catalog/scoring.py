"""Metric, fusion, threshold and pre-processing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertmill.catalog import register
from alertmill.catalog.sensing import HOURS
from alertmill.catalog.sequencing import ROLL, RUNS
from alertmill.catalog.views_sql import MATRIX, MELTED, SCORES, WINDOWS
from alertmill.catalog.windowing import rounded
from alertmill.functions import scalars
from alertmill.operators import fusion, metrics, prep, rolling, runs, sensor
from alertmill.operators.ordered import quantiles
from alertmill.schemas import WINDOW_FEATURES
from alertmill.plans import reporting
from alertmill.sources import views

KEYS = ["dataset"]

# Both models of the score table in long form, and running counts over distinct scores.
LONG = (
    SCORES
    + """,
long AS (SELECT id, dataset, y, attack_type, 'forest' AS model, p_if AS p FROM scores
         UNION ALL SELECT id, dataset, y, attack_type, 'sequence' AS model, p_lstm AS p FROM scores)
"""
)
STEPS = (
    LONG
    + """,
st0 AS (SELECT dataset, model, p, sum(y) AS pos, sum(1 - y) AS neg FROM long GROUP BY ALL),
steps AS (SELECT *, sum(pos) OVER w AS cpos, sum(neg) OVER w AS cneg, sum(pos) OVER g AS tpos, sum(neg) OVER g AS tneg
  FROM st0 WINDOW w AS (PARTITION BY dataset, model ORDER BY p), g AS (PARTITION BY dataset, model))
"""
)
MODEL_KEYS = ["dataset", "model"]


def long_scores(spark, sf_dir):
    s = views.scores(spark, sf_dir)
    both = F.array(
        F.struct(F.lit("forest").alias("model"), F.col("p_if").alias("p")),
        F.struct(F.lit("sequence").alias("model"), F.col("p_lstm").alias("p")),
    )
    return s.select("id", "dataset", "y", "attack_type", F.inline(both))


@register(
    "roc_auc",
    f"""WITH {LONG}, r AS (SELECT dataset, model, y, rank() OVER w + (count(*) OVER (PARTITION BY dataset, model, p) - 1)
          / 2.0 AS rk FROM long WINDOW w AS (PARTITION BY dataset, model ORDER BY p))
        SELECT dataset, model, round((sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0)
          / (sum(y) * sum(1 - y)), 6) AS auc FROM r GROUP BY dataset, model""",
)
def roc_auc(spark, sf_dir):
    return rounded(metrics.auc(long_scores(spark, sf_dir), MODEL_KEYS), ["auc"])


@register(
    "average_precision",
    f"""WITH {STEPS} SELECT dataset, model, round(sum(neg / tneg * (cneg / (cneg + cpos))), 6) AS average_precision
        FROM steps GROUP BY dataset, model""",
)
def average_precision(spark, sf_dir):
    return rounded(metrics.average_precision(long_scores(spark, sf_dir), MODEL_KEYS), ["average_precision"])


CONFUSION = """count(*) FILTER (p < {t} AND y = 0) AS n_attack_detected,
  count(*) FILTER (p >= {t} AND y = 0) AS n_attack_missed,
  count(*) FILTER (p < {t} AND y = 1) AS n_normal_flagged, count(*) FILTER (p >= {t} AND y = 1) AS n_normal_accepted"""
RATES = """n_attack_detected / (n_attack_detected + n_attack_missed) AS tpr,
  n_normal_flagged / (n_normal_flagged + n_normal_accepted) AS fpr,
  2 * n_attack_detected / (2 * n_attack_detected + n_attack_missed + n_normal_flagged) AS f1"""


@register(
    "confusion_metrics",
    f"""WITH {LONG}, c AS (SELECT dataset, model, {CONFUSION.format(t=0.5)} FROM long GROUP BY ALL),
        r AS (SELECT *, {RATES} FROM c)
        SELECT dataset, model, n_attack_detected, n_attack_missed, n_normal_flagged, n_normal_accepted,
        round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(1 - fpr, 6) AS recall_normal,
        round(1 - tpr, 6) AS miss_attack, round(f1, 6) AS f1 FROM r""",
)
def confusion_metrics(spark, sf_dir):
    c = metrics.confusion(long_scores(spark, sf_dir), MODEL_KEYS)
    return rounded(c, ["tpr", "fpr", "recall_normal", "miss_attack", "f1"])


BINS = "(" + " + ".join(f"CAST(p >= {i * 0.1!r}::DOUBLE AS INTEGER)" for i in range(10)) + ") - 1"


@register(
    "calibration_error",
    f"""WITH {LONG}, b AS (SELECT dataset, model, {BINS} AS bin, count(*) AS n, avg(y) AS a, avg(p) AS c
          FROM long WHERE p < 1 GROUP BY ALL)
        SELECT dataset, model, round(sum(n * abs(a - c)) / any_value(total), 6) AS ece
        FROM b JOIN (SELECT dataset, model, count(*) AS total FROM long GROUP BY ALL) USING (dataset, model)
        GROUP BY dataset, model""",
)
def calibration_error(spark, sf_dir):
    return rounded(metrics.ece(long_scores(spark, sf_dir), MODEL_KEYS), ["ece"])


@register(
    "reliability_bins",
    f"""WITH {LONG} SELECT dataset, model, {BINS} AS bin, count(*) AS n, round(avg(p), 6) AS confidence,
        round(avg(y), 6) AS accuracy FROM long WHERE p < 1 GROUP BY ALL""",
)
def reliability_bins(spark, sf_dir):
    return rounded(metrics.reliability_bins(long_scores(spark, sf_dir), MODEL_KEYS), ["confidence", "accuracy"])


HIST = (
    LONG
    + """,
h AS (SELECT dataset, model, least(49, CAST(floor((p - lo) / (hi - lo) * 50) AS INTEGER)) AS bin,
    sum(y) AS n_normal, sum(1 - y) AS n_attack
  FROM long JOIN (SELECT dataset, model, min(p) AS lo, max(p) AS hi FROM long GROUP BY ALL) USING (dataset, model)
  GROUP BY ALL)
"""
)


@register(
    "score_histogram",
    f"""WITH {HIST} SELECT dataset, model, bin, CAST(n_normal AS BIGINT) AS n_normal,
        CAST(n_attack AS BIGINT) AS n_attack FROM h""",
)
def score_histogram(spark, sf_dir):
    return metrics.histogram(long_scores(spark, sf_dir), MODEL_KEYS)


@register(
    "bhattacharyya",
    f"""WITH {HIST}, s AS (SELECT dataset, model, n_normal / sum(n_normal) OVER g AS a, n_attack / sum(n_attack) OVER g AS b
          FROM h WINDOW g AS (PARTITION BY dataset, model))
        SELECT dataset, model, round(sum(sqrt(a * b)), 6) AS bhattacharyya FROM s GROUP BY dataset, model""",
)
def bhattacharyya(spark, sf_dir):
    return rounded(metrics.bhattacharyya(long_scores(spark, sf_dir), MODEL_KEYS), ["bhattacharyya"])


ROC = (
    STEPS
    + """,
roc AS (SELECT dataset, model, p AS threshold, (tpos - cpos + pos) / tpos AS tpr, (tneg - cneg + neg) / tneg AS fpr
  FROM steps)
"""
)


@register(
    "roc_points",
    f"""WITH {ROC} SELECT dataset, model, round(threshold + 1e-9, 6) AS threshold, round(tpr + 1e-9, 6) AS tpr,
        round(fpr + 1e-9, 6) AS fpr FROM roc""",
)
def roc_points(spark, sf_dir):
    points = metrics.roc_points(metrics.score_steps(long_scores(spark, sf_dir), MODEL_KEYS), MODEL_KEYS)
    return rounded(points, ["threshold", "tpr", "fpr"])


@register(
    "precision_recall_points",
    f"""WITH {STEPS} SELECT dataset, model, round(p + 1e-9, 6) AS threshold,
        round(cneg / (cneg + cpos) + 1e-9, 6) AS precision, round(cneg / tneg + 1e-9, 6) AS recall FROM steps""",
)
def precision_recall_points(spark, sf_dir):
    points = metrics.precision_recall_points(metrics.score_steps(long_scores(spark, sf_dir), MODEL_KEYS), MODEL_KEYS)
    return rounded(points, ["threshold", "precision", "recall"])


@register(
    "youden_threshold",
    f"""WITH {ROC}, o AS (SELECT *, row_number() OVER (PARTITION BY dataset, model
          ORDER BY round(tpr - fpr, 12) DESC, threshold DESC) AS r FROM roc)
        SELECT dataset, model, round(threshold, 6) AS threshold, round(tpr - fpr, 6) AS youden_j FROM o WHERE r = 1""",
)
def youden_threshold(spark, sf_dir):
    return rounded(metrics.youden(long_scores(spark, sf_dir), MODEL_KEYS), ["threshold", "youden_j"])


@register(
    "normal_recall_at_limit",
    f"""WITH {ROC} SELECT dataset, model, round(coalesce(max(tpr) FILTER (fpr <= 0.15), 0), 6) AS best_tpr
        FROM roc GROUP BY dataset, model""",
)
def normal_recall_at_limit(spark, sf_dir):
    return rounded(metrics.normal_recall_at(long_scores(spark, sf_dir), MODEL_KEYS), ["best_tpr"])


def _grid_sql(thresholds) -> str:
    return (
        LONG
        + f""",
t AS (SELECT unnest([{", ".join(f"{t!r}::DOUBLE" for t in thresholds)}]) AS thr),
g AS (SELECT dataset, model, thr, count(*) FILTER (p < thr AND y = 0) AS det, count(*) FILTER (p < thr AND y = 1) AS fa,
    count(*) FILTER (y = 0) AS na, count(*) FILTER (y = 1) AS nn FROM long, t GROUP BY ALL),
gr AS (SELECT dataset, model, thr, det, fa, na, nn, det / na AS tpr, fa / nn AS fpr,
    2 * det / (2 * det + fa + na - det) AS f1 FROM g)
"""
    )


@register(
    "threshold_grid",
    f"""WITH {_grid_sql(metrics.F1_GRID)} SELECT dataset, model, round(thr, 4) AS threshold, det AS detected,
        fa AS false_alarms, round(tpr + 1e-9, 6) AS tpr, round(fpr + 1e-9, 6) AS fpr, round(f1 + 1e-9, 6) AS f1 FROM gr""",
)
def threshold_grid(spark, sf_dir):
    t = metrics.threshold_table(long_scores(spark, sf_dir), MODEL_KEYS, metrics.F1_GRID)
    return rounded(t.drop("n_attack", "n_normal"), ["tpr", "fpr", "f1"]).withColumn(
        "threshold", F.round("threshold", 4)
    )


@register(
    "best_f1_threshold",
    f"""WITH {_grid_sql(metrics.F1_GRID)}, o AS (SELECT *, row_number() OVER (PARTITION BY dataset, model
          ORDER BY f1 DESC, thr) AS r FROM gr)
        SELECT dataset, model, round(CASE WHEN f1 > 0 THEN thr ELSE 0.55 END, 4) AS threshold, round(f1, 6) AS f1
        FROM o WHERE r = 1""",
)
def best_f1_threshold(spark, sf_dir):
    t = metrics.threshold_table(long_scores(spark, sf_dir), MODEL_KEYS, metrics.F1_GRID)
    best = metrics.best_f1_threshold(t, MODEL_KEYS)
    return best.withColumn("threshold", F.round("threshold", 4)).withColumn("f1", F.round("f1", 6))


def _fpr_query(name: str, thresholds, fallback: float) -> None:
    sql = f"""WITH {_grid_sql(thresholds)}, o AS (SELECT *, row_number() OVER (PARTITION BY dataset, model
          ORDER BY tpr DESC, thr DESC) AS r FROM gr WHERE fpr <= 0.15 AND tpr > 0)
        SELECT k.dataset, k.model, round(coalesce(thr, {fallback}), 4) AS threshold, round(coalesce(tpr, 0), 6) AS tpr,
          round(coalesce(fpr, 0), 6) AS fpr, round(coalesce(f1, 0), 6) AS f1
        FROM (SELECT DISTINCT dataset, model FROM long) k
        LEFT JOIN o ON o.dataset = k.dataset AND o.model = k.model AND r = 1"""

    @register(name, sql)
    def query(spark, sf_dir):
        t = metrics.threshold_table(long_scores(spark, sf_dir), MODEL_KEYS, thresholds)
        best = metrics.recall_at_fpr(t, MODEL_KEYS, fallback=fallback)
        return rounded(best, ["tpr", "fpr", "f1"]).withColumn("threshold", F.round("threshold", 4))


_fpr_query("recall_at_fpr15", metrics.FPR_GRID, 0.55)
_fpr_query("recall_at_fpr15_wide", metrics.FPR_GRID_WIDE, 0.5)
_fpr_query("recall_at_fpr15_full", metrics.FPR_GRID_FULL, 0.5)


@register(
    "detection_by_attack_type",
    f"""WITH {LONG} SELECT dataset, model, attack_type, count(*) AS n,
        round(avg(CASE WHEN p < 0.5 THEN 1e0 ELSE 0e0 END), 6) AS detect,
        CASE WHEN attack_type IN ('ddos', 'injection') THEN 'behavioral' ELSE 'auth' END AS scope
        FROM long WHERE y = 0 GROUP BY ALL""",
)
def detection_by_attack_type(spark, sf_dir):
    return rounded(metrics.detection_by_type(long_scores(spark, sf_dir), MODEL_KEYS), ["detect"])


@register(
    "behavioural_metrics",
    f"""WITH {LONG}, k AS (SELECT * FROM long WHERE y = 1 OR attack_type IN ('ddos', 'injection')),
        c AS (SELECT dataset, model, {CONFUSION.format(t=0.55)}, count(*) AS n FROM k GROUP BY ALL),
        r AS (SELECT *, {RATES} FROM c)
        SELECT dataset, model, n_attack_detected, n_normal_flagged, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr,
          round(f1, 6) AS f1 FROM r WHERE n >= 5 AND n_attack_detected + n_attack_missed > 0""",
)
def behavioural_metrics(spark, sf_dir):
    r = metrics.behavioural_report(long_scores(spark, sf_dir), MODEL_KEYS, 0.55)
    cols = ["tpr", "fpr", "f1"]
    return rounded(r.select(*MODEL_KEYS, "n_attack_detected", "n_normal_flagged", *cols), cols)


AUCS = (
    STEPS
    + """,
aucs AS (SELECT dataset, model, sum(pos * (cneg - neg / 2)) / (any_value(tpos) * any_value(tneg)) AS auc
  FROM steps GROUP BY dataset, model)
"""
)


@register(
    "model_comparison",
    f"""WITH {AUCS}, m AS (SELECT *, max(auc) OVER (PARTITION BY dataset) AS top,
          max(auc) FILTER (model = 'sequence') OVER (PARTITION BY dataset) AS ref FROM aucs)
        SELECT dataset, model, round(auc, 6) AS auc, round(ref - auc, 4) AS delta_auc,
          CASE WHEN auc = top THEN 'best' WHEN top - auc <= 0.02 THEN 'tie' ELSE 'behind' END AS standing FROM m""",
)
def model_comparison(spark, sf_dir):
    a = metrics.auc(long_scores(spark, sf_dir), MODEL_KEYS)
    return rounded(metrics.compare_models(a, "sequence"), ["auc"]).withColumn("delta_auc", F.col("delta_auc") + 0.0)


def _results(spark, sf_dir):
    s = long_scores(spark, sf_dir)
    table = metrics.threshold_table(s, MODEL_KEYS, metrics.FPR_GRID)
    at15 = metrics.recall_at_fpr(table, MODEL_KEYS).select(*MODEL_KEYS, F.col("fpr").alias("fpr_at_15fpr"))
    beh = metrics.auc(metrics.behavioural_rows(s), MODEL_KEYS).withColumnRenamed("auc", "auc_behavioral")
    return (
        metrics.auc(s, MODEL_KEYS)
        .withColumnRenamed("auc", "auc_all")
        .join(beh, MODEL_KEYS, "left")
        .join(at15, MODEL_KEYS)
    )


VERDICTS = f"""{_grid_sql(metrics.FPR_GRID)},
at15 AS (SELECT dataset, model, arg_max(fpr, tpr * 1000 + thr) AS fpr FROM gr WHERE fpr <= 0.15 AND tpr > 0 GROUP BY ALL),
ru AS (SELECT l.dataset, l.model, l.y, l.attack_type, rank() OVER w
    + (count(*) OVER (PARTITION BY dataset, model, p) - 1) / 2.0 AS rk
  FROM long l WINDOW w AS (PARTITION BY dataset, model ORDER BY p)),
rb AS (SELECT l.dataset, l.model, l.y, rank() OVER w + (count(*) OVER (PARTITION BY dataset, model, p) - 1) / 2.0 AS rk
  FROM long l WHERE y = 1 OR attack_type IN ('ddos', 'injection')
  WINDOW w AS (PARTITION BY dataset, model ORDER BY p)),
res AS (SELECT k.dataset, k.model, a.auc AS auc_all, b.auc AS auc_behavioral, coalesce(at15.fpr, 0) AS fpr_at_15fpr
  FROM (SELECT DISTINCT dataset, model FROM long) k
  JOIN (SELECT dataset, model, (sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) AS auc
        FROM ru GROUP BY ALL) a ON a.dataset = k.dataset AND a.model = k.model
  JOIN (SELECT dataset, model, (sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) AS auc
        FROM rb GROUP BY ALL) b ON b.dataset = k.dataset AND b.model = k.model
  LEFT JOIN at15 ON at15.dataset = k.dataset AND at15.model = k.model)
"""


@register(
    "dataset_verdicts",
    f"""WITH {VERDICTS} SELECT dataset, model, round(auc_all, 6) AS auc_all, round(auc_behavioral, 6) AS auc_behavioral,
        round(fpr_at_15fpr, 6) AS fpr_at_15fpr, CASE WHEN auc_behavioral >= 0.85 AND fpr_at_15fpr <= 0.15 THEN 'GOOD'
        WHEN auc_behavioral >= 0.78 AND fpr_at_15fpr <= 0.15 THEN 'PUBLISHABLE'
        WHEN auc_behavioral >= 0.78 THEN 'MODERATE' ELSE 'POOR' END AS verdict FROM res""",
)
def dataset_verdicts(spark, sf_dir):
    r = _results(spark, sf_dir)
    v = r.withColumn("verdict", metrics.verdict(F.coalesce("auc_behavioral", "auc_all"), F.col("fpr_at_15fpr")))
    return rounded(v, ["auc_all", "auc_behavioral", "fpr_at_15fpr"])


@register(
    "verdict_counts",
    f"""WITH {VERDICTS} SELECT count(*) AS n_datasets,
        count(*) FILTER (auc_behavioral >= 0.85 AND fpr_at_15fpr <= 0.15) AS n_good_behavioral,
        count(*) FILTER (auc_all >= 0.85 AND fpr_at_15fpr <= 0.15) AS n_good_all FROM res""",
)
def verdict_counts(spark, sf_dir):
    return metrics.verdict_counts(_results(spark, sf_dir))


@register(
    "regime_aucs",
    f"""WITH {RUNS}, base AS (SELECT *, lag(id) OVER d AS prev, count(y) OVER w AS c5, min(y) OVER w AS m5 FROM r
          WINDOW d AS (PARTITION BY dataset ORDER BY id),
                 w AS (PARTITION BY dataset ORDER BY id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
        pos AS (SELECT *, row_number() OVER (PARTITION BY dataset, y, grp ORDER BY id) AS run_pos FROM base),
        sc AS (SELECT 'flooding' AS scenario, dataset, y, p_if, p_lstm FROM pos WHERE y = 1 OR attack_type = 'ddos'
          UNION ALL SELECT 'isolated', dataset, y, p_if, p_lstm FROM pos WHERE y = 1 OR (c5 >= 3 AND m5 = 1)
          UNION ALL SELECT 'early', dataset, y, p_if, p_lstm FROM pos WHERE y = 1 OR run_pos <= 5
          UNION ALL SELECT 'cold_start', dataset, y, p_if, p_lstm FROM pos WHERE prev IS NULL OR id - prev > 1),
        lg AS (SELECT scenario, dataset, y, unnest(['forest', 'sequence']) AS model, unnest([p_if, p_lstm]) AS p FROM sc),
        k AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY scenario, dataset, model, p) - 1) / 2.0 AS rk
          FROM lg WINDOW w AS (PARTITION BY scenario, dataset, model ORDER BY p))
        SELECT scenario, dataset, model, round((sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0)
          / (sum(y) * sum(1 - y)), 6) AS auc FROM k GROUP BY ALL""",
)
def regime_aucs(spark, sf_dir):
    s = views.scores(spark, sf_dir)
    normals = s.filter("y = 1")
    attack = F.col("y") == 0
    parts = {
        "flooding": s.filter((F.col("y") == 1) | (F.col("attack_type") == "ddos")),
        "isolated": normals.unionByName(runs.isolated_attacks(s, KEYS, ["id"])),
        "early": normals.unionByName(runs.early_run_rows(s, KEYS, ["id"], attack)),
        "cold_start": runs.cold_starts(s, KEYS, "id"),
    }
    both = F.array(
        F.struct(F.lit("forest").alias("model"), F.col("p_if").alias("p")),
        F.struct(F.lit("sequence").alias("model"), F.col("p_lstm").alias("p")),
    )
    tagged = [d.select(F.lit(n).alias("scenario"), "dataset", "y", F.inline(both)) for n, d in parts.items()]
    every = tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).unionByName(tagged[3])
    return rounded(metrics.auc(every, ["scenario", "dataset", "model"]), ["auc"])


# Fusion and thresholds.

GATE = """CASE WHEN abs(p_lstm - p_if) >= {d} AND p_lstm < 0.5 AND p_if >= 0.5 THEN (1 - {a}) * p_lstm + {a} * p_if
  WHEN abs(p_lstm - p_if) >= {d} AND p_lstm < 0.5 AND p_if < 0.5 THEN 0.6 * p_lstm + 0.4 * p_if ELSE p_lstm END"""


@register("gated_score", f"WITH {SCORES} SELECT id, round({GATE.format(d='0.3', a='0.5')} + 1e-9, 6) AS p FROM scores")
def gated_score(spark, sf_dir):
    s = views.scores(spark, sf_dir)
    return rounded(s.select("id", fusion.gate(F.col("p_if"), F.col("p_lstm"), 0.3, 0.5).alias("p")), ["p"])


GATE_GRID = (
    SCORES
    + f""",
ds AS (SELECT unnest([{", ".join(f"{d!r}::DOUBLE" for d in fusion.GATE_DELTAS)}]) AS delta),
als AS (SELECT unnest([{", ".join(f"{a!r}::DOUBLE" for a in fusion.GATE_ALPHAS)}]) AS alpha),
gg AS (SELECT delta, alpha, y, {GATE.format(d="delta", a="alpha")} AS p FROM scores, ds, als),
gt AS (SELECT delta, alpha, count(*) FILTER (p < 0.5 AND y = 0) AS tp, count(*) FILTER (p < 0.5 AND y = 1) AS fp,
    count(*) FILTER (y = 0) AS na, count(*) FILTER (y = 1) AS nn FROM gg GROUP BY ALL)
"""
)


@register(
    "gate_grid",
    f"""WITH {GATE_GRID} SELECT round(delta, 4) AS delta, alpha, tp, fp, round(2 * tp / (2 * tp + fp + na - tp), 6) AS f1,
        round(fp / nn, 6) AS fpr_norm FROM gt""",
)
def gate_grid(spark, sf_dir):
    t = fusion.gate_table(views.scores(spark, sf_dir))
    return rounded(t, ["f1", "fpr_norm"]).withColumn("delta", F.round("delta", 4))


@register(
    "gate_search",
    f"""WITH {GATE_GRID}, best AS (SELECT *, 2 * tp / (2 * tp + fp + na - tp) AS f1 FROM gt WHERE fp / nn <= 0.45),
        tied AS (SELECT delta, alpha, f1 FROM best WHERE f1 = (SELECT max(f1) FROM best)),
        k AS (SELECT g.delta, g.alpha, y, f1, rank() OVER w
            + (count(*) OVER (PARTITION BY g.delta, g.alpha, p) - 1) / 2.0 AS rk
          FROM gg g JOIN tied t ON t.delta = g.delta AND t.alpha = g.alpha
          WINDOW w AS (PARTITION BY g.delta, g.alpha ORDER BY p)),
        a AS (SELECT delta, alpha, any_value(f1) AS f1, (sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0)
            / (sum(y) * sum(1 - y)) AS auc FROM k GROUP BY ALL)
        SELECT round(delta, 4) AS delta, alpha, round(f1, 6) AS f1, round(auc, 6) AS auc
        FROM a ORDER BY round(auc, 12) DESC, delta, alpha LIMIT 1""",
)
def gate_search(spark, sf_dir):
    s = views.scores(spark, sf_dir)
    g = fusion.search_gate(s, max_fpr=0.45)
    return s.limit(1).select(
        F.lit(round(g.delta, 4)).alias("delta"),
        F.lit(g.alpha).alias("alpha"),
        F.lit(round(g.f1, 6)).alias("f1"),
        F.lit(round(g.auc, 6)).alias("auc"),
    )


@register(
    "confidence_blend",
    f"""WITH {SCORES}, c AS (SELECT id, p_if, p_lstm, abs(p_if - 0.5) * 2 AS cf, abs(p_lstm - 0.5) * 2 AS cs FROM scores)
        SELECT id, round(cf / (cf + cs + 1e-9) * p_if + (1 - cf / (cf + cs + 1e-9)) * p_lstm + 1e-9, 6) AS p FROM c""",
)
def confidence_blend(spark, sf_dir):
    s = views.scores(spark, sf_dir)
    return rounded(s.select("id", fusion.confidence_blend(F.col("p_if"), F.col("p_lstm")).alias("p")), ["p"])


COMPONENTS = {"gate": "p_lstm", "ae": "p_if", "tas": "p_mix"}


@register(
    "component_weights",
    f"""WITH {SCORES}, m AS (SELECT dataset, avg(p_lstm) FILTER (y = 1) - avg(p_lstm) FILTER (y = 0) AS g,
          avg(p_if) FILTER (y = 1) - avg(p_if) FILTER (y = 0) AS e,
          avg((p_if + p_lstm) / 2) FILTER (y = 1) - avg((p_if + p_lstm) / 2) FILTER (y = 0) AS t
          FROM scores GROUP BY dataset),
        w AS (SELECT CAST(unnest(range(0, 12)) AS INTEGER) AS choice,
          unnest([0.5, 0.5, 0.5, 0.6, 0.6, 0.6, 0.65, 0.65, 0.65, 0.7, 0.7, 0.7]::DOUBLE[]) AS w_gate,
          unnest([0.1, 0.15, 0.2, 0.1, 0.15, 0.2, 0.1, 0.15, 0.2, 0.1, 0.15, 0.2]::DOUBLE[]) AS w_ae)
        SELECT dataset, choice, w_gate, w_ae, round(1 - w_gate - w_ae, 6) AS w_tas,
          round(abs(w_gate * g + w_ae * e + (1 - w_gate - w_ae) * t), 6) AS separation FROM m, w""",
)
def component_weights(spark, sf_dir):
    s = views.scores(spark, sf_dir).withColumn("p_mix", (F.col("p_if") + F.col("p_lstm")) / 2)
    return rounded(fusion.weight_table(s, KEYS, COMPONENTS), ["w_tas", "separation"])


@register(
    "best_component_weights",
    f"""WITH {SCORES}, m AS (SELECT dataset, avg(p_lstm) FILTER (y = 1) - avg(p_lstm) FILTER (y = 0) AS g,
          avg(p_if) FILTER (y = 1) - avg(p_if) FILTER (y = 0) AS e FROM scores GROUP BY dataset)
        SELECT dataset, arg_max(round(w_gate, 6), sep) AS w_gate, round(max(sep), 6) AS separation FROM (
          SELECT dataset, w_gate, abs(w_gate * g + w_ae * e + (1 - w_gate - w_ae) * (g + e) / 2) AS sep FROM m,
            (SELECT unnest([0.5, 0.6, 0.65, 0.7]::DOUBLE[]) AS w_gate), (SELECT unnest([0.1, 0.15, 0.2]::DOUBLE[]) AS w_ae))
        GROUP BY dataset""",
)
def best_component_weights(spark, sf_dir):
    s = views.scores(spark, sf_dir).withColumn("p_mix", (F.col("p_if") + F.col("p_lstm")) / 2)
    best = fusion.best_weights(fusion.weight_table(s, KEYS, COMPONENTS), KEYS)
    return rounded(best.select("dataset", "w_gate", "separation"), ["separation"])


@register(
    "auc_weights",
    f"""WITH {AUCS}, g AS (SELECT dataset, model, greatest(auc - 0.5, 0) ** 2 AS g FROM aucs)
        SELECT dataset, model, round(CASE WHEN sum(g) OVER w > 0 THEN g / sum(g) OVER w
          ELSE 1 / count(*) OVER w END, 5) AS weight FROM g WINDOW w AS (PARTITION BY dataset)""",
)
def auc_weights(spark, sf_dir):
    w = fusion.auc_weights(metrics.auc(long_scores(spark, sf_dir), MODEL_KEYS), KEYS)
    return w.select("dataset", "model", F.round("weight", 5).alias("weight"))


@register(
    "oriented_scores",
    f"""WITH {LONG}, m AS (SELECT dataset, model, avg(p) FILTER (y = 1) < avg(p) FILTER (y = 0) AS flip
          FROM long GROUP BY ALL)
        SELECT id, l.model, round(CASE WHEN flip THEN 1 - p ELSE p END + 1e-9, 6) AS p
        FROM long l JOIN m ON m.dataset = l.dataset AND m.model = l.model""",
)
def oriented_scores(spark, sf_dir):
    return rounded(fusion.orient(long_scores(spark, sf_dir), MODEL_KEYS).select("id", "model", "p"), ["p"])


@register(
    "low_percentile_threshold",
    f"""WITH {LONG} SELECT dataset, model, round(quantile_cont(p, 0.15), 6) AS threshold FROM long GROUP BY ALL""",
)
def low_percentile_threshold(spark, sf_dir):
    return rounded(fusion.low_percentile_threshold(long_scores(spark, sf_dir), MODEL_KEYS, "p"), ["threshold"])


@register(
    "adaptive_threshold",
    f"""WITH {SCORES}, c AS (SELECT dataset, quantile_cont(p_lstm, 0.28) AS ca, quantile_cont(p_if, 0.28) AS cb,
          quantile_cont(p_lstm, 0.33) AS p33, quantile_cont(p_lstm, 0.5) AS mid FROM scores GROUP BY dataset),
        t AS (SELECT s.dataset, quantile_cont(p_lstm, 0.05) FILTER (p_lstm >= ca) AS ta,
          quantile_cont(p_lstm, 0.05) FILTER (p_if >= cb) AS tb, count(*) FILTER (p_lstm >= ca) AS na,
          count(*) FILTER (p_if >= cb) AS nb FROM scores s JOIN c ON c.dataset = s.dataset GROUP BY s.dataset),
        u AS (SELECT dataset, CASE WHEN na >= 30 THEN ta END AS ta, CASE WHEN nb >= 30 THEN tb END AS tb FROM t),
        v AS (SELECT dataset, CASE WHEN ta IS NULL THEN tb WHEN tb IS NULL THEN ta
          WHEN greatest(ta, tb) - least(ta, tb) > 0.1 THEN greatest(ta, tb) ELSE (ta + tb) / 2 END AS tau FROM u)
        SELECT v.dataset, round(CASE WHEN tau IS NULL THEN 0.55 ELSE greatest(0.15, least(greatest(0.15, mid * 0.95),
          CASE WHEN tau >= mid THEN p33 ELSE tau END)) END, 6) AS threshold FROM v JOIN c ON c.dataset = v.dataset""",
)
def adaptive_threshold(spark, sf_dir):
    t = fusion.adaptive_threshold(views.scores(spark, sf_dir), "dataset", "p_lstm", "p_if")
    return t.withColumn("threshold", F.round("threshold", 6))


@register(
    "target_score",
    f"""WITH {SCORES}, t AS (SELECT dataset, quantile_cont(p_if, 0.15) AS thr, max(p_if) - min(p_if) AS span
          FROM scores GROUP BY dataset)
        SELECT id, round(greatest(0, least(1, (p_if - thr) / (span + 1e-12))) + 1e-9, 6) AS p_target
        FROM scores s JOIN t ON t.dataset = s.dataset""",
)
def target_score(spark, sf_dir):
    s = views.scores(spark, sf_dir)
    thr = fusion.low_percentile_threshold(s, KEYS, "p_if")
    return rounded(
        fusion.target_score(s.join(thr, KEYS), KEYS, "p_if", "threshold").select("id", "p_target"), ["p_target"]
    )


@register(
    "component_separation",
    f"""WITH {LONG} SELECT dataset, model, round(abs(avg(p) FILTER (y = 1) - avg(p) FILTER (y = 0)), 6) AS separation,
        CAST(abs(avg(p) FILTER (y = 1) - avg(p) FILTER (y = 0)) >= 0.05 AS INTEGER) AS enabled FROM long GROUP BY ALL""",
)
def component_separation(spark, sf_dir):
    s = fusion.separation(long_scores(spark, sf_dir), MODEL_KEYS, "p")
    return rounded(s, ["separation"]).withColumn("enabled", F.col("enabled").cast("int"))


@register(
    "decision_routes",
    f"""WITH {LONG} SELECT model, CASE WHEN p < 0.5 THEN 'DROP' WHEN p < 0.95 THEN 'FLAG' ELSE 'ALERT' END AS route,
        count(*) AS n FROM long GROUP BY ALL""",
)
def decision_routes(spark, sf_dir):
    s = long_scores(spark, sf_dir).withColumn("route", fusion.route(F.col("p"), 0.5, 0.5, 0.95))
    return s.groupBy("model", "route").agg(F.count(F.lit(1)).alias("n"))


@register(
    "score_activation",
    f"""WITH {SCORES}, t AS (SELECT dataset, quantile_cont(p_if, 0.15) AS thr FROM scores GROUP BY dataset)
        SELECT id, round(1 / (1 + exp(0.8 * p_lstm)) + 1e-9, 6) AS p_tas,
          round(1 / (1 + exp(-5 * (p_if - thr))) + 1e-9, 6) AS p_ae FROM scores s JOIN t ON t.dataset = s.dataset""",
)
def score_activation(spark, sf_dir):
    s = views.scores(spark, sf_dir)
    s = s.join(fusion.low_percentile_threshold(s, KEYS, "p_if"), KEYS)
    out = s.select(
        "id",
        fusion.neighbour_probability(F.col("p_lstm")).alias("p_tas"),
        fusion.error_probability(F.col("p_if"), F.col("threshold")).alias("p_ae"),
    )
    return rounded(out, ["p_tas", "p_ae"])


TEMPERATURES = [0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0]


@register(
    "temperature_nll",
    f"""WITH {SCORES}, t AS (SELECT unnest([{", ".join(map(str, TEMPERATURES))}]::DOUBLE[]) AS temperature),
        z AS (SELECT y, ln(greatest(1e-7, least(1 - 1e-7, p_lstm)) / (1 - greatest(1e-7, least(1 - 1e-7, p_lstm)))) AS z
          FROM scores),
        q AS (SELECT temperature, y, 1 / (1 + exp(-z / temperature)) AS q FROM z, t)
        SELECT temperature, round(-avg(y * ln(q + 1e-7) + (1 - y) * ln(1 - q + 1e-7)), 6) AS nll FROM q GROUP BY 1""",
)
def temperature_nll(spark, sf_dir):
    return rounded(fusion.nll_table(views.scores(spark, sf_dir), TEMPERATURES, "p_lstm"), ["nll"])


@register("temperature_fit")
def temperature_fit(spark, sf_dir):
    s = views.scores(spark, sf_dir)
    t = fusion.fit_temperature(s, "p_lstm")
    return rounded(metrics.ece(s.withColumn("p", fusion.apply_temperature(F.col("p_lstm"), t)), KEYS), ["ece"]).withColumn(
        "temperature", F.lit(round(t, 3))
    )


@register(
    "platt_calibration",
    f"""WITH {SCORES} SELECT round(avg(y), 4) AS mean_p, round(avg(y * (0.7 * p_if + 0.3 * y)), 4) AS mean_px,
        count(*) AS n FROM scores""",
)
def platt_calibration(spark, sf_dir):
    """At the optimum the calibrated score has the mean of the label, alone and times the raw score."""
    s = views.scores(spark, sf_dir).withColumn("x", 0.7 * F.col("p_if") + 0.3 * F.col("y"))
    p = fusion.Platt.fit(s, "x", max_iter=500).apply(F.col("x"))
    return s.agg(
        F.round(F.avg(p), 4).alias("mean_p"), F.round(F.avg(p * F.col("x")), 4).alias("mean_px"), F.count(F.lit(1)).alias("n")
    )


@register("platt_error")
def platt_error(spark, sf_dir):
    s = views.scores(spark, sf_dir)
    model = fusion.Platt.fit(s, "p_if")
    after = metrics.ece(s.withColumn("p", model.apply(F.col("p_if"))), KEYS)
    before = metrics.ece(s, KEYS, "p_if").withColumnRenamed("ece", "ece_before")
    return rounded(after.join(before, KEYS), ["ece", "ece_before"], 4)


@register("mixture_threshold")
def mixture_threshold(spark, sf_dir):
    s = views.scores(spark, sf_dir)
    t = fusion.mixture_threshold(s, "p_if")
    return metrics.confusion(s, KEYS, t, "p_if").withColumn("threshold", F.lit(t))


# Pre-processing.

FEATS = views.MATRIX_FEATURES


@register(
    "impute_and_clip",
    f"""WITH {WINDOWS}, q AS (SELECT quantile_cont(inter_alert_interval_mean, 0.5) AS m1,
          quantile_cont(inter_alert_interval_mean, 0.99) AS u1, quantile_cont(regularity_coefficient, 0.5) AS m2,
          quantile_cont(regularity_coefficient, 0.99) AS u2 FROM windows WHERE label = 1)
        SELECT window_id, round(least(coalesce(inter_alert_interval_mean, m1), u1) + 1e-9, 6) AS interval_mean,
          round(least(coalesce(regularity_coefficient, m2), u2) + 1e-9, 6) AS regularity FROM windows, q""",
)
def impute_and_clip(spark, sf_dir):
    w = views.windows(spark, sf_dir)
    cols = ["inter_alert_interval_mean", "regularity_coefficient"]
    out = prep.MedianClip.fit(w.filter("label = 1"), cols).transform(w)
    out = out.select("window_id", F.col(cols[0]).alias("interval_mean"), F.col(cols[1]).alias("regularity"))
    return rounded(out, ["interval_mean", "regularity"])


@register(
    "standardise",
    f"""WITH {MATRIX}, s AS (SELECT {", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in FEATS)}
          FROM matrix WHERE class = 'N')
        SELECT id, {", ".join(f"round(({f} - m_{f}) / s_{f} + 1e-9, 6) AS {f}" for f in FEATS)} FROM matrix, s""",
)
def standardise(spark, sf_dir):
    m = views.matrix(spark, sf_dir)
    out = prep.Standardiser.fit(m.filter("class = 'N'"), FEATS).transform(m)
    return rounded(out.drop("class"), FEATS)


@register(
    "robust_scale",
    f"""WITH {MATRIX}, l AS (SELECT id, class, quantity, ln(1 + abs(price)) AS price, discount, tax FROM matrix),
        s AS (SELECT {", ".join(f"quantile_cont({f}, 0.5) AS m_{f}, quantile_cont({f}, 0.75) - quantile_cont({f}, 0.25)"
                                f" + 1e-9 AS i_{f}" for f in FEATS)} FROM l WHERE class = 'N')
        SELECT id, {", ".join(f"round(({f} - m_{f}) / i_{f} + 1e-9, 6) AS {f}" for f in FEATS)} FROM l, s""",
)
def robust_scale(spark, sf_dir):
    m = views.matrix(spark, sf_dir)
    out = prep.RobustScaler.fit(m.filter("class = 'N'"), FEATS, skewed=("price",)).transform(m)
    return rounded(out.select("id", *FEATS), FEATS)


@register(
    "zscore_by_dataset",
    f"""WITH {MATRIX} SELECT id, {", ".join(f"round(greatest(-50, least(50, ({f} - avg({f}) OVER w) / (stddev_pop({f}) "
                                            f"OVER w + 1e-9))) + 1e-9, 6) AS {f}" for f in FEATS)}
        FROM matrix WINDOW w AS (PARTITION BY class)""",
)
def zscore_by_dataset(spark, sf_dir):
    out = prep.zscore_by(views.matrix(spark, sf_dir), "class", FEATS)
    return rounded(out.select("id", *FEATS), FEATS)


COVS = [(a, b) for i, a in enumerate(FEATS) for b in FEATS[i:]]


@register(
    "coral_alignment",
    f"""WITH {MATRIX}, z AS (SELECT class, {", ".join(f"({f} - avg({f}) OVER w) / (stddev_pop({f}) OVER w + 1e-9) AS {f}"
                                                      for f in FEATS)} FROM matrix WINDOW w AS (PARTITION BY true))
        SELECT {", ".join(f"round(covar_samp({a}, {b}), 4) + 0 AS cov_{a}_{b}" for a, b in COVS)},
          {", ".join(f"round(avg({f}), 4) + 0 AS mean_{f}" for f in FEATS)} FROM z WHERE class = 'N'""",
)
def coral_alignment(spark, sf_dir):
    """Moments of the aligned target, which must be those of the source."""
    m = views.matrix(spark, sf_dir)
    z = prep.Standardiser.fit(m, FEATS).transform(m)
    source, target = z.filter("class = 'N'"), z.filter("class = 'R'")
    out = prep.CoralAligner.fit(source, target, FEATS).transform(target, FEATS)
    return out.agg(
        *[(F.round(F.covar_samp(a, b), 4) + 0).alias(f"cov_{a}_{b}") for a, b in COVS],
        *[(F.round(F.avg(f), 4) + 0).alias(f"mean_{f}") for f in FEATS],
    )


@register(
    "coral_alignment_packet",
    f"""WITH {MATRIX}, z AS (SELECT class, {", ".join(f"({f} - avg({f}) OVER w) / (stddev_pop({f}) OVER w + 1e-9) AS {f}"
                                                      for f in FEATS)} FROM matrix WINDOW w AS (PARTITION BY true))
        SELECT {", ".join(f"round(covar_samp({a}, {b}), 3) + 0 AS cov_{a}_{b}" for a, b in COVS)}
        FROM z WHERE class = 'N'""",
)
def coral_alignment_packet(spark, sf_dir):
    """Covariance of the aligned target, which must be that of the source."""
    m = views.matrix(spark, sf_dir)
    z = prep.Standardiser.fit(m, FEATS).transform(m)
    source, target = z.filter("class = 'N'"), z.filter("class = 'R'")
    out = prep.CoralAligner.fit(source, target, FEATS, packet=True).transform(target, FEATS)
    return out.agg(*[(F.round(F.covar_samp(a, b), 3) + 0).alias(f"cov_{a}_{b}") for a, b in COVS])


@register(
    "score_to_probability",
    f"""WITH {SCORES}, q AS (SELECT quantile_cont(p_if, 0.01) AS lo, quantile_cont(p_if, 0.99) AS hi FROM scores WHERE y = 1)
        SELECT id, round(greatest(0, least(1, (p_if - lo) / (hi - lo + 1e-12))) + 1e-9, 6) AS p FROM scores, q""",
)
def score_to_probability(spark, sf_dir):
    s = views.scores(spark, sf_dir)
    lo, hi = prep.score_bounds(s.filter("y = 1"), "p_if")
    return rounded(s.select("id", prep.unit_range(F.col("p_if"), lo, hi).alias("p")), ["p"])


@register(
    "percentile_normalise",
    f"""WITH {LONG}, q AS (SELECT dataset, model, quantile_cont(p, 0.02) AS lo, quantile_cont(p, 0.98) AS hi
          FROM long GROUP BY ALL)
        SELECT id, l.model, round(greatest(0, least(1, (p - lo) / (hi - lo))) + 1e-9, 6) AS q
        FROM long l JOIN q ON q.dataset = l.dataset AND q.model = l.model""",
)
def percentile_normalise(spark, sf_dir):
    out = prep.percentile_normalise(long_scores(spark, sf_dir), MODEL_KEYS, "p", "q")
    return rounded(out.select("id", "model", "q"), ["q"])


@register(
    "training_bounds_score",
    f"""WITH {SCORES}, q AS (SELECT min(p_if) AS lo, max(p_if) AS hi FROM scores WHERE y = 1 AND dataset = 0)
        SELECT id, round(greatest(0, least(1, (p_if - lo) / (hi - lo))) + 1e-9, 6) AS p FROM scores, q""",
)
def training_bounds_score(spark, sf_dir):
    s = views.scores(spark, sf_dir)
    lo, hi = prep.train_bounds(s.filter("y = 1 AND dataset = 0"), "p_if")
    return rounded(s.select("id", prep.bounded_score(F.col("p_if"), lo, hi).alias("p")), ["p"])


@register(
    "exact_quantiles",
    f"""WITH {MELTED} SELECT class, feature, round(quantile_cont(value, 0.05), 6) AS p05,
        round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99
        FROM melted GROUP BY class, feature""",
)
def exact_quantiles(spark, sf_dir):
    from alertmill.operators.ordered import melt

    long = melt(views.matrix(spark, sf_dir), ["class"], FEATS)
    q = quantiles(long, ["class", "feature"], "value", {"p05": 0.05, "p50": 0.5, "p99": 0.99})
    return rounded(q, ["p05", "p50", "p99"])


@register(
    "dataset_integrity",
    f"""WITH {WINDOWS} SELECT count(*) AS n_rows, {" + ".join(f"count(*) FILTER ({f} IS NULL)" for f in WINDOW_FEATURES)}
        AS nans, 0 AS infs, 0 AS bad_labels, count(*) FILTER (label = 1) AS n_normal,
        count(*) FILTER (label = 0) AS n_attack FROM windows""",
)
def dataset_integrity(spark, sf_dir):
    return prep.integrity_table(views.windows(spark, sf_dir), WINDOW_FEATURES)


@register(
    "sequential_gate",
    f"""WITH {ROLL}, f AS (SELECT coalesce(p, mp, ap, 0) AS p, coalesce(m, mm, am, 0) AS m FROM roll
          JOIN med ON med.attack_type = roll.attack_type)
        SELECT 0 AS missing, count(*) FILTER (p > 1) AS persistence_above_one, count(*) FILTER (m < 0) AS negative_mean
        FROM f""",
)
def sequential_gate(spark, sf_dir):
    return prep.sequential_gate(rolling.sequential_features(views.windows(spark, sf_dir)))


@register(
    "class_text",
    """SELECT event_type, translate(trim(lower(event_type || '-Attack Two')), '- ', '__') AS class_text,
       count(*) AS n FROM events GROUP BY event_type""",
)
def class_text(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").withColumn("t", F.concat("event_type", F.lit("-Attack Two")))
    return e.groupBy("event_type", scalars.class_text("t").alias("class_text")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "attack_families",
    f"""WITH {WINDOWS} SELECT attack_type, CASE WHEN regexp_matches(attack_type, 'flood|attack2|a2') THEN 'flooding'
        WHEN regexp_matches(attack_type, 'poison|slow|attack5|a5') THEN 'slow_poisoning' END AS family, count(*) AS n
        FROM windows GROUP BY ALL""",
)
def attack_families(spark, sf_dir):
    w = views.windows(spark, sf_dir).withColumn("family", scalars.attack_family("attack_type"))
    return w.groupBy("attack_type", "family").agg(F.count(F.lit(1)).alias("n"))


@register(
    "numeric_coercion",
    """SELECT count(*) AS n, count(TRY_CAST(props AS DOUBLE)) AS n_text,
       count(TRY_CAST(CAST(value AS VARCHAR) AS DOUBLE)) AS n_value FROM events""",
)
def numeric_coercion(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    return e.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.col("props").try_cast("double")).alias("n_text"),
        F.count(F.col("value").cast("string").try_cast("double")).alias("n_value"),
    )


@register(
    "sensor_zscore",
    f"""WITH {HOURS.format(least=3)} SELECT dataset, make_timestamp(h * 3600000000)::VARCHAR AS start,
        round((payload_entropy - avg(payload_entropy) OVER w) / (stddev_pop(payload_entropy) OVER w + 1e-9) + 1e-9, 5)
          AS payload_entropy FROM feats WINDOW w AS (PARTITION BY dataset)""",
)
def sensor_zscore(spark, sf_dir):
    w = sensor.sensor_windows(views.readings(spark, sf_dir), min_rows=3, rolling=False)
    z = prep.zscore_by(w, "dataset", ["payload_entropy"])
    z = z.select("dataset", F.date_format("window_start_time", "yyyy-MM-dd HH:mm:ss").alias("start"), "payload_entropy")
    return rounded(z, ["payload_entropy"], 5)


EVALUATED = f"""WITH {SCORES},
lg AS (SELECT dataset, id, y, attack_type, unnest(['forest', 'sequence']) AS model, unnest([p_if, p_lstm]) AS p FROM scores),
pt AS (SELECT dataset, model, point, thr, (count(*) FILTER (y = 0 AND p < thr))::DOUBLE AS ad, (count(*) FILTER (y = 0 AND p >= thr))::DOUBLE AS am,
    (count(*) FILTER (y = 1 AND p < thr))::DOUBLE AS nf, (count(*) FILTER (y = 1 AND p >= thr))::DOUBLE AS na
  FROM lg, (VALUES ('fixed', 0.5), ('low', 0.25)) AS t(point, thr) GROUP BY ALL),
mc AS (SELECT dataset, (count(*) FILTER (f AND NOT s))::DOUBLE AS b, (count(*) FILTER (s AND NOT f))::DOUBLE AS c
  FROM (SELECT dataset, (p_if < 0.5) = (y = 0) AS f, (p_lstm < 0.5) = (y = 0) AS s FROM scores) GROUP BY dataset),
g AS (SELECT *, row_number() OVER (PARTITION BY dataset, model ORDER BY id) AS rn, row_number() OVER (PARTITION BY dataset, model ORDER BY id)
    - row_number() OVER (PARTITION BY dataset, model, y ORDER BY id) AS grp FROM lg),
rr AS (SELECT dataset, model, 10.0 * coalesce(min(CASE WHEN p < 0.5 THEN rn END) - min(rn), count(*)) AS delay,
    count(*) FILTER (p < 0.5) > 0 AS detected FROM g WHERE y = 0 GROUP BY dataset, model, grp),
dl AS (SELECT dataset, model, count(*)::DOUBLE AS n, (count(*) FILTER (detected))::DOUBLE AS d, quantile_cont(delay::DOUBLE, 0.5) AS med,
    quantile_cont(delay::DOUBLE, 0.9) AS p90, (count(*) FILTER (delay <= 10))::DOUBLE AS early FROM rr GROUP BY ALL),
sl AS (SELECT *, y = 0 AND attack_type = 'injection' AS slow FROM lg),
sg AS (SELECT *, lag(id) OVER d AS prev, count(y) OVER w AS c5, min(y) OVER w AS m5,
    row_number() OVER d - row_number() OVER (PARTITION BY dataset, model, slow ORDER BY id) AS sgrp FROM sl
  WINDOW d AS (PARTITION BY dataset, model ORDER BY id),
    w AS (PARTITION BY dataset, model ORDER BY id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
sp AS (SELECT *, row_number() OVER (PARTITION BY dataset, model, slow, sgrp ORDER BY id) AS pos FROM sg),
rg AS (SELECT 'scores' AS section, dataset, model, y, p FROM sp
  UNION ALL SELECT 'regime:flooding', dataset, model, y, p FROM sp WHERE y = 1 OR attack_type = 'ddos'
  UNION ALL SELECT 'regime:isolated', dataset, model, y, p FROM sp WHERE y = 1 OR (c5 >= 3 AND m5 = 1)
  UNION ALL SELECT 'regime:early', dataset, model, y, p FROM sp WHERE y = 1 OR (slow AND pos <= 5)
  UNION ALL SELECT 'regime:cold_start', dataset, model, y, p FROM sp WHERE prev IS NULL OR id - prev > 1),
rk AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY section, dataset, model, p) - 1) / 2.0 AS r
  FROM rg WINDOW w AS (PARTITION BY section, dataset, model ORDER BY p)),
every AS (
  SELECT dataset, section, model, 'auc' AS measure, (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) AS value
    FROM rk GROUP BY dataset, section, model
  UNION ALL SELECT dataset, 'point:' || point, model, unnest(['threshold', 'n_attack_detected', 'n_attack_missed', 'n_normal_flagged',
      'n_normal_accepted', 'tpr', 'fpr', 'f1']), unnest([thr::DOUBLE, ad, am, nf, na, ad / (ad + am), nf / (nf + na), 2 * ad / (2 * ad + nf + am)]) FROM pt
  UNION ALL SELECT dataset, 'mcnemar', 'forest/sequence', unnest(['b', 'c', 'chi2']),
      unnest([b, c, CASE WHEN b + c > 0 THEN (abs(b - c) - 1) * (abs(b - c) - 1) / (b + c) ELSE 0 END]) FROM mc
  UNION ALL SELECT dataset, 'delay', model, unnest(['n_runs', 'n_detected', 'detection_rate', 'median_delay_min', 'p90_delay_min', 'early_detect_1w']),
      unnest([n, d, d / n, med, p90, early]) FROM dl)
SELECT dataset, section, model, measure, round(value, 6) AS value FROM every"""
#: Held by queries of their own.
ELSEWHERE = ["average_precision", "ece", "bhattacharyya", "tpr_lo", "tpr_hi", "fpr_lo", "fpr_hi", "p_value", "power"]


@register("evaluation_report", EVALUATED)
def evaluation_report(spark, sf_dir):
    kind = F.col("attack_type")
    r = reporting.evaluation(
        views.scores(spark, sf_dir),
        {"forest": "p_if", "sequence": "p_lstm"},
        KEYS,
        ["id"],
        "id",
        {"fixed": 0.5, "low": 0.25},
        kind == "ddos",
        kind == "injection",
    )
    return rounded(r.filter(~F.col("measure").isin(ELSEWHERE)), ["value"])
