"""Effect size, rank test, correlation, selection and interval queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from alertmill.catalog import register
from alertmill.catalog.scoring import AUCS, LONG, MODEL_KEYS, long_scores
from alertmill.catalog.views_sql import MATRIX, MELTED, SCORES, WINDOWS
from alertmill.catalog.windowing import rounded
from alertmill.functions.scalars import whole
from alertmill.operators import metrics, resample, splits, stats
from alertmill.plans import selection
from alertmill.sources import views

FEATS = views.MATRIX_FEATURES

# The line items play the feature table: class N is normal, A and R the two attack families.
FAMILY = {"N": "normal", "A": "flooding", "R": "slow_poisoning"}

GROUPED = (
    MELTED
    + """,
mom AS (SELECT feature, class, count(value) AS n, avg(value) AS m, var_samp(value) AS v, var_pop(value) AS vp
  FROM melted GROUP BY ALL),
eff AS (
  SELECT feature, max(g) FILTER (class = 'A') AS ga, max(g) FILTER (class = 'R') AS gr FROM (
    SELECT a.feature, b.class, abs(a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2))
      * (1 - 3 / (4e0 * (a.n + b.n - 2) - 1)) AS g
    FROM mom a JOIN mom b ON b.feature = a.feature WHERE a.class = 'N' AND b.class <> 'N') GROUP BY feature)
"""
)


def feature_table(spark, sf_dir):
    m = views.matrix(spark, sf_dir)
    fam = F.create_map(*[F.lit(x) for kv in FAMILY.items() for x in kv])
    return m.withColumn("family", fam[F.col("class")]).withColumn("label", F.when(F.col("class") == "N", 1).otherwise(0))


@register(
    "effect_sizes",
    f"""WITH {GROUPED} SELECT feature, round(ga, 6) AS g_flooding, round(gr, 6) AS g_slow,
        round(least(ga, gr), 6) AS g_min, CASE WHEN least(ga, gr) >= 0.8 THEN 'LARGE'
        WHEN least(ga, gr) >= 0.5 THEN 'MEDIUM' ELSE 'small' END AS effect FROM eff""",
)
def effect_sizes(spark, sf_dir):
    e = stats.effect_sizes(feature_table(spark, sf_dir), FEATS)
    return e.withColumns({c: F.round(c, 6) for c in ("g_flooding", "g_slow", "g_min")})


WINDOW_STATS = ["alert_frequency_per_hour", "normal_emergency_ratio", "inter_alert_interval_mean", "payload_entropy"]


@register(
    "window_effect_sizes",
    f"""WITH {WINDOWS}, l AS (SELECT attack_type AS class, unnest({WINDOW_STATS!r}) AS feature,
          unnest([{", ".join(WINDOW_STATS)}]) AS value FROM windows),
        mom AS (SELECT feature, class, count(value) AS n, avg(value) AS m, var_samp(value) AS v FROM l GROUP BY ALL)
        SELECT a.feature, b.class, round(abs(a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2))
          * (1 - 3 / (4e0 * (a.n + b.n - 2) - 1)), 6) AS g
        FROM mom a JOIN mom b ON b.feature = a.feature WHERE a.class = 'normal' AND b.class <> 'normal'""",
)
def window_effect_sizes(spark, sf_dir):
    tagged = stats.split_families(views.windows(spark, sf_dir), ["window_start_time", "window_id"])
    e = stats.effect_sizes(tagged, WINDOW_STATS, undefined=None)
    pair = F.array(
        F.struct(F.lit("flooding").alias("class"), F.round("g_flooding", 6).alias("g")),
        F.struct(F.lit("slow_poisoning").alias("class"), F.round("g_slow", 6).alias("g")),
    )
    return e.select("feature", F.inline(pair))


@register(
    "frequency_split_families",
    f"""WITH {WINDOWS}, a AS (SELECT window_id, row_number() OVER (ORDER BY alert_frequency_per_hour, ws, window_id) AS rn,
          count(*) OVER () AS n FROM windows WHERE label = 0)
        SELECT window_id, CASE WHEN rn <= n // 2 THEN 'slow_poisoning' ELSE 'flooding' END AS family FROM a
        UNION ALL SELECT window_id, 'normal' FROM windows WHERE label = 1""",
)
def frequency_split_families(spark, sf_dir):
    w = stats.halve_by_frequency(views.windows(spark, sf_dir), ["window_start_time", "window_id"])
    return w.select("window_id", "family")


@register(
    "variance_filter",
    f"""WITH {MELTED} SELECT feature, round(var_pop(value), 4) AS variance,
        CAST(var_pop(value) > 1e-4 AS INTEGER) AS keep FROM melted GROUP BY feature""",
)
def variance_filter(spark, sf_dir):
    v = stats.variance_filter(feature_table(spark, sf_dir), FEATS)
    return v.withColumn("variance", F.round("variance", 4)).withColumn("keep", F.col("keep").cast("int"))


@register(
    "within_class_filter",
    f"""WITH {GROUPED} SELECT feature, round(min(v), 4) AS min_class_variance, CAST(min(v) >= 1e-6 AS INTEGER) AS keep
        FROM mom GROUP BY feature""",
)
def within_class_filter(spark, sf_dir):
    v = stats.within_class_filter(feature_table(spark, sf_dir), FEATS, "class")
    return v.withColumn("min_class_variance", F.round("min_class_variance", 4)).withColumn(
        "keep", F.col("keep").cast("int")
    )


RANKS = (
    MELTED
    + """,
rk AS (SELECT feature, class, rank() OVER w + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS r,
    count(*) OVER (PARTITION BY feature, value) AS t, count(*) OVER (PARTITION BY feature) AS n
  FROM melted WINDOW w AS (PARTITION BY feature ORDER BY value)),
rs AS (SELECT feature, any_value(n)::DOUBLE AS n, count(*) FILTER (class = 'N')::DOUBLE AS n1,
    count(*) FILTER (class <> 'N')::DOUBLE AS n0, sum(r) FILTER (class = 'N')::DOUBLE AS r1,
    sum(r) FILTER (class <> 'N')::DOUBLE AS r0, sum(t::DOUBLE * t - 1) AS tie FROM rk GROUP BY feature)
"""
)


@register(
    "mann_whitney_u",
    f"WITH {RANKS} SELECT feature, round(r1 - n1 * (n1 + 1) / 2, 3) AS u FROM rs",
)
def mann_whitney_u(spark, sf_dir):
    return stats.rank_tests(feature_table(spark, sf_dir), FEATS).select("feature", F.round("u", 3).alias("u"))


@register(
    "kruskal_wallis_h",
    f"""WITH {RANKS} SELECT feature, round((12 / (n * (n + 1)) * (r1 * r1 / n1 + r0 * r0 / n0) - 3 * (n + 1))
        / (1 - tie / (n * n * n - n)), 5) AS h FROM rs""",
)
def kruskal_wallis_h(spark, sf_dir):
    return stats.rank_tests(feature_table(spark, sf_dir), FEATS).select("feature", F.round("h", 5).alias("h"))


@register("rank_test_p_values")
def rank_test_p_values(spark, sf_dir):
    return stats.rank_tests(feature_table(spark, sf_dir), FEATS).select(
        "feature", F.round("u_p", 6).alias("u_p"), F.round("h_p", 6).alias("h_p")
    )


PAIRS = [(a, b) for i, a in enumerate(FEATS) for b in FEATS[i + 1 :]]
NORMAL_CORR = f"""
nm AS (SELECT {", ".join(f"{f}, rank() OVER (ORDER BY {f}) + (count(*) OVER (PARTITION BY {f}) - 1) / 2.0 AS r_{f}"
                         for f in FEATS)} FROM matrix WHERE class = 'N'),
pc AS ({" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, abs(corr({a}, {b})) AS pearson, "
                           f"abs(corr(r_{a}, r_{b})) AS spearman FROM nm" for a, b in PAIRS)})
"""
CORR = f"{MATRIX}, {NORMAL_CORR}"


def _normal_rows(spark, sf_dir):
    return feature_table(spark, sf_dir).filter("label = 1")


@register(
    "correlation_pairs",
    f"WITH {CORR} SELECT a, b, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman FROM pc",
)
def correlation_pairs(spark, sf_dir):
    m = _normal_rows(spark, sf_dir)
    c = stats.correlation_pairs(m.withColumn("row_id", F.concat_ws("|", "id", *FEATS)), FEATS, "row_id")
    return c.withColumns({n: F.round(n, 6) for n in ("pearson", "spearman")})


@register(
    "collinear_pairs",
    f"WITH {CORR} SELECT a, b, round(pearson, 6) AS pearson FROM pc WHERE pearson > 0.005 AND spearman > 0.005",
)
def collinear_pairs(spark, sf_dir):
    m = _normal_rows(spark, sf_dir)
    c = stats.correlation_pairs(m.withColumn("row_id", F.concat_ws("|", "id", *FEATS)), FEATS, "row_id")
    return stats.collinear_pairs(c, 0.005).select("a", "b", F.round("pearson", 6).alias("pearson"))


@register(
    "collinear_components",
    f"""WITH RECURSIVE {GROUPED}, {NORMAL_CORR},
        links AS (SELECT a, b FROM pc WHERE pearson > 0.003 UNION SELECT b, a FROM pc WHERE pearson > 0.003),
        reach(f, t) AS (SELECT feature, feature FROM eff
          UNION SELECT r.f, l.b FROM reach r JOIN links l ON l.a = r.t),
        comp AS (SELECT f AS feature, min(t) AS component FROM reach GROUP BY f)
        SELECT c.feature, component, CAST(row_number() OVER (PARTITION BY component
          ORDER BY least(ga, gr) DESC, c.feature DESC) = 1 AS INTEGER) AS keep FROM comp c JOIN eff e ON e.feature = c.feature""",
)
def collinear_components(spark, sf_dir):
    t = feature_table(spark, sf_dir)
    linked = stats.pearson_pairs(t.filter("label = 1"), FEATS).filter("r > 0.003")
    kept = stats.prune_collinear(linked, stats.effect_sizes(t, FEATS), FEATS)
    return kept.withColumn("keep", F.col("keep").cast("int"))


SAMPLED = """
sm AS (SELECT id, quantity, price, discount, tax, CASE WHEN class = 'N' THEN 1 ELSE 0 END AS label FROM (
  SELECT *, row_number() OVER (PARTITION BY class = 'N' ORDER BY md5('42:' || id), id) AS rn,
    count(*) OVER (PARTITION BY class = 'N') AS n FROM matrix) WHERE rn <= round(n * 0.6))
"""


def _calibration(spark, sf_dir):
    return splits.stratified_sample(feature_table(spark, sf_dir), ["label"], "id")


_LONG_SAMPLE = f"""{MATRIX}, {SAMPLED},
sl AS (SELECT label, unnest(['quantity', 'price', 'discount', 'tax']) AS feature,
  unnest([quantity, price, discount, tax]) AS value FROM sm)"""
_ANOVA = """
an AS (SELECT feature, (sum(n * (m - g) * (m - g)) / 1) / (sum(n * vp) / (sum(n) - 2)) AS f_score FROM (
  SELECT feature, label, count(*) AS n, avg(value) AS m, var_pop(value) AS vp FROM sl GROUP BY ALL)
  JOIN (SELECT feature, avg(value) AS g FROM sl GROUP BY feature) USING (feature) GROUP BY feature)"""
_MI = """
bn AS (SELECT feature, label, ((rank() OVER (PARTITION BY feature ORDER BY value) - 1) * 10)
    // count(*) OVER (PARTITION BY feature) AS bin FROM sl),
ct AS (SELECT feature, bin, label, count(*)::DOUBLE AS c FROM bn GROUP BY ALL),
mt AS (SELECT feature, sum(c / t * ln(c * t / (rb * rl))) AS mi FROM (
  SELECT *, sum(c) OVER (PARTITION BY feature) AS t, sum(c) OVER (PARTITION BY feature, bin) AS rb,
    sum(c) OVER (PARTITION BY feature, label) AS rl FROM ct) GROUP BY feature)"""


@register("anova_f", f"WITH {_LONG_SAMPLE}, {_ANOVA} SELECT feature, round(f_score, 5) AS f_score FROM an")
def anova_f(spark, sf_dir):
    return stats.anova_f(_calibration(spark, sf_dir), FEATS).withColumn("f_score", F.round("f_score", 5))


@register("binned_information", f"WITH {_LONG_SAMPLE}, {_MI} SELECT feature, round(mi, 8) AS mi FROM mt")
def binned_information(spark, sf_dir):
    return stats.binned_information(_calibration(spark, sf_dir), FEATS).withColumn("mi", F.round("mi", 8))


@register(
    "combined_rank",
    f"""WITH {GROUPED}, {SAMPLED}, sl AS (SELECT label, unnest(['quantity', 'price', 'discount', 'tax']) AS feature,
          unnest([quantity, price, discount, tax]) AS value FROM sm), {_ANOVA}, {_MI},
        j AS (SELECT e.feature, least(ga, gr) AS g, f_score AS f, mi FROM eff e JOIN an ON an.feature = e.feature
          JOIN mt ON mt.feature = e.feature)
        SELECT feature, round((g / max(g) OVER () + f / max(f) OVER () + mi / max(mi) OVER ()) / 3, 5) AS score FROM j""",
)
def combined_rank(spark, sf_dir):
    return _combined(spark, sf_dir).select("feature", F.round("score", 5).alias("score"))


def _combined(spark, sf_dir):
    sample = _calibration(spark, sf_dir)
    return stats.combined_rank(
        stats.effect_sizes(feature_table(spark, sf_dir), FEATS),
        stats.anova_f(sample, FEATS),
        stats.binned_information(sample, FEATS),
    )


@register("bootstrap_stability")
def bootstrap_stability(spark, sf_dir):
    return resample.selection_stability(feature_table(spark, sf_dir), FEATS, "id", replicates=200, k=2)


@register("bootstrap_moments")
def bootstrap_moments(spark, sf_dir):
    m = resample.replicate_moments(feature_table(spark, sf_dir), FEATS, "label", "id", replicates=200)
    return m.groupBy("cls", "feature").agg(F.avg("mean").alias("mean"), F.stddev_samp("mean").alias("spread"))


@register("final_feature_pick")
def final_feature_pick(spark, sf_dir):
    stability = resample.selection_stability(feature_table(spark, sf_dir), FEATS, "id", replicates=200, k=2)
    return stats.final_pick(_combined(spark, sf_dir), stability, k=2).select("feature", "stable")


@register("max_pairwise_correlation", f"WITH {CORR} SELECT round(max(pearson), 6) AS max_pearson FROM pc")
def max_pairwise_correlation(spark, sf_dir):
    return rounded(stats.max_correlation(_normal_rows(spark, sf_dir), FEATS), ["max_pearson"])


@register(
    "class_audit",
    f"""WITH {GROUPED} SELECT class, feature, n, round(m, 4) AS mean, round(sqrt(vp), 4) AS std FROM mom""",
)
def class_audit(spark, sf_dir):
    a = stats.class_audit(feature_table(spark, sf_dir), FEATS, "class")
    return a.withColumn("mean", F.round("mean", 4)).withColumn("std", F.round("std", 4))


@register(
    "top_windows",
    f"""WITH {WINDOWS} SELECT window_id, alert_frequency_per_hour FROM windows
        ORDER BY alert_frequency_per_hour DESC, window_id LIMIT 10""",
)
def top_windows(spark, sf_dir):
    w = views.windows(spark, sf_dir).orderBy(F.col("alert_frequency_per_hour").desc(), "window_id").limit(10)
    return w.select("window_id", "alert_frequency_per_hour")


_TAIL = (
    "list_sum(list_transform(range({a}, {b}), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)"
    " + i * ln({p}) + (n - i) * ln(1 - {p}))))"
)


@register(
    "detection_rate_intervals",
    f"""WITH RECURSIVE {LONG},
        c AS (SELECT dataset, model, count(*) FILTER (p < 0.5) AS k, count(*) AS n FROM long WHERE y = 0 GROUP BY ALL),
        -- bisection: the bound at which the seen count is just in the 2.5 % tail
        bis(dataset, model, k, n, step, a, b, u, v) AS (
          SELECT dataset, model, k, n, 0, 0e0, 1e0, 0e0, 1e0 FROM c
          UNION ALL
          SELECT dataset, model, k, n, step + 1,
            CASE WHEN {_TAIL.format(a="k", b="n + 1", p="((a + b) / 2)")} < 0.025 THEN (a + b) / 2 ELSE a END,
            CASE WHEN {_TAIL.format(a="k", b="n + 1", p="((a + b) / 2)")} < 0.025 THEN b ELSE (a + b) / 2 END,
            CASE WHEN {_TAIL.format(a="0", b="k + 1", p="((u + v) / 2)")} > 0.025 THEN (u + v) / 2 ELSE u END,
            CASE WHEN {_TAIL.format(a="0", b="k + 1", p="((u + v) / 2)")} > 0.025 THEN v ELSE (u + v) / 2 END
          FROM bis WHERE step < 45)
        SELECT dataset, model, round(k / n, 6) AS tpr, round(a, 6) AS ci_lo, round(u, 6) AS ci_hi
        FROM bis WHERE step = 45""",
)
def detection_rate_intervals(spark, sf_dir):
    c = metrics.confusion(long_scores(spark, sf_dir), MODEL_KEYS).withColumn(
        "n_attack", F.col("n_attack_detected") + F.col("n_attack_missed")
    )
    return stats.share_interval(c, "n_attack_detected", "n_attack").select(
        *MODEL_KEYS, *[F.round(n, 6).alias(n) for n in ("tpr", "ci_lo", "ci_hi")]
    )


@register(
    "zero_event_bound",
    f"""WITH {SCORES} SELECT dataset, count(*) AS n_normal, round(1 - pow(0.025, 1.0 / count(*)), 8) AS upper
        FROM scores WHERE y = 1 GROUP BY dataset""",
)
def zero_event_bound(spark, sf_dir):
    n = views.scores(spark, sf_dir).filter("y = 1").groupBy("dataset").agg(F.count(F.lit(1)).alias("n_normal"))
    return n.withColumn("upper", F.round(stats.zero_event_bound(F.col("n_normal")), 8))


def _mcnemar(spark, sf_dir):
    s = views.scores(spark, sf_dir)
    right = lambda p: F.when(F.col("y") == 0, F.col(p) < 0.5).otherwise(F.col(p) >= 0.5)
    return stats.mcnemar(s, ["dataset", "y"], right("p_if"), right("p_lstm"))


@register(
    "mcnemar",
    f"""WITH {SCORES}, r AS (SELECT dataset, y, (p_if < 0.5) = (y = 0) AS f, (p_lstm < 0.5) = (y = 0) AS s FROM scores),
        c AS (SELECT dataset, y, count(*) FILTER (f AND NOT s) AS b, count(*) FILTER (s AND NOT f) AS c FROM r GROUP BY ALL)
        SELECT dataset, y, b, c, round(CASE WHEN b + c > 0 THEN pow(abs(b - c) - 1, 2) / (b + c) ELSE 0 END, 6) AS chi2
        FROM c""",
)
def mcnemar(spark, sf_dir):
    return rounded(_mcnemar(spark, sf_dir).select("dataset", "y", "b", "c", "chi2"), ["chi2"])


@register("mcnemar_p_values")
def mcnemar_p_values(spark, sf_dir):
    return rounded(_mcnemar(spark, sf_dir).select("dataset", "y", "p_value"), ["p_value"])


@register(
    "mcnemar_power",
    f"""WITH {SCORES}, r AS (SELECT dataset, y, (p_if < 0.5) = (y = 0) AS f, (p_lstm < 0.5) = (y = 0) AS s FROM scores),
        t AS (SELECT dataset, y, count(*) FILTER (f AND NOT s) AS b, count(*) FILTER (s AND NOT f) AS c FROM r GROUP BY ALL),
        n AS (SELECT *, b + c AS n, c / (b + c) AS q FROM t WHERE b > 0 AND c > 0),
        i AS (SELECT dataset, y, n, q, unnest(range(0, n + 1)) AS i FROM n),
        d AS (SELECT *, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + n * ln(0.5))) OVER w AS half,
            sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(q) + (n - i) * ln(1 - q))) OVER w AS seen
          FROM i WINDOW w AS (PARTITION BY dataset, y ORDER BY i)),
        k AS (SELECT dataset, y, min(i) AS crit FROM d WHERE half >= 0.95 GROUP BY ALL)
        SELECT k.dataset, k.y, round(1 - d.seen, 5) + 0 AS power FROM k JOIN d
          ON d.dataset = k.dataset AND d.y = k.y AND d.i = k.crit - 1""",
)
def mcnemar_power(spark, sf_dir):
    return _mcnemar(spark, sf_dir).select("dataset", "y", (F.round("power", 5) + 0).alias("power"))


@register(
    "auc_normal_interval",
    f"""WITH {AUCS}, n AS (SELECT dataset, sum(y) AS nn, sum(1 - y) AS na FROM scores GROUP BY dataset),
        q AS (SELECT a.dataset, model, auc, sqrt((auc * (1 - auc) + (na - 1) * (auc / (2 - auc) - auc * auc)
          + (nn - 1) * (2 * auc * auc / (1 + auc) - auc * auc)) / (na * nn)) AS se FROM aucs a JOIN n ON n.dataset = a.dataset)
        SELECT dataset, model, round(auc, 6) AS auc, round(greatest(0, auc - 1.96 * se), 6) AS ci_lo,
          round(least(1, auc + 1.96 * se), 6) AS ci_hi FROM q""",
)
def auc_normal_interval(spark, sf_dir):
    s = long_scores(spark, sf_dir)
    sizes = s.groupBy(*MODEL_KEYS).agg(
        F.count_if(F.col("y") == 0).alias("na"), F.count_if(F.col("y") == 1).alias("nn")
    )
    a = stats.auc_interval(metrics.auc(s, MODEL_KEYS).join(sizes, MODEL_KEYS), "na", "nn")
    return rounded(a.select(*MODEL_KEYS, "auc", "ci_lo", "ci_hi"), ["auc", "ci_lo", "ci_hi"])


# Fixed value: replicates of an interval.
REPLICATES = 10_000


@register("bootstrap_auc_interval")
def bootstrap_auc_interval(spark, sf_dir):
    s = views.scores(spark, sf_dir)
    return resample.bootstrap_interval(resample.replicate_metrics(s, "id", "p_lstm", replicates=REPLICATES))


@register("block_bootstrap_interval")
def block_bootstrap_interval(spark, sf_dir):
    s = splits.in_order(views.scores(spark, sf_dir), [], ["id"]).withColumn("block", whole(F.col("_rank") - 1, 6))
    return resample.bootstrap_interval(resample.replicate_metrics(s, "block", "p_lstm", replicates=REPLICATES))


def weighted_flag_rate(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """Share of attacks below one half; an example of a caller's metric."""
    attack = labels == 0
    return float(weights[attack & (scores < 0.5)].sum() / max(weights[attack].sum(), 1.0))


@register("user_metric_bootstrap")
def user_metric_bootstrap(spark, sf_dir):
    s = views.scores(spark, sf_dir)
    r = resample.user_metric_replicates(s, weighted_flag_rate, "id", "p_lstm", replicates=100)
    return r.agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


@register(
    "repeat_summary",
    f"""WITH {LONG} SELECT model, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std FROM (
          SELECT model, dataset, avg(p) AS v FROM long GROUP BY ALL) GROUP BY model""",
)
def repeat_summary(spark, sf_dir):
    per = long_scores(spark, sf_dir).groupBy(*MODEL_KEYS).agg(F.avg("p").alias("value"))
    s = stats.summarise_repeats(per, ["model"])
    return rounded(s.select("model", "n", "mean", "std"), ["mean", "std"])


# The line items once more, with columns that each step of the choice has to turn down.
WIDE_FEATS = [*FEATS, "net", "gross", "unit", "returned"]
WIDE = (
    MATRIX
    + """,
wide AS (SELECT *, price * (1 - discount) AS net, price * (1 + tax) AS gross, tax / 100 AS unit,
    CASE WHEN class = 'N' THEN 0e0 ELSE 1e0 END AS returned FROM matrix),
melted AS (SELECT id, class, unnest([{names}]) AS feature, unnest([{columns}]) AS value FROM wide),
vr AS (SELECT feature, var_pop(value) > 1e-4 AS varies FROM melted GROUP BY feature),
mom AS (SELECT feature, class, count(value) AS n, avg(value) AS m, var_samp(value) AS v FROM melted GROUP BY ALL),
wi AS (SELECT feature, min(v) >= 1e-6 AS within FROM mom GROUP BY feature),
sv AS (SELECT feature FROM vr JOIN wi USING (feature) WHERE varies AND within),
eff AS (SELECT feature, least(max(g) FILTER (class = 'A'), max(g) FILTER (class = 'R')) AS g FROM (
    SELECT a.feature, b.class, abs(a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2))
      * (1 - 3 / (4e0 * (a.n + b.n - 2) - 1)) AS g
    FROM mom a JOIN mom b ON b.feature = a.feature JOIN sv ON sv.feature = a.feature
    WHERE a.class = 'N' AND b.class <> 'N') GROUP BY feature),
rk AS (SELECT id, feature, value, rank() OVER (PARTITION BY feature ORDER BY value)
    + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS r FROM melted JOIN sv USING (feature) WHERE class = 'N'),
pc AS (SELECT a.feature AS a, b.feature AS b, abs(corr(a.value, b.value)) AS pearson, abs(corr(a.r, b.r)) AS spearman
    FROM rk a JOIN rk b ON b.id = a.id AND a.feature <> b.feature GROUP BY ALL),
links AS (SELECT a, b FROM pc WHERE pearson > 0.92 AND spearman > 0.92),
reach(f, t) AS (SELECT feature, feature FROM eff UNION SELECT r.f, l.b FROM reach r JOIN links l ON l.a = r.t),
comp AS (SELECT f AS feature, min(t) AS component FROM reach GROUP BY f),
free AS (SELECT feature, g FROM (SELECT c.feature, g, row_number() OVER (PARTITION BY component
    ORDER BY g DESC, c.feature DESC) AS place FROM comp c JOIN eff ON eff.feature = c.feature) WHERE place = 1),
sm AS (SELECT id, CASE WHEN class = 'N' THEN 1 ELSE 0 END AS label FROM (
  SELECT *, row_number() OVER (PARTITION BY class = 'N' ORDER BY md5('42:' || id), id) AS rn,
    count(*) OVER (PARTITION BY class = 'N') AS n FROM matrix) WHERE rn <= round(n * 0.6)),
sl AS (SELECT label, feature, value FROM melted JOIN sm USING (id) JOIN free USING (feature))""".format(
        names=", ".join(f"'{f}'" for f in WIDE_FEATS), columns=", ".join(WIDE_FEATS)
    )
)


def wide_table(spark, sf_dir):
    t = feature_table(spark, sf_dir)
    price, tax = F.col("price"), F.col("tax")
    return t.withColumns(
        {
            "net": price * (1 - F.col("discount")),
            "gross": price * (1 + tax),
            "unit": tax / 100,
            "returned": F.when(F.col("class") == "N", 0.0).otherwise(1.0),
        }
    )


@register(
    "feature_candidates",
    f"""WITH RECURSIVE {WIDE}, {_ANOVA}, {_MI},
        j AS (SELECT feature, g, f_score, mi, (g / max(g) OVER () + f_score / max(f_score) OVER ()
            + mi / max(mi) OVER ()) / 3 AS score FROM free JOIN an USING (feature) JOIN mt USING (feature))
        SELECT vr.feature, CASE WHEN NOT varies THEN 'variance' WHEN NOT within THEN 'within_class'
          WHEN j.feature IS NULL THEN 'collinear' ELSE 'ranked' END AS stage,
          round(j.g, 6) AS g_min, round(j.f_score, 5) AS f_score, round(j.mi, 8) AS mi, round(j.score, 5) AS score
        FROM vr JOIN wi USING (feature) LEFT JOIN j ON j.feature = vr.feature""",
)
def feature_candidates(spark, sf_dir):
    found = selection.candidates(wide_table(spark, sf_dir), WIDE_FEATS, "id", "class")
    return found.withColumns({c: F.round(c, d) for c, d in (("g_min", 6), ("f_score", 5), ("mi", 8), ("score", 5))})


@register("feature_selection")
def feature_selection(spark, sf_dir):
    return selection.select_features(wide_table(spark, sf_dir), WIDE_FEATS, "id", k=3, cls="class")
