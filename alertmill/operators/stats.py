"""Effect sizes, rank tests, correlation and the feature choice built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertmill.functions.scalars import attack_family, effect_label
from alertmill.functions.special import (
    chi2_tail_one,
    discordance_power_udf,
    exact_interval_udf,
    normal_two_sided,
    t_upper_975,
)
from alertmill.operators.ordered import ladder, melt
from alertmill.operators.splits import in_order


def class_moments(df: DataFrame, features: Sequence[str], cls: str | None) -> DataFrame:
    """(class, feature, n, mean, var, var_pop): one aggregate pass, rows are not multiplied."""
    groups = [cls] if cls else []
    aggs = []
    for f in features:
        c = F.col(f).cast("double")
        aggs += [
            F.count(c).alias(f"n_{f}"),
            F.avg(c).alias(f"m_{f}"),
            F.var_samp(c).alias(f"v_{f}"),
            F.var_pop(c).alias(f"p_{f}"),
        ]
    wide = df.groupBy(*groups).agg(*aggs)
    rows = [
        F.struct(
            F.lit(f).alias("feature"),
            F.col(f"n_{f}").alias("n"),
            F.col(f"m_{f}").alias("mean"),
            F.col(f"v_{f}").alias("var"),
            F.col(f"p_{f}").alias("var_pop"),
        )
        for f in features
    ]
    return wide.select(*groups, F.inline(F.array(*rows)))


def hedges_g(
    n1: Column, m1: Column, v1: Column, n2: Column, m2: Column, v2: Column, undefined: float | None = 0.0
) -> Column:
    """Bias-corrected standardised mean difference, absolute."""
    df = (n1 + n2 - 2).cast("double")
    pooled = F.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / df)
    g = F.abs(m1 - m2) / pooled * (1.0 - 3.0 / (4.0 * df - 1.0))
    return F.when((n1 >= 2) & (n2 >= 2) & (pooled >= 1e-10), g).otherwise(F.lit(undefined))


def split_families(df: DataFrame, order: Sequence[str], cls: str = "attack_type", least: int = 5) -> DataFrame:
    """``family``: normal, flooding or slow_poisoning.

    With fewer than ``least`` rows in either attack family, the attacks are cut
    at the middle of their order by alert frequency instead: slow below.
    """
    family = F.when(F.col("label") == 1, "normal").otherwise(attack_family(cls))
    tagged = df.withColumn("family", family)
    sizes = {r["family"]: r["count"] for r in tagged.filter("label = 0").groupBy("family").count().collect()}
    if min(sizes.get("flooding", 0), sizes.get("slow_poisoning", 0)) >= least:
        return tagged
    return halve_by_frequency(tagged, order)


def halve_by_frequency(df: DataFrame, order: Sequence[str]) -> DataFrame:
    attacks = in_order(df.filter("label = 0"), [], ["alert_frequency_per_hour", *order])
    low = F.col("_rank") <= F.floor(F.col("_n") / 2)
    halves = attacks.withColumn("family", F.when(low, "slow_poisoning").otherwise("flooding")).drop("_rank", "_n")
    return df.filter("label = 1").withColumn("family", F.lit("normal")).unionByName(halves)


def effect_sizes(df: DataFrame, features: Sequence[str], family: str = "family", undefined: float | None = 0.0) -> DataFrame:
    """Per feature: g of each attack family against normal, the smaller one and its label."""
    m = class_moments(df, features, family)
    pick = {
        fam: F.max(F.when(F.col(family) == fam, F.struct("n", "mean", "var"))).alias(fam)
        for fam in ("normal", "flooding", "slow_poisoning")
    }
    wide = m.groupBy("feature").agg(*pick.values())

    def g(fam: str) -> Column:
        parts = [F.col(f"{side}.{c}") for side in ("normal", fam) for c in ("n", "mean", "var")]
        return F.coalesce(hedges_g(*parts, undefined=undefined), F.lit(undefined))

    out = wide.select("feature", g("flooding").alias("g_flooding"), g("slow_poisoning").alias("g_slow"))
    return out.withColumn("g_min", F.least("g_flooding", "g_slow")).withColumn("effect", effect_label(F.col("g_min")))


def variance_filter(df: DataFrame, features: Sequence[str], least: float = 1e-4) -> DataFrame:
    """Population variance per feature and whether it passes."""
    return class_moments(df, features, None).select(
        "feature", F.col("var_pop").alias("variance"), (F.col("var_pop") > least).alias("keep")
    )


def within_class_filter(
    df: DataFrame, features: Sequence[str], cls: str = "attack_type", least: float = 1e-6
) -> DataFrame:
    """Smallest class variance per feature; a feature near constant in one class only mirrors the label."""
    m = class_moments(df, features, cls).filter("n >= 2")
    return m.groupBy("feature").agg(F.min("var").alias("min_class_variance")).withColumn(
        "keep", F.col("min_class_variance") >= least
    )


def value_ranks(df: DataFrame, features: Sequence[str], group: str) -> DataFrame:
    """Distinct values per feature with counts of both groups (1 and 0) and the average rank."""
    long = melt(df, [group], features).filter(F.col("value").isNotNull())
    steps = ladder(
        long,
        ["feature"],
        "value",
        {"c1": F.when(F.col(group) == 1, 1).otherwise(0), "c0": F.when(F.col(group) == 0, 1).otherwise(0)},
    )
    t = F.col("c1") + F.col("c0")
    below = F.col("c1_cum") + F.col("c0_cum") - t
    return steps.select(
        "feature",
        "value",
        "c1",
        "c0",
        t.alias("ties"),
        below.alias("below"),
        (below + (t + 1) / 2.0).alias("rank"),
        (F.col("c1_cum_total") + F.col("c0_cum_total")).alias("n"),
    )


def rank_tests(df: DataFrame, features: Sequence[str], group: str = "label") -> DataFrame:
    """Mann-Whitney U (of the normal rows) and Kruskal-Wallis H with their p-values."""
    t = F.col("ties").cast("double")
    sums = (
        value_ranks(df, features, group)
        .groupBy("feature")
        .agg(
            F.sum("c1").cast("double").alias("n1"),
            F.sum("c0").cast("double").alias("n0"),
            F.sum(F.col("c1") * F.col("rank")).alias("r1"),
            F.sum(F.col("c0") * F.col("rank")).alias("r0"),
            F.sum(t * t * t - t).alias("tie"),
        )
    )
    n1, n0 = F.col("n1"), F.col("n0")
    n = n1 + n0
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n0 / 12.0 * ((n + 1) - F.col("tie") / (n * (n - 1))))
    z = (F.greatest(u, n1 * n0 - u) - n1 * n0 / 2.0 - 0.5) / sd
    h = (12.0 / (n * (n + 1)) * (F.col("r1") * F.col("r1") / n1 + F.col("r0") * F.col("r0") / n0) - 3 * (n + 1)) / (
        1.0 - F.col("tie") / (n * n * n - n)
    )
    ok = (n1 > 0) & (n0 > 0) & (F.col("tie") < n * n * n - n)
    return sums.select(
        "feature",
        F.when(n1 * n0 > 0, u).alias("u"),
        F.when(ok, h).alias("h"),
        F.when(ok, z).alias("_z"),
    ).select(
        "feature",
        "u",
        F.coalesce(normal_two_sided("_z"), F.lit(1.0)).alias("u_p"),
        F.coalesce("h", F.lit(0.0)).alias("h"),
        F.coalesce(chi2_tail_one("h"), F.lit(1.0)).alias("h_p"),
    )


def _pairs(features: Sequence[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]


def pearson_pairs(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """|Pearson r| of each feature pair, from one aggregate row."""
    pairs = _pairs(features)
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.abs(F.col(f"r{i}")).alias("r"))
                    for i, (a, b) in enumerate(pairs)
                ]
            )
        )
    )


HOT_SHARE = 1 / 64


def rank_rows(df: DataFrame, features: Sequence[str], id_col: str) -> DataFrame:
    """Replace every feature by its average rank.

    A value that holds more than 1/64 of the rows has its rank broadcast (there
    are fewer than 64 such values per feature); all others are joined by value,
    where no key is heavy.
    """
    long = melt(df, [id_col], features)
    steps = ladder(long, ["feature"], "value", {"c": F.lit(1)})
    ranks = steps.select(
        "feature",
        "value",
        (F.col("c_cum") - F.col("c") + (F.col("c") + 1) / 2.0).alias("rank"),
        (F.col("c") > F.col("c_cum_total") * HOT_SHARE).alias("hot"),
    )
    hot = ranks.filter("hot").select("feature", "value", F.col("rank").alias("hot_rank"))
    marked = long.join(F.broadcast(hot), ["feature", "value"], "left")
    done = marked.filter("hot_rank IS NOT NULL").select(id_col, "feature", F.col("hot_rank").alias("rank"))
    rest = marked.filter("hot_rank IS NULL").join(ranks.filter("NOT hot"), ["feature", "value"])
    every = done.unionByName(rest.select(id_col, "feature", "rank"))
    return every.groupBy(id_col).agg(*[F.max(F.when(F.col("feature") == f, F.col("rank"))).alias(f) for f in features])


def correlation_pairs(df: DataFrame, features: Sequence[str], id_col: str) -> DataFrame:
    """Absolute Pearson and Spearman correlation of each feature pair."""
    p = pearson_pairs(df, features).withColumnRenamed("r", "pearson")
    s = pearson_pairs(rank_rows(df, features, id_col), features).withColumnRenamed("r", "spearman")
    return p.join(s, ["a", "b"])


def collinear_pairs(correlations: DataFrame, limit: float = 0.92) -> DataFrame:
    return correlations.filter((F.col("pearson") > limit) & (F.col("spearman") > limit))


def prune_collinear(pairs: DataFrame, effects: DataFrame, features: Sequence[str]) -> DataFrame:
    """Groups of mutually linked features; the member with the largest g_min stays.

    The nodes are column names, so labels are spread on the driver.
    """
    label = {f: f for f in features}
    links = [(r["a"], r["b"]) for r in pairs.select("a", "b").collect()]
    for _ in features:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    g = {r["feature"]: r["g_min"] or 0.0 for r in effects.select("feature", "g_min").collect()}
    best = {c: max((f for f in features if label[f] == c), key=lambda f: (g.get(f, 0.0), f)) for c in set(label.values())}
    rows = [F.struct(F.lit(f).alias("feature"), F.lit(label[f]).alias("component"), F.lit(best[label[f]] == f).alias("keep")) for f in features]
    return effects.sparkSession.range(1).select(F.inline(F.array(*rows)))


def anova_f(df: DataFrame, features: Sequence[str], cls: str = "label") -> DataFrame:
    """One-way F statistic from class counts, means and variances."""
    m = class_moments(df, features, cls).filter("n > 0")
    grand = F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    between = F.sum(F.col("n") * F.col("mean") * F.col("mean")) - F.sum("n") * grand * grand
    within = F.sum(F.col("n") * F.col("var_pop"))
    k = F.count(F.lit(1))
    return m.groupBy("feature").agg((between / (k - 1) / (within / (F.sum("n") - k))).alias("f_score"))


def binned_information(df: DataFrame, features: Sequence[str], cls: str = "label", bins: int = 10) -> DataFrame:
    """Mutual information of the label with the rank bin of each feature, in nats."""
    ranks = value_ranks(df, features, cls).withColumn("bin", F.floor(F.col("below") * bins / F.col("n")))
    cells = ranks.groupBy("feature", "bin").agg(
        F.sum("c1").cast("double").alias("c1"), F.sum("c0").cast("double").alias("c0")
    )
    totals = cells.groupBy("feature").agg(F.sum("c1").alias("t1"), F.sum("c0").alias("t0"))
    n = F.col("t1") + F.col("t0")
    row = F.col("c1") + F.col("c0")

    def part(c: str, t: str) -> Column:
        return F.when(F.col(c) > 0, F.col(c) / n * F.ln(F.col(c) * n / (row * F.col(t)))).otherwise(0.0)

    joined = cells.join(totals, "feature")
    return joined.groupBy("feature").agg(F.sum(part("c1", "t1") + part("c0", "t0")).alias("mi"))


def combined_rank(effects: DataFrame, f_scores: DataFrame, information: DataFrame) -> DataFrame:
    """Mean of g, F and MI, each over its largest value. One row per feature."""
    t = effects.select("feature", "g_min").join(f_scores, "feature").join(information, "feature")
    top = t.agg(F.max("g_min").alias("g"), F.max("f_score").alias("f"), F.max("mi").alias("m")).first()

    def part(c: str, most: float | None) -> Column:
        return F.coalesce(F.col(c), F.lit(0.0)) / (most or 1.0)

    return t.withColumn("score", (part("g_min", top["g"]) + part("f_score", top["f"]) + part("mi", top["m"])) / 3.0)


def final_pick(ranked: DataFrame, stability: DataFrame, k: int = 8, least: float = 0.60) -> DataFrame:
    """The best ``k`` stable features by score, topped up with the best of the others."""
    joined = ranked.join(stability, "feature", "left").withColumn(
        "stable", F.coalesce(F.col("frequency") >= least, F.lit(False))
    )
    return joined.orderBy(F.col("stable").desc(), F.col("score").desc(), "feature").limit(k)


def max_correlation(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return pearson_pairs(df, features).agg(F.max("r").alias("max_pearson"))


def class_audit(df: DataFrame, features: Sequence[str], cls: str = "attack_type") -> DataFrame:
    """Mean and population deviation per class and feature."""
    m = class_moments(df, features, cls)
    return m.select(cls, "feature", "n", "mean", F.sqrt("var_pop").alias("std"))


def share_interval(counts: DataFrame, k: str, n: str) -> DataFrame:
    """Exact 95 % interval of k / n on aggregated rows: adds ``ci_lo`` and ``ci_hi``."""
    return (
        counts.withColumn("_ci", exact_interval_udf(F.col(k), F.col(n)))
        .withColumn("ci_lo", F.col("_ci.lo"))
        .withColumn("ci_hi", F.col("_ci.hi"))
        .drop("_ci")
    )


def zero_event_bound(n: Column, alpha: float = 0.05) -> Column:
    """Upper bound of a rate after no event in n trials."""
    return F.when(n > 0, 1.0 - F.pow(F.lit(alpha / 2), 1.0 / n)).otherwise(1.0)


def mcnemar(df: DataFrame, keys: Sequence[str], first: Column, second: Column) -> DataFrame:
    """Discordance of two detectors given as booleans.

    ``b``: only the first is right, ``c``: only the second. Continuity-corrected
    statistic, p-value, and the power for the seen discordance.
    """
    counts = df.groupBy(*keys).agg(
        F.count_if(first & ~second).alias("b"), F.count_if(~first & second).alias("c")
    )
    b, c = F.col("b"), F.col("c")
    chi2 = F.when(b + c > 0, F.pow(F.abs(b - c) - 1.0, F.lit(2.0)) / (b + c)).otherwise(0.0)
    out = counts.withColumn("chi2", chi2)
    return out.withColumn("p_value", F.when(b + c > 0, chi2_tail_one("chi2")).otherwise(1.0)).withColumn(
        "power", discordance_power_udf("b", "c")
    )


def auc_interval(aucs: DataFrame, n_attack: str, n_normal: str, z: float = 1.96) -> DataFrame:
    """Normal-theory interval of an AUC, clipped to [0, 1]."""
    a, m, n = F.col("auc"), F.col(n_attack), F.col(n_normal)
    q1, q2 = a / (2 - a), 2 * a * a / (1 + a)
    se = F.sqrt((a * (1 - a) + (m - 1) * (q1 - a * a) + (n - 1) * (q2 - a * a)) / (m * n))
    return aucs.withColumn("ci_lo", F.greatest(F.lit(0.0), a - z * se)).withColumn(
        "ci_hi", F.least(F.lit(1.0), a + z * se)
    )


def summarise_repeats(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Mean, sample deviation and t-based 95 % interval over repeats."""
    s = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std")
    )
    half = t_upper_975(F.col("n") - 1) * F.col("std") / F.sqrt("n")
    return s.withColumn("_h", half).withColumn("ci95_lo", F.col("mean") - F.col("_h")).withColumn(
        "ci95_hi", F.col("mean") + F.col("_h")
    ).drop("_h")
