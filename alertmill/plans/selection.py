"""Choice of the columns that a detector is fitted on, from the labelled table to the list of names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertmill.operators import resample, splits, stats
from alertmill.session import settle

#: What becomes of a column, in the order of the steps; only ``ranked`` ones are up for the final pick.
STAGES = ("variance", "within_class", "collinear", "ranked")


def _names(kept: DataFrame) -> list[str]:
    """Names of columns, so never more than the table is wide."""
    return [r["feature"] for r in kept.select("feature").collect()]


def candidates(
    table: DataFrame,
    features: Sequence[str],
    id_col: str,
    cls: str = "attack_type",
    least_variance: float = 1e-4,
    least_within: float = 1e-6,
    collinear: float = 0.92,
    share: float = 0.6,
    seed: int = 42,
) -> DataFrame:
    """One row per feature: its stage, and of those that stay their effect, F, information and combined score.

    ``table`` holds label (1 normal), family (normal, flooding, slow_poisoning)
    and ``cls``. A column leaves as near constant, as constant within a class
    (it mirrors the label), or as collinear with one of larger effect; the
    correlations are those of normal rows. F and information are taken from a
    seeded share of both labels. A feature without a value in two classes has
    no variance within and stays. No feature left: no row is ranked.
    """
    slim = settle(table.select(*dict.fromkeys([id_col, "label", "family", cls, *features])), "selection")
    spread = stats.variance_filter(slim, features).select("feature", F.col("keep").alias("varies"))
    within = stats.within_class_filter(slim, features, cls).select("feature", F.col("keep").alias("within"))
    passed = spread.join(within, "feature", "left").withColumn("within", F.coalesce("within", F.lit(True)))
    passed = settle(passed.withColumn("varies", F.coalesce("varies", F.lit(False))), "passed")
    left = [f for f in features if f in set(_names(passed.filter("varies AND within")))]
    nothing = F.lit(None).cast("double")
    if not left:
        kept = passed.sparkSession.createDataFrame([], "feature string, keep boolean, g_min double, f_score double, mi double, score double")
    else:
        effects = settle(stats.effect_sizes(slim, left), "effects")
        kept = effects.select("feature", F.lit(True).alias("keep"))
        if len(left) > 1:
            linked = stats.collinear_pairs(stats.correlation_pairs(slim.filter("label = 1"), left, id_col), collinear)
            kept = stats.prune_collinear(linked, effects, left).select("feature", "keep")
        kept = settle(kept, "kept")
        free = [f for f in left if f in set(_names(kept.filter("keep")))]
        sample = settle(splits.stratified_sample(slim, ["label"], id_col, share, seed), "calibration")
        scores = stats.combined_rank(
            effects.filter(F.col("feature").isin(free)), stats.anova_f(sample, free), stats.binned_information(sample, free)
        )
        kept = kept.join(scores.select("feature", "g_min", "f_score", "mi", "score"), "feature", "left")
    stage = (
        F.when(~F.col("varies"), STAGES[0])
        .when(~F.col("within"), STAGES[1])
        .when(~F.coalesce("keep", F.lit(False)), STAGES[2])
        .otherwise(STAGES[3])
    )
    numbers = [F.coalesce(F.col(c), nothing).alias(c) for c in ("g_min", "f_score", "mi", "score")]
    return passed.join(kept, "feature", "left").select("feature", stage.alias("stage"), *numbers)


def select_features(
    table: DataFrame,
    features: Sequence[str],
    id_col: str,
    k: int = 8,
    replicates: int = 200,
    least_frequency: float = 0.60,
    seed: int = 42,
    **steps,
) -> DataFrame:
    """``candidates`` with how often a ranked column is among the ``k`` largest effects of a resample, and ``place``.

    ``place`` counts the chosen columns from 1, stable ones first and by score,
    topped up with the best of the others; it is null for all that are left out.
    ``max_pearson`` is the largest correlation of two chosen ones on normal rows.
    """
    found = settle(candidates(table, features, id_col, seed=seed, **steps), "candidates")
    ranked = found.filter("stage = 'ranked'")
    free = [f for f in features if f in set(_names(ranked))]
    if not free:
        return found.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("frequency", "double"), ("place", "int"), ("max_pearson", "double"))])
    stability = resample.selection_stability(table, free, id_col, replicates, k, seed)
    picked = stats.final_pick(ranked.select("feature", "score"), stability, k, least_frequency).collect()
    places = F.create_map(*[F.lit(x) for i, r in enumerate(picked, 1) for x in (r["feature"], i)])
    chosen = [r["feature"] for r in picked]
    closest = None
    if len(chosen) > 1:
        closest = stats.max_correlation(table.filter("label = 1"), chosen).first()["max_pearson"]
    out = found.join(stability, "feature", "left").withColumn("place", places[F.col("feature")])
    return out.withColumn("max_pearson", F.when(F.col("place").isNotNull(), F.lit(closest).cast("double")))


def chosen_features(selection: DataFrame) -> list[str]:
    """The chosen names in their order, as ``fit_detection`` takes them."""
    rows = selection.filter("place IS NOT NULL").orderBy("place").select("feature").collect()
    return [r["feature"] for r in rows]
