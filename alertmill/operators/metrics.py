"""Detection metrics. Scores are P(normal); y = 1 normal, 0 attack; p < threshold flags.

All functions work per group of ``keys`` (at least one column; use a constant
for a single group) and reduce the rows to distinct scores or bins first.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertmill.functions.scalars import attack_scope
from alertmill.operators.ordered import ladder



def _is(value: int, y: str) -> Column:
    return F.when(F.col(y) == value, 1).otherwise(0)


def score_steps(df: DataFrame, keys: Sequence[str], p: str = "p", y: str = "y") -> DataFrame:
    """Distinct scores per group, ascending, with running normal (pos) and attack (neg) counts."""
    return ladder(df, keys, p, {"pos": _is(1, y), "neg": _is(0, y)})


def ratio(num: Column, den: Column, empty: float | None = 0.0) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(empty))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def auc_of(steps: DataFrame, keys: Sequence[str], one_class: float | None = None) -> DataFrame:
    """Area under the ROC from score steps, ties counted half."""
    wins = F.sum(F.col("pos") * (F.col("neg_cum") - F.col("neg") / 2))
    pairs = (F.max("pos_cum_total") * F.max("neg_cum_total")).cast("double")
    return steps.groupBy(*keys).agg(ratio(wins, pairs, one_class).alias("auc"))


def auc(df: DataFrame, keys: Sequence[str], p: str = "p", y: str = "y", one_class: float | None = None) -> DataFrame:
    return auc_of(score_steps(df, keys, p, y), keys, one_class)


def average_precision_of(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Step-wise average precision of the attack class, flagged from low scores up."""
    precision = F.col("neg_cum") / (F.col("neg_cum") + F.col("pos_cum"))
    ap = F.sum(F.col("neg") / F.col("neg_cum_total") * precision)
    return steps.groupBy(*keys).agg(
        F.when((F.max("neg_cum_total") > 0) & (F.max("pos_cum_total") > 0), ap).alias("average_precision")
    )


def average_precision(df: DataFrame, keys: Sequence[str], p: str = "p", y: str = "y") -> DataFrame:
    return average_precision_of(score_steps(df, keys, p, y), keys)


def confusion_aggs(thr: Column | float, p: str = "p", y: str = "y") -> list[Column]:
    flagged = F.col(p) < thr
    return [
        F.count_if(flagged & (F.col(y) == 0)).alias("n_attack_detected"),
        F.count_if(~flagged & (F.col(y) == 0)).alias("n_attack_missed"),
        F.count_if(flagged & (F.col(y) == 1)).alias("n_normal_flagged"),
        F.count_if(~flagged & (F.col(y) == 1)).alias("n_normal_accepted"),
    ]


def with_rates(counts: DataFrame, null_if_one_class: bool = True) -> DataFrame:
    """tpr, fpr, miss and f1 from the four counts."""
    tp, fn = F.col("n_attack_detected"), F.col("n_attack_missed")
    fp, tn = F.col("n_normal_flagged"), F.col("n_normal_accepted")
    both = ((tp + fn) > 0) & ((fp + tn) > 0) if null_if_one_class else F.lit(True)
    rates = {
        "tpr": ratio(tp, tp + fn),
        "fpr": ratio(fp, fp + tn),
        "recall_normal": ratio(tn, fp + tn),
        "miss_attack": ratio(fn, tp + fn),
        "f1": f1(tp, fp, fn),
    }
    return counts.withColumns({n: F.when(both, e) for n, e in rates.items()})


def confusion(
    df: DataFrame,
    keys: Sequence[str],
    thr: Column | float = 0.5,
    p: str = "p",
    y: str = "y",
    null_if_one_class: bool = True,
) -> DataFrame:
    return with_rates(df.groupBy(*keys).agg(*confusion_aggs(thr, p, y)), null_if_one_class)


def report(df: DataFrame, keys: Sequence[str], thr: float = 0.5, p: str = "p", y: str = "y") -> DataFrame:
    """Confusion, rates, AUC and average precision in one row per group."""
    steps = score_steps(df, keys, p, y)
    return (
        confusion(df, keys, thr, p, y)
        .join(auc_of(steps, keys), list(keys))
        .join(average_precision_of(steps, keys), list(keys))
    )


def edge_bin(p: Column, edges: Sequence[float]) -> Column:
    """Number of edges at or below p, less one."""
    return sum((F.when(p >= e, 1).otherwise(0) for e in edges), F.lit(0)) - 1


def reliability_bins(df: DataFrame, keys: Sequence[str], p: str = "p", y: str = "y", bins: int = 10) -> DataFrame:
    """Rows, mean score and share of normals per equal bin; p = 1 lies in no bin."""
    edges = [i * (1.0 / bins) for i in range(bins)]
    inside = df.filter((F.col(p) >= 0) & (F.col(p) < 1.0)).withColumn("bin", edge_bin(F.col(p), edges))
    return inside.groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("confidence"), F.avg(F.col(y).cast("double")).alias("accuracy")
    )


def ece(df: DataFrame, keys: Sequence[str], p: str = "p", y: str = "y", bins: int = 10) -> DataFrame:
    """Expected calibration error over all rows, those outside every bin included in n."""
    gaps = reliability_bins(df, keys, p, y, bins).groupBy(*keys).agg(
        F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))).alias("_gap")
    )
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.join(gaps, list(keys), "left").select(
        *keys, (F.coalesce("_gap", F.lit(0.0)) / F.col("_n")).alias("ece")
    )


def histogram(
    df: DataFrame, keys: Sequence[str], p: str = "p", y: str = "y", bins: int = 50, span: tuple | None = None
) -> DataFrame:
    """Counts of normal and attack scores per equal bin over the pooled range."""
    if span:
        rows = df.withColumn("_lo", F.lit(float(span[0]))).withColumn("_hi", F.lit(float(span[1])))
        rows = rows.filter((F.col(p) >= F.col("_lo")) & (F.col(p) <= F.col("_hi")))
    else:
        ends = df.groupBy(*keys).agg(F.min(p).alias("_lo"), F.max(p).alias("_hi"))
        rows = df.join(ends, list(keys))
    width = F.col("_hi") - F.col("_lo")
    at = F.when(width > 0, F.floor((F.col(p) - F.col("_lo")) / width * bins)).otherwise(F.lit(bins // 2))
    return (
        rows.withColumn("bin", F.least(F.lit(bins - 1), at).cast("int"))
        .groupBy(*keys, "bin")
        .agg(F.sum(_is(1, y)).alias("n_normal"), F.sum(_is(0, y)).alias("n_attack"))
    )


def bhattacharyya(
    df: DataFrame, keys: Sequence[str], p: str = "p", y: str = "y", bins: int = 50, span: tuple | None = None
) -> DataFrame:
    """Overlap of the two score distributions: 1 same, 0 disjoint."""
    h = histogram(df, keys, p, y, bins, span)
    shares = F.sum(F.sqrt(F.col("n_normal").cast("double") * F.col("n_attack")))
    return h.groupBy(*keys).agg(
        (shares / F.sqrt(F.sum("n_normal").cast("double") * F.sum("n_attack"))).alias("bhattacharyya")
    )


def roc_points(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """ROC with normal as positive: rows with p >= threshold are accepted."""
    p = [c for c in steps.columns if c not in keys and not c.startswith(("pos", "neg"))][0]
    accepted_pos = F.col("pos_cum_total") - F.col("pos_cum") + F.col("pos")
    accepted_neg = F.col("neg_cum_total") - F.col("neg_cum") + F.col("neg")
    return steps.select(
        *keys,
        F.col(p).alias("threshold"),
        ratio(accepted_pos, F.col("pos_cum_total")).alias("tpr"),
        ratio(accepted_neg, F.col("neg_cum_total")).alias("fpr"),
    )


def precision_recall_points(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Precision and recall of the attack class when all scores up to ``threshold`` are flagged."""
    p = [c for c in steps.columns if c not in keys and not c.startswith(("pos", "neg"))][0]
    return steps.select(
        *keys,
        F.col(p).alias("threshold"),
        (F.col("neg_cum") / (F.col("neg_cum") + F.col("pos_cum"))).alias("precision"),
        ratio(F.col("neg_cum"), F.col("neg_cum_total")).alias("recall"),
    )


def youden(df: DataFrame, keys: Sequence[str], p: str = "p", y: str = "y") -> DataFrame:
    """Threshold with the largest tpr - fpr; the highest one on ties."""
    points = roc_points(score_steps(df, keys, p, y), keys)
    j = F.col("tpr") - F.col("fpr")
    best = F.max(F.struct(F.round(j, 12).alias("j"), F.col("threshold").alias("t")))
    return points.groupBy(*keys).agg(best.alias("_b")).select(
        *keys, F.col("_b.t").alias("threshold"), F.col("_b.j").alias("youden_j")
    )


def normal_recall_at(df: DataFrame, keys: Sequence[str], limit: float = 0.15, p: str = "p", y: str = "y") -> DataFrame:
    """Largest share of normals accepted while at most ``limit`` of the attacks pass."""
    points = roc_points(score_steps(df, keys, p, y), keys)
    return points.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col("fpr") <= limit, F.col("tpr"))), F.lit(0.0)).alias("best_tpr")
    )


def grid(start: float, stop: float, step: float) -> list[float]:
    """Evenly spaced thresholds, stop excluded."""
    return [float(t) for t in np.arange(start, stop, step)]


def _count_at_or_below(p: Column, ts: Sequence[float]) -> Column:
    """How many of the sorted ``ts`` are at or below p.

    On an even grid the place is computed and then set right by comparing with
    the two nearest thresholds, so rounding cannot move a row.
    """
    step = (ts[-1] - ts[0]) / (len(ts) - 1) if len(ts) > 1 else 0.0
    if step <= 0 or max(abs(ts[0] + i * step - t) for i, t in enumerate(ts)) > step / 4:
        return sum((F.when(p >= t, 1).otherwise(0) for t in ts), F.lit(0))
    # Open ends on both sides: table[i + 2] is threshold i.
    table = F.array(*[F.lit(t) for t in (-math.inf, *ts, math.inf)])
    at = F.greatest(F.lit(-1), F.least(F.lit(len(ts) - 1), F.floor((p - ts[0]) / step))).cast("int")
    return (
        F.when(F.element_at(table, at + 3) <= p, at + 2).when(F.element_at(table, at + 2) > p, at).otherwise(at + 1)
    )


def threshold_table(
    df: DataFrame, keys: Sequence[str], thresholds: Sequence[float], p: str = "p", y: str = "y"
) -> DataFrame:
    """Counts and rates at each threshold of a fixed grid.

    A row is flagged from the first threshold above its score on, so rows are
    counted once by that place and the few counts are then summed upwards;
    rows are never multiplied by the grid.
    """
    ts = sorted(thresholds)
    place = _count_at_or_below(F.col(p), ts)
    cells = df.groupBy(*keys, place.alias("_g")).agg(F.sum(_is(0, y)).alias("_a"), F.sum(_is(1, y)).alias("_m"))
    totals = cells.groupBy(*keys).agg(F.sum("_a").alias("n_attack"), F.sum("_m").alias("n_normal"))
    zero = totals.select(*keys, F.lit(0).alias("_g"), F.lit(0).alias("_a"), F.lit(0).alias("_m"))
    sums = (
        cells.filter(F.col("_g") < len(ts))
        .unionByName(zero)
        .withColumn("_i", F.explode(F.sequence(F.col("_g"), F.lit(len(ts) - 1))))
        .groupBy(*keys, "_i")
        .agg(F.sum("_a").alias("detected"), F.sum("_m").alias("false_alarms"))
        .join(totals, list(keys))
    )
    det, fa = F.col("detected"), F.col("false_alarms")
    return sums.select(
        *keys,
        F.element_at(F.array(*[F.lit(t) for t in ts]), F.col("_i") + 1).alias("threshold"),
        "detected",
        "false_alarms",
        "n_attack",
        "n_normal",
        ratio(det, F.col("n_attack")).alias("tpr"),
        ratio(fa, F.col("n_normal")).alias("fpr"),
        f1(det, fa, F.col("n_attack") - det).alias("f1"),
    )


def best_f1_threshold(table: DataFrame, keys: Sequence[str], fallback: float = 0.55) -> DataFrame:
    """Largest F1, the lowest threshold on ties; the fallback if F1 is nowhere above 0."""
    best = F.max(F.struct(F.col("f1"), -F.col("threshold"))).alias("_b")
    top = table.groupBy(*keys).agg(best)
    hit = F.col("_b.f1") > 0
    return top.select(
        *keys,
        F.when(hit, -F.col("_b.col2")).otherwise(fallback).alias("threshold"),
        F.when(hit, F.col("_b.f1")).otherwise(0.0).alias("f1"),
    )


def recall_at_fpr(table: DataFrame, keys: Sequence[str], target: float = 0.15, fallback: float = 0.55) -> DataFrame:
    """Largest attack recall with fpr within target, the highest threshold on ties."""
    good = F.when(
        (F.col("fpr") <= target) & (F.col("tpr") > 0),
        F.struct(F.col("tpr"), F.col("threshold"), F.col("fpr"), F.col("f1")),
    )
    top = table.groupBy(*keys).agg(F.max(good).alias("_b"))
    return top.select(
        *keys,
        F.coalesce(F.col("_b.threshold"), F.lit(fallback)).alias("threshold"),
        *[F.coalesce(F.col(f"_b.{c}"), F.lit(0.0)).alias(c) for c in ("tpr", "fpr", "f1")],
    )


# The threshold grids in use.
F1_GRID = grid(0.25, 0.85, 0.01)
FPR_GRID = grid(0.85, 0.10, -0.01)
FPR_GRID_WIDE = grid(0.95, 0.05, -0.01)
FPR_GRID_FULL = grid(0.99, 0.01, -0.01)


def detection_by_type(
    df: DataFrame, keys: Sequence[str], thr: float = 0.5, p: str = "p", y: str = "y", atype: str = "attack_type"
) -> DataFrame:
    """Detection rate per attack type, with its scope."""
    attacks = df.filter(F.col(y) == 0)
    return attacks.groupBy(*keys, atype).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col(p) < thr, 1.0).otherwise(0.0)).alias("detect")
    ).withColumn("scope", attack_scope(atype))


def behavioural_rows(df: DataFrame, y: str = "y", atype: str = "attack_type") -> DataFrame:
    """Normals and behavioural attacks."""
    return df.filter((F.col(y) == 1) | (attack_scope(atype) == "behavioral"))


def behavioural_report(df: DataFrame, keys: Sequence[str], thr: float = 0.5, p: str = "p", y: str = "y") -> DataFrame:
    """``report`` on behavioural rows; groups with under five rows or no attack are left out."""
    rows = behavioural_rows(df, y)
    fit = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum(_is(0, y)).alias("_a"))
    return report(rows, keys, thr, p, y).join(fit.filter("_n >= 5 AND _a > 0").select(*keys), list(keys), "left_semi")


def verdict(auc_col: Column, fpr_col: Column) -> Column:
    """Ladder of AUC and false-alarm cut-offs."""
    return (
        F.when((auc_col >= 0.85) & (fpr_col <= 0.15), "GOOD")
        .when((auc_col >= 0.78) & (fpr_col <= 0.15), "PUBLISHABLE")
        .when(auc_col >= 0.78, "MODERATE")
        .otherwise("POOR")
    )


def verdict_counts(results: DataFrame) -> DataFrame:
    """Datasets in total and those good on behavioural and on all attacks."""
    low = F.col("fpr_at_15fpr") <= 0.15
    return results.agg(
        F.count(F.lit(1)).alias("n_datasets"),
        F.count_if((F.coalesce("auc_behavioral", F.lit(0.0)) >= 0.85) & low).alias("n_good_behavioral"),
        F.count_if((F.col("auc_all") >= 0.85) & low).alias("n_good_all"),
    )


def compare_models(results: DataFrame, reference: str, key: str = "dataset", tie: float = 0.02) -> DataFrame:
    """Difference to the reference model, and which models are best or within ``tie`` of it."""
    ref = results.filter(F.col("model") == reference).select(key, F.col("auc").alias("_ref"))
    top = results.groupBy(key).agg(F.max("auc").alias("_top"))
    return (
        results.join(ref, key, "left")
        .join(top, key)
        .withColumn("delta_auc", F.round(F.coalesce("_ref", F.lit(0.0)) - F.col("auc"), 4))
        .withColumn(
            "standing",
            F.when(F.col("auc") == F.col("_top"), "best").when(F.col("_top") - F.col("auc") <= tie, "tie").otherwise(
                "behind"
            ),
        )
        .drop("_ref", "_top")
    )
