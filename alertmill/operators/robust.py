"""Noise and jitter sweeps: perturb, score again, compare.

``score`` is any function that adds P(normal) as column ``p``. Noise is a
function of row, feature and setting, so a task that runs again perturbs alike.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertmill.operators import metrics
from alertmill.operators.stats import summarise_repeats
from alertmill.session import settle

Scorer = Callable[[DataFrame], DataFrame]

# Noise and jitter levels in use.
NOISE_LEVELS = [0.01, 0.05, 0.10, 0.15, 0.20, 0.30]
JITTER_LEVELS = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0, 1.5, 2.0]


def gaussian(*parts: Column) -> Column:
    """Standard normal draw from a hash of its arguments."""

    def uniform(tag: int) -> Column:
        return (F.pmod(F.xxhash64(*parts, F.lit(tag)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)

    return F.sqrt(-2.0 * F.ln(uniform(1))) * F.cos(2.0 * math.pi * uniform(2))


def with_noise(df: DataFrame, features: Sequence[str], id_col: str, sigma: Column, seed: Column) -> DataFrame:
    """x * (1 + N(0, sigma)) on every feature."""
    return df.withColumns(
        {f: F.col(f) * (1.0 + sigma * gaussian(F.col(id_col), F.lit(f), seed)) for f in features}
    )


def _levels(values: Sequence[float], repeats: int = 1, seed: int = 42) -> Column:
    return F.array(
        *[
            F.struct(F.lit(float(v)).alias("level"), F.lit(r).alias("repeat"), F.lit(seed + (i if repeats == 1 else r)).alias("seed"))
            for i, v in enumerate(values)
            for r in range(repeats)
        ]
    )


def noise_sweep(
    df: DataFrame,
    features: Sequence[str],
    id_col: str,
    score: Scorer,
    levels: Sequence[float] = tuple(NOISE_LEVELS),
    threshold: float = 0.5,
    robust_auc: float = 0.85,
    everyone: bool = False,
    seed: int = 42,
) -> DataFrame:
    """Metrics per noise level; attacks only are perturbed unless ``everyone``."""
    rows = df.select("*", F.inline(_levels(levels, 1, seed)))
    hit = F.col("level") if everyone else F.when(F.col("y") == 0, F.col("level")).otherwise(0.0)
    noisy = score(with_noise(rows, features, id_col, hit, F.col("seed")))
    r = metrics.report(settle(noisy.select("level", "y", "p"), "noisy"), ["level"], threshold)
    return r.select("level", "auc", "tpr", "fpr", (F.col("auc") > robust_auc).alias("robust"))


def sequence_noise_sweep(
    sequences: DataFrame,
    id_col: str,
    score: Scorer,
    width: int,
    length: int = 10,
    levels: Sequence[float] = (0.0, 0.05, 0.10),
    seed: int = 42,
) -> DataFrame:
    """Noise on every element of every sequence of ``length`` vectors of ``width``."""
    rows = sequences.select("*", F.inline(_levels(levels, 1, seed)))

    def element(i: int, j: int) -> Column:
        draw = gaussian(F.col(id_col), F.lit(i), F.lit(j), F.col("seed"))
        return F.col("sequence")[i][j] * (1.0 + F.col("level") * draw)

    noisy = F.array(*[F.array(*[element(i, j) for j in range(width)]) for i in range(length)])
    scored = score(rows.withColumn("sequence", noisy)).select("level", "y", "p")
    r = metrics.report(settle(scored, "noisy"), ["level"])
    return r.select("level", "auc", "recall_normal", "tpr", (F.col("auc") > 0.85).alias("robust"))


def repeated_noise(
    df: DataFrame,
    features: Sequence[str],
    id_col: str,
    score: Scorer,
    levels: Sequence[float] = tuple(NOISE_LEVELS),
    repeats: int = 5,
    seed: int = 42,
) -> DataFrame:
    """Mean and deviation of the AUC over seeds per level, with the change against clean rows."""
    rows = df.select("*", F.inline(_levels([0.0, *levels], repeats, seed)))
    hit = F.when(F.col("y") == 0, F.col("level")).otherwise(0.0)
    noisy = score(with_noise(rows, features, id_col, hit, F.col("seed")))
    per = metrics.auc(noisy, ["level", "repeat"])
    out = per.groupBy("level").agg(F.avg("auc").alias("auc_mean"), F.stddev_pop("auc").alias("auc_std"))
    out = settle(out, "noise_levels")
    clean = out.filter("level = 0").first()["auc_mean"]
    return out.filter("level > 0").withColumn("delta", F.col("auc_mean") - clean)


INTERVAL, VARIANCE = "inter_alert_interval_mean", "inter_interval_variance"


def jitter_rows(
    attacks: DataFrame,
    normals: DataFrame,
    id_col: str,
    levels: Sequence[float] = tuple(JITTER_LEVELS),
    repeats: int = 10,
    seed: int = 42,
) -> tuple[DataFrame, dict[str, float]]:
    """Attack rows under timing jitter: the mean gap is shifted, its variance grows."""
    m = normals.agg(
        F.avg(INTERVAL).alias("mi"), F.stddev_pop(INTERVAL).alias("si"), F.avg(VARIANCE).alias("mv"), F.stddev_pop(VARIANCE).alias("sv")
    ).first()
    base = {k: m[k] or 0.0 for k in ("mi", "si", "mv", "sv")}
    rows = attacks.select("*", F.inline(_levels(levels, repeats, seed)))
    width = F.col("level") * base["si"]
    shift = F.greatest(F.lit(0.0), F.col(INTERVAL) + width * gaussian(F.col(id_col), F.lit("gap"), F.col("seed")))
    return (
        rows.withColumn(INTERVAL, F.when(F.col("level") > 0, shift).otherwise(F.col(INTERVAL))).withColumn(
            VARIANCE, F.col(VARIANCE) + width * width
        ),
        base,
    )


def jitter_sweep(
    attacks: DataFrame,
    normals: DataFrame,
    id_col: str,
    score: Scorer,
    levels: Sequence[float] = tuple(JITTER_LEVELS),
    repeats: int = 10,
    threshold: float = 0.5,
    seed: int = 42,
) -> DataFrame:
    """Detection rate under growing timing jitter, with the shift in normal deviations."""
    rows, base = jitter_rows(attacks, normals, id_col, levels, repeats, seed)
    kept = rows.withColumn("_gap", F.col(INTERVAL)).withColumn("_var", F.col(VARIANCE))
    per = score(kept).groupBy("level", "repeat").agg(
        F.avg(F.when(F.col("p") < threshold, 1.0).otherwise(0.0)).alias("tpr"),
        (F.abs(F.avg("_gap") - base["mi"]) / (base["si"] + 1e-12)).alias("gap_shift"),
        (F.abs(F.avg("_var") - base["mv"]) / (base["sv"] + 1e-12)).alias("variance_shift"),
    )
    return per.groupBy("level").agg(
        F.avg("tpr").alias("tpr_mean"),
        F.stddev_pop("tpr").alias("tpr_std"),
        F.avg("gap_shift").alias("gap_shift"),
        F.avg("variance_shift").alias("variance_shift"),
        F.max(F.greatest(F.lit(0.0), 1.0 - 0.4 * F.col("level"))).alias("effectiveness"),
    )


def seed_sweep(fit_and_score: Callable[[int], DataFrame], seeds: Sequence[int], threshold: float = 0.5) -> DataFrame:
    """Fit once per seed, evaluate, and summarise each metric over the seeds.

    ``fit_and_score(seed)`` returns rows with y and p.
    """
    parts = [fit_and_score(s).select(F.lit(s).alias("seed"), "y", "p") for s in seeds]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    r = metrics.report(every, ["seed"], threshold).select("seed", "auc", "tpr", "fpr", "f1")
    long = r.unpivot(["seed"], ["auc", "tpr", "fpr", "f1"], "metric", "value")
    return summarise_repeats(long, ["metric"])
