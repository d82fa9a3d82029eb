"""Shapley attribution, exact or by sampled orders, and comparison of two models.

The coalitions of a row are built and scored inside the task that holds the
row; only one value per feature leaves it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BatchScore = Callable[[np.ndarray], np.ndarray]
#: All coalitions of more features than this are not enumerated; give ``samples``.
EXACT_FEATURES = 12


def background(normals: DataFrame, vector: str, k: int = 20, seed: int = 42) -> np.ndarray:
    """At most ``k`` cluster centres that stand for the normal rows."""
    data = normals.select(array_to_vector(vector).alias("features"))
    return np.array(KMeans(k=k, seed=seed, maxIter=20).fit(data).clusterCenters())


def coalition_weights(d: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks of all coalitions, and per feature the weight of each coalition's value."""
    masks = ((np.arange(2**d)[:, None] >> np.arange(d)) & 1).astype(bool)
    size = masks.sum(axis=1)
    fact = [math.factorial(i) for i in range(d + 1)]
    joined = np.array([fact[max(s - 1, 0)] * fact[d - s] / fact[d] for s in size])
    absent = np.array([fact[s] * fact[max(d - s - 1, 0)] / fact[d] for s in size])
    return masks, np.where(masks, joined[:, None], -absent[:, None])


def shapley(x: np.ndarray, score: BatchScore, base: np.ndarray, groups: list[np.ndarray]) -> np.ndarray:
    """Values of each group of columns for one row, absent columns taken from ``base`` rows."""
    masks, weights = coalition_weights(len(groups))
    keep = np.zeros((len(masks), len(x)), dtype=bool)
    for g, cols in enumerate(groups):
        keep[:, cols] = masks[:, [g]]
    mixed = np.where(keep[:, None, :], x[None, None, :], base[None, :, :])
    value = score(mixed.reshape(-1, len(x))).reshape(len(masks), len(base)).mean(axis=1)
    return value @ weights


def sampled_shapley(
    x: np.ndarray, score: BatchScore, base: np.ndarray, groups: list[np.ndarray], samples: int, seed: int = 42
) -> np.ndarray:
    """Mean gain of each group over ``samples`` random orders and their reverses; the gains of an order sum exactly."""
    rng, d = np.random.default_rng(seed), len(groups)
    orders = [rng.permutation(d) for _ in range(-(-samples // 2))]
    orders = [o for p in orders for o in (p, p[::-1])]
    keep = np.zeros((len(orders), d + 1, len(x)), dtype=bool)
    for o, order in enumerate(orders):
        for step, g in enumerate(order):
            keep[o, step + 1 :, groups[g]] = True
    flat = keep.reshape(-1, len(x))
    mixed = np.where(flat[:, None, :], x[None, None, :], base[None, :, :])
    value = score(mixed.reshape(-1, len(x))).reshape(len(orders), d + 1, len(base)).mean(axis=2)
    total = np.zeros(d)
    for o, order in enumerate(orders):
        total[order] += np.diff(value[o])
    return total / len(orders)


def attribute(
    rows: DataFrame,
    id_col: str,
    vector: str,
    names: Sequence[str],
    score: BatchScore,
    base: np.ndarray,
    steps: int = 1,
    samples: int | None = None,
) -> DataFrame:
    """(id, feature, contribution) for each row.

    With ``steps`` the vector is a flattened sequence and one feature owns its
    place in every step. ``samples`` is the number of random orders; without it
    all coalitions are taken, which only few features allow.
    """
    d = len(names)
    if samples is None and d > EXACT_FEATURES:
        raise ValueError(f"give samples for more than {EXACT_FEATURES} features")
    groups = [np.arange(steps) * d + i for i in range(d)]
    names = list(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rid, v in zip(pdf[id_col], pdf["_v"], strict=True):
                x = np.asarray(v, dtype=float)
                phi = sampled_shapley(x, score, base, groups, samples) if samples else shapley(x, score, base, groups)
                yield pd.DataFrame({id_col: [rid] * d, "feature": names, "contribution": phi})

    kind = dict(rows.dtypes)[id_col]
    return rows.select(id_col, F.col(vector).alias("_v")).mapInPandas(
        run, f"{id_col} {kind}, feature string, contribution double"
    )


def importance(contributions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean absolute contribution per feature in percent of the total; even if all are 0."""
    ks = list(keys) or ["_all"]
    rows = contributions if keys else contributions.withColumn("_all", F.lit(0))
    mean = rows.groupBy(*ks, "feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"))
    total = mean.groupBy(*ks).agg(F.sum("mean_abs").alias("_t"), F.count(F.lit(1)).alias("_k"))
    share = F.when(F.col("_t") > 0, 100.0 * F.col("mean_abs") / F.col("_t")).otherwise(100.0 / F.col("_k"))
    return mean.join(total, ks).withColumn("importance_pct", share).drop("_t", "_k", "_all")


def agreement(first: DataFrame, second: DataFrame, limit: float = 15.0) -> DataFrame:
    """Difference of two importance tables per feature, close if under ``limit`` points."""
    a = first.select("feature", F.col("importance_pct").alias("first_pct"))
    b = second.select("feature", F.col("importance_pct").alias("second_pct"))
    gap = F.abs(F.col("first_pct") - F.col("second_pct"))
    return a.join(b, "feature").withColumn("gap", gap).withColumn("converged", gap < limit)
