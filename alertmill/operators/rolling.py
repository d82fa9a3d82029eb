"""Causal rolling features and neighbour scores over ordered windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertmill.functions.scalars import finite_or_zero
from alertmill.operators.ordered import core, part_window, quantiles, ranked
from alertmill.schemas import SEQUENTIAL_FEATURES

ORDER = ("window_start_time", "window_id")


def rolling_raw(
    windows: DataFrame,
    key: str = "attack_type",
    order: Sequence[str] = ORDER,
    width: int = 5,
    least: int = 3,
) -> DataFrame:
    """Rolling persistence, mean and sample deviation per class; NULL below ``least`` rows.

    Keeps ``_rank`` and ``_n``, the place of the row in its class.
    """
    df = windows.drop(*SEQUENTIAL_FEATURES)
    w = part_window([key]).rowsBetween(-(width - 1), 0)
    freq = F.col("alert_frequency_per_hour").cast("double")
    alert = F.when(F.col("n_emergency") > 0, 1.0).otherwise(0.0)
    full = F.count(F.lit(1)).over(w) >= least
    rows = ranked(df, [key], order, before=width - 1)
    return core(
        rows.withColumn("freq_persistence_5w", F.when(full, F.avg(alert).over(w)))
        .withColumn("freq_rolling_mean_5w", F.when(full, F.avg(freq).over(w)))
        .withColumn("freq_rolling_std_5w", F.when(full, F.stddev_samp(freq).over(w))),
        keep=["_rank", "_n"],
    )


def fill_medians(rolled: DataFrame, key: str = "attack_type", train_fraction: float = 0.6) -> DataFrame:
    """Per class and feature: the median of the first rows, and of all rows as second choice."""
    head = F.col("_rank") <= F.greatest(F.lit(1), F.floor(F.col("_n") * train_fraction))
    scoped = rolled.select(
        key,
        *SEQUENTIAL_FEATURES,
        F.explode(F.when(head, F.array(F.lit("train"), F.lit("all"))).otherwise(F.array(F.lit("all")))).alias("scope"),
    )
    long = scoped.unpivot([key, "scope"], SEQUENTIAL_FEATURES, "feature", "value")
    return quantiles(long, [key, "scope", "feature"], "value", {"median": 0.5})


def sequential_features(
    windows: DataFrame, key: str = "attack_type", order: Sequence[str] = ORDER, train_fraction: float = 0.6
) -> DataFrame:
    """Add the three rolling columns with no NULL left.

    NULLs take the class median of the training head, else of the class, else
    0; a class with fewer than three windows therefore gets 0 everywhere.
    Columns of an earlier run are dropped and computed again.
    """
    rolled = rolling_raw(windows, key, order)
    picks = [
        F.coalesce(
            F.max(F.when((F.col("feature") == f) & (F.col("scope") == "train"), F.col("median"))),
            F.max(F.when((F.col("feature") == f) & (F.col("scope") == "all"), F.col("median"))),
        ).alias(f"_m_{f}")
        for f in SEQUENTIAL_FEATURES
    ]
    medians = fill_medians(rolled, key, train_fraction).groupBy(key).agg(*picks)
    filled = rolled.join(medians, key, "left").withColumns(
        {f: F.coalesce(F.col(f), F.col(f"_m_{f}"), F.lit(0.0)) for f in SEQUENTIAL_FEATURES}
    )
    return filled.drop("_rank", "_n", *[f"_m_{f}" for f in SEQUENTIAL_FEATURES])


def _bind(value: Column, then) -> Column:
    """Evaluate ``value`` once and use it in ``then``."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _middle(s: Column) -> Column:
    """Median of a sorted array."""
    n = F.size(s)
    return (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2).cast("int") + 1)) / 2.0


def _robust_distance(near: Column, vec: Column, i: int) -> Column:
    def around(s: Column) -> Column:
        return _bind(_middle(s), lambda m: _bind(F.sort_array(_away(s, m)), lambda t: gap(m, t)))

    def gap(m: Column, t: Column) -> Column:
        return F.abs(vec[i] - m) / (_middle(t) + 1e-9)

    return _bind(F.sort_array(F.transform(near, lambda v: v[i])), around)


def _away(s: Column, m: Column) -> Column:
    return F.transform(s, lambda x: F.abs(x - m))


def neighbour_deviation(
    df: DataFrame, key: str, order: Sequence[str], features: Sequence[str], reach: int = 5
) -> DataFrame:
    """``tas``: mean robust distance to the ``reach`` rows on either side, z-scored per key.

    Neighbours carry at most ``2 * reach`` vectors, so the arrays stay small.
    """
    vec = F.array(*[finite_or_zero(F.col(f).cast("double")) for f in features])
    rows = ranked(df.withColumn("_v", vec), [key], order, before=reach, after=reach)
    w = part_window([key])
    near = F.concat(
        F.collect_list("_v").over(w.rowsBetween(-reach, -1)), F.collect_list("_v").over(w.rowsBetween(1, reach))
    )
    rows = core(rows.withColumn("_near", near))
    total = sum((_robust_distance(F.col("_near"), F.col("_v"), i) for i in range(len(features))), F.lit(0.0))
    raw = F.when(F.size("_near") < 2, 0.0).otherwise(total / len(features))
    scored = rows.withColumn("tas_raw", raw).drop("_v", "_near")
    stats = scored.groupBy(key).agg(F.avg("tas_raw").alias("_mu"), (F.stddev_pop("tas_raw") + 1e-9).alias("_sd"))
    return scored.join(stats, key).withColumn("tas", (F.col("tas_raw") - F.col("_mu")) / F.col("_sd")).drop("_mu", "_sd")


def neighbour_distance(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], features: Sequence[str], reach: int = 5
) -> DataFrame:
    """``tas``: Euclidean distance to the mean of the neighbours, 0 without any."""
    rows = ranked(df, keys, order, before=reach, after=reach)
    around, self_ = part_window(keys).rowsBetween(-reach, reach), F.lit(1)
    n = F.count(self_).over(around) - 1
    gaps = [F.col(f) - (F.sum(f).over(around) - F.col(f)) / n for f in features]
    dist = F.sqrt(sum((g * g for g in gaps), F.lit(0.0)))
    return core(rows.withColumn("tas", F.when(n > 0, dist).otherwise(0.0)))


def autocorrelation(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, max_lag: int = 15) -> DataFrame:
    """Autocorrelation of centred values at lags 1..``max_lag``, one row per lag."""
    rows = ranked(df.select(*keys, *order, F.col(value).alias("_r")), keys, order, before=max_lag)
    w = part_window(keys)
    plain = rows.filter(~F.col("_halo"))
    mean = plain.groupBy(*keys).agg(F.avg("_r").alias("_mu")) if keys else plain.agg(F.avg("_r").alias("_mu"))
    if keys:
        centred = rows.join(mean, list(keys))
    else:
        centred = rows.withColumn("_mu", F.lit(mean.first()["_mu"]))
    r = F.col("_r") - F.col("_mu")
    lagged = centred.select(
        *keys, "_halo", r.alias("r"), *[F.lag(r, k).over(w).alias(f"r{k}") for k in range(1, max_lag + 1)]
    ).filter(~F.col("_halo"))
    sums = [
        F.struct(
            F.lit(k).alias("lag"), (F.sum(F.col("r") * F.col(f"r{k}")) / F.sum(F.col("r") * F.col("r"))).alias("acf")
        )
        for k in range(1, max_lag + 1)
    ]
    grouped = lagged.groupBy(*keys) if keys else lagged.groupBy()
    return grouped.agg(F.array(*sums).alias("_a")).select(*keys, F.inline("_a")).filter(F.col("acf").isNotNull())
