"""Chronological splits, zones, seeded samples and folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertmill.functions.scalars import whole
from alertmill.operators.ordered import core, hashed_rank, ranked, shuffle_token

ORDER = ("window_start_time", "window_id")


def in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows with ``_rank`` and ``_n`` inside the key."""
    return core(ranked(df, keys, order), keep=["_rank", "_n"])


def chronological_split(
    df: DataFrame, key: str = "attack_type", order: Sequence[str] = ORDER, train_fraction: float = 0.6
) -> DataFrame:
    """``split``: the first share of each class is train, the rest test."""
    rows = in_order(df, [key], order)
    train = F.col("_rank") <= F.floor(F.col("_n") * train_fraction)
    return rows.withColumn("split", F.when(train, "train").otherwise("test")).drop("_rank", "_n")


def zones(
    df: DataFrame,
    key: str = "attack_type",
    order: Sequence[str] = ORDER,
    fit_end: float = 0.6,
    calibrate_end: float = 0.8,
) -> DataFrame:
    """``zone`` per class in time: A to fit, B to calibrate, C to test."""
    rows = in_order(df, [key], order)
    place = F.col("_rank")
    zone = (
        F.when(place <= F.floor(F.col("_n") * fit_end), "A")
        .when(place <= F.floor(F.col("_n") * calibrate_end), "B")
        .otherwise("C")
    )
    return rows.withColumn("zone", zone).drop("_rank", "_n")


def random_split(df: DataFrame, id_col: str, seed: int = 42, fit: float = 0.6, calibrate: float = 0.2) -> DataFrame:
    """``part``: exact random shares fit / calibrate / test by seeded digest order."""
    rows = hashed_rank(df, [], shuffle_token(seed, id_col), id_col)
    n_fit, n_cal = F.floor(F.col("_n") * fit), F.floor(F.col("_n") * calibrate)
    part = F.when(F.col("_rank") <= n_fit, "fit").when(F.col("_rank") <= n_fit + n_cal, "calibrate").otherwise("test")
    return rows.withColumn("part", part).drop("_rank", "_n")


def balance(
    train: DataFrame, id_col: str, classes: Sequence[str] = ("flooding", "slow_poisoning"), seed: int = 42
) -> DataFrame:
    """Sample the named classes down to the smallest of them; other rows stay.

    If one of the classes is absent nothing is dropped.
    """
    rows = hashed_rank(train, ["attack_type"], shuffle_token(seed, id_col), id_col)
    sizes = train.filter(F.col("attack_type").isin(list(classes))).groupBy("attack_type").count()
    least = sizes.agg(F.min("count").alias("least"), F.count(F.lit(1)).alias("present")).first()
    if least["present"] < len(classes):
        return train
    keep = ~F.col("attack_type").isin(list(classes)) | (F.col("_rank") <= least["least"])
    return rows.filter(keep).drop("_rank", "_n")


def stratified_sample(df: DataFrame, keys: Sequence[str], id_col: str, fraction: float = 0.6, seed: int = 42) -> DataFrame:
    """An exact share of every stratum, taken in seeded digest order."""
    rows = hashed_rank(df, keys, shuffle_token(seed, id_col), id_col)
    return rows.filter(F.col("_rank") <= F.round(F.col("_n") * fraction)).drop("_rank", "_n")


def ordered_folds(df: DataFrame, order: Sequence[str], k: int = 5) -> DataFrame:
    """``fold`` 1..k of contiguous rows; the first ``n % k`` folds hold one row more."""
    rows = in_order(df, [], order)
    size, extra, i = whole(F.col("_n"), k), F.col("_n") % k, F.col("_rank") - 1
    fold = F.when(i < extra * (size + 1), whole(i, size + 1)).otherwise(extra + whole(i - extra * (size + 1), size))
    return rows.withColumn("fold", (fold + 1).cast("int")).drop("_rank", "_n")


def expanding_folds(df: DataFrame, order: Sequence[str], k: int = 5) -> DataFrame:
    """``block`` 0..k of contiguous rows; fold f trains on blocks below f and tests on f.

    The k test blocks have equal size and the first block takes the rest.
    """
    rows = in_order(df, [], order)
    size = whole(F.col("_n"), k + 1)
    head = F.col("_n") - size * k
    block = F.when(F.col("_rank") <= head, 0).otherwise(whole(F.col("_rank") - 1 - head, size) + 1)
    return rows.withColumn("block", block.cast("int")).drop("_rank", "_n")


def tail_holdout(df: DataFrame, order: Sequence[str], fraction: float = 0.2, least: int = 10) -> DataFrame:
    """``holdout``: the last ``max(least, fraction * n)`` rows."""
    rows = in_order(df, [], order)
    n_out = F.greatest(F.lit(least), F.floor(F.col("_n") * fraction))
    return rows.withColumn("holdout", F.col("_rank") > F.col("_n") - n_out).drop("_rank", "_n")


def even_pick(df: DataFrame, order: Sequence[str], n_max: int) -> DataFrame:
    """At most ``n_max`` rows, evenly spaced over the order, first and last included."""
    rows = in_order(df, [], order)
    i, n = F.col("_rank") - 1, F.col("_n")
    if n_max == 1:
        hit = i == 0
    else:
        # Row i is picked if some j in 0..n_max-1 has floor(j * (n-1) / (n_max-1)) = i.
        j = F.ceil(i * (n_max - 1) / (n - 1))
        hit = (j <= n_max - 1) & (F.floor(j * (n - 1) / (n_max - 1)) == i)
    return rows.filter((n <= n_max) | hit).drop("_rank", "_n")


def random_pick(df: DataFrame, id_col: str, n_max: int, seed: int = 42) -> DataFrame:
    """At most ``n_max`` rows in seeded digest order."""
    token = shuffle_token(seed, id_col)
    return df.orderBy(token, id_col).limit(n_max)


def thin_normals(df: DataFrame, id_col: str, seed: int = 42, ratio: int = 4, least: int = 50) -> DataFrame:
    """Keep ``min(n, max(ratio * attacks, least))`` normal rows and all attacks."""
    n_attack = df.filter("y = 0").count()
    rows = hashed_rank(df, ["y"], shuffle_token(seed, id_col), id_col)
    return rows.filter((F.col("y") == 0) | (F.col("_rank") <= max(ratio * n_attack, least))).drop("_rank", "_n")


def shuffled(df: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """Seeded total order for output tables."""
    return df.orderBy(shuffle_token(seed, id_col), id_col)


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight n / (classes * n_class) per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).first()
    return counts.select(label, "n", (F.lit(float(total["n"] or 0)) / (total["k"] * F.col("n"))).alias("weight"))


