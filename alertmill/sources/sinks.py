"""Output tables, audit records and the feature cache."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertmill.operators.rolling import sequential_features


def write_features(table: DataFrame, path: str) -> None:
    """One table partitioned by split and class; the labelled, normal-only, train and test sets are filters of it."""
    table.write.mode("overwrite").partitionBy("split", "attack_type").parquet(path)


def read_features(spark: SparkSession, path: str, part: str = "labelled") -> DataFrame:
    """``part``: labelled, normal, train or test. The filters prune partitions."""
    df = spark.read.parquet(path)
    if part == "normal":
        return df.filter("attack_type = 'normal'")
    return df.filter(F.col("split") == part) if part in ("train", "test") else df


def write_csv(table: DataFrame, path: str, order: Sequence[str]) -> None:
    """Plain CSV in time order."""
    table.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def enrich_in_versions(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Add the rolling columns of ``source`` and write them to ``target``.

    Spark cannot overwrite what it reads, so the input stays behind as its own
    backup. Running again on an enriched table gives the same columns.
    """
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("write to a new path")
    sequential_features(spark.read.parquet(source)).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def audit(df: DataFrame, class_col: str = "attack_type") -> DataFrame:
    """Dataset record: rows in total, per class and per split, as one nested row."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.struct(
            F.count_if(F.col(class_col) == "normal").alias("normal"),
            F.count_if(F.col(class_col) == "flooding").alias("flooding"),
            F.count_if(F.col(class_col) == "slow_poisoning").alias("slow_poisoning"),
        ).alias("classes"),
        F.struct(F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "test").alias("test")).alias(
            "splits"
        ),
    )


def write_record(record: DataFrame, path: str) -> None:
    """A small record table as JSON lines."""
    record.coalesce(1).write.mode("overwrite").json(path)


def write_results(results: DataFrame, path: str) -> None:
    """Result rows keyed by dataset, replacing only the datasets they hold."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset").parquet(path)


def with_earlier(results: DataFrame, earlier: DataFrame, key: str = "dataset") -> DataFrame:
    """Earlier numbers of the same dataset beside the new ones; NULL where there are none."""
    old = earlier.select(key, *[F.col(c).alias(f"earlier_{c}") for c in earlier.columns if c != key])
    return results.join(old, key, "left")


def cache_key(features: Sequence[str], *facts: object) -> str:
    """Digest of what a cached table depends on."""
    return hashlib.sha256(json.dumps([sorted(features), [str(f) for f in facts]]).encode()).hexdigest()[:16]


def cached(spark: SparkSession, root: str, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table stored under ``key``, built on first use."""
    path = f"{root.rstrip('/')}/cache_key={key}"
    try:
        return spark.read.parquet(path)
    except Exception as error:  # nothing stored yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
