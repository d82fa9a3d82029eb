"""The alert, sensor, packet and score tables as projections of the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertmill.functions.scalars import as_utc
from alertmill.operators.windows import CAPTURES, extract_windows
from alertmill.session import settle

_LANDED: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def landed(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Write a derived fact table once per application and read it from then on."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _LANDED:
        _LANDED[key] = settle(build(), name)
    return _LANDED[key]


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", '"k": (\\d+)', 1).cast("int")
    stream = F.when(F.col("user_id") % 3 == 0, "normal").when(F.col("user_id") % 3 == 1, "flooding")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        as_utc("ts").alias("timestamp"),
        F.when(F.col("event_type") == "error", "emergency").otherwise("normal").alias("type"),
        F.concat(F.lit("home/"), (k % 3).cast("string")).alias("topic"),
        F.col("props").alias("message"),
        stream.otherwise("slow_poisoning").alias("stream"),
    )


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window fact table, landed once; ``window_id`` is its key."""

    def build() -> DataFrame:
        w = extract_windows(alerts(spark, sf_dir), CAPTURES)
        return w.withColumn("window_id", F.concat_ws(":", "stream", F.col("window_no").cast("string")))

    return landed(spark, sf_dir, "windows", build)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        as_utc("ts").alias("timestamp"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("label"),
        F.col("event_type").alias("type"),
        "value",
        (F.col("user_id") % 3).cast("int").alias("dataset"),
    )


def packets(spark: SparkSession, sf_dir: str, *extra: Column) -> DataFrame:
    """Packet log; ``seq`` is the capture order."""
    k = F.regexp_extract("props", '"k": (\\d+)', 1).cast("int")
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.when(kind.isin("click", "view", "purchase"), "3")
        .when(kind == "signup", "1")
        .when(kind == "error", "12")
        .alias("mqtt.msgtype"),
        F.concat(F.lit("home/"), (k % 3).cast("string")).alias("mqtt.topic"),
        F.when(F.col("event_id") % 2 == 0, F.hex(F.encode("props", "UTF-8")))
        .otherwise(F.col("props"))
        .alias("mqtt.msg"),
        (F.unix_micros(as_utc("ts")) / 1e6).cast("string").alias("frame.time_epoch"),
        *extra,
    )


def packet_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packet log as three captures, named like those of the alerts."""
    user = F.col("user_id") % 3
    return packets(spark, sf_dir, F.when(user == 0, "normal").when(user == 1, "flooding").otherwise("slow_poisoning").alias("capture"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = (
        F.when(F.col("event_id") % 4 == 0, "ddos")
        .when(F.col("event_id") % 4 == 1, "injection")
        .when(F.col("event_id") % 4 == 2, "password")
        .otherwise("scanning")
    )
    attack = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.when(attack, 0).otherwise(1).alias("y"),
        (F.pmod("value", F.lit(97.0)) / 97.0).alias("p_if"),
        (((F.col("event_id") * 37) % 101) / 100.0).alias("p_lstm"),
        F.when(attack, kinds).otherwise("normal").alias("attack_type"),
        (F.col("user_id") % 3).cast("int").alias("dataset"),
    )


MATRIX_FEATURES = ["quantity", "price", "discount", "tax"]


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four numeric columns and a class, at the volume of the line items."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.col("l_returnflag").alias("class"),
    )


VECTOR_DIM = 64


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.transform("embedding", lambda v: v.cast("double")).alias("features"),
        (F.col("label") < 3).cast("int").alias("y"),
        "label",
    )
