"""Windows of fifty consecutive packets and their features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertmill.functions.scalars import whole
from alertmill.operators.octets import byte_counts
from alertmill.operators.ordered import core, part_window, ranked

# Message type codes of the protocol.
PUBLISH = "3"
MANAGEMENT = ["1", "2", "8", "9", "12", "13", "14"]

HEX_TEXT = r"^(\s*[0-9A-Fa-f]{2})+\s*$"


def packet_windows(
    packets: DataFrame, order: Sequence[str] = ("seq",), size: int = 50, keys: Sequence[str] = ()
) -> DataFrame:
    """Number packets in capture order and cut them into whole windows, each capture (``keys``) for itself.

    A partial tail is dropped.
    """
    rows = core(ranked(packets, list(keys), list(order)), keep=["_rank", "_n"])
    return (
        rows.filter(F.col("_rank") <= F.col("_n") - F.col("_n") % size)
        .withColumn("window_no", whole(F.col("_rank") - 1, size))
        .drop("_rank", "_n")
    )


def payload_bytes(msg: Column) -> Column:
    """Bytes of a payload: decoded if it is text of hex pairs, else its UTF-8 bytes."""
    text = F.trim(msg)
    return F.when(text.rlike(HEX_TEXT), F.unhex(F.regexp_replace(text, r"\s", ""))).otherwise(F.encode(text, "UTF-8"))


def packet_features(windowed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per packet window; expects ``window_no`` (and ``keys``) from ``packet_windows``."""
    by = [*keys, "window_no"]
    kind = F.col("`mqtt.msgtype`")
    pub = kind == PUBLISH
    rows = windowed.select(
        *by,
        F.coalesce(pub, F.lit(False)).alias("pub"),
        F.coalesce(kind.isin(MANAGEMENT), F.lit(False)).alias("mgmt"),
        F.when(pub & (F.col("`mqtt.topic`") != ""), F.col("`mqtt.topic`")).alias("topic"),
        F.when(pub, F.expr("try_cast(`frame.time_epoch` AS DOUBLE)")).alias("t"),
        F.when(pub, F.col("`mqtt.msg`")).alias("msg"),
    )
    w = Window.partitionBy(*by)
    mid = F.min("t").over(w) + (F.max("t").over(w) - F.min("t").over(w)) / 2.0
    rows = rows.withColumn("d", F.col("t") - F.lag("t").over(w.orderBy(F.col("t").asc_nulls_first()))).withColumn(
        "mid", mid
    )
    base = rows.groupBy(*by).agg(
        F.count_if("pub").alias("n_publish"),
        F.count_if("mgmt").alias("n_mgmt"),
        F.count("topic").alias("n_topics"),
        F.count_distinct("topic").alias("distinct_topics"),
        F.count("t").alias("n_t"),
        F.avg("d").alias("mean_d"),
        F.var_pop("d").alias("var_d"),
        F.count_if(F.col("t") > F.col("mid")).alias("late"),
        F.count_if(F.col("t") <= F.col("mid")).alias("early"),
    )
    bodies = rows.filter(F.trim("msg") != "").select(*by, payload_bytes(F.col("msg")).alias("body"))
    counts = byte_counts(bodies, by, "body").withColumnRenamed("n", "c")
    entropy = counts.groupBy(*by).agg(
        (F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c")).alias("entropy")
    )
    two = F.col("n_t") >= 2
    return base.join(entropy, by, "left").select(
        *by,
        F.coalesce("entropy", F.lit(0.0)).alias("payload_entropy"),
        F.when(F.col("n_topics") > 0, F.col("distinct_topics") / F.col("n_topics"))
        .otherwise(0.0)
        .alias("topic_diversity"),
        F.when(two & (F.col("mean_d") > 1e-9), F.sqrt("var_d") / F.col("mean_d"))
        .when(two, 1.0)
        .when(F.col("n_publish") == 0, 0.0)
        .otherwise(1.0)
        .alias("temporal_clustering_score"),
        (F.col("n_mgmt") / F.greatest(F.lit(1), F.col("n_publish"))).alias("normal_emergency_ratio"),
        F.when(two, F.col("mean_d")).otherwise(0.0).alias("inter_alert_interval_mean"),
        F.when(two, F.col("var_d")).otherwise(0.0).alias("inter_interval_variance"),
        (F.col("late") - F.col("early")).cast("double").alias("alert_rate_acceleration"),
        "n_publish",
    )


def packet_rolling(features: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Population deviation of the publish count over the last five windows, 0 when alone."""
    rows = ranked(features, list(keys), ["window_no"], before=4)
    w = part_window(list(keys)).rowsBetween(-4, 0)
    return core(rows.withColumn("freq_rolling_std_5w", F.stddev_pop("n_publish").over(w)))
