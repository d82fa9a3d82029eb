"""Hourly windows over sensor logs. Here label 1 in the log means attack."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertmill.functions.scalars import day_angle, micros, whole
from alertmill.operators.ordered import core, part_window, ranked
from alertmill.operators.windows import MINUTE, SECOND, fold_gaps, interval_mean, interval_variance

HOUR = 60 * MINUTE


def count_entropy(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Base-2 entropy of the value frequencies per key, from additive sums only."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    total = F.sum("_c")
    return counts.groupBy(*keys).agg((F.log2(total) - F.sum(F.col("_c") * F.log2("_c")) / total).alias("entropy"))


def sensor_windows(
    readings: DataFrame,
    value_col: str | None = "value",
    min_rows: int = 10,
    attack_share: float = 0.30,
    rolling: bool = True,
) -> DataFrame:
    """One row per dataset and hour with at least ``min_rows`` readings.

    Needs dataset, timestamp, label, type. The output label follows the window
    tables: 1 normal, 0 attack.
    """
    keys = ["dataset", "hour_no"]
    us = micros("timestamp")
    ev = readings.select(
        "dataset",
        us.alias("us"),
        whole(us, HOUR).alias("hour_no"),
        (F.col("label") == 1).alias("atk"),
        F.trim(F.lower("type")).alias("atype"),
        *([F.col(value_col).alias("value")] if value_col else []),
    )
    atk, mid = F.col("atk"), F.col("hour_no") * HOUR + 30 * MINUTE
    base = (
        ev.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_total"),
            F.count_if(atk).alias("n_attack"),
            F.count_if(atk & (F.col("us") <= mid)).alias("w1"),
            F.count_if(atk & (F.col("us") >= mid)).alias("w2"),
            F.min("us").alias("first_us"),
            F.max("us").alias("last_us"),
        )
        .filter(F.col("n_total") >= min_rows)
    )
    attacks = ev.filter(atk)
    cells = attacks.groupBy(*keys, whole(F.col("us"), 10 * MINUTE).alias("b10"), whole(F.col("us"), 5 * MINUTE)).agg(
        F.count(F.lit(1)).alias("n5")
    )
    bins = (
        cells.groupBy(*keys, "b10")
        .agg(F.sum("n5").alias("n10"), F.max("n5").alias("n5"))
        .groupBy(*keys)
        .agg(F.max("n5").alias("max5"), F.max("n10").alias("max10"))
    )
    instants = (
        attacks.select(*keys, whole(F.col("us"), SECOND).alias("sec"), "us")
        .distinct()
        .select(
            *keys,
            "sec",
            F.col("us").alias("first"),
            F.col("us").alias("last"),
            F.lit(0).cast("decimal(38,0)").alias("ss"),
        )
    )
    gaps = fold_gaps(fold_gaps(instants, [*keys, "sec"]), keys).select(
        *keys, (F.col("last") - F.col("first")).cast("decimal(19,0)").alias("reach"), "ss"
    )
    modes = (
        attacks.groupBy(*keys, "atype")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*keys)
        .agg(F.min_by("atype", F.struct(-F.col("n"), F.col("atype"))).alias("mode"))
    )
    out = base.join(bins, keys, "left").join(gaps, keys, "left").join(modes, keys, "left")
    if value_col:
        out = out.join(count_entropy(ev.filter(F.col("value").isNotNull()), keys, "value"), keys, "left")
    else:
        out = out.withColumn("entropy", F.lit(0.0))
    n = F.col("n_attack")
    start = F.timestamp_micros(F.col("hour_no") * HOUR)
    angle = day_angle(start, with_minutes=False)
    mean, var = interval_mean(n, F.col("reach"), MINUTE), interval_variance(n, F.col("reach"), F.col("ss"), MINUTE)
    slots = whole(F.col("last_us"), 10 * MINUTE) - whole(F.col("first_us"), 10 * MINUTE) + 1
    hit = n / F.col("n_total") > attack_share
    out = out.select(
        "dataset",
        start.alias("window_start_time"),
        n.cast("double").alias("alert_frequency_per_hour"),
        ((F.col("n_total") - n) / F.greatest(F.lit(1), n)).alias("normal_emergency_ratio"),
        F.coalesce(mean, F.lit(0.05)).alias("inter_alert_interval_mean"),
        F.when(n < 2, 0.0).otherwise(var).alias("inter_interval_variance"),
        F.coalesce("max5", F.lit(0)).cast("double").alias("burst_score"),
        F.lit(1.0).alias("topic_diversity"),
        F.sin(angle).alias("time_sin"),
        F.cos(angle).alias("time_cos"),
        F.coalesce("entropy", F.lit(0.0)).alias("payload_entropy"),
        F.when(n > 0, 1.0).otherwise(0.0).alias("consecutive_emergency_count"),
        (F.col("w2") - F.col("w1")).cast("double").alias("alert_rate_acceleration"),
        F.when((n >= 3) & (mean > 0), 1.0 / (F.sqrt(var) / mean + 0.01))
        .when(n >= 2, 10.0)
        .otherwise(1.0)
        .alias("regularity_coefficient"),
        F.when(n > 0, F.col("max10") / F.greatest(F.lit(0.1), n / slots))
        .otherwise(1.0)
        .alias("temporal_clustering_score"),
        F.when(hit, 0).otherwise(1).alias("label"),
        F.when(hit, F.coalesce("mode", F.lit("unknown"))).otherwise("normal").alias("attack_type"),
        F.col("n_total").alias("n_messages"),
    )
    return sensor_rolling(out) if rolling else out


def sensor_rolling(windows: DataFrame) -> DataFrame:
    """Sample deviation of the alert frequency over the last five windows, 0 below three."""
    rows = ranked(windows, ["dataset"], ["window_start_time"], before=4)
    w = part_window(["dataset"]).rowsBetween(-4, 0)
    freq = F.col("alert_frequency_per_hour")
    std = F.when(F.count(freq).over(w) >= 3, F.stddev_samp(freq).over(w)).otherwise(0.0)
    return core(rows.withColumn("freq_rolling_std_5w", std))


def cyclic_hour(df: DataFrame, ts: str | None) -> DataFrame:
    """Time-of-day columns for tables that lack them; midnight if there is no time."""
    angle = day_angle(F.col(ts)) if ts else F.lit(0.0)
    turn = {"time_sin": F.sin(angle), "time_cos": F.cos(angle)}
    return df.withColumns({c: e for c, e in turn.items() if c not in df.columns})


def backfill(df: DataFrame, ts: str | None = None) -> DataFrame:
    """Add the columns later steps expect: cyclic time and the rolling deviation."""
    df = cyclic_hour(df, ts if ts in df.columns else None)
    if "freq_rolling_std_5w" not in df.columns:
        if {"alert_frequency_per_hour", "dataset", "window_start_time"} <= set(df.columns):
            df = sensor_rolling(df)
        else:
            df = df.withColumn("freq_rolling_std_5w", F.lit(0.0))
    return df


