"""Sliding windows over alert captures and their thirteen features.

Each capture (``stream``) is cut into panes: the largest step that divides
both window and step, counted from the first message of the capture. Messages
are reduced to pane or second level with map-side combined aggregates, and only
those small rows are replicated into the overlapping windows. No step needs
all messages of a window, or of a stream, in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertmill.functions.scalars import EMERGENCY, day_angle, emergency, micros, whole
from alertmill.operators.octets import byte_counts
from alertmill.schemas import WINDOW_FEATURES
from alertmill.session import settle

SECOND = 1_000_000
MINUTE = 60 * SECOND
BIN = 5 * MINUTE
CV_FLOOR = 0.01


@dataclass(frozen=True)
class WindowConfig:
    """Window settings of one capture."""

    stream: str
    label: int
    window_min: int = 60
    step_min: int = 10
    min_emergency: int = 0
    deduplicate: bool = False

    def __post_init__(self) -> None:
        if self.window_min <= 0 or self.step_min <= 0:
            raise ValueError("window and step must be positive")
        if self.step_min >= self.window_min:
            raise ValueError("the step must be shorter than the window")

    @property
    def overlap_pct(self) -> int:
        return int(100 * (1 - self.step_min / self.window_min))


CAPTURES = (
    WindowConfig("normal", label=1, step_min=10, min_emergency=0),
    WindowConfig("flooding", label=0, step_min=15, min_emergency=1, deduplicate=True),
    WindowConfig("slow_poisoning", label=0, step_min=15, min_emergency=1, deduplicate=True),
)


def config_table(spark, configs: Sequence[WindowConfig]) -> DataFrame:
    """One row per capture; sizes in microseconds."""
    rows = [
        F.struct(
            F.lit(c.stream).alias("stream"),
            F.lit(c.label).alias("label"),
            F.lit(c.window_min * MINUTE).cast("bigint").alias("window_us"),
            F.lit(c.step_min * MINUTE).cast("bigint").alias("step_us"),
            F.lit(math.gcd(c.window_min, c.step_min) * MINUTE).cast("bigint").alias("pane_us"),
            F.lit(c.min_emergency).alias("min_emergency"),
            F.lit(c.overlap_pct).alias("overlap_pct"),
        )
        for c in configs
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def origins(alerts: DataFrame, configs: Sequence[WindowConfig]) -> DataFrame:
    """Per capture: settings, first message time and number of whole windows."""
    spans = alerts.groupBy("stream").agg(F.min(micros("timestamp")).alias("t0"), F.max(micros("timestamp")).alias("t1"))
    room = F.col("t1") - F.col("t0") - F.col("window_us")
    return (
        spans.join(config_table(alerts.sparkSession, configs), "stream")
        .withColumn("n_windows", F.when(room >= 0, whole(room, F.col("step_us")) + 1).otherwise(F.lit(0)))
        .drop("t1")
    )


def into_windows(df: DataFrame) -> DataFrame:
    """Replicate rows that carry ``pane`` into the windows ``k`` that cover it."""
    per_step = whole(F.col("step_us"), F.col("pane_us"))
    per_window = whole(F.col("window_us"), F.col("pane_us"))
    past = F.col("pane") - per_window + per_step
    lo = F.when(past > 0, whole(past, per_step)).otherwise(F.lit(0))
    hi = F.least(F.col("n_windows") - 1, whole(F.col("pane"), per_step))
    return (
        df.withColumn("_lo", lo)
        .withColumn("_hi", hi)
        .filter(F.col("_lo") <= F.col("_hi"))
        .withColumn("k", F.explode(F.sequence("_lo", "_hi")))
        .drop("_lo", "_hi")
    )


class _Capture:
    """The reduced tables of one extraction; every branch starts from these."""

    def __init__(self, alerts: DataFrame, configs: Sequence[WindowConfig]):
        self.starts = settle(origins(alerts, configs), "origins")
        self.alerts = alerts
        emg = F.col("emg")
        ticks = (
            self.events(alerts.select("stream", "timestamp", emergency().alias("emg")), "emg")
            .groupBy("stream", "pane", "sec", whole(F.col("us"), BIN).alias("bin5"))
            .agg(
                F.count(F.lit(1)).alias("n_msg"),
                F.count_if(emg).alias("n_emg"),
                F.min("us").alias("first_msg"),
                F.min(F.when(emg, F.col("us"))).alias("first_emg"),
            )
        )
        self.ticks = settle(ticks, "ticks")
        self.marks = (
            self.events(self.emergencies("timestamp")).groupBy("stream", "pane", "sec", "us").agg(F.count(F.lit(1)).alias("n"))
        )

    def emergencies(self, *cols: str) -> DataFrame:
        """Alert rows only; a plain comparison, so that the scan can skip the rest."""
        return self.alerts.filter(F.col("type") == EMERGENCY).select("stream", *cols)

    def events(self, rows: DataFrame, *cols: str) -> DataFrame:
        """Rows with their instant, pane and second since the start of the capture."""
        us = micros("timestamp")
        rel = F.col("us") - F.col("t0")
        return (
            rows.select("stream", us.alias("us"), *cols)
            .join(self.starts.select("stream", "t0", "pane_us"), "stream")
            .select("stream", "us", whole(rel, F.col("pane_us")).alias("pane"), whole(rel, SECOND).alias("sec"), *cols)
        )

    def placed(self, df: DataFrame) -> DataFrame:
        return into_windows(df.join(self.starts, "stream"))

    def base(self) -> DataFrame:
        panes = self.ticks.groupBy("stream", "pane").agg(
            F.sum("n_msg").alias("n_msg"),
            F.sum("n_emg").alias("n_emg"),
            F.min("first_msg").alias("first_msg"),
            F.min("first_emg").alias("first_emg"),
        )
        return (
            self.placed(panes)
            .groupBy("stream", "k")
            .agg(
                F.sum("n_msg").alias("n_messages"),
                F.sum("n_emg").alias("n_emergency"),
                F.min("first_msg").alias("first_msg"),
                F.min("first_emg").alias("first_emg"),
            )
        )

    def bins(self) -> DataFrame:
        """Largest 5-minute bin, and largest and mean non-empty 10-minute bin."""
        cells = self.ticks.groupBy("stream", "pane", "bin5").agg(F.sum("n_emg").alias("n")).filter("n > 0")
        fine = self.placed(cells).groupBy("stream", "k", "bin5").agg(F.sum("n").alias("n"))
        wide = fine.groupBy("stream", "k", whole(F.col("bin5"), 2).alias("bin10")).agg(
            F.sum("n").alias("n10"), F.max("n").alias("n5")
        )
        return wide.groupBy("stream", "k").agg(
            F.max("n5").alias("max5"), F.max("n10").alias("max10"), F.avg("n10").alias("mean10")
        )

    def topics(self) -> DataFrame:
        rows = self.emergencies("timestamp", "topic").filter(F.col("topic").isNotNull())
        seen = self.events(rows, "topic").select("stream", "pane", "topic").distinct()
        return self.placed(seen).groupBy("stream", "k").agg(F.count_distinct("topic").alias("n_topics"))

    def payload(self) -> DataFrame:
        """Entropy of the payload bytes, payloads joined by one zero byte.

        Every payload brings a leading zero byte; the window then takes one off.
        """
        rows = self.emergencies("timestamp", "message").filter(F.col("message").isNotNull())
        bodies = self.events(rows, "message").select("stream", "pane", F.encode("message", "UTF-8").alias("body"))
        panes = byte_counts(bodies, ["stream", "pane"], "body", lead=True)
        counts = (
            self.placed(panes)
            .groupBy("stream", "k", "byte")
            .agg((F.sum("n") - F.when(F.col("byte") == 0, 1).otherwise(0)).alias("n"))
            .filter("n > 0")
        )
        total = F.sum("n").over(Window.partitionBy("stream", "k"))
        share = counts.select("stream", "k", (F.col("n") / total).alias("p"))
        return share.groupBy("stream", "k").agg((-F.sum(F.col("p") * F.log2(F.col("p") + 1e-12))).alias("entropy"))

    def gaps(self) -> DataFrame:
        """Sum of squared gaps between consecutive emergencies of a window.

        Folded from distinct instants to seconds, panes and windows; a group of
        one level holds at most one row per unit of the level below. Exact
        integers, so equal gaps give a variance of exactly zero.
        """
        zero = F.lit(0).cast("decimal(38,0)")
        instants = self.marks.select(
            "stream", "pane", "sec", F.col("us").alias("first"), F.col("us").alias("last"), zero.alias("ss")
        )
        seconds = fold_gaps(instants, ["stream", "pane", "sec"])
        panes = fold_gaps(seconds, ["stream", "pane"])
        return fold_gaps(self.placed(panes).select("stream", "k", "first", "last", "ss"), ["stream", "k"]).select(
            "stream", "k", (F.col("last") - F.col("first")).cast("decimal(19,0)").alias("reach"), "ss"
        )

    def halves(self, base: DataFrame) -> DataFrame:
        """Emergencies before the midpoint, first message plus half a window.

        Whole seconds before the midpoint come from second counts; only the
        second that holds it is compared instant by instant.
        """
        mids = base.join(self.starts, "stream").select(
            "stream",
            "k",
            "t0",
            (F.col("first_msg") + whole(F.col("window_us"), 2)).alias("mid"),
            whole(F.col("first_msg") + whole(F.col("window_us"), 2) - F.col("t0"), SECOND).alias("mid_sec"),
        )
        seconds = self.ticks.groupBy("stream", "pane", "sec").agg(F.sum("n_emg").alias("n")).filter("n > 0")
        early = (
            self.placed(seconds)
            .select("stream", "k", "sec", "n")
            .join(mids, ["stream", "k"])
            .filter(F.col("sec") < F.col("mid_sec"))
            .select("stream", "k", "n")
        )
        edge = (
            self.marks.select("stream", F.col("sec").alias("mid_sec"), "us", "n")
            .join(mids, ["stream", "mid_sec"])
            .filter(F.col("us") < F.col("mid"))
            .select("stream", "k", "n")
        )
        return early.unionByName(edge).groupBy("stream", "k").agg(F.sum("n").alias("n_before"))


def fold_gaps(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merge disjoint, ordered spans (first, last, ss) of a group into one span."""
    prev = F.lag("last").over(Window.partitionBy(*keys).orderBy("first"))
    gap = (F.col("first") - prev).cast("decimal(19,0)")
    return (
        df.withColumn("_g", F.coalesce(gap * gap, F.lit(0).cast("decimal(38,0)")))
        .groupBy(*keys)
        .agg(
            F.min("first").alias("first"),
            F.max("last").alias("last"),
            (F.sum("ss") + F.sum("_g")).cast("decimal(38,0)").alias("ss"),
        )
    )


def interval_mean(n: Column, reach: Column, unit_us: float) -> Column:
    """Mean gap of n ordered instants; NULL below two."""
    return F.when(n >= 2, reach.cast("double") / unit_us / (n - 1))


def interval_variance(n: Column, reach: Column, ss: Column, unit_us: float, population: bool = False) -> Column:
    """Variance of the n-1 gaps from exact sums; NULL if undefined."""
    m = (n - 1).cast("decimal(19,0)")
    spread = (m * ss - (reach * reach).cast("decimal(38,0)")).cast("double") / (unit_us * unit_us)
    steps = (n - 1).cast("double")
    return F.when(n >= 2, spread / (steps * steps)) if population else F.when(n >= 3, spread / (steps * (steps - 1)))


def extract_windows(
    alerts: DataFrame,
    configs: Sequence[WindowConfig] = CAPTURES,
    features: Sequence[str] = WINDOW_FEATURES,
) -> DataFrame:
    """Window rows of every capture in one job, with only the asked features.

    ``alerts``: stream, timestamp, type and, if payload or topic features are
    wanted, topic and message. Only windows wholly inside the capture are kept,
    empty ones are dropped, and each needs the capture's least emergencies.
    """
    want = set(features)
    cap = _Capture(alerts, configs)
    base = cap.base()
    n = F.col("n_emergency")
    out = base.join(cap.starts, "stream").filter(n >= F.col("min_emergency"))
    branches = [
        ({"burst_score", "temporal_clustering_score"}, lambda: cap.bins()),
        ({"topic_diversity"}, lambda: cap.topics() if "topic" in alerts.columns else None),
        ({"payload_entropy"}, lambda: cap.payload() if "message" in alerts.columns else None),
        ({"inter_alert_interval_mean", "inter_interval_variance", "regularity_coefficient"}, lambda: cap.gaps()),
        ({"alert_rate_acceleration"}, lambda: cap.halves(base)),
    ]
    for names, build in branches:
        if want & names:
            branch = build()
            if branch is not None:
                out = out.join(branch, ["stream", "k"], "left")
    for late in ("n_topics", "entropy"):
        if late not in out.columns:
            out = out.withColumn(late, F.lit(0))
    start = F.col("t0") + F.col("k") * F.col("step_us")
    expr: dict[str, Column] = {
        "alert_frequency_per_hour": n.cast("double"),
        "normal_emergency_ratio": (F.col("n_messages") - n) / F.greatest(F.lit(1), n),
        "topic_diversity": F.coalesce(F.col("n_topics"), F.lit(0)).cast("double"),
        "payload_entropy": F.coalesce(F.col("entropy"), F.lit(0.0)).cast("double"),
        "consecutive_emergency_count": F.when(n > 0, 1.0).otherwise(0.0),
    }
    if want & {"time_sin", "time_cos"}:
        angle = day_angle(F.timestamp_micros(F.coalesce("first_emg", "first_msg")))
        expr |= {"time_sin": F.sin(angle), "time_cos": F.cos(angle)}
    if want & branches[0][0]:
        expr["burst_score"] = F.coalesce(F.col("max5"), F.lit(0)).cast("double")
        expr["temporal_clustering_score"] = F.when(n >= 3, F.col("max10") / F.col("mean10")).otherwise(1.0)
    if want & branches[3][0]:
        mean = interval_mean(n, F.col("reach"), MINUTE)
        var = interval_variance(n, F.col("reach"), F.col("ss"), MINUTE)
        cv = F.sqrt(var) / mean
        expr["inter_alert_interval_mean"] = mean
        expr["inter_interval_variance"] = F.coalesce(var, F.lit(0.0))
        expr["regularity_coefficient"] = F.when(
            (n >= 3) & (var > 0) & (mean != 0), 1.0 / F.greatest(cv, F.lit(CV_FLOOR))
        ).when(n >= 2, 1.0 / CV_FLOOR)
    if want & branches[4][0]:
        expr["alert_rate_acceleration"] = F.when(
            n >= 4, (n - 2 * F.coalesce(F.col("n_before"), F.lit(0))).cast("double")
        ).otherwise(0.0)
    return out.select(
        "stream",
        F.col("k").alias("window_no"),
        *[expr[f].alias(f) for f in features],
        "label",
        F.col("stream").alias("attack_type"),
        F.timestamp_micros(start).alias("window_start_time"),
        F.timestamp_micros(start + F.col("window_us")).alias("window_end_time"),
        "n_messages",
        "n_emergency",
    )


def deduplicate_windows(windows: DataFrame, streams: Sequence[str] | None = None) -> DataFrame:
    """Keep one window per start time in the named captures.

    Rows of one capture with the same start cover the same messages, so any of
    them may stay; the aggregate combines map-side.
    """
    if streams is None:
        return windows.dropDuplicates(["stream", "window_start_time"])
    hit = F.col("stream").isin(list(streams))
    return windows.filter(~hit).unionByName(
        windows.filter(hit).dropDuplicates(["stream", "window_start_time"])
    )
