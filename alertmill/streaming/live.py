"""Live window features, ordered features and scoring.

Live windows start at multiples of the step since the epoch, as a running
stream has no first message to count from.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from alertmill.functions.scalars import day_angle, emergency, micros, whole
from alertmill.operators.fusion import route
from alertmill.operators.windows import BIN, CV_FLOOR, MINUTE

BINS = 12  # five-minute bins of an hour window


def read_stream(spark: SparkSession, path: str, schema, files: int | None = None) -> DataFrame:
    """Parquet files of a folder as they arrive, ``files`` at a time."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(path)


def live_windows(alerts: DataFrame, step_min: int = 10, delay: str = "10 minutes") -> DataFrame:
    """Hour windows of each stream; rows later than the watermark are dropped.

    Bin counts are twelve conditional counts, since epoch-aligned windows hold
    whole five-minute bins, so the state of a window has a fixed size but for
    its set of topics.
    """
    if step_min % 10:
        raise ValueError("live windows need a step of whole ten minutes")
    emg = emergency()
    slot = whole(F.pmod(micros("timestamp"), F.lit(60 * MINUTE)), BIN).cast("int")
    bins = [F.count_if(emg & (slot == i)).alias(f"b{i}") for i in range(BINS)]
    agg = (
        alerts.withWatermark("timestamp", delay)
        .groupBy("stream", F.window("timestamp", "60 minutes", f"{step_min} minutes"))
        .agg(
            F.count(F.lit(1)).alias("n_messages"),
            F.count_if(emg).alias("n_emergency"),
            F.min("timestamp").alias("first_msg"),
            F.min(F.when(emg, F.col("timestamp"))).alias("first_emg"),
            F.size(F.collect_set(F.when(emg, F.col("topic")))).alias("n_topics"),
            *bins,
        )
    )
    n = F.col("n_emergency")
    # Slots are counted within the clock hour, so two of them make one ten-minute bin.
    pairs = [F.col(f"b{i}") + F.col(f"b{i + 1}") for i in range(0, BINS, 2)]
    filled = sum((F.when(p > 0, 1).otherwise(0) for p in pairs), F.lit(0))
    angle = day_angle(F.coalesce("first_emg", "first_msg"))
    return agg.select(
        "stream",
        F.col("window.start").alias("window_start_time"),
        F.col("window.end").alias("window_end_time"),
        "n_messages",
        "n_emergency",
        n.cast("double").alias("alert_frequency_per_hour"),
        ((F.col("n_messages") - n) / F.greatest(F.lit(1), n)).alias("normal_emergency_ratio"),
        F.greatest(*[F.col(f"b{i}") for i in range(BINS)]).cast("double").alias("burst_score"),
        F.col("n_topics").cast("double").alias("topic_diversity"),
        F.sin(angle).alias("time_sin"),
        F.cos(angle).alias("time_cos"),
        F.when(n > 0, 1.0).otherwise(0.0).alias("consecutive_emergency_count"),
        F.when(n >= 3, F.greatest(*pairs) * filled / n).otherwise(1.0).alias("temporal_clustering_score"),
    )


def second_cells(alerts: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Stage one of the ordered features: one row per stream and second, final once emitted.

    ``marks`` lists the distinct instants of the second with message and
    emergency counts: at most a million, whatever the number of messages.
    """
    emg = emergency()
    instants = (
        alerts.withWatermark("timestamp", delay)
        .groupBy("stream", F.window("timestamp", "1 second"), micros("timestamp").alias("us"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(emg).alias("e"))
    )
    cells = instants.groupBy("stream", F.window(F.window_time("window"), "1 second").alias("cell")).agg(
        F.collect_list(F.struct("us", "n", "e")).alias("marks")
    )
    return cells.select("stream", F.col("cell.start").alias("cell_time"), "marks")


ORDERED_SCHEMA = (
    "stream string, window_start_time timestamp, n_messages long, n_emergency long, "
    "inter_alert_interval_mean double, inter_interval_variance double, regularity_coefficient double, "
    "alert_rate_acceleration double, freq_persistence_5w double, freq_rolling_mean_5w double, "
    "freq_rolling_std_5w double, sequence array<double>"
)
STATE_SCHEMA = (
    "starts array<long>, n array<long>, e array<long>, first_msg array<long>, first_emg array<long>, "
    "last_emg array<long>, ss array<double>, early array<long>, ring_start array<long>, ring_freq array<double>"
)
_OPEN = ["starts", "n", "e", "first_msg", "first_emg", "last_emg", "ss", "early"]


class _Stream:
    """The open windows of one stream, folded cell by cell in time order."""

    def __init__(self, values: tuple | None, step: int, size: int, gap: int, length: int):
        self.step, self.size, self.gap, self.length = step, size, gap, length
        lists = [list(v) for v in values] if values else [[] for _ in range(10)]
        self.open = [dict(zip(_OPEN, row, strict=True)) for row in zip(*lists[:8], strict=True)]
        self.ring = list(zip(lists[8], lists[9], strict=True))
        self.out: list[dict] = []

    def state(self) -> tuple:
        columns = [[w[c] for w in self.open] for c in _OPEN]
        return (*columns, [s for s, _ in self.ring], [f for _, f in self.ring])

    def add(self, marks: list) -> None:
        for us, n, e in sorted((m["us"], m["n"], m["e"]) for m in marks):
            self.close(us)
            known = {w["starts"] for w in self.open}
            first = us - us % self.step
            for start in range(first - self.size + self.step, first + 1, self.step):
                if start not in known and start + self.size > us:
                    self.open.append(
                        dict(starts=start, n=0, e=0, first_msg=us, first_emg=-1, last_emg=-1, ss=0.0, early=0)
                    )
            for w in self.open:
                if not w["starts"] <= us < w["starts"] + self.size:
                    continue
                w["n"] += n
                if not e:
                    continue
                if w["last_emg"] >= 0:
                    w["ss"] += float(us - w["last_emg"]) ** 2
                else:
                    w["first_emg"] = us
                w["last_emg"] = us
                w["e"] += e
                if us < w["first_msg"] + self.size // 2:
                    w["early"] += e

    def close(self, us: int) -> None:
        """Emit the windows that end at or before ``us``."""
        done = sorted((w for w in self.open if w["starts"] + self.size <= us), key=lambda w: w["starts"])
        self.open = [w for w in self.open if w["starts"] + self.size > us]
        for w in done:
            self.out.append(self._row(w))

    def _row(self, w: dict) -> dict:
        n, reach = w["e"], float(w["last_emg"] - w["first_emg"])
        mean = reach / MINUTE / (n - 1) if n >= 2 else None
        var = 0.0
        if n >= 3:
            m = n - 1
            var = max(m * w["ss"] - reach * reach, 0.0) / (float(MINUTE) ** 2 * m * (m - 1))
        regular = None
        if n >= 3 and var > 1e-18 and mean:
            regular = 1.0 / max(var**0.5 / mean, CV_FLOOR)
        elif n >= 2:
            regular = 1.0 / CV_FLOOR
        if self.ring and w["starts"] - self.ring[-1][0] > self.gap:
            self.ring = []
        self.ring = [*self.ring, (w["starts"], float(n))][-self.length :]
        last = np.array([f for _, f in self.ring[-5:]])
        full = len(last) >= 3
        return {
            "window_start_time": pd.Timestamp(w["starts"], unit="us"),
            "n_messages": w["n"],
            "n_emergency": n,
            "inter_alert_interval_mean": mean,
            "inter_interval_variance": var,
            "regularity_coefficient": regular,
            "alert_rate_acceleration": float(n - 2 * w["early"]) if n >= 4 else 0.0,
            "freq_persistence_5w": float((last > 0).mean()) if full else None,
            "freq_rolling_mean_5w": float(last.mean()) if full else None,
            "freq_rolling_std_5w": float(last.std(ddof=1)) if full else None,
            "sequence": [f for _, f in self.ring] if len(self.ring) == self.length else None,
        }

    def next_end(self) -> int | None:
        return min((w["starts"] + self.size for w in self.open), default=None)


def ordered_features(
    cells: DataFrame,
    step_min: int = 10,
    window_min: int = 60,
    delay: str = "0 seconds",
    max_gap_min: int = 120,
    length: int = 10,
) -> DataFrame:
    """Stage two: interval, regularity, acceleration, rolling and last-ten features per stream.

    Cells arrive final and in time order. State per stream is a few numbers for
    each open window and a ring of the last ten; a gap clears the ring. A
    window is emitted when a later cell or the watermark passes its end.
    """
    names = [c.split()[0] for c in ORDERED_SCHEMA.split(", ")]

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        s = _Stream(held, step_min * MINUTE, window_min * MINUTE, max_gap_min * MINUTE, length)
        cells = pd.concat(list(batches), ignore_index=True) if not state.hasTimedOut else pd.DataFrame()
        if len(cells):
            for marks in cells.sort_values("cell_time")["marks"]:
                s.add(list(marks))
        s.close(state.getCurrentWatermarkMs() * 1000)
        state.update(s.state())
        end = s.next_end()
        if end is not None:
            state.setTimeoutTimestamp(max(end // 1000, state.getCurrentWatermarkMs() + 1))
        if s.out:
            yield pd.DataFrame(s.out).assign(stream=key[0])[names]

    return (
        cells.withWatermark("cell_time", delay)
        .groupBy("stream")
        .applyInPandasWithState(fold, ORDERED_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)
    )


def score_stream(
    windows: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, drop: float = 0.50
):
    """Score and route each micro-batch into ``out``; a batch that runs again replaces its own files."""
    def write(batch: DataFrame, batch_id: int) -> None:
        routed = score(batch).withColumn("route", route(F.col("p"), drop))
        routed.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return windows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def run_to_table(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Process what is there, append the results to ``out`` as Parquet and read it."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
