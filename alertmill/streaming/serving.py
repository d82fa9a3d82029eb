"""The fitted detection as a live route: features, sequences, published models, scores.

Features. ``live_features`` is one chain of native aggregations. Ten-minute panes
count messages, distinct emergency instants, topics and payload bytes; windows
gather the panes' counts, keyed by (stream, window), so a busy stream is spread
over its open windows and no task reads a stream's messages. What a window holds
is bounded by its distinct emergency instants, topics and 256 bytes a pane.

Sequences. Each micro-batch holds all windows that have closed since the last
one. They are put behind the last ten of every stream, which the batch before has
left in a table, and get their rolling features and sequences by plain window
functions over these few rows an hour.

Models. ``publish`` writes a detection as two tables under a new version and only
then names the version in the list of published ones, so a reader never meets
half a model. ``serve`` looks at that list in every micro-batch and takes the
newest; every scored row tells its version.

A batch that runs again reads what the batch before it has left and replaces its
own folders, so each window is written, and scored, once.

Defined cases: a missing message or topic adds no byte or topic; a message that
is no emergency only counts; values missing in a vector are 0 after scaling, as
in the batch; a gap of more than ``max_gap_min`` starts a stream anew; windows
with fewer than ten before them have no sequence and are not scored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from alertmill.functions.scalars import emergency, hex_bytes, micros, utf8_hex, whole
from alertmill.operators import fusion, prep
from alertmill.operators.detectors import SequenceClassifier
from alertmill.operators.forest import IsolationForest, Tree
from alertmill.operators.windows import BIN, CV_FLOOR, MINUTE
from alertmill.plans.pipeline import Detection
from alertmill.schemas import SELECTED_FEATURES

HOUR = 60 * MINUTE


def _facts() -> Column:
    """What a message adds to its pane: itself; of an emergency also its instant, topic and payload bytes."""
    fact = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    none = F.array().cast("array<struct<kind: string, key: string>>")
    given = lambda c, facts: F.when(emergency() & F.col(c).isNotNull(), facts).otherwise(none)
    # a leading zero byte joins the payloads of a window
    payload = F.transform(hex_bytes(F.concat(F.lit("00"), utf8_hex(F.col("message")))), lambda b: fact("byte", b))
    return F.concat(
        F.array(fact("message", F.lit(""))),
        given("timestamp", F.array(fact("instant", micros("timestamp").cast("string")))),
        given("topic", F.array(fact("topic", F.col("topic")))),
        given("message", payload),
    )


def _sum(items: Column, of: str = "n") -> Column:
    return F.aggregate(items, F.lit(0).cast("bigint"), lambda s, x: s + x[of])


def _entropy(counts: Column) -> Column:
    """Of the window's bytes, given as (key, n) per pane; the first zero byte joins nothing."""
    keys = F.array_distinct(F.transform(counts, lambda x: x["key"]))
    total = F.transform(keys, lambda k: (_sum(F.filter(counts, lambda x: x["key"] == k)) - F.when(k == "00", 1).otherwise(0)).cast("double"))
    seen = F.array_sort(F.filter(total, lambda n: n > 0))  # one order, so that sums agree to the last bit
    size = F.aggregate(seen, F.lit(0.0), lambda s, n: s + n)
    return F.aggregate(seen, F.lit(0.0), lambda s, n: s - n / size * F.log2(n / size + 1e-12))


def live_features(alerts: DataFrame, step_min: int = 10, delay: str = "10 minutes") -> DataFrame:
    """Hour windows of each stream, final when the watermark has passed them, with all but the rolling features."""
    if step_min % 10 or 60 % step_min:
        raise ValueError("live windows need a step of ten minutes, or several that make an hour")
    facts = alerts.withWatermark("timestamp", delay).select("stream", "timestamp", micros("timestamp").alias("us"), F.explode(_facts()).alias("f"))
    panes = facts.groupBy("stream", F.window("timestamp", "10 minutes"), "f.kind", "f.key").agg(
        F.count(F.lit(1)).alias("n"), F.min("us").alias("first")
    )
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    windows = panes.groupBy("stream", F.window(F.window_time("window"), "60 minutes", f"{step_min} minutes").alias("hour")).agg(
        F.sum(of("message", F.col("n"))).alias("n_messages"),
        F.min(of("message", F.col("first"))).alias("first_msg"),
        F.array_sort(F.collect_list(of("instant", F.struct(F.col("first").alias("us"), "n")))).alias("marks"),
        F.size(F.collect_set(of("topic", F.col("key")))).cast("double").alias("topic_diversity"),
        F.collect_list(of("byte", F.struct("key", "n"))).alias("bytes"),
    )
    slots = F.transform(
        F.sequence(F.lit(0), F.lit(11)),
        lambda i: _sum(F.filter("marks", lambda m: whole(F.pmod(m["us"], F.lit(HOUR)), BIN) == i)),
    )
    gaps = F.transform(F.sequence(F.lit(1), F.size("marks") - 1), lambda i: (F.get("marks", i)["us"] - F.get("marks", i - 1)["us"]).cast("double"))
    squares = F.aggregate(F.when(F.size("marks") > 1, gaps).otherwise(F.array().cast("array<double>")), F.lit(0.0), lambda s, g: s + g * g)
    reach = F.coalesce(F.get("marks", F.size("marks") - 1)["us"] - F.get("marks", F.lit(0))["us"], F.lit(0)).cast("double")
    early = _sum(F.filter("marks", lambda m: m["us"] < F.col("first_msg") + HOUR // 2))
    w = windows.select("*", _sum(F.col("marks")).alias("e"), slots.alias("slots"), squares.alias("ss"), reach.alias("reach"), early.alias("early"))
    e, m = F.col("e"), F.col("e") - 1
    mean = F.when(e >= 2, F.col("reach") / MINUTE / m)
    spread = F.greatest(m * F.col("ss") - F.col("reach") * F.col("reach"), F.lit(0.0)) / (F.lit(float(MINUTE) ** 2) * m * (m - 1))
    variance = F.when(e >= 3, spread).otherwise(0.0)
    tens = F.transform(F.sequence(F.lit(0), F.lit(10), F.lit(2)), lambda i: F.get("slots", i) + F.get("slots", i + 1))
    filled = F.size(F.filter(tens, lambda n: n > 0))
    regular = F.when((e >= 3) & (variance > 1e-18) & (mean > 0), 1.0 / F.greatest(F.sqrt(variance) / mean, F.lit(CV_FLOOR)))
    return w.select(
        "stream",
        F.col("hour.start").alias("window_start_time"),
        "n_messages",
        e.alias("n_emergency"),
        e.cast("double").alias("alert_frequency_per_hour"),
        ((F.col("n_messages") - e) / F.greatest(F.lit(1), e)).alias("normal_emergency_ratio"),
        mean.alias("inter_alert_interval_mean"),
        variance.alias("inter_interval_variance"),
        F.array_max("slots").cast("double").alias("burst_score"),
        "topic_diversity",
        _entropy(F.col("bytes")).alias("payload_entropy"),
        F.when(e >= 4, e - 2 * F.col("early")).otherwise(0).cast("double").alias("alert_rate_acceleration"),
        F.when(regular.isNotNull(), regular).when(e >= 2, F.lit(1.0 / CV_FLOOR)).alias("regularity_coefficient"),
        F.when(e >= 3, F.array_max(tens) * filled / e).otherwise(1.0).alias("temporal_clustering_score"),
    )


ROLLING = ["freq_persistence_5w", "freq_rolling_mean_5w", "freq_rolling_std_5w"]
LENGTH = 10


def sequenced(
    windows: DataFrame, earlier: DataFrame | None = None, features: Sequence[str] = SELECTED_FEATURES, max_gap_min: int = 120
) -> DataFrame:
    """Windows in a row with rolling features of the last five and ``vectors``, the last ten rows of ``features`` (null before).

    ``earlier``: rows of an earlier result, which come before the new ones; the result holds both, told apart by ``fresh``.
    """
    new = windows.withColumns({c: F.lit(None).cast("double") for c in ROLLING} | {"fresh": F.lit(True)})
    if earlier is not None:
        new = new.unionByName(earlier.select(*windows.columns, *ROLLING).withColumn("fresh", F.lit(False)))
    line = Window.partitionBy("stream").orderBy("window_start_time")
    start = F.unix_micros("window_start_time")
    begins = F.when(start - F.lag(start).over(line) > max_gap_min * MINUTE, 1).otherwise(0)
    rows = new.withColumn("_begins", begins).withColumn("_stretch", F.sum("_begins").over(line))
    own = Window.partitionBy("stream", "_stretch").orderBy("window_start_time")
    five, n = own.rowsBetween(-4, 0), F.col("n_emergency").cast("double")
    rolled = [F.avg(F.when(n > 0, 1.0).otherwise(0.0)).over(five), F.avg(n).over(five), F.stddev_samp(n).over(five)]
    enough = F.col("fresh") & (F.count(F.lit(1)).over(five) >= 3)
    rows = rows.withColumns({c: F.when(enough, r).otherwise(F.col(c)) for c, r in zip(ROLLING, rolled, strict=True)})
    rows = rows.withColumn("_vector", F.array(*[F.col(f).cast("double") for f in features]))
    ten = F.collect_list("_vector").over(own.rowsBetween(-(LENGTH - 1), 0))
    full = F.col("fresh") & (F.size(ten) == LENGTH)
    return rows.withColumn("vectors", F.when(full, F.flatten(ten))).drop("_begins", "_stretch", "_vector")


# --- published models

_NUMBERS = "name string, place int, value double"
_NODES = "tree int, node long, feature int, cut double, left long, depth int, size long"


def publish(spark: SparkSession, model: Detection, folder: str) -> int:
    """Write the model under the next version of ``folder`` and then list it; the number of the version."""
    version = (latest(spark, folder) or 0) + 1
    numbers = {
        "mean": [model.scaler.means[f] for f in model.features],
        "scale": [model.scaler.scales[f] for f in model.features],
        "bounds": list(model.bounds),
        "sample": [model.forest.sample_size],
        "mlp": [float(model.sequence.kind == "mlp")],
        "layers": model.sequence.layers,
        "weights": model.sequence.weights.tolist(),
        "platt": [model.platt_forest.slope, model.platt_forest.intercept, model.platt_sequence.slope, model.platt_sequence.intercept],
        "temperature": [model.temperature],
        "gate": [model.gate.delta, model.gate.alpha, model.gate.f1, model.gate.auc, model.gate.met_limit],
        "youden": [model.youden],
    }
    rows = [(n, i, float(v)) for n, values in numbers.items() for i, v in enumerate(values)]
    rows += [(f"feature:{f}", i, 0.0) for i, f in enumerate(model.features)]
    spark.createDataFrame(rows, _NUMBERS).write.mode("overwrite").parquet(f"{folder}/numbers/version={version}")
    nodes = [
        (k, i, *(int(x) if j != 1 else float(x) for j, x in enumerate(node)))
        for k, t in enumerate(model.forest.trees)
        for i, node in enumerate(zip(t.feature, t.cut, t.left, t.depth, t.size, strict=True))
    ]
    spark.createDataFrame(nodes, _NODES).write.mode("overwrite").parquet(f"{folder}/nodes/version={version}")
    spark.createDataFrame([(version,)], "version int").write.mode("append").parquet(f"{folder}/published")
    return version


def latest(spark: SparkSession, folder: str) -> int | None:
    """The newest published version; None before the first."""
    if not _exists(spark, f"{folder}/published"):
        return None
    return spark.read.schema("version int").parquet(f"{folder}/published").agg(F.max("version")).first()[0]


def load(spark: SparkSession, folder: str, version: int) -> Detection:
    """A published model. Its tables are bounded by the trees, their samples and the layers."""
    found: dict[str, list[float]] = {}
    for r in spark.read.schema(_NUMBERS).parquet(f"{folder}/numbers/version={version}").orderBy("name", "place").collect():
        found.setdefault(r["name"], []).append(r["value"])
    names = spark.read.schema(_NUMBERS).parquet(f"{folder}/numbers/version={version}").filter("name LIKE 'feature:%'").orderBy("place")
    features = [r["name"].removeprefix("feature:") for r in names.collect()]
    nodes = spark.read.schema(_NODES).parquet(f"{folder}/nodes/version={version}").orderBy("tree", "node").toPandas()
    trees = []
    for _, t in nodes.groupby("tree", sort=True):
        tree = Tree(seed=0, rate=0.0, allowed=())
        tree.feature, tree.cut, tree.left, tree.depth, tree.size = (t[c].tolist() for c in ("feature", "cut", "left", "depth", "size"))
        trees.append(tree)
    scaler = prep.Standardiser(dict(zip(features, found["mean"], strict=True)), dict(zip(features, found["scale"], strict=True)))
    kind = "mlp" if found["mlp"][0] else "logistic"
    sequence = SequenceClassifier(kind, [int(x) for x in found["layers"]], np.array(found["weights"]))
    a, b, c, d = found["platt"]
    gate = fusion.Gate(*found["gate"][:4], bool(found["gate"][4]))
    forest = IsolationForest(features, trees, found["sample"][0])
    none = spark.createDataFrame([], "p double")
    return Detection(
        features, scaler, forest, (found["bounds"][0], found["bounds"][1]), sequence, fusion.Platt(a, b), fusion.Platt(c, d),
        found["temperature"][0], gate, found["youden"][0], none,
    )


def scored(model: Detection, rows: DataFrame) -> DataFrame:
    """Windows with ``vectors``: forest, sequence and gated scores, as the batch gives them."""
    full = rows.filter("vectors IS NOT NULL")
    means = F.array(*[F.lit(float(model.scaler.means[f])) for f in model.features])
    scales = F.array(*[F.lit(float(model.scaler.scales[f])) for f in model.features])
    width = len(model.features)
    scaled = F.transform(
        "vectors",
        lambda x, i: F.coalesce(F.nanvl((x - F.get(means, i % width)) / F.get(scales, i % width), F.lit(None)), F.lit(0.0)),
    )
    sequence = F.array(scaled)  # flattened again by the classifier
    both = model.sequence.transform(model.forest.transform(model.scaler.transform(full.withColumn("sequence", sequence))), "raw_sequence")
    raw = both.withColumn("raw_forest", prep.unit_range(F.col("score"), *model.bounds))
    return model.calibrate(raw).drop("sequence", "vectors", "score")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def serve(windows: DataFrame, out: str, checkpoint: str, models: str | None = None, drop: float = 0.50) -> DataStreamWriter:
    """A writer to start: per micro-batch of ``live_features``, the folders ``windows``, ``last`` and, with ``models``, ``scores`` under ``out``.

    Scores come from the newest model published in ``models``, with its version and the route of each window.
    """
    held: dict[int, Detection] = {}

    def newest(spark: SparkSession) -> int:
        version = latest(spark, models)
        if version is None:
            raise RuntimeError(f"no model is published in {models}")
        if version not in held:
            held.clear()
            held[version] = load(spark, models, version)
        return version

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        path = lambda name, k: f"{out}/{name}/batch={k}"
        before = path("last", batch_id - 1)
        earlier = spark.read.parquet(before) if _exists(spark, before) else None
        rows = sequenced(batch, earlier)
        rows.write.mode("overwrite").parquet(path("both", batch_id))  # the batch is worked out once
        rows = spark.read.schema(rows.schema).parquet(path("both", batch_id))
        rows.filter("fresh").drop("fresh").write.mode("overwrite").parquet(path("windows", batch_id))
        line = Window.partitionBy("stream").orderBy(F.col("window_start_time").desc())
        last = rows.withColumn("_place", F.row_number().over(line)).filter(F.col("_place") <= LENGTH)
        last.drop("_place", "vectors", "fresh").write.mode("overwrite").parquet(path("last", batch_id))
        if models is not None:
            version = newest(spark)
            found = scored(held[version], rows.filter("fresh").drop("fresh")).withColumn("version", F.lit(version))
            found.withColumn("route", fusion.route(F.col("p"), drop)).write.mode("overwrite").parquet(path("scores", batch_id))

    return windows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
