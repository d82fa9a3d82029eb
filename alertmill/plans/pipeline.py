"""The three end-to-end jobs: features, calibrated detection, transfer to foreign logs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertmill.operators import fusion, metrics, prep, rolling, sensor, splits, stats
from alertmill.operators.detectors import ReconstructionDetector, SequenceClassifier
from alertmill.operators.forest import IsolationForest, target_forest
from alertmill.operators.sequences import padded_sequences, sliding_sequences
from alertmill.operators.windows import CAPTURES, WindowConfig, deduplicate_windows, extract_windows
from alertmill.schemas import SELECTED_FEATURES, WINDOW_FEATURES
from alertmill.session import settle

ORDER = ["window_start_time", "window_id"]


def build_features(
    alerts: DataFrame, configs: Sequence[WindowConfig] = CAPTURES, seed: int = 42, check: bool = True
) -> DataFrame:
    """Alert captures to the labelled feature table with ``split`` and rolling columns.

    Windows, duplicates out, split in time, attack classes of the training part
    balanced, gaps filled and tails clipped by training values, rolling columns.
    """
    windows = extract_windows(alerts, configs).withColumn(
        "window_id", F.concat_ws(":", "stream", F.col("window_no").cast("string"))
    )
    unique = [c.stream for c in configs if c.deduplicate]
    split = settle(splits.chronological_split(deduplicate_windows(windows, unique)), "split")
    train = splits.balance(split.filter("split = 'train'"), "window_id", seed=seed)
    filler = prep.MedianClip.fit(train, WINDOW_FEATURES)
    table = filler.transform(train.unionByName(split.filter("split = 'test'")))
    if check:
        prep.integrity(table, WINDOW_FEATURES)
    return rolling.sequential_features(table)


@dataclass
class Detection:
    """Fitted parts of the calibrated ensemble."""

    features: list[str]
    scaler: prep.Standardiser
    forest: IsolationForest
    bounds: tuple[float, float]
    sequence: SequenceClassifier
    platt_forest: fusion.Platt
    platt_sequence: fusion.Platt
    temperature: float
    gate: fusion.Gate
    youden: float
    scored: DataFrame = field(repr=False)

    def raw_scores(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Forest and sequence scores of every row that ends a gap-free sequence."""
        scaled = self.scaler.transform(df)
        seqs = sliding_sequences(scaled, keys, ORDER, self.features, ts="window_start_time")
        both = self.sequence.transform(self.forest.transform(seqs), "raw_sequence")
        return both.withColumn("raw_forest", prep.unit_range(F.col("score"), *self.bounds))

    def calibrate(self, df: DataFrame) -> DataFrame:
        p_seq = fusion.apply_temperature(self.platt_sequence.apply(F.col("raw_sequence")), self.temperature)
        return (
            df.withColumn("p_forest", self.platt_forest.apply(F.col("raw_forest")))
            .withColumn("p_sequence", p_seq)
            .withColumn("p", self.gate.apply(F.col("p_forest"), F.col("p_sequence")))
        )


def fit_detection(
    table: DataFrame,
    features: Sequence[str] = SELECTED_FEATURES,
    n_trees: int = 100,
    kind: str = "mlp",
    max_iter: int = 60,
    seed: int = 42,
) -> Detection:
    """Fit on zone A, calibrate on zone B; ``scored`` holds zones B and C."""
    features = list(features)
    zoned = settle(splits.zones(table.withColumn("y", F.col("label"))), "zones")
    fit_rows = zoned.filter("zone = 'A'")
    normal_fit = fit_rows.filter("y = 1")
    scaler = prep.Standardiser.fit(normal_fit, features)
    forest = IsolationForest.fit(scaler.transform(normal_fit), features, "window_id", n_trees, seed=seed)
    train = settle(
        sliding_sequences(scaler.transform(fit_rows), ["zone"], ORDER, features, ts="window_start_time"), "train_seq"
    )
    sequence = SequenceClassifier.fit(train, "window_id", kind=kind, max_iter=max_iter, seed=seed)
    calibration = forest.transform(scaler.transform(zoned.filter("zone = 'B' AND y = 1")))
    bounds = prep.score_bounds(calibration, "score")
    none = fusion.Platt(1.0, 0.0)
    model = Detection(
        features, scaler, forest, bounds, sequence, none, none, 1.0, fusion.Gate(1.0, 0.0, 0.0, 0.0, False), 0.5, zoned
    )
    raw = settle(model.raw_scores(zoned.filter("zone IN ('B', 'C')"), ["zone"]).drop("sequence"), "raw")
    b = raw.filter("zone = 'B'")
    model.platt_forest = fusion.Platt.fit(b, "raw_forest")
    model.platt_sequence = fusion.Platt.fit(b, "raw_sequence")
    platted = b.withColumn("p_seq", model.platt_sequence.apply(F.col("raw_sequence")))
    model.temperature = fusion.fit_temperature(platted, "p_seq")
    half = model.calibrate(b)
    model.gate = fusion.search_gate(half, "p_forest", "p_sequence")
    model.scored = settle(model.calibrate(raw), "scored")
    fixed = model.scored.filter("zone = 'B'").withColumn("_k", F.lit(0))
    model.youden = metrics.youden(fixed, ["_k"]).first()["threshold"]
    return model


def detection_report(model: Detection, threshold: float = 0.5) -> DataFrame:
    """Held-out metrics of both parts and the ensemble, with intervals."""
    named = F.array(
        *[
            F.struct(F.lit(n).alias("model"), F.col(c).alias("p"))
            for n, c in [("forest", "p_forest"), ("sequence", "p_sequence"), ("ensemble", "p")]
        ]
    )
    rows = model.scored.filter("zone = 'C'").select("window_id", "y", "attack_type", F.inline(named))
    r = metrics.report(rows, ["model"], threshold).join(metrics.ece(rows, ["model"]), "model")
    r = r.join(metrics.bhattacharyya(rows, ["model"]), "model")
    r = r.withColumn("n_attack", F.col("n_attack_detected") + F.col("n_attack_missed"))
    r = r.withColumn("n_normal", F.col("n_normal_flagged") + F.col("n_normal_accepted"))
    return stats.share_interval(stats.auc_interval(r, "n_attack", "n_normal"), "n_attack_detected", "n_attack")


# Weights used when target labels must not be read.
FIXED_WEIGHTS = {"gate": 0.65, "ae": 0.15, "tas": 0.15, "tgt_if": 0.05}
COMPONENTS = {"gate": "p_gate", "ae": "p_ae", "tas": "p_tas", "tgt_if": "p_target"}


def transfer(
    readings: DataFrame,
    source: DataFrame,
    model: Detection,
    min_rows: int = 10,
    label_free: bool = True,
    threshold: float = 0.55,
) -> DataFrame:
    """Apply a fitted detector to foreign sensor logs; one result row per dataset.

    ``source``: normal windows of the home domain. By default no target label
    is read before the metrics. ``label_free=False`` orients the parts and
    weighs them by their class separation instead, for parity studies.
    """
    feats = model.features
    home = settle(source.filter("label = 1"), "home")
    windows = sensor.sensor_windows(readings, min_rows=min_rows)
    windows = windows.withColumn("y", F.col("label")).withColumn(
        "window_id", F.concat_ws(":", F.col("dataset").cast("string"), F.date_format("window_start_time", "yyyyMMddHH"))
    )
    windows = settle(prep.with_missing_zero(windows, feats), "foreign")
    z = settle(prep.zscore_by(windows, "dataset", feats), "foreign_z")
    home_z = settle(prep.zscore_by(home.withColumn("_h", F.lit(0)), "_h", feats), "home_z")
    errors = ReconstructionDetector.fit(home_z, feats, k=min(4, len(feats) - 1))
    robust = prep.RobustScaler.fit(home, feats)
    source_forest = IsolationForest.fit(robust.transform(home), feats, "window_id", len(model.forest.trees))
    lo, hi = prep.score_bounds(source_forest.transform(robust.transform(home)), "score", 0.02, 0.98)
    p_forest = source_forest.transform(robust.transform(windows), "source_score").select(
        "window_id",
        "source_score",
        model.platt_forest.apply(prep.unit_range(F.col("source_score"), lo, hi)).alias("p_forest"),
    )
    parts: DataFrame | None = None
    for (name,) in z.select("dataset").distinct().orderBy("dataset").collect():
        mine = z.filter(F.col("dataset") == name)
        aligned = settle(prep.CoralAligner.fit(home_z, mine, feats).transform(mine, feats), "aligned")
        seqs = padded_sequences(aligned, "dataset", ["window_start_time"], feats)
        raw = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), F.col("raw")))
        p_seq = fusion.apply_temperature(model.platt_sequence.apply(raw), model.temperature)
        one = model.sequence.transform(seqs, "raw").withColumn("p_sequence", p_seq)
        one = settle(errors.transform(one), "parts")
        cut = fusion.mixture_threshold(one, "ae_z")
        one = one.withColumn("p_ae", fusion.error_probability(F.col("ae_z"), cut))
        target = settle(
            target_forest(mine, feats, "window_id").transform(mine, "target_score").select("window_id", "dataset", "target_score"),
            "target",
        )
        target = target.withColumn("_cut", F.lit(fusion.mixture_threshold(target, "target_score")))
        target = fusion.target_score(target, ["dataset"], "target_score", "_cut", "p_target")
        one = one.join(target.select("window_id", "p_target"), "window_id")
        one = one.select("window_id", "dataset", "y", "attack_type", "p_sequence", "p_ae", "p_target")
        parts = one if parts is None else parts.unionByName(one)
    tas = rolling.neighbour_deviation(z, "dataset", ["window_start_time"], feats)
    tas = tas.select("window_id", fusion.neighbour_probability(F.col("tas")).alias("p_tas"))
    scored = settle(parts.join(p_forest, "window_id").join(tas, "window_id"), "components")
    if not label_free:
        for p in ("p_forest", "p_sequence", "p_ae", "p_tas", "p_target"):
            scored = settle(fusion.orient(scored, ["dataset"], p), "oriented")
    gated = scored.withColumn("p_gate", model.gate.apply(F.col("p_forest"), F.col("p_sequence")))
    if label_free:
        weights = {n: F.lit(w) for n, w in FIXED_WEIGHTS.items()}
        fused = gated
    else:
        fused = gated.join(separating_weights(gated), "dataset")
        weights = {n: F.col(f"w_{n}") for n in COMPONENTS}
    fused = fused.withColumn("p", sum((F.col(c) * weights[n] for n, c in COMPONENTS.items()), F.lit(0.0)))
    fused = settle(fused, "fused")
    return transfer_report(fused, threshold)


def separating_weights(gated: DataFrame) -> DataFrame:
    """Weights per dataset by class separation; the target forest only joins where it separates. Reads labels."""
    use = fusion.separation(gated, ["dataset"], "p_target").select("dataset", "enabled")
    rows = gated.join(use, "dataset")
    three = {n: c for n, c in COMPONENTS.items() if n != "tgt_if"}
    with_target = fusion.best_weights(fusion.weight_table(rows.filter("enabled"), ["dataset"], COMPONENTS), ["dataset"])
    without = fusion.best_weights(fusion.weight_table(rows.filter("NOT enabled"), ["dataset"], three), ["dataset"])
    return with_target.unionByName(without.withColumn("w_tgt_if", F.lit(0.0)))


def transfer_report(fused: DataFrame, threshold: float = 0.55) -> DataFrame:
    """Fixed, adaptive, best and limited-alarm operating points per dataset, and the verdict."""
    k = ["dataset"]
    fixed = metrics.report(fused, k, threshold).select("dataset", "auc", "tpr", "fpr", "f1", "n_attack_detected")
    adaptive = fusion.adaptive_threshold(fused, "dataset", "p", "source_score")
    adaptive = adaptive.withColumnRenamed("threshold", "tau_adaptive")
    best = metrics.best_f1_threshold(metrics.threshold_table(fused, k, metrics.F1_GRID), k)
    best = best.select("dataset", F.col("threshold").alias("threshold_optimal"), F.col("f1").alias("f1_optimal"))
    at15 = metrics.recall_at_fpr(metrics.threshold_table(fused, k, metrics.FPR_GRID), k)
    at15 = at15.select(
        "dataset",
        F.col("threshold").alias("threshold_15fpr"),
        F.col("tpr").alias("tpr_at_15fpr"),
        F.col("fpr").alias("fpr_at_15fpr"),
    )
    behavioural = metrics.auc(metrics.behavioural_rows(fused), k).withColumnRenamed("auc", "auc_behavioral")
    out = fixed.withColumnRenamed("auc", "auc_all")
    for part in (adaptive, best, at15, behavioural):
        out = out.join(part, k, "left")
    return out.withColumn(
        "verdict", metrics.verdict(F.coalesce("auc_behavioral", "auc_all"), F.col("fpr_at_15fpr"))
    )
