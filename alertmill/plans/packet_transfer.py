"""A fitted detector on foreign packet captures: windows, scores of five parts, one result row per kind of attack."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertmill.functions.scalars import finite_or_zero
from alertmill.operators import fusion, metrics, packets, prep, rolling
from alertmill.operators.detectors import ReconstructionDetector
from alertmill.operators.forest import IsolationForest, target_forest
from alertmill.operators.ordered import hashed_rank, shuffle_token
from alertmill.operators.sequences import padded_sequences
from alertmill.plans.pipeline import COMPONENTS, FIXED_WEIGHTS, Detection
from alertmill.session import settle

ALL_ATTACKS = "ALL_ATTACKS"
#: Columns with long tails, taken as log(1 + |x|) before robust scaling.
SKEWED = ("payload_entropy", "freq_rolling_std_5w", "alert_rate_acceleration")
PARTS = {"src_if": "p_forest", "sequence": "p_sequence", "gate": "p_gate", "ae": "p_ae", "tas": "p_tas", "tgt_if": "p_target"}
ORDER = ["_side", "capture", "window_no"]


def capture_windows(logs: DataFrame, normal: str = "normal", capture: str = "capture", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Window features of every capture, with y (1 for the capture named ``normal``), attack_type and window_id."""
    cut = packets.packet_windows(logs, order, keys=[capture])
    rows = packets.packet_rolling(packets.packet_features(cut, [capture]), [capture])
    y = F.when(F.col(capture) == normal, 1).otherwise(0)
    named = rows.withColumnRenamed(capture, "capture") if capture != "capture" else rows
    return named.withColumn("y", y).withColumn("attack_type", F.col("capture")).withColumn(
        "window_id", F.concat_ws(":", "capture", F.col("window_no").cast("string"))
    )


def evaluation_sets(windows: DataFrame, ratio: int = 4, least: int = 50, least_all: int = 100, seed: int = 42) -> DataFrame:
    """The windows by ``dataset``: one per kind of attack and one of all attacks, normals thinned to ``ratio`` per attack.

    Normals are ranked once; a dataset takes those up to its own limit, so a row
    is repeated by the kinds of attack only. Without attacks there is no dataset.
    """
    attacks = windows.filter("y = 0")
    sets = attacks.withColumn("dataset", F.col("attack_type")).unionByName(attacks.withColumn("dataset", F.lit(ALL_ATTACKS)))
    floor = F.when(F.col("dataset") == ALL_ATTACKS, least_all).otherwise(least)
    limits = sets.groupBy("dataset").agg(F.count(F.lit(1)).alias("n")).withColumn("most", F.greatest(F.col("n") * ratio, floor)).collect()
    normals = hashed_rank(windows.filter("y = 1"), [], shuffle_token(seed, "window_id"), "window_id")
    into = [F.when(F.col("_rank") <= r["most"], F.lit(r["dataset"])) for r in limits]
    wanted = F.array_compact(F.array(*into)) if into else F.array().cast("array<string>")
    taken = normals.withColumn("dataset", F.explode(wanted))
    return sets.unionByName(taken.select(*sets.columns))


def _by_dataset(z: DataFrame, home_z: DataFrame, model: Detection, errors: ReconstructionDetector) -> DataFrame:
    """Scores whose fit is the dataset's own; one short job for each kind of attack, as their number is that of the kinds."""
    feats = model.features
    parts = []
    for (name,) in z.select("dataset").distinct().orderBy("dataset").collect():
        mine = z.filter(F.col("dataset") == name)
        aligner = prep.CoralAligner.fit(home_z, mine, feats, packet=True)
        aligned = settle(aligner.transform(mine, feats).withColumns({f: finite_or_zero(F.col(f)) for f in feats}), "aligned")
        one = model.sequence.transform(padded_sequences(aligned, "dataset", ORDER, feats), "raw")
        one = settle(errors.transform(one).select("window_id", "raw", "ae_z"), "parts")
        cut = fusion.mixture_threshold(one, "ae_z")
        forest = target_forest(mine, feats, "window_id", euclidean=True)
        target = settle(forest.transform(mine, "target_score").select("window_id", "dataset", "target_score"), "target")
        target = target.withColumn("_cut", F.lit(fusion.mixture_threshold(target, "target_score")))
        target = fusion.target_score(target, ["dataset"], "target_score", "_cut", "p_target")
        one = one.select("window_id", "raw", fusion.error_probability(F.col("ae_z"), cut).alias("p_ae"))
        parts.append(target.join(one, "window_id").withColumn("coral_ok", F.lit(aligner.applied)))
    return settle(reduce(DataFrame.unionByName, parts).drop("target_score", "_cut"), "own_fits")


def packet_scores(windows: DataFrame, source: DataFrame, model: Detection, label_free: bool = True) -> DataFrame:
    """Every evaluation window with the probability of each part, and ``p`` of all together.

    ``source``: labelled windows of the home domain. With ``label_free=False``
    parts are turned the right way round and weighed by their squared AUC gain,
    and the target forest only joins where it separates: this reads labels.
    """
    feats = model.features
    home = settle(source.filter("label = 1"), "home")
    sets = evaluation_sets(windows).withColumns({f: finite_or_zero(F.col(f).cast("double")) for f in feats})
    sets = settle(sets.withColumn("_side", 1 - F.col("y")), "packet_sets")
    if sets.isEmpty():
        raise ValueError("no attack window to evaluate")
    robust = prep.RobustScaler.fit(home, feats, [f for f in SKEWED if f in feats])
    forest = IsolationForest.fit(robust.transform(home), feats, "window_id", len(model.forest.trees))
    lo, hi = prep.score_bounds(forest.transform(robust.transform(home)), "score", 0.02, 0.98)
    z = settle(prep.zscore_by(sets, "dataset", feats), "packet_z")
    home_z = settle(prep.zscore_by(home.withColumn("_h", F.lit(0)), "_h", feats), "home_z")
    errors = ReconstructionDetector.fit(home_z, feats, k=min(4, len(feats) - 1))
    own = _by_dataset(z, home_z, model, errors)
    key = ["dataset", "window_id"]
    scored = forest.transform(robust.transform(sets), "_score").select(
        *key, "y", "attack_type", prep.unit_range(F.col("_score"), lo, hi).alias("p_forest")
    )
    tas = rolling.neighbour_distance(z, ["dataset"], ORDER, feats)
    tas = tas.select(*key, fusion.neighbour_probability(F.col("tas")).alias("p_tas"))
    raw = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), F.col("raw")))
    tempered = own.withColumn("p_sequence", fusion.apply_temperature(raw, model.temperature)).drop("raw")
    scored = settle(scored.join(tempered, key).join(tas, key), "packet_parts")
    if not label_free:
        for p in ("p_forest", "p_sequence", "p_ae", "p_tas", "p_target"):
            scored = settle(fusion.orient(scored, ["dataset"], p), "oriented")
    scored = scored.withColumn("p_forest", model.platt_forest.apply(F.col("p_forest")))
    scored = scored.withColumn("p_sequence", model.platt_sequence.apply(F.col("p_sequence")))
    scored = scored.withColumn("p_gate", fusion.confidence_blend(F.col("p_forest"), F.col("p_sequence")))
    if label_free:
        weighed, weights = scored, {n: F.lit(w) for n, w in FIXED_WEIGHTS.items()}
    else:
        scored = settle(scored, "gated")
        weighed = scored.join(gain_weights(scored), "dataset")
        weights = {n: F.coalesce(F.col(f"w_{n}"), F.lit(0.0)) for n in COMPONENTS}
    total = sum((F.col(c) * weights[n] for n, c in COMPONENTS.items()), F.lit(0.0))
    return settle(weighed.withColumn("p", total).drop(*[f"w_{n}" for n in COMPONENTS]), "packet_scored")


def long_parts(scored: DataFrame, parts: dict[str, str]) -> DataFrame:
    named = F.array(*[F.struct(F.lit(n).alias("part"), F.col(c).alias("p")) for n, c in parts.items()])
    return scored.select("dataset", "window_id", "y", F.inline(named))


def gain_weights(scored: DataFrame) -> DataFrame:
    """Per dataset a weight of each part by its squared AUC gain. Reads labels."""
    use = fusion.separation(scored, ["dataset"], "p_target").select("dataset", "enabled")
    aucs = metrics.auc(long_parts(scored, COMPONENTS), ["dataset", "part"], one_class=0.5)
    aucs = aucs.join(use, "dataset").filter((F.col("part") != "tgt_if") | F.col("enabled"))
    weights = fusion.auc_weights(aucs, ["dataset"])
    picks = [F.max(F.when(F.col("part") == n, F.col("weight"))).alias(f"w_{n}") for n in COMPONENTS]
    return weights.groupBy("dataset").agg(*picks)


def packet_report(scored: DataFrame, threshold: float = 0.55, limit: float = 0.15) -> DataFrame:
    """Per dataset: sizes, AUC of every part, rates at the threshold, and the low-percentile one that reads no label.

    ``tpr_at_limit`` is the largest share of normals accepted while at most
    ``limit`` of the attacks pass.
    """
    k = ["dataset"]
    parts = {**PARTS, "ensemble": "p"}
    aucs = metrics.auc(long_parts(scored, parts), ["dataset", "part"], one_class=0.5)
    wide = aucs.groupBy("dataset").agg(*[F.max(F.when(F.col("part") == n, F.col("auc"))).alias(f"auc_{n}") for n in parts])
    rates = metrics.confusion(long_parts(scored, {n: parts[n] for n in ("src_if", "sequence", "ensemble")}), ["dataset", "part"], threshold)
    at = [F.max(F.when(F.col("part") == n, F.col(c))).alias(f"{c}_{n}") for n in ("src_if", "sequence", "ensemble") for c in ("tpr", "fpr", "f1")]
    sizes = scored.groupBy(*k).agg(
        F.count_if(F.col("y") == 1).alias("n_normal"), F.count_if(F.col("y") == 0).alias("n_attack"), F.bool_and("coral_ok").alias("coral_ok")
    )
    best = metrics.normal_recall_at(scored, k, limit).withColumnRenamed("best_tpr", "tpr_at_limit")
    low = fusion.low_percentile_threshold(scored, k, "p").withColumnRenamed("threshold", "low_threshold")
    return reduce(lambda a, b: a.join(b, k), [wide, rates.groupBy(*k).agg(*at), best, low], sizes)


def transfer_packets(
    logs: DataFrame, source: DataFrame, model: Detection, normal: str = "normal", label_free: bool = True, threshold: float = 0.55
) -> DataFrame:
    """From the packet logs of several captures to one result row per kind of attack and one of all."""
    windows = settle(capture_windows(logs, normal), "packet_windows")
    return packet_report(packet_scores(windows, source, model, label_free), threshold)
