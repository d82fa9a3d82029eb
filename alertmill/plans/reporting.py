"""Everything that is reported on held-out scores, as one long table (section, model, measure, value)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertmill.operators import metrics, runs, stats
from alertmill.plans.pipeline import ORDER, Detection
from alertmill.session import settle

MODELS = {"forest": "p_forest", "sequence": "p_sequence", "ensemble": "p"}


def by_model(scored: DataFrame, parts: dict[str, str], keep: Sequence[str]) -> DataFrame:
    named = [F.struct(F.lit(n).alias("model"), F.col(c).alias("_p")) for n, c in parts.items()]
    return scored.select(*keep, F.inline(F.array(*named))).withColumnRenamed("_p", "p")


def point_table(scored: DataFrame, parts: dict[str, str], keys: Sequence[str], points: dict[str, float]) -> DataFrame:
    """Counts and rates of every model at every named threshold, with exact intervals of both rates."""
    rows = by_model(scored, parts, [*keys, "y"])
    by = [*keys, "model"]
    tables = [metrics.confusion(rows, by, t).select("*", F.lit(n).alias("point"), F.lit(float(t)).alias("threshold")) for n, t in points.items()]
    r = reduce(DataFrame.unionByName, tables)
    r = r.withColumn("n_attack", F.col("n_attack_detected") + F.col("n_attack_missed"))
    r = r.withColumn("n_normal", F.col("n_normal_flagged") + F.col("n_normal_accepted"))
    for rate, hits, size in (("tpr", "n_attack_detected", "n_attack"), ("fpr", "n_normal_flagged", "n_normal")):
        r = stats.share_interval(r, hits, size).withColumnsRenamed({"ci_lo": f"{rate}_lo", "ci_hi": f"{rate}_hi"})
    return r


def pair_table(scored: DataFrame, parts: dict[str, str], keys: Sequence[str], threshold: float) -> DataFrame:
    """McNemar's test of every two models at one threshold: what only the first, and only the second, gets right."""
    out = []
    for first, second in combinations(parts, 2):
        right = [(F.col(parts[m]) < threshold) == (F.col("y") == 0) for m in (first, second)]
        out.append(stats.mcnemar(scored, keys, *right).withColumn("model", F.lit(f"{first}/{second}")))
    return reduce(DataFrame.unionByName, out)


def delay_table(
    scored: DataFrame, parts: dict[str, str], keys: Sequence[str], order: Sequence[str], threshold: float, step_minutes: int = 10
) -> DataFrame:
    """Detection of contiguous attack runs by every model: how many, how soon."""
    rows = by_model(scored, parts, [*keys, *order, "y"])
    found = settle(runs.detection_runs(rows, [*keys, "model"], order, F.col("p") < threshold), "runs")
    return runs.summarise_runs(found, [*keys, "model"], step_minutes)


def regime_table(
    scored: DataFrame, parts: dict[str, str], keys: Sequence[str], order: Sequence[str], number: str, flooding: Column, slow: Column
) -> DataFrame:
    """AUC of every model in four regimes on the same rows: flooding, isolated attacks, early slow ones, cold starts.

    ``number`` counts the rows in order; a break in it is a cold start. A regime
    without one of the classes has no AUC.
    """
    slim = settle(scored.select(*dict.fromkeys([*keys, *order, number, "y", "attack_type", *parts.values()])), "regimes")
    normals = slim.filter("y = 1")
    regimes = {
        "flooding": slim.filter((F.col("y") == 1) | flooding),
        "isolated": normals.unionByName(runs.isolated_attacks(slim, keys, order)),
        "early": normals.unionByName(runs.early_run_rows(slim, keys, order, (F.col("y") == 0) & slow)),
        "cold_start": runs.cold_starts(slim, keys, number),
    }
    tagged = [by_model(d, parts, [*keys, "y"]).withColumn("regime", F.lit(n)) for n, d in regimes.items()]
    by = ["regime", *keys, "model"]
    return metrics.auc(reduce(DataFrame.unionByName, tagged), by)


def _long(df: DataFrame, section: Column, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    rows = [F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures]
    return df.select(*keys, section.alias("section"), "model", F.inline(F.array(*rows)))


def evaluation(
    scored: DataFrame,
    parts: dict[str, str],
    keys: Sequence[str],
    order: Sequence[str],
    number: str,
    points: dict[str, float],
    flooding: Column,
    slow: Column,
    threshold: float = 0.5,
) -> DataFrame:
    """All tables of this module and the threshold-free measures, one row per (keys, section, model, measure).

    ``scored``: y (1 normal), attack_type and a probability column per model.
    """
    keys = list(keys)
    scored = settle(scored, "evaluated")
    rows = by_model(scored, parts, [*keys, "y"])
    by = [*keys, "model"]
    steps = metrics.score_steps(rows, by)
    free = metrics.auc_of(steps, by).join(metrics.average_precision_of(steps, by), by)
    free = free.join(metrics.ece(rows, by), by).join(metrics.bhattacharyya(rows, by), by)
    at = point_table(scored, parts, keys, points)
    counts = ["n_attack_detected", "n_attack_missed", "n_normal_flagged", "n_normal_accepted"]
    tables = [
        _long(free, F.lit("scores"), keys, ["auc", "average_precision", "ece", "bhattacharyya"]),
        _long(at, F.concat(F.lit("point:"), "point"), keys, ["threshold", *counts, "tpr", "tpr_lo", "tpr_hi", "fpr", "fpr_lo", "fpr_hi", "f1"]),
        _long(pair_table(scored, parts, keys, threshold), F.lit("mcnemar"), keys, ["b", "c", "chi2", "p_value", "power"]),
        _long(
            delay_table(scored, parts, keys, order, threshold),
            F.lit("delay"),
            keys,
            ["n_runs", "n_detected", "detection_rate", "median_delay_min", "p90_delay_min", "early_detect_1w"],
        ),
        _long(
            regime_table(scored, parts, keys, order, number, flooding, slow), F.concat(F.lit("regime:"), "regime"), keys, ["auc"]
        ),
    ]
    return reduce(DataFrame.unionByName, tables)


def detection_evaluation(model: Detection, threshold: float = 0.5) -> DataFrame:
    """The held-out zone of a fitted detector, at the fixed threshold and at Youden's of the calibration zone."""
    held_out = model.scored.filter("zone = 'C'")
    points = {"fixed": threshold, "youden": model.youden}
    family = F.col("attack_type")
    flooding, slow = F.coalesce(family == "flooding", F.lit(False)), F.coalesce(family == "slow_poisoning", F.lit(False))
    return evaluation(held_out, MODELS, ["zone"], ORDER, "end_id", points, flooding, slow, threshold)
