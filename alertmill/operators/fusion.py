"""Score fusion, calibration parameters, thresholds and routing."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertmill.functions.scalars import clip, logit, sigmoid
from alertmill.operators import metrics
from alertmill.operators.ordered import quantiles

# The gate search grid.
GATE_DELTAS = [float(d) for d in np.arange(0.05, 0.70, 0.05)]
GATE_ALPHAS = [0.00, 0.10, 0.20, 0.30, 0.40, 0.50, 0.60, 0.75, 1.00]


def gate(p_forest: Column, p_sequence: Column, delta: Column | float, alpha: Column | float) -> Column:
    """Sequence score, softened by the forest where the two disagree by ``delta`` and the sequence alarms."""
    alpha = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    apart, alarm = F.abs(p_sequence - p_forest) >= delta, p_sequence < 0.5
    return (
        F.when(apart & alarm & (p_forest >= 0.5), (1.0 - alpha) * p_sequence + alpha * p_forest)
        .when(apart & alarm & (p_forest < 0.5), 0.6 * p_sequence + 0.4 * p_forest)
        .otherwise(p_sequence)
    )


def gate_table(
    df: DataFrame,
    p_forest: str = "p_if",
    p_sequence: str = "p_lstm",
    y: str = "y",
    deltas: Sequence[float] = tuple(GATE_DELTAS),
    alphas: Sequence[float] = tuple(GATE_ALPHAS),
) -> DataFrame:
    """F1 and false-alarm rate at 0.5 for every (delta, alpha), from one pass over the rows.

    Only rows where the sequence alarms and the forest does not can change
    with the setting; both rules keep every other row on its side of 0.5. Rows
    are counted by how many deltas they exceed, and the at most
    2 * (deltas + 1) counts are then summed for each setting.
    """
    f, s = F.col(p_forest), F.col(p_sequence)
    swing = (s < 0.5) & (f >= 0.5)
    passed = sum((F.when(F.abs(s - f) >= d, 1).otherwise(0) for d in deltas), F.lit(0))
    cells = df.groupBy(F.col(y).alias("_y"), passed.alias("_g")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(s < 0.5).alias("_base"),
        F.count_if(swing).alias("_swing"),
        *[
            F.count_if(swing & ((1.0 - a) * s + F.lit(float(a)) * f < 0.5)).alias(f"_f{i}")
            for i, a in enumerate(alphas)
        ],
    )
    by_class = cells.groupBy("_y").agg(F.sum("_n").alias("n"), F.sum("_base").alias("base"))
    rows = cells.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(len(deltas)))))
    gated = F.col("_g") > F.col("_j")
    moved = (
        rows.filter(F.col("_j") < len(deltas))
        .groupBy("_y", "_j")
        .agg(
            *[
                F.sum(F.when(gated, F.col(f"_f{i}") - F.col("_swing")).otherwise(0)).alias(f"_f{i}")
                for i in range(len(alphas))
            ]
        )
    )
    settings = F.array(
        *[F.struct(F.lit(float(a)).alias("alpha"), F.col(f"_f{i}").alias("moved")) for i, a in enumerate(alphas)]
    )
    flagged = moved.join(by_class, "_y").select("_y", "_j", "n", "base", F.inline(settings)).groupBy("_j", "alpha").agg(
        F.sum(F.when(F.col("_y") == 0, F.col("base") + F.col("moved")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("_y") == 1, F.col("base") + F.col("moved")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("_y") == 0, F.col("n")).otherwise(0)).alias("n_attack"),
        F.sum(F.when(F.col("_y") == 1, F.col("n")).otherwise(0)).alias("n_normal"),
    )
    return flagged.select(
        F.element_at(F.array(*[F.lit(float(d)) for d in deltas]), F.col("_j") + 1).alias("delta"),
        "alpha",
        "tp",
        "fp",
        metrics.f1(F.col("tp"), F.col("fp"), F.col("n_attack") - F.col("tp")).alias("f1"),
        (F.col("fp") / F.greatest(F.col("n_normal"), F.lit(1))).alias("fpr_norm"),
    )


@dataclass(frozen=True)
class Gate:
    """Chosen gate setting and its calibration quality."""

    delta: float
    alpha: float
    f1: float
    auc: float
    met_limit: bool

    def apply(self, p_forest: Column, p_sequence: Column) -> Column:
        return gate(p_forest, p_sequence, self.delta, self.alpha)


def search_gate(
    df: DataFrame, p_forest: str = "p_if", p_sequence: str = "p_lstm", y: str = "y", max_fpr: float = 0.03
) -> Gate:
    """Largest attack F1 with false alarms within ``max_fpr``; the AUC decides ties, then the first setting.

    The AUC needs the ordered scores, so it is worked out only for the settings
    that tie in F1, on distinct score pairs. If no setting meets the limit the
    sequence score is used alone.
    """
    rows = gate_table(df, p_forest, p_sequence, y).collect()
    fit = [r for r in rows if r["fpr_norm"] <= max_fpr]
    top = max((r["f1"] for r in fit), default=None)
    tied = sorted([(r["delta"], r["alpha"]) for r in fit if r["f1"] == top]) if fit else [(1.0, 0.0)]
    pairs = df.groupBy(F.col(p_forest).alias("f"), F.col(p_sequence).alias("s"), F.col(y).alias("y")).agg(
        F.count(F.lit(1)).alias("n")
    )
    choices = F.array(
        *[
            F.struct(F.lit(i).alias("choice"), F.lit(d).alias("delta"), F.lit(a).alias("alpha"))
            for i, (d, a) in enumerate(tied)
        ]
    )
    scored = pairs.select("f", "s", "y", "n", F.inline(choices)).withColumn(
        "p", gate(F.col("f"), F.col("s"), F.col("delta"), F.col("alpha"))
    )
    aucs = {r["choice"]: r["auc"] or 0.0 for r in weighted_auc(scored, ["choice"]).collect()}
    best = min(range(len(tied)), key=lambda i: (-round(aucs.get(i, 0.0), 12), i))
    if top is None:
        counts = metrics.confusion(df.withColumn("_k", F.lit(0)), ["_k"], 0.5, p_sequence, y, False).first()
        top = counts["f1"] if counts else 0.0
    return Gate(tied[best][0], tied[best][1], top, aucs.get(best, 0.0), bool(fit))


def weighted_auc(df: DataFrame, keys: Sequence[str], p: str = "p", y: str = "y", n: str = "n") -> DataFrame:
    """AUC of rows that stand for ``n`` equal ones."""
    steps = metrics.ladder(
        df,
        keys,
        p,
        {"pos": F.when(F.col(y) == 1, F.col(n)).otherwise(0), "neg": F.when(F.col(y) == 0, F.col(n)).otherwise(0)},
    )
    return metrics.auc_of(steps, keys)


def confidence_blend(p_forest: Column, p_sequence: Column) -> Column:
    """Each score weighted by its distance from one half."""
    cf, cs = F.abs(p_forest - 0.5) * 2, F.abs(p_sequence - 0.5) * 2
    w = cf / (cf + cs + 1e-9)
    return w * p_forest + (1 - w) * p_sequence


# Component weights tried by the separation search.
GATE_WEIGHTS = [0.50, 0.60, 0.65, 0.70]
ERROR_WEIGHTS = [0.10, 0.15, 0.20]


def weight_grid(with_target: bool) -> list[dict[str, float]]:
    out = []
    for w_gate in GATE_WEIGHTS:
        for w_err in ERROR_WEIGHTS:
            w_tas = 1.0 - w_gate - w_err - (0.05 if with_target else 0.0)
            if w_tas >= 0.05:
                out.append({"gate": w_gate, "ae": w_err, "tas": w_tas} | ({"tgt_if": 0.05} if with_target else {}))
    return out


def weight_table(df: DataFrame, keys: Sequence[str], components: dict[str, str], y: str = "y") -> DataFrame:
    """Class separation of every weighting. Reads labels; for parity studies only.

    The mean of a weighted sum is the weighted sum of means, so only the class
    means of the components are needed.
    """
    diff = {
        name: (F.avg(F.when(F.col(y) == 1, F.col(c))) - F.avg(F.when(F.col(y) == 0, F.col(c)))).alias(f"_d_{name}")
        for name, c in components.items()
    }
    means = df.groupBy(*keys).agg(*diff.values())
    options = [
        F.struct(
            F.lit(i).alias("choice"),
            *[F.lit(w.get(n, 0.0)).alias(f"w_{n}") for n in components],
            F.abs(sum((F.lit(w[n]) * F.col(f"_d_{n}") for n in w if n in components), F.lit(0.0))).alias("separation"),
        )
        for i, w in enumerate(weight_grid("tgt_if" in components))
    ]
    return means.select(*keys, F.inline(F.array(*options)))


def best_weights(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The weighting with the largest separation, the first one on ties."""
    pick = F.max_by(F.struct(*[c for c in table.columns if c not in keys]), F.struct("separation", -F.col("choice")))
    return table.groupBy(*keys).agg(pick.alias("_b")).select(*keys, "_b.*")


def auc_weights(aucs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weights from squared gain over chance, equal if none gains. Reads label-based AUCs."""
    gain = F.greatest(F.col("auc") - 0.5, F.lit(0.0)) * F.greatest(F.col("auc") - 0.5, F.lit(0.0))
    sums = aucs.groupBy(*keys).agg(F.sum(gain).alias("_sum"), F.count(F.lit(1)).alias("_k"))
    return (
        aucs.join(sums, list(keys))
        .withColumn("weight", F.when(F.col("_sum") > 0, gain / F.col("_sum")).otherwise(1.0 / F.col("_k")))
        .drop("_sum", "_k")
    )


def orient(df: DataFrame, keys: Sequence[str], p: str = "p", y: str = "y") -> DataFrame:
    """1 - p in groups where normals score below attacks on average. Reads labels."""
    means = df.groupBy(*keys).agg(
        (F.avg(F.when(F.col(y) == 1, F.col(p))) < F.avg(F.when(F.col(y) == 0, F.col(p)))).alias("_flip")
    )
    flipped = F.when(F.coalesce("_flip", F.lit(False)), 1.0 - F.col(p)).otherwise(F.col(p))
    return df.join(means, list(keys)).withColumn(p, flipped).drop("_flip")


def low_percentile_threshold(df: DataFrame, keys: Sequence[str], score: str, at: float = 0.15) -> DataFrame:
    return quantiles(df, keys, score, {"threshold": at})


def adaptive_threshold(
    df: DataFrame,
    key: str,
    p: str = "p",
    source_score: str | None = "score",
    prior: float = 0.28,
    least: int = 30,
    fallback: float = 0.55,
) -> DataFrame:
    """Label-free threshold per dataset from two guesses at the normal rows.

    One takes the rows above the prior percentile of the fused score, the other
    those above it in the source score; each yields its 5th percentile of the
    fused score if it holds at least ``least`` rows.
    """
    have_source = source_score is not None
    measures = [F.struct(F.lit("a").alias("m"), F.col(p).cast("double").alias("v"))]
    if have_source:
        measures.append(F.struct(F.lit("b").alias("m"), F.col(source_score).cast("double").alias("v")))
    cuts = (
        quantiles(
            df.select(key, F.inline(F.array(*measures))),
            [key, "m"],
            "v",
            {"cut": prior, "above": prior + 0.05, "half": 0.5},
        )
        .groupBy(key)
        .agg(
            *[
                F.max(F.when(F.col("m") == m, F.col(c))).alias(n)
                for m, c, n in [("a", "cut", "cut_a"), ("b", "cut", "cut_b"), ("a", "above", "p33"), ("a", "half", "mid")]
            ]
        )
    )
    rows = df.join(cuts.select(key, "cut_a", "cut_b"), key)
    hits = F.array(
        F.when(F.col(p) >= F.col("cut_a"), "a"),
        F.when(F.col(source_score) >= F.col("cut_b"), "b") if have_source else F.lit(None).cast("string"),
    )
    kept = rows.select(key, F.col(p).alias("_p"), F.explode(F.array_compact(hits)).alias("m"))
    sizes = kept.groupBy(key, "m").agg(F.count(F.lit(1)).alias("size"))
    taus = (
        quantiles(kept, [key, "m"], "_p", {"tau": 0.05})
        .join(sizes, [key, "m"])
        .filter(F.col("size") >= least)
        .groupBy(key)
        .agg(F.max("tau").alias("top"), F.min("tau").alias("low"), F.avg("tau").alias("mean"))
    )
    tau = F.when(F.col("top") - F.col("low") > 0.10, F.col("top")).otherwise(F.col("mean"))
    tau = F.when(tau >= F.col("mid"), F.col("p33")).otherwise(tau)
    tau = clip(tau, 0.15, F.greatest(F.lit(0.15), F.col("mid") * 0.95))
    return cuts.join(taus, key, "left").select(
        key, F.when(F.col("top").isNull(), F.lit(fallback)).otherwise(tau).alias("threshold")
    )


def target_score(
    df: DataFrame, keys: Sequence[str], score: str, threshold: str, out: str = "p_target"
) -> DataFrame:
    """Raw target score above its threshold, over the score range, clipped to [0, 1]."""
    span = df.groupBy(*keys).agg((F.max(score) - F.min(score)).alias("_span"))
    return (
        df.join(span, list(keys))
        .withColumn(out, clip((F.col(score) - F.col(threshold)) / (F.col("_span") + 1e-12), 0.0, 1.0))
        .drop("_span")
    )


def separation(df: DataFrame, keys: Sequence[str], p: str, y: str = "y", least: float = 0.05) -> DataFrame:
    """Gap of class means, and whether it is wide enough to use the component. Reads labels."""
    gap = F.abs(
        F.coalesce(F.avg(F.when(F.col(y) == 1, F.col(p))), F.lit(0.5))
        - F.coalesce(F.avg(F.when(F.col(y) == 0, F.col(p))), F.lit(0.5))
    )
    return df.groupBy(*keys).agg(gap.alias("separation")).withColumn("enabled", F.col("separation") >= least)


def neighbour_probability(tas: Column) -> Column:
    return sigmoid(-0.8 * tas)


def error_probability(z: Column, threshold: Column | float) -> Column:
    return sigmoid((z - threshold) * 5.0)


def route(p: Column, drop: float = 0.50, flag: float | None = None, alert: float | None = None) -> Column:
    """DROP below the first cut; further cuts only if given."""
    out = F.when(p < drop, "DROP")
    if flag is not None and alert is not None:
        return out.when((p >= flag) & (p < alert), "FLAG").when(p >= alert, "ALERT").otherwise("FORWARD")
    return out.otherwise("FORWARD")


@dataclass(frozen=True)
class Platt:
    """Logistic calibration of one score."""

    slope: float
    intercept: float

    @classmethod
    def fit(cls, df: DataFrame, p: str, y: str = "y", c: float = 1e5, max_iter: int = 200) -> Platt:
        """Distributed logistic regression with ridge 1 / (C n); a falling curve is turned round."""
        rows = df.select(F.col(p).cast("double").alias("x"), F.col(y).cast("double").alias("label"))
        n = rows.count()
        data = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows)
        model = LogisticRegression(
            regParam=1.0 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=1e-10
        ).fit(data)
        a, b = float(model.coefficients[0]), float(model.intercept)
        return cls(-a, -b) if a < 0 else cls(a, b)

    def apply(self, p: Column) -> Column:
        return sigmoid(F.lit(self.slope) * p + self.intercept)


def nll_table(df: DataFrame, temperatures: Sequence[float], p: str = "p", y: str = "y") -> DataFrame:
    """Mean negative log likelihood at each temperature, all in one pass."""
    eps = 1e-7
    z, label = logit(F.col(p)), F.col(y)

    def loss(t: float) -> Column:
        q = sigmoid(z / t)
        return -F.avg(label * F.ln(q + eps) + (1 - label) * F.ln(1 - q + eps))

    return df.agg(
        F.array(*[F.struct(F.lit(float(t)).alias("temperature"), loss(t).alias("nll")) for t in temperatures]).alias("_t")
    ).select(F.inline("_t"))


def fit_temperature(
    df: DataFrame, p: str = "p", y: str = "y", lo: float = 0.05, hi: float = 5.0, points: int = 33, rounds: int = 5
) -> float:
    """Grid search refined around the minimum; every round is one pass."""
    best = 1.0
    for _ in range(rounds):
        ts = [float(t) for t in np.linspace(lo, hi, points)]
        best = min(nll_table(df, ts, p, y).collect(), key=lambda r: r["nll"])["temperature"]
        width = (hi - lo) / (points - 1)
        lo, hi = max(lo, best - width), min(hi, best + width)
    return best


def apply_temperature(p: Column, t: float) -> Column:
    return sigmoid(logit(p) / t)


def mixture_threshold(df: DataFrame, score: str, seed: int = 42) -> float:
    """Crossing point of a two-Gaussian mixture, weighted by the deviations."""
    data = VectorAssembler(inputCols=[score], outputCol="features").transform(df.select(score))
    model = GaussianMixture(k=2, seed=seed, maxIter=100).fit(data)
    parts = sorted((float(g.mean[0]), float(g.cov.toArray()[0, 0]) ** 0.5 + 1e-9) for g in model.gaussians)
    (ma, sa), (mn, sn) = parts
    return (mn * sa + ma * sn) / (sn + sa)
