"""Sequence classifier, reconstruction error and one-class boundary, and their comparison."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertmill.operators import metrics, splits
from alertmill.operators.ordered import quantiles
from alertmill.operators.prep import moments
from alertmill.session import settle


def replicate_by_weight(df: DataFrame, id_col: str, label: str = "y") -> DataFrame:
    """Repeat rows of the rarer class so that both weigh the same.

    For learners without a weight column. The whole part of the ratio repeats
    every row, the fraction a hashed share of them.
    """
    sizes = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    if len(sizes) < 2:
        return df
    most = max(sizes.values())
    ratio = F.lit(0.0)
    for value, n in sizes.items():
        ratio = F.when(F.col(label) == value, float(most / n)).otherwise(ratio)
    part = F.pmod(F.xxhash64(F.col(id_col), F.lit("repeat")), F.lit(1_000_000)) / 1_000_000.0
    times = F.floor(ratio) + F.when(part < ratio - F.floor(ratio), 1).otherwise(0)
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1), times.cast("int")))).drop("_copy")


@dataclass
class SequenceClassifier:
    """P(normal) of a flattened sequence.

    ``kind`` "mlp": perceptron trained by distributed L-BFGS on balanced rows;
    "logistic": class-weighted linear baseline.
    """

    kind: str
    layers: list[int]
    weights: np.ndarray

    @classmethod
    def fit(
        cls,
        sequences: DataFrame,
        id_col: str,
        label: str = "y",
        kind: str = "mlp",
        hidden: Sequence[int] = (64, 32),
        max_iter: int = 60,
        seed: int = 42,
    ) -> SequenceClassifier:
        flat = sequences.select(id_col, F.col(label).cast("int").alias("y"), F.flatten("sequence").alias("_x"))
        width = len(flat.select("_x").first()["_x"])
        if kind == "logistic":
            weights = splits.class_weights(flat, "y").select("y", "weight")
            data = flat.join(F.broadcast(weights), "y").select(
                F.col("y").cast("double").alias("label"), "weight", array_to_vector("_x").alias("features")
            )
            model = LogisticRegression(weightCol="weight", maxIter=max_iter, regParam=1e-4).fit(data)
            return cls(kind, [width], np.append(model.coefficients.toArray(), model.intercept))
        data = replicate_by_weight(flat, id_col).select(
            F.col("y").cast("double").alias("label"), array_to_vector("_x").alias("features")
        )
        layers = [width, *hidden, 2]
        model = MultilayerPerceptronClassifier(layers=layers, maxIter=max_iter, seed=seed, solver="l-bfgs").fit(data)
        return cls(kind, layers, model.weights.toArray())

    def score_array(self, x: np.ndarray) -> np.ndarray:
        """P(normal) of flattened sequences."""
        if self.kind == "logistic":
            return 1.0 / (1.0 + np.exp(-(x @ self.weights[:-1] + self.weights[-1])))
        at, h = 0, x
        for i, (n_in, n_out) in enumerate(zip(self.layers[:-1], self.layers[1:], strict=True)):
            b = self.weights[at + n_in * n_out : at + (n_in + 1) * n_out]
            # The stored block is n_out x n_in in column order, followed by the offsets.
            h = h @ self.weights[at : at + n_in * n_out].reshape(n_out, n_in, order="F").T + b
            at += (n_in + 1) * n_out
            h = 1.0 / (1.0 + np.exp(-h)) if i < len(self.layers) - 2 else h
        e = np.exp(h - h.max(axis=1, keepdims=True))
        return e[:, 1] / e.sum(axis=1)

    def transform(self, sequences: DataFrame, out: str = "p") -> DataFrame:
        model = sequences.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def score(flat: pd.Series) -> pd.Series:
            return pd.Series(model.value.score_array(np.stack(flat.to_numpy()).astype(float)))

        return sequences.withColumn(out, score(F.flatten("sequence")))


def temporal_validation(
    sequences: DataFrame, id_col: str, order: Sequence[str], label: str = "y", k: int = 5, least_auc: float = 0.80, **fit
) -> DataFrame:
    """Fit on the blocks before each test block; AUC, TPR and FPR per fold with the overall verdict."""
    blocks = splits.expanding_folds(sequences, order, k)
    tested: DataFrame | None = None
    for fold in range(1, k + 1):
        train, test = blocks.filter(F.col("block") < fold), blocks.filter(F.col("block") == fold)
        if train.select(label).distinct().count() < 2 or test.select(label).distinct().count() < 2:
            continue
        scored = SequenceClassifier.fit(train, id_col, label, **fit).transform(test)
        part = scored.select(F.lit(fold).alias("fold"), F.col(label).alias("y"), "p")
        tested = part if tested is None else tested.unionByName(part)
    if tested is None:
        raise ValueError("no fold holds both classes")
    r = metrics.report(tested, ["fold"]).select("fold", "auc", "tpr", "fpr")
    r = settle(r, "folds")
    worst = r.agg(F.min("auc").alias("worst")).first()["worst"]
    return r.withColumn("robust", F.lit(worst is not None and worst > least_auc))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


@dataclass
class ReconstructionDetector:
    """Bottleneck of the leading components; score is minus the standardised squared error."""

    features: list[str]
    mean: np.ndarray
    components: np.ndarray
    mu: float
    sd: float

    @classmethod
    def fit(cls, normals: DataFrame, features: Sequence[str], k: int = 4) -> ReconstructionDetector:
        mean, _ = moments(normals, features)
        centred = normals.select(F.array(*[F.col(f) - float(mean[i]) for i, f in enumerate(features)]).alias("_a"))
        data = centred.select(array_to_vector("_a").alias("features"))
        pcs = PCA(k=k, inputCol="features", outputCol="z").fit(data).pc.toArray()
        model = cls(list(features), mean, pcs, 0.0, 1.0)
        stats = model._errors(normals).agg(F.avg("error").alias("mu"), F.stddev_pop("error").alias("sd")).first()
        model.mu, model.sd = stats["mu"], stats["sd"]
        return model

    def _errors(self, df: DataFrame) -> DataFrame:
        """Mean squared error, by array functions, so that the expression does not grow with the columns.

        With orthonormal components the lost part is |x|^2 less the squared
        projections.
        """
        x = F.array(*[F.col(f) - float(self.mean[i]) for i, f in enumerate(self.features)])
        rows = df.withColumn("_x", x)
        lost = _dot(F.col("_x"), F.col("_x"))
        for part in self.components.T:
            z = _dot(F.col("_x"), F.array(*[F.lit(float(c)) for c in part]))
            lost = lost - z * z
        return rows.withColumn("error", F.greatest(lost, F.lit(0.0)) / len(self.features)).drop("_x")

    def transform(self, df: DataFrame, out: str = "ae_z") -> DataFrame:
        return self._errors(df).withColumn(out, -(F.col("error") - self.mu) / (self.sd + 1e-9)).drop("error")


@dataclass
class OneClassBoundary:
    """One-class margin, linear or on random Fourier features of the RBF kernel.

    The boundary vector is a mean of rows in which none may weigh more than
    1 / (nu n). Each step moves it towards the mean of the share nu of rows
    that now score lowest (a conditional-gradient step); tasks sum the features
    of those rows and only the sums are shuffled.
    """

    features: list[str]
    omega: np.ndarray | None
    phase: np.ndarray | None
    w: np.ndarray
    rho: float

    @classmethod
    def fit(
        cls,
        normals: DataFrame,
        features: Sequence[str],
        nu: float = 0.05,
        kernel: str = "rbf",
        width: int = 128,
        steps: int = 10,
        seed: int = 42,
    ) -> OneClassBoundary:
        d = len(features)
        rng = np.random.default_rng(seed)
        omega = phase = None
        if kernel == "rbf":
            mean, cov = moments(normals, features)
            spread = float(np.trace(cov)) / d + float(np.var(mean))
            gamma = 1.0 / (d * max(spread, 1e-12))
            omega = rng.normal(0.0, np.sqrt(2.0 * gamma), (d, width))
            phase = rng.uniform(0.0, 2.0 * np.pi, width)
        model = cls(list(features), omega, phase, np.zeros(width if kernel == "rbf" else d), 0.0)
        rows = normals.select(*[F.col(f).cast("double").alias(f) for f in features]).persist()
        n = rows.count()
        model.w = model._sums(rows, inside_only=False)[1:] / n
        for step in range(1, steps + 1):
            model.rho = _margin(model, rows, nu)
            sums = model._sums(rows, inside_only=True)
            rate = 2.0 / (step + 2.0)
            model.w = (1.0 - rate) * model.w + rate * sums[1:] / max(sums[0], 1.0)
        model.rho = _margin(model, rows, nu)
        rows.unpersist()
        return model

    def phi(self, x: np.ndarray) -> np.ndarray:
        if self.omega is None:
            return x
        return np.sqrt(2.0 / len(self.phase)) * np.cos(x @ self.omega + self.phase)

    def _sums(self, rows: DataFrame, inside_only: bool) -> np.ndarray:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(1 + len(self.w))
            for pdf in batches:
                z = self.phi(pdf.to_numpy(dtype=float))
                if inside_only:
                    z = z[z @ self.w < self.rho]
                total[0] += len(z)
                total[1:] += z.sum(axis=0)
            yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

        out = np.zeros(1 + len(self.w))
        for i, v in rows.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v")).collect():
            out[i] = v
        return out

    def score_array(self, x: np.ndarray) -> np.ndarray:
        return self.phi(x) @ self.w - self.rho

    def transform(self, df: DataFrame, out: str = "score") -> DataFrame:
        model = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def score(*cols: pd.Series) -> pd.Series:
            return pd.Series(model.value.score_array(np.column_stack([c.to_numpy(dtype=float) for c in cols])))

        return df.withColumn(out, score(*[F.col(f).cast("double") for f in self.features]))


def _margin(model: OneClassBoundary, normals: DataFrame, nu: float) -> float:
    """The offset that leaves a share nu of the normals outside."""
    flat = OneClassBoundary(model.features, model.omega, model.phase, model.w, 0.0)
    return quantiles(flat.transform(normals), [], "score", {"t": nu}).first()["t"]


def baseline_matrix(scored: DataFrame, keys: Sequence[str] = ("dataset",)) -> DataFrame:
    """One metrics row per detector, variant and dataset.

    ``scored``: keys, detector, variant, y, p; ranking metrics and the best
    recall within 15 % false alarms.
    """
    ks = [*keys, "detector", "variant"]
    best = metrics.recall_at_fpr(
        metrics.threshold_table(scored, ks, metrics.FPR_GRID_FULL), ks, fallback=0.5
    )
    return metrics.auc(scored, ks, one_class=0.5).join(best, ks)

