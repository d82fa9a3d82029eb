"""Fitted pre-processing: fit on one table, apply to another.

Fitting runs one aggregate job and brings back a handful of numbers per
feature; applying is a projection with those numbers as literals.
Parameters per dataset stay in a DataFrame and are joined by key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertmill.functions.scalars import clip, finite, finite_or_zero
from alertmill.operators.ordered import feature_quantiles, quantiles


def require(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Project the features; an error names those that are missing."""
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")
    return df.select(*features)


def with_missing_zero(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add absent feature columns as constant 0."""
    return df.withColumns({f: F.lit(0.0) for f in features if f not in df.columns})


@dataclass(frozen=True)
class MedianClip:
    """Median for NULL, NaN and infinite values, then an upper clip."""

    medians: dict[str, float | None]
    uppers: dict[str, float | None]

    @classmethod
    def fit(cls, train: DataFrame, features: Sequence[str], percentile: float = 0.99) -> MedianClip:
        clean = train.select(*[finite(F.col(f).cast("double")).alias(f) for f in features])
        rows = feature_quantiles(clean, features, {"median": 0.5, "upper": percentile}).collect()
        got = {r["feature"]: r for r in rows}
        return cls(
            {f: got[f]["median"] if f in got else None for f in features},
            {f: got[f]["upper"] if f in got else None for f in features},
        )

    def transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for f, median in self.medians.items():
            c = finite(F.col(f).cast("double"))
            c = F.coalesce(c, F.lit(median)) if median is not None else c
            upper = self.uppers[f]
            out[f] = F.when(c > upper, F.lit(upper)).otherwise(c) if upper is not None else c
        return df.withColumns(out)


@dataclass(frozen=True)
class Standardiser:
    """Zero mean and unit population deviation; constant columns keep scale 1."""

    means: dict[str, float]
    scales: dict[str, float]

    @classmethod
    def fit(cls, train: DataFrame, features: Sequence[str]) -> Standardiser:
        row = train.agg(
            *[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]
        ).first()
        return cls(
            {f: row[f"m_{f}"] or 0.0 for f in features},
            {f: row[f"s_{f}"] if row[f"s_{f}"] else 1.0 for f in features},
        )

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f: (F.col(f) - m) / self.scales[f] for f, m in self.means.items()})


# The features with long tails that are put on a log scale first.
SKEWED = ("payload_entropy", "freq_rolling_std_5w", "alert_rate_acceleration")


@dataclass(frozen=True)
class RobustScaler:
    """log1p of skewed columns, then (x - median) / (IQR + 1e-9) of the source."""

    centre: dict[str, float]
    iqr: dict[str, float]
    skewed: tuple[str, ...]

    @staticmethod
    def _log(df: DataFrame, features: Sequence[str], skewed: Sequence[str]) -> DataFrame:
        return df.withColumns(
            {
                f: F.log1p(F.abs(finite_or_zero(F.col(f).cast("double"))))
                if f in skewed
                else finite_or_zero(F.col(f).cast("double"))
                for f in features
            }
        )

    @classmethod
    def fit(cls, source: DataFrame, features: Sequence[str], skewed: Sequence[str] = SKEWED) -> RobustScaler:
        logged = cls._log(source, features, skewed)
        rows = feature_quantiles(logged, features, {"q1": 0.25, "q2": 0.5, "q3": 0.75}).collect()
        return cls(
            {r["feature"]: r["q2"] for r in rows},
            {r["feature"]: r["q3"] - r["q1"] + 1e-9 for r in rows},
            tuple(skewed),
        )

    def transform(self, df: DataFrame) -> DataFrame:
        logged = self._log(df, list(self.centre), self.skewed)
        return logged.withColumns({f: (F.col(f) - c) / self.iqr[f] for f, c in self.centre.items()})


def zscore_by(df: DataFrame, key: str, features: Sequence[str], limit: float = 50.0) -> DataFrame:
    """z-score each dataset by its own moments, clipped to +-limit."""
    df = df.withColumns({f: finite_or_zero(F.col(f).cast("double")) for f in features})
    stats = df.groupBy(key).agg(
        *[F.avg(f).alias(f"_m_{f}") for f in features],
        *[(F.stddev_pop(f) + 1e-9).alias(f"_s_{f}") for f in features],
    )
    scaled = {f: clip((F.col(f) - F.col(f"_m_{f}")) / F.col(f"_s_{f}"), -limit, limit) for f in features}
    return df.join(stats, key).withColumns(scaled).drop(*[f"_{c}_{f}" for c in "ms" for f in features])


def moments(df: DataFrame, features: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean vector and sample covariance matrix; missing values are left out pair by pair.

    NULL and NaN are missing. Tasks report one row per matrix cell: rows that
    have both values, the sums of either and of the product, around the mean.
    """
    d = len(features)
    means = [F.avg(F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double"))).alias(f"m{i}") for i, f in enumerate(features)]
    first = df.agg(*means).first()
    mean = np.array([first[f"m{i}"] for i in range(d)], dtype=float)
    centre = np.nan_to_num(mean)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((3, d, d))
        for pdf in batches:
            x = pdf.to_numpy(dtype=float) - centre
            seen = ~np.isnan(x)
            x, seen = np.where(seen, x, 0.0), seen.astype(float)
            total += np.stack([seen.T @ seen, x.T @ seen, x.T @ x])
        i, j = np.indices((d, d))
        flat = total.reshape(3, -1)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "n": flat[0], "s": flat[1], "v": flat[2]})

    cells = df.select(*[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)])
    cells = cells.mapInPandas(products, "i int, j int, n double, s double, v double")
    n, s, v = np.zeros((3, d, d))
    for r in cells.groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("v").alias("v")).collect():
        n[r["i"], r["j"]], s[r["i"], r["j"]], v[r["i"], r["j"]] = r["n"], r["s"], r["v"]
    # s[i, j] sums feature i over the rows that also have feature j
    return mean, (v - s * s.T / np.maximum(n, 1)) / np.maximum(n - 1, 1)


def _root(c: np.ndarray, power: float) -> np.ndarray:
    w, v = np.linalg.eigh(c)
    return (v * np.power(np.maximum(w, 1e-300), power)) @ v.T


#: Columns up to which a linear map is written out term by term.
PLAIN_COLUMNS = 16


def linear_map(df: DataFrame, features: Sequence[str], a: np.ndarray, before: np.ndarray, after: np.ndarray) -> DataFrame:
    """Row vectors (x - before) A + after as plain column arithmetic, of many columns by array functions.

    Both add in the same order; arrays keep a wide map within the size of one compiled method.
    """
    old = [F.col(f) - float(before[i]) for i, f in enumerate(features)]
    new: dict[str, Column] = {}
    for j, f in enumerate(features):
        terms = [float(a[i, j]) for i in range(len(features))]
        if len(features) <= PLAIN_COLUMNS:
            new[f] = sum((x * t for x, t in zip(old, terms, strict=True)), F.lit(float(after[j])))
        else:
            parts = F.zip_with("_x", F.array(*[F.lit(t) for t in terms]), lambda x, t: x * t)
            new[f] = F.aggregate(parts, F.lit(float(after[j])), lambda total, x: total + x)
    if len(features) > PLAIN_COLUMNS:
        df = df.withColumn("_x", F.array(*old))
        return df.select(*[c for c in df.columns if c not in new and c != "_x"], *[e.alias(f) for f, e in new.items()])
    return df.select(*[c for c in df.columns if c not in new], *[e.alias(f) for f, e in new.items()])


@dataclass(frozen=True)
class CoralAligner:
    """Colour the target with the source covariance; identity if not finite.

    ``packet=True`` is the variant for packet windows: larger ridge, no centring
    and the transposed product.
    """

    matrix: np.ndarray
    before: np.ndarray
    after: np.ndarray
    applied: bool

    @classmethod
    def fit(cls, source: DataFrame, target: DataFrame, features: Sequence[str], packet: bool = False) -> CoralAligner:
        d = len(features)
        ms, cs = moments(source, features)
        mt, ct = moments(target, features)
        ridge = (1e-5 if packet else 1e-6) * np.eye(d)
        if packet:
            a = (_root(cs + ridge, 0.5) @ np.linalg.pinv(_root(ct + ridge, 0.5))).T
            before, after = np.zeros(d), np.zeros(d)
        else:
            a = _root(ct + ridge, -0.5) @ _root(cs + ridge, 0.5)
            before, after = mt, ms
        if not np.all(np.isfinite(a)):
            return cls(np.eye(d), np.zeros(d), np.zeros(d), False)
        return cls(a, before, after, True)

    def transform(self, df: DataFrame, features: Sequence[str]) -> DataFrame:
        return linear_map(df, features, self.matrix, self.before, self.after)


def unit_range(score: Column, lo: Column | float, hi: Column | float, floor: float = 1e-12) -> Column:
    """Map [lo, hi] to [0, 1], clipped."""
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return clip((score - lo) / (hi - lo + floor), 0.0, 1.0)


def score_bounds(calibration: DataFrame, score: str, lo: float = 0.01, hi: float = 0.99) -> tuple[float, float]:
    """Percentile bounds of calibration scores for ``unit_range``."""
    row = quantiles(calibration, [], score, {"lo": lo, "hi": hi}).first()
    return row["lo"], row["hi"]


def percentile_normalise(
    df: DataFrame, keys: Sequence[str], score: str, out: str = "p", lo: float = 0.02, hi: float = 0.98
) -> DataFrame:
    """Per group: p2..p98 to [0, 1]; 0.5 where the scores are flat."""
    bounds = quantiles(df, keys, score, {"_lo": lo, "_hi": hi})
    width = F.col("_hi") - F.col("_lo")
    p = F.when(width < 1e-12, 0.5).otherwise(clip((F.col(score) - F.col("_lo")) / width, 0.0, 1.0))
    return df.join(bounds, list(keys)).withColumn(out, p).drop("_lo", "_hi")


def train_bounds(train: DataFrame, score: str) -> tuple[float, float]:
    """Smallest and largest training score."""
    row = train.agg(F.min(score).alias("lo"), F.max(score).alias("hi")).first()
    return row["lo"], row["hi"]


def bounded_score(score: Column, lo: float, hi: float) -> Column:
    """Training bounds to [0, 1]; 0.5 where they coincide."""
    return clip((score - lo) / (hi - lo), 0.0, 1.0) if hi - lo > 1e-12 else F.lit(0.5)


def integrity(df: DataFrame, features: Sequence[str], label: str = "label") -> dict:
    """One pass of checks; raises on NaN, infinite values or foreign labels."""
    bad = [F.count_if(F.col(f).isNull() | F.isnan(F.col(f).cast("double"))) for f in features]
    inf = [F.count_if(F.abs(F.col(f).cast("double")) == float("inf")) for f in features]
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        sum(bad[1:], bad[0]).alias("nans"),
        sum(inf[1:], inf[0]).alias("infs"),
        F.count_if(~F.col(label).isin(0, 1) | F.col(label).isNull()).alias("bad_labels"),
        F.count_if(F.col(label) == 1).alias("normal"),
        F.count_if(F.col(label) == 0).alias("attack"),
    ).first()
    report = row.asDict()
    for check in ("nans", "infs", "bad_labels"):
        if report[check]:
            raise ValueError(f"integrity: {report[check]} {check.replace('_', ' ')}")
    report["imbalanced"] = bool(row["attack"] and row["normal"] / row["attack"] > 10.0)
    return report


def integrity_table(df: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """The same counts as a one-row table, without raising."""
    value = {f: F.col(f).cast("double") for f in features}
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        sum((F.count_if(c.isNull() | F.isnan(c)) for c in value.values()), F.lit(0)).alias("nans"),
        sum((F.count_if(F.abs(c) == float("inf")) for c in value.values()), F.lit(0)).alias("infs"),
        F.count_if(~F.col(label).isin(0, 1)).alias("bad_labels"),
        F.count_if(F.col(label) == 1).alias("n_normal"),
        F.count_if(F.col(label) == 0).alias("n_attack"),
    )


def sequential_gate(df: DataFrame) -> DataFrame:
    """Expectations on the rolling columns: no gaps, persistence within 1, mean not negative."""
    cols = ["freq_persistence_5w", "freq_rolling_mean_5w", "freq_rolling_std_5w"]
    return df.agg(
        sum((F.count_if(F.col(c).isNull() | F.isnan(c)) for c in cols), F.lit(0)).alias("missing"),
        F.count_if(F.col(cols[0]) > 1.0).alias("persistence_above_one"),
        F.count_if(F.col(cols[1]) < 0.0).alias("negative_mean"),
    )
