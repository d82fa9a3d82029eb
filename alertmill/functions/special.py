"""Tail probabilities for a handful of aggregated rows; no SciPy needed."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Beyond this a + b, with both large, the expansion is used; both agree to 1e-7 there.
LARGE = 1e6
STEPS = 20_000


def _expansion(x: float, a: float, b: float) -> float:
    """Leading terms of the uniform expansion for large a and b (error of order (a + b)^-3/2)."""
    n, x0 = a + b, a / (a + b)
    gap = x - x0
    half_square = -(x0 * math.log1p(gap / x0) + (1.0 - x0) * math.log1p(-gap / (1.0 - x0)))
    eta = math.copysign(math.sqrt(2.0 * max(half_square, 0.0)), gap)
    root = math.sqrt(x0 * (1.0 - x0))
    if abs(gap) < 1e-5 * root:
        first = (1.0 - 2.0 * x0) / (3.0 * root)
    else:
        first = 1.0 / eta - root / gap
    tail = math.exp(-n * half_square) / math.sqrt(2.0 * math.pi * n)
    return 0.5 * math.erfc(-eta * math.sqrt(n / 2.0)) + tail * first


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function: continued fraction, or an expansion for large a and b."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if a + b > LARGE and min(a, b) > math.sqrt(LARGE):
        return min(1.0, max(0.0, _expansion(x, a, b)))
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_cdf(1.0 - x, b, a)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
    total = d
    for m in range(1, STEPS):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            return front * total / a
    raise ArithmeticError(f"no convergence at x = {x}, a = {a}, b = {b}")


def beta_quantile(q: float, a: float, b: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2.0
        if beta_cdf(mid, a, b) < q:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2.0


def t_quantile(q: float, df: float) -> float:
    """Upper quantile (q > 0.5) of Student's t."""
    # P(T <= t) = 1 - I_x(df/2, 1/2) / 2 with x = df / (df + t^2).
    x = beta_quantile(2.0 * (1.0 - q), df / 2.0, 0.5)
    return math.sqrt(df * (1.0 - x) / x)


def binomial_cdf(k: int, n: int, p: float) -> float:
    if k < 0:
        return 0.0
    if k >= n:
        return 1.0
    return 1.0 - beta_cdf(p, k + 1, n - k)


def binomial_quantile(q: float, n: int, p: float) -> int:
    lo, hi = 0, n
    while lo < hi:
        mid = (lo + hi) // 2
        if binomial_cdf(mid, n, p) >= q:
            hi = mid
        else:
            lo = mid + 1
    return lo


def exact_interval(k: int, n: int, alpha: float = 0.05) -> tuple[float, float]:
    """Exact two-sided interval of a share."""
    if n == 0:
        return 0.0, 1.0
    lo = beta_quantile(alpha / 2, k, n - k + 1) if k > 0 else 0.0
    hi = beta_quantile(1 - alpha / 2, k + 1, n - k) if k < n else 1.0
    return lo, hi


def discordance_power(b: int, c: int, alpha: float = 0.05) -> float:
    n = b + c
    if n == 0:
        return 0.0
    critical = binomial_quantile(1 - alpha, n, 0.5)
    return 1.0 - binomial_cdf(critical - 1, n, c / n)


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """Two-sided p-value of a standard normal deviate."""
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2.0)) if pd.notna(v) else None).astype(float)


@F.pandas_udf(T.DoubleType())
def chi2_tail_one(x: pd.Series) -> pd.Series:
    """Upper tail of chi-squared with one degree of freedom."""
    return x.map(lambda v: math.erfc(math.sqrt(max(v, 0.0) / 2.0)) if pd.notna(v) else None).astype(float)


@F.pandas_udf(T.StructType([T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())]))
def exact_interval_udf(k: pd.Series, n: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([exact_interval(int(a), int(b)) for a, b in zip(k, n, strict=True)], columns=["lo", "hi"])


@F.pandas_udf(T.DoubleType())
def discordance_power_udf(b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series([discordance_power(int(x), int(y)) for x, y in zip(b, c, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def t_upper_975(df: pd.Series) -> pd.Series:
    return df.map(lambda v: t_quantile(0.975, float(v)) if v and v > 0 else 0.0).astype(float)
