"""Column expressions used by several operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: str | Column) -> Column:
    return F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)


def as_utc(ts: str | Column) -> Column:
    """TIMESTAMP from a zone-less column; the session zone is UTC."""
    return (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp")


def whole(num: Column, den: Column | int) -> Column:
    """Integer division of non-negative integers."""
    return F.call_function("div", num, den if isinstance(den, Column) else F.lit(den))


def finite(c: Column) -> Column:
    """NaN and infinities to NULL."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(math.inf)), F.lit(None)).otherwise(c)


def finite_or_zero(c: Column) -> Column:
    return F.coalesce(finite(c), F.lit(0.0))


EMERGENCY = "emergency"


def emergency(c: str = "type") -> Column:
    return F.coalesce(F.col(c) == EMERGENCY, F.lit(False))


def day_angle(ts: Column, with_minutes: bool = True) -> Column:
    hours = F.hour(ts) + (F.minute(ts) / 60.0 if with_minutes else F.lit(0))
    return 2.0 * math.pi * hours / 24.0


def utf8_hex(c: Column) -> Column:
    return F.hex(F.encode(c, "UTF-8"))


def hex_bytes(c: Column) -> Column:
    """Array of two-digit strings, one per byte."""
    return F.regexp_extract_all(c, F.lit("(..)"), F.lit(1))


def clip(c: Column, lo: float | Column, hi: float | Column) -> Column:
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return F.when(c.isNotNull(), F.greatest(lo, F.least(hi, c)))


def sigmoid(c: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-c))


def logit(p: Column, eps: float = 1e-7) -> Column:
    q = clip(p, eps, 1.0 - eps)
    return F.ln(q / (1.0 - q))


def class_text(c: str | Column) -> Column:
    """Lower case, trimmed, '-' and ' ' to '_'."""
    c = F.col(c) if isinstance(c, str) else c
    return F.translate(F.trim(F.lower(c)), "- ", "__")


# Patterns of the two in-domain attack families.
FLOODING_PATTERN = "flood|attack2|a2"
SLOW_PATTERN = "poison|slow|attack5|a5"


def attack_family(c: str | Column) -> Column:
    c = F.lower(F.col(c) if isinstance(c, str) else c)
    return F.when(c.rlike(FLOODING_PATTERN), "flooding").when(c.rlike(SLOW_PATTERN), "slow_poisoning")


# The attack taxonomy of the foreign sensor logs.
BEHAVIOURAL_ATTACKS = [
    "ddos",
    "injection",
    "ransomware",
    "backdoor",
    "flooding",
    "slow_poisoning",
    "mitm",
    "dos",
]
AUTH_ATTACKS = [
    "password",
    "xss",
    "scanning",
    "sql injection",
    "bruteforce",
    "brute_force",
]


def attack_scope(c: str | Column) -> Column:
    c = F.trim(F.lower(F.col(c) if isinstance(c, str) else c))
    return F.when(c.isin(BEHAVIOURAL_ATTACKS), "behavioral").otherwise("auth")


def effect_label(c: Column) -> Column:
    return F.when(c >= 0.8, "LARGE").when(c >= 0.5, "MEDIUM").otherwise("small")
