"""Numeric column functions with one null policy: NULL stands for missing, NaN and infinities never pass."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def clamp(x: Column, lo: float = 0.0, hi: float = 100.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def round_safe(x: Column, digits: int = 6) -> Column:
    """Rounded, 0 where missing or not finite."""
    return F.round(F.coalesce(finite(x.cast("double")), F.lit(0.0)), digits)


def safe_float(x: Column, digits: int = 6) -> Column:
    return F.round(finite(x.cast("double")), digits)


def divide(a: Column, b: Column) -> Column:
    """NULL where the divisor is 0 or missing."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


SIGNALS = ((80, "STRONG_BUY"), (70, "BUY"), (55, "HOLD"), (40, "REDUCE"))


def signal_of(score: Column) -> Column:
    """Five-step signal of a score of 0 to 100; NULL of NULL."""
    out = F.when(score.isNull(), None)
    for least, name in SIGNALS:
        out = out.when(score >= least, name)
    return out.otherwise("SELL")


def ordinal(x: Column, *names: str) -> Column:
    """Place of a name among ``names`` from 1, 0 for others."""
    out = F.lit(0)
    for k, n in enumerate(names, 1):
        out = F.when(x == n, k).otherwise(out)
    return out
