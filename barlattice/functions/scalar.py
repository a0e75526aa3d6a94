"""Column-level helpers with the panel's NULL rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x) -> Column:
    """NaN and infinities become NULL (missing)."""
    x = c(x)
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def ratio(a, b) -> Column:
    """a / b, NULL when b is zero."""
    return F.try_divide(c(a), c(b))


def pct_move(x, base) -> Column:
    """(x / base - 1) * 100, in this exact floating-point order."""
    return (ratio(x, base) - F.lit(1.0)) * F.lit(100.0)


def pct_gap(x, base) -> Column:
    """(x - base) / base * 100."""
    return ratio(c(x) - c(base), base) * F.lit(100.0)


def held(cond: Column) -> Column:
    """A missing comparison counts as False."""
    return F.coalesce(cond, F.lit(False))


def flag(cond: Column) -> Column:
    """1.0 / 0.0 with missing as 0.0, so that an average is a share."""
    return held(cond).cast("double")


def pct_of(part: Column, whole: Column) -> Column:
    """round(100 * part / whole, 2); 0 when there is nothing to divide by."""
    return F.when(whole > 0, F.round(F.lit(100.0) * part / whole, 2)).otherwise(F.lit(0.0))
