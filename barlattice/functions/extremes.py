"""Extremes over long row frames by doubling.

A frame of n rows is covered by two overlapping frames of the largest power of two up to n, and those are built from each
other: twice the length is the extreme of two halves. So a window of any length costs a number of columns and a work a row
that grow with log n, all of it over one sort of the entity's rows. Missing values and rows beyond the entity's ends
take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import Axis


def levels_for(longest: int) -> int:
    """How many powers of two (from 1) frames of up to `longest` rows need."""
    return longest.bit_length()


def add_doubled(df: DataFrame, sources: dict[str, tuple[str, str]], levels: int, axis: Axis) -> DataFrame:
    """Columns `<name>_<k>`: the extreme of the 2^k rows that end at the row, for each name -> (column, "least" or "greatest")."""
    out = df.withColumns({f"{name}_0": F.col(column) for name, (column, _) in sources.items()})
    for k in range(1, levels):
        out = out.withColumns({
            f"{name}_{k}": getattr(F, pick)(f"{name}_{k - 1}", axis.offset(f"{name}_{k - 1}", -(1 << (k - 1))))
            for name, (_, pick) in sources.items()
        })
    return out


def past_extreme(name: str, pick: str, n: int, axis: Axis) -> Column:
    """The extreme of the n rows before the row."""
    k = levels_for(n) - 1
    ends = {1, n - (1 << k) + 1}
    parts = [axis.offset(f"{name}_{k}", -e) for e in sorted(ends)]
    return getattr(F, pick)(*parts) if len(parts) > 1 else parts[0]


def ahead_extreme(name: str, pick: str, n: int, axis: Axis) -> Column:
    """The extreme of the n rows after the row; NULL where not all n rows are there."""
    k = levels_for(n) - 1
    ends = {1 << k, n}
    parts = [axis.offset(f"{name}_{k}", e) for e in sorted(ends)]
    both = getattr(F, pick)(*parts) if len(parts) > 1 else parts[0]
    return F.when(axis.offset(axis.time, n).isNotNull(), both)


def extreme_since(ago: str, now: str, then: str, pick: str, levels: int) -> Column:
    """The extreme of the last `ago` rows (1 to 2^levels - 1): of the 2^k rows that end at the row (`<now>_<k>`) and the 2^k
    rows that begin after the place `ago` rows back (`then` with the level in place of {})."""
    out = F.lit(None)
    for k in range(levels):
        inside = (F.col(ago) >= (1 << k)) & (F.col(ago) < (1 << (k + 1)))
        out = F.when(inside, getattr(F, pick)(F.col(f"{now}_{k}"), F.col(then.format(k)))).otherwise(out)
    return out
