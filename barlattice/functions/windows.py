"""Row-framed windows over one entity's own history."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from .scalar import c


@dataclass(frozen=True)
class Axis:
    """Which column identifies the entity and which one orders its rows.

    (key, time) is the panel's primary key, so a window partition holds at most one
    row per calendar date however popular the entity is in the raw data.
    """

    key: str = "ticker"
    time: str = "date"

    def rows(self) -> WindowSpec:
        return Window.partitionBy(self.key).orderBy(self.time)

    def roll(self, n: int) -> WindowSpec:
        return self.rows().rowsBetween(-(n - 1), 0)

    def past(self, n: int) -> WindowSpec:
        return self.rows().rowsBetween(-n, -1)

    def ahead(self, n: int) -> WindowSpec:
        return self.rows().rowsBetween(1, n)

    def sofar(self) -> WindowSpec:
        return self.rows().rowsBetween(Window.unboundedPreceding, 0)

    def lag(self, x, n: int = 1) -> Column:
        return F.lag(c(x), n).over(self.rows())

    def lead(self, x, n: int = 1) -> Column:
        return F.lead(c(x), n).over(self.rows())

    def offset(self, column: str, n: int) -> Column:
        """The column n rows ahead (behind when negative), written as one SQL expression.

        Same as lead / lag; meant for the many offsets of a frame, where a call per
        sub-expression would make building the plan slower than running it on small data.
        """
        return F.expr(f"lead(`{column}`, {n}) OVER (PARTITION BY `{self.key}` ORDER BY `{self.time}`)")


TICKER = Axis()
INDEX = Axis(key="index_id")
MARKET = Axis(key="market_id")


def full_mean(x, frame: WindowSpec, n: int) -> Column:
    """Mean over the frame, NULL unless it holds n non-null values."""
    return F.when(F.count(c(x)).over(frame) >= n, F.avg(c(x)).over(frame))


def full_max(x, frame: WindowSpec, n: int) -> Column:
    return F.when(F.count(c(x)).over(frame) >= n, F.max(c(x)).over(frame))


def full_min(x, frame: WindowSpec, n: int) -> Column:
    return F.when(F.count(c(x)).over(frame) >= n, F.min(c(x)).over(frame))
