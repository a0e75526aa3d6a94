"""Fixed-edge bucketing. A bucket is an integer ordinal; labels live in the scheme."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import c


@dataclass(frozen=True)
class Scheme:
    """Edges and labels of one bucketing; `right` = right-closed with the lowest edge included."""

    name: str
    edges: tuple[float, ...]
    labels: tuple[str, ...]
    right: bool = False

    def __post_init__(self):
        if len(self.labels) != len(self.edges) - 1:
            raise ValueError(f"{self.name}: {len(self.edges)} edges need {len(self.edges) - 1} labels")

    def ordinal(self, x) -> Column:
        """0-based bucket ordinal, NULL for a missing or out-of-range value."""
        x = c(x)
        out = None
        for i in range(len(self.labels)):
            lo, hi = self.edges[i], self.edges[i + 1]
            cond = None
            if not math.isinf(lo):
                if self.right:
                    cond = (x >= lo) if i == 0 else (x > lo)
                else:
                    cond = x >= lo
            if not math.isinf(hi):
                upper = (x <= hi) if self.right else (x < hi)
                cond = upper if cond is None else cond & upper
            out = F.when(cond, i) if out is None else out.when(cond, i)
        return out

    def label(self, x) -> Column:
        return F.get(F.array(*[F.lit(s) for s in self.labels]), self.ordinal(x))


_INF = math.inf

# The bucket schemes.
RS_DECILES = Scheme(
    "coarse",
    (0, 10, 20, 30, 40, 50, 60, 70, 80, 90, 100),
    ("0-10", "10-20", "20-30", "30-40", "40-50", "50-60", "60-70", "70-80", "80-90", "90-100"),
    right=True,
)
RS_FINE = Scheme(
    "fine_above_80",
    (80, 82.5, 85, 87.5, 90, 92.5, 95, 97.5, 100),
    ("80-82.5", "82.5-85", "85-87.5", "87.5-90", "90-92.5", "92.5-95", "95-97.5", "97.5-100"),
    right=True,
)
RS_CROSS = Scheme(
    "rs_bucket",
    (0, 80, 90, 95, 97.5, 100 + 1e-6),
    ("<80", "80-90", "90-95", "95-97.5", "97.5-100"),
)
ATR_EXTENSION = Scheme(
    "atr_bucket",
    (-_INF, 0, 2, 4, 6, 8, 10, _INF),
    ("<0", "0-2", "2-4", "4-6", "6-8", "8-10", ">=10"),
)
EMA_DISTANCE = Scheme(
    "ema_bucket",
    (-_INF, -5, -2, 0, 2, 5, 10, _INF),
    ("<-5%", "-5% to -2%", "-2% to 0%", "0% to +2%", "+2% to +5%", "+5% to +10%", ">=+10%"),
)
PRIOR_EXTENSION = Scheme(
    "prev_ext_bucket",
    (-_INF, 4, 6, 8, 10, _INF),
    ("<4", "4-6", "6-8", "8-10", ">=10"),
)
EMA_DISTANCE_FINE = Scheme(
    "distance_bucket",
    (-_INF, -10, -7.5, -5, -3, -2, -1, 0, 1, 2, 3, 5, 7.5, 10, _INF),
    ("<-10%", "-10 to -7.5%", "-7.5 to -5%", "-5 to -3%", "-3 to -2%", "-2 to -1%", "-1 to 0%",
     "0 to +1%", "+1 to +2%", "+2 to +3%", "+3 to +5%", "+5 to +7.5%", "+7.5 to +10%", ">=+10%"),
)
# End of fixed values.
