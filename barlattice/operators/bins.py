"""Value bins that split any column into small, order-preserving pieces.

A mergeable sketch gives at most `pieces` edges per column; the edges become a literal,
so a row's bin is a pure function of its value and stays the same however often a task is
rerun. Equal values always share a bin, and apart from ties a bin holds about 1/pieces of
the rows, whatever the distribution looks like.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_PIECES = 256
PIECE_ROWS = 1_000_000  # rows of all groups together that one bin should hold at most, about


def pieces_for(rows: DataFrame, least: int = DEFAULT_PIECES, piece_rows: int = PIECE_ROWS) -> int:
    """Number of bins that grows with a stored table, so that no (group, bin) outgrows a task.

    Edges follow the values of all rows: a group that holds half of them in a narrow band also gets half of the bins.
    """
    return max(least, math.ceil(rows.count() / piece_rows))


@dataclass(frozen=True)
class Edges:
    """Bin edges of one column. Bin k holds edge[k-1] < x <= edge[k].

    A value that alone makes up a whole piece or more is heavy. It gets a bin of its own
    (listed in `pure`), closed off by the next smaller number, so that every other bin is
    small whatever the ties.
    """

    edges: np.ndarray
    pure: tuple[int, ...] = ()

    def bin_of(self, x: Column) -> Column:
        return bin_of(x, self.edges)

    def is_pure(self, b: Column) -> Column:
        return b.isin(*self.pure) if self.pure else F.lit(False)


def value_edges(df: DataFrame, columns: dict[str, Column | str], pieces: int = DEFAULT_PIECES) -> dict[str, Edges]:
    """Edges per column: one pass, a bounded mergeable sketch, about `pieces` numbers per column."""
    probs = [i / pieces for i in range(1, pieces)]
    row = df.agg(*[
        F.approx_percentile(F.col(c) if isinstance(c, str) else c, probs, 4 * pieces).alias(n)
        for n, c in columns.items()
    ]).first()
    return {n: _edges(np.array(row[n] or [], dtype="float64")) for n in columns}


def _edges(found: np.ndarray) -> Edges:
    values, counts = np.unique(found, return_counts=True)
    heavy = values[counts > 1]
    edges = np.union1d(values, np.nextafter(heavy, -np.inf))
    return Edges(edges, tuple(int(i) for i in np.searchsorted(edges, heavy)))


def bin_of(x: Column, edges: np.ndarray) -> Column:
    """Number of edges strictly below x, by a two-level search (about 2 * sqrt(edges) steps)."""
    if len(edges) == 0:
        return F.when(x.isNotNull(), F.lit(0))
    step = max(1, math.isqrt(len(edges)))
    all_edges = F.lit(edges)
    coarse = F.lit(edges[step - 1 :: step])
    blocks = F.size(F.filter(coarse, lambda e: e < x))
    inside = F.size(F.filter(F.slice(all_edges, blocks * step + 1, step), lambda e: e < x))
    return F.when(x.isNotNull(), blocks * step + inside)
