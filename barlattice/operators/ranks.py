"""Average-rank percentiles inside each date's eligible set, without one task per date.

Values are split into order-preserving bins (see `bins`). The rank of a value is the
number of rows in earlier bins plus its rank inside its own bin, so only the rows of one
(date, bin) are sorted together. A heavy value has a bin of its own where every row has the
same rank; those rows need no order and are spread by a salt. So neither a date holding a
large part of all rows nor a value shared by many of them ends up in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bins import pieces_for, value_edges

_SALTS = 64


def rank_percentiles(
    rows: DataFrame,
    sources: dict[str, str],
    key: str = "ticker",
    group: str = "date",
    pieces: int | None = None,
) -> DataFrame:
    """One row per (group, key) with a percentile column per entry of `sources`.

    `rows` holds only the competitors (eligible rows) and should be a stored or staged
    table, since it is read more than once. A missing value has no percentile and does
    not take part.
    """
    names = list(sources)
    edges = value_edges(rows, sources, pieces or pieces_for(rows))
    salt = F.pmod(F.xxhash64(key), F.lit(_SALTS)).cast("int")

    def slot(i: int, name: str) -> Column:
        e, x = edges[name], F.col(sources[name])
        b = e.bin_of(x)
        pure = e.is_pure(b)
        return F.struct(
            F.lit(i).alias("h"), b.alias("b"), x.alias("x"), pure.alias("pure"),
            F.when(pure, salt).otherwise(0).alias("salt"),
        )

    slots = F.array(*[slot(i, n) for i, n in enumerate(names)])
    long = (
        rows.select(group, key, F.explode(F.filter(slots, lambda s: s["x"].isNotNull())).alias("s"))
        .select(group, key, "s.*")
    )
    # Per (group, horizon) this is at most one row per bin.
    over_bins = Window.partitionBy(group, "h").orderBy("b")
    offsets = (
        long.groupBy(group, "h", "b").agg(F.count(F.lit(1)).alias("size"), F.first("pure").alias("pure"))
        .withColumns({
            "before": F.sum("size").over(over_bins.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"),
            "total": F.sum("size").over(Window.partitionBy(group, "h")),
        })
        .withColumn("salt", F.explode(
            F.when(F.col("pure"), F.sequence(F.lit(0), F.lit(_SALTS - 1))).otherwise(F.array(F.lit(0)))
        ))
        .drop("pure")
    )
    piece = [group, "h", "b", "salt"]
    inside = Window.partitionBy(*piece).orderBy("x")
    ranked = long.withColumns({
        "place": F.rank().over(inside),
        "ties": F.count(F.lit(1)).over(inside.rangeBetween(Window.currentRow, Window.currentRow)),
    }).join(offsets.hint("merge"), piece)
    below = F.col("before") + F.when(F.col("pure"), 0).otherwise(F.col("place") - 1)
    same = F.when(F.col("pure"), F.col("size")).otherwise(F.col("ties"))
    pct = (below + (same + F.lit(1)) / F.lit(2.0)) / F.col("total") * F.lit(100.0)
    return ranked.withColumn("pct", pct).groupBy(group, key).agg(*[
        F.max(F.when(F.col("h") == i, F.col("pct"))).alias(n) for i, n in enumerate(names)
    ])
