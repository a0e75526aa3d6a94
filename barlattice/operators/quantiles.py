"""Exact linear-interpolated quantiles of many overlapping groups at once.

No group is ever brought together. The rows are read a fixed number of times:

1. sketch: one set of edges per metric (see `bins`);
2. code: each row's group ids, metric values and value bins are written once, narrow;
3. count: coded rows are counted per (group, metric, bin), which combines before the
   shuffle, and running counts tell in which bin each wanted rank lies;
4. pick: only rows of those bins are counted per distinct value, and the values at the
   wanted ranks are read off.

Groups that overlap (cells, marginals, cohorts, ranges) are unions of finer ones: rows with the same list of groups.
Rows are counted by that list, and only the counts are handed on to each group of it, so a row is never repeated
for the groups it is in. With lists that would be too many (several independent group families), a row has a list
for each family.

The result equals sorting each group and interpolating between neighbours.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .bins import pieces_for, value_edges


@dataclass(frozen=True)
class Metric:
    """A value column and the probabilities wanted from it."""

    name: str
    column: str
    probs: tuple[float, ...] = (0.5,)


def _running(keys: list[str], order: str):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


@dataclass(frozen=True)
class Coded:
    """Staged rows with their group columns, metric values and value bins (`_bin_<i>`)."""

    rows: DataFrame
    groups: tuple[str, ...]
    columns: tuple[str, ...]

    def long(self, columns) -> DataFrame:
        """(group columns, m, b, x): one row per finest group (see `fine`) and present metric value."""
        at = {c: i for i, c in enumerate(self.columns)}
        slots = F.array(*[
            F.struct(F.lit(i).alias("m"), F.col(f"_bin_{at[c]}").alias("b"), F.col(c).cast("double").alias("x"))
            for i, c in enumerate(columns)
        ])
        present = F.filter(slots, lambda s: s["b"].isNotNull())
        return self.fine(present.alias("_s")).withColumn("s", F.explode("_s")).select(*self.groups, "s.*")

    def _overlapping(self) -> str | None:
        """The group column that lists ids, or lists of ids by family; None when groups don't overlap."""
        return next((n for n, kind in self.rows.dtypes if n in self.groups and kind.startswith("array")), None)

    def fine(self, *columns) -> DataFrame:
        """Rows by finest group: once each, or once for each family of group lists."""
        df, name = self.rows.select(*self.groups, *columns), self._overlapping()
        if name and dict(df.dtypes)[name].startswith("array<array"):
            df = df.withColumn(name, F.explode(name))
        return df

    def spread(self, fine: DataFrame, keep: str | None = None) -> DataFrame:
        """What was aggregated by finest group, once for each group that it is part of (`keep`: the list under this name)."""
        name = self._overlapping()
        if name is None:
            return fine
        kept = fine.withColumn(keep, F.col(name)) if keep else fine
        return kept.withColumn(name, F.explode(name))

    def totals(self, **sums) -> DataFrame:
        """Sums (name -> what is summed up, a column expression) of every group, added up from those of the finest groups."""
        inputs = [c for c in self.rows.columns if c not in self.groups]
        fine = self.fine(*inputs).groupBy(*self.groups).agg(*[F.sum(e).alias(n) for n, e in sums.items()])
        if self._overlapping() is None:
            return fine
        return self.spread(fine).groupBy(*self.groups).agg(*[F.sum(n).alias(n) for n in sums])


def code_rows(
    rows: DataFrame, groups: dict, columns, keep=(), pieces: int | None = None
) -> Coded:
    """Write what the later passes need: group columns, metric columns, their bins, `keep`.

    `groups` maps group column names to expressions. At most one of them may be an array
    of ids, for rows that belong to several groups.
    """
    columns = tuple(dict.fromkeys(columns))
    edges = value_edges(rows, {c: c for c in columns}, pieces or pieces_for(rows))
    coded = rows.select(
        *[(F.col(e) if isinstance(e, str) else e).alias(k) for k, e in groups.items()],
        *dict.fromkeys([*columns, *keep]),
        *[edges[c].bin_of(F.col(c)).alias(f"_bin_{i}") for i, c in enumerate(columns)],
    )
    for name, kind in coded.dtypes:
        if name in groups and kind.startswith("array"):
            coded = coded.filter(F.size(name) > 0)
    return Coded(stage(coded, "coded"), tuple(groups), columns)


def exact_quantiles(coded: Coded, metrics: list[Metric], few_groups: bool = True) -> DataFrame:
    """(group columns, metric, prob, value) for every non-empty group, metric and probability.

    With `few_groups` the wanted bins (groups x metrics x probabilities, a number known
    beforehand) are broadcast for the last pass; otherwise Spark chooses the join.
    """
    keys = list(coded.groups)
    long = coded.long([m.column for m in metrics])
    gm = keys + ["m"]
    lists = coded._overlapping()
    fine = counts = long.groupBy(*gm, "b").agg(F.count(F.lit(1)).alias("size"))
    if lists:
        fine = stage(fine, "fine")
        counts = coded.spread(fine).groupBy(*gm, "b").agg(F.sum("size").alias("size"))
    counts = counts.withColumns({
        "upto": F.sum("size").over(_running(gm, "b")),
        "n": F.sum("size").over(Window.partitionBy(*gm)),
    })
    wanted = F.array(*[
        F.array(*[F.lit(float(p)) for p in m.probs]) for m in metrics
    ])
    probs = F.explode(F.get(wanted, F.col("m")))
    targets = counts.withColumn("p", probs)
    spot = (F.col("n") - 1) * F.col("p")
    targets = targets.withColumns({
        "lo": F.floor(spot), "hi": F.ceil(spot), "frac": spot - F.floor(spot),
        "before": F.col("upto") - F.col("size"),
    })
    # Ranks are 0-based; a bin covers ranks before .. upto - 1. An upper neighbour may sit
    # in a later bin than its lower one.
    ends = targets.withColumn(
        "end", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("lo").alias("rank")),
                                 F.struct(F.lit(1).alias("side"), F.col("hi").alias("rank"))))
    ).select(*gm, "b", "p", "frac", "before", "upto", "end.side", "end.rank")
    ends = ends.filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("upto")))

    by_bin = (
        ends.groupBy(*gm, "b")
        .agg(
            F.first("before").alias("before"),
            F.collect_set(F.struct("p", "frac", "side", "rank")).alias("asks"),
        )
    )
    bins = by_bin.select(*gm, "b")
    bins = F.broadcast(bins) if few_groups else bins
    if lists:
        # Which finest groups' bins matter to some wanted one; then rows are looked at once, and their counts handed on.
        matter = coded.spread(fine, keep="_list").join(bins, gm + ["b"], "left_semi")
        matter = matter.drop(lists).withColumnRenamed("_list", lists).select(*gm, "b").distinct()
        values = long.join(matter, gm + ["b"], "left_semi").groupBy(*gm, "b", "x").agg(F.count(F.lit(1)).alias("ties"))
        values = coded.spread(values).join(bins, gm + ["b"], "left_semi").groupBy(*gm, "b", "x").agg(F.sum("ties").alias("ties"))
    else:
        values = long.join(bins, gm + ["b"], "left_semi").groupBy(*gm, "b", "x").agg(F.count(F.lit(1)).alias("ties"))
    values = values.withColumn("upto", F.sum("ties").over(_running(gm + ["b"], "x")))
    # The coded values may be many; only the wanted bins may travel.
    asked = F.broadcast(by_bin) if few_groups else by_bin.hint("merge")
    picked = (
        values.join(asked, gm + ["b"])
        .select(
            *gm, "x", F.explode("asks").alias("a"),
            (F.col("before") + F.col("upto") - F.col("ties")).alias("from_rank"),
            (F.col("before") + F.col("upto")).alias("to_rank"),
        )
        .filter((F.col("a.rank") >= F.col("from_rank")) & (F.col("a.rank") < F.col("to_rank")))
        .groupBy(*gm, "a.p")
        .agg(
            F.max("a.frac").alias("frac"),
            F.max(F.when(F.col("a.side") == 0, F.col("x"))).alias("low"),
            F.max(F.when(F.col("a.side") == 1, F.col("x"))).alias("high"),
        )
    )
    names = F.array(*[F.lit(m.name) for m in metrics])
    return picked.select(
        *keys,
        F.get(names, F.col("m")).alias("metric"),
        F.col("p").alias("prob"),
        (F.col("low") + (F.col("high") - F.col("low")) * F.col("frac")).alias("value"),
    )


def wide_quantiles(coded: Coded, outputs: dict[str, tuple[str, float]], few_groups: bool = True) -> DataFrame:
    """One row per group, one column per output name -> (value column, probability)."""
    by_column: dict[str, list[float]] = {}
    for column, prob in outputs.values():
        probs = by_column.setdefault(column, [])
        if prob not in probs:
            probs.append(prob)
    metrics = [Metric(c, c, tuple(ps)) for c, ps in by_column.items()]
    long = exact_quantiles(coded, metrics, few_groups)
    return long.groupBy(*coded.groups).agg(*[
        F.max(F.when((F.col("metric") == c) & (F.col("prob") == F.lit(p)), F.col("value"))).alias(n)
        for n, (c, p) in outputs.items()
    ])
