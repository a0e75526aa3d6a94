"""Dense bucket cells, their outcome statistics and their baselines.

A study is a fixed list of cells known before any data is read: (table, fixed labels,
bucket labels). A row is turned into the ids of all cells it counts in (cell, marginal,
universe, cohort ...), so every table of a study comes out of one aggregation, and empty
cells stay visible because the list of cells, not the data, decides the rows. Rows are
aggregated by their list of ids, and those few aggregates are added up to cells.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quantiles import code_rows, wide_quantiles

# Metric name -> (outcome column stem, statistic).
BUCKET_METRICS = {
    "median_mfe_pct": ("mfe_pct_{h}d", 0.5),
    "mean_mfe_pct": ("mfe_pct_{h}d", "mean"),
    "p75_mfe_pct": ("mfe_pct_{h}d", 0.75),
    "p90_mfe_pct": ("mfe_pct_{h}d", 0.9),
    "median_mae_pct": ("mae_pct_{h}d", 0.5),
    "mean_mae_pct": ("mae_pct_{h}d", "mean"),
    "median_forward_return": ("forward_return_close_{h}d", 0.5),
    "mean_forward_return": ("forward_return_close_{h}d", "mean"),
    "reached_plus_5pct_share": ("reached_plus_5pct_{h}d", "mean"),
    "reached_plus_10pct_share": ("reached_plus_10pct_{h}d", "mean"),
    "reached_2atr_share": ("reached_2atr_{h}d", "mean"),
    "reached_3atr_share": ("reached_3atr_{h}d", "mean"),
    "reached_plus_5_before_minus_5_share": ("reached_plus_5_before_minus_5_{h}d", "mean"),
    "reached_plus_10_before_minus_5_share": ("reached_plus_10_before_minus_5_{h}d", "mean"),
}
# End of fixed values.
METRIC_COLS = list(BUCKET_METRICS)


def outcome_inputs(horizons) -> list[str]:
    """The outcome columns the bucket metrics read."""
    return list(dict.fromkeys(stem.format(h=h) for h in horizons for stem, _ in BUCKET_METRICS.values()))


@dataclass(frozen=True)
class Dim:
    """A bucketed axis: output column, its labels, and the row's ordinal expression."""

    name: str
    labels: tuple[str, ...]
    ordinal: Column


@dataclass
class CellSpace:
    """All cells of a study, numbered on the driver (hundreds, never data-sized)."""

    rows: list[dict] = field(default_factory=list)
    families: dict[str, list[Column]] = field(default_factory=dict)
    index: dict = field(default_factory=dict)

    def add(self, table: str, fixed: dict | None = None, dims: list[Dim] = (), where: Column | None = None) -> None:
        fixed = dict(fixed or {})
        base = len(self.rows)
        for combo in itertools.product(*[range(len(d.labels)) for d in dims]):
            labels = {d.name: d.labels[i] for d, i in zip(dims, combo)}
            row = {"cell_id": len(self.rows), "table": table, **fixed, **labels}
            self.index[self._key(table, {**fixed, **labels})] = row["cell_id"]
            self.rows.append(row)
        code = F.lit(base)
        offset = None
        for d in dims:
            offset = d.ordinal if offset is None else offset * F.lit(len(d.labels)) + d.ordinal
        if offset is not None:
            code = code + offset  # NULL when any bucket is NULL: the row is in no such cell
        if where is not None:
            code = F.when(where, code)
        # Cells of different RS horizons are independent: together they would make far more lists than each alone.
        self.families.setdefault(fixed.get("rs_horizon", ""), []).append(code.cast("int"))

    @staticmethod
    def _key(table: str, labels: dict):
        return table, tuple(sorted(labels.items()))

    def id_of(self, table: str, **labels) -> int | None:
        return self.index.get(self._key(table, labels))

    def ids(self) -> Column:
        """The ids of all cells the row counts in, as one list for each family of cells that has any."""
        lists = F.array(*[F.array_compact(F.array(*exprs)) for exprs in self.families.values()])
        return F.filter(lists, lambda x: F.size(x) > 0)

    def frame(self, spark: SparkSession, tables, columns: dict[str, str], extra: dict | None = None) -> DataFrame:
        """The cells of some tables as rows: cell_id, the label columns, and computed id columns.

        `columns` maps output label columns to SQL types; `extra` maps a column name to a
        function of the cell's dict that gives the id of one of its baselines.
        """
        extra = extra or {}
        tables = {tables} if isinstance(tables, str) else set(tables)
        picked = [r for r in self.rows if r["table"] in tables]
        fields = [T.StructField("cell_id", T.IntegerType()), T.StructField("table", T.StringType())]
        fields += [
            T.StructField(n, {"string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType()}[t])
            for n, t in columns.items()
        ]
        fields += [T.StructField(n, T.IntegerType()) for n in extra]
        data = [
            tuple([r["cell_id"], r["table"]] + [r.get(n) for n in columns] + [fn(r) for fn in extra.values()])
            for r in picked
        ]
        return spark.createDataFrame(data, T.StructType(fields))


def bucket_stats(rows: DataFrame, space: CellSpace, horizons, extra_medians: dict[str, str] | None = None) -> DataFrame:
    """(cell_id, outcome_horizon, n, 14 metrics) for every non-empty cell.

    Missing outcomes are skipped per metric, while n counts the cell's rows. `rows` is a
    stored or staged table of the study's eligible rows. `extra_medians` adds medians of
    further columns, repeated on every horizon.
    """
    horizons = tuple(horizons)
    extra = dict(extra_medians or {})
    means = {
        f"{m}__{h}": stem.format(h=h)
        for h in horizons for m, (stem, stat) in BUCKET_METRICS.items() if stat == "mean"
    }
    averaged = list(dict.fromkeys(means.values()))
    wanted = {
        f"{m}__{h}": (stem.format(h=h), stat)
        for h in horizons for m, (stem, stat) in BUCKET_METRICS.items() if stat != "mean"
    }
    wanted |= {name: (column, 0.5) for name, column in extra.items()}
    inputs = outcome_inputs(horizons)
    coded = code_rows(rows, {"cell_id": space.ids()}, [c for c, _ in wanted.values()], keep=inputs)
    plain = coded.totals(
        n=F.lit(1), **{f"sum_{c}": F.col(c) for c in averaged}, **{f"n_{c}": F.col(c).isNotNull().cast("long") for c in averaged})
    plain = plain.select("cell_id", "n", *[F.try_divide(f"sum_{c}", f"n_{c}").alias(k) for k, c in means.items()])
    both = plain.join(wide_quantiles(coded, wanted), "cell_id", "left")
    per_h = F.array(*[
        F.struct(F.lit(h).alias("outcome_horizon"), *[F.col(f"{m}__{h}").alias(m) for m in METRIC_COLS])
        for h in horizons
    ])
    return both.select("cell_id", "n", *extra, F.explode(per_h).alias("s")).select("cell_id", "n", *extra, "s.*")


def dense(cells: DataFrame, stats: DataFrame, horizons) -> DataFrame:
    """Every cell for every outcome horizon; empty cells have n = 0 and NULL metrics."""
    grid = cells.withColumn("outcome_horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    return grid.join(stats, ["cell_id", "outcome_horizon"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def with_baseline(table: DataFrame, stats: DataFrame, name: str, id_col: str) -> DataFrame:
    """baseline_{name}_{metric} and delta_vs_{name}_{metric} from the cell that `id_col` points at.

    The statistics side has one row per cell and horizon of a space numbered on the
    driver, so its size is fixed by the study and not by the data.
    """
    base = F.broadcast(stats.select(
        F.col("cell_id").alias(id_col), "outcome_horizon",
        *[F.col(m).alias(f"baseline_{name}_{m}") for m in METRIC_COLS],
    ))
    out = table.join(base, [id_col, "outcome_horizon"], "left")
    return out.withColumns({
        f"delta_vs_{name}_{m}": F.col(m) - F.col(f"baseline_{name}_{m}") for m in METRIC_COLS
    })


def baseline_columns(name: str) -> list[str]:
    return [x for m in METRIC_COLS for x in (f"baseline_{name}_{m}", f"delta_vs_{name}_{m}")]


def small_cells(table: DataFrame, limit: int = 30, n: str = "n") -> DataFrame:
    """Cells too thin to trust; listed, never merged or dropped from their table."""
    return table.filter(F.col(n) < limit)
