"""Exponential averages: the one ordered recurrence Spark windows cannot express.

Rows are laid out by entity and sorted by time, then streamed through Arrow batches.
A batch is cut at an entity boundary: rows of its last entity wait for the next batch,
so a task holds one batch plus one entity (at most one row per calendar date). Every
span and every source is computed in the same pass, vectorised over the entities of a
batch; all other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.windows import TICKER, Axis


def _streamer(key: str, specs: list[tuple[str, str, int]], names: list[str]):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd
        import pyarrow as pa

        def emit(table: pa.Table) -> Iterator:
            ids = table.column(key).combine_chunks()
            if isinstance(ids, pa.ChunkedArray):
                ids = pa.concat_arrays(ids.chunks)
            codes = ids.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            cols = {n: table.column(n) for n in table.column_names}
            series = {
                s: pd.Series(table.column(s).to_numpy().astype("float64")) for s in {s for _, s, _ in specs}
            }
            for out, src, span in specs:
                vals = series[src].groupby(codes, sort=False).ewm(span=span, adjust=False).mean().to_numpy()
                cols[out] = pa.array(vals, type=pa.float64(), mask=np.isnan(vals))
            yield from pa.table({n: cols[n] for n in names}).to_batches()

        def tail_start(table: pa.Table) -> int:
            """First row of the table's last entity."""
            col = table.column(key)
            last = col[table.num_rows - 1]
            lo, hi = 0, table.num_rows - 1
            while lo < hi:
                mid = (lo + hi) // 2
                if col[mid].equals(last):
                    hi = mid
                else:
                    lo = mid + 1
            return lo

        waiting: list = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            table = pa.Table.from_batches([batch])
            same = waiting and waiting[-1].column(key)[0].equals(table.column(key)[table.num_rows - 1])
            if same:
                waiting.append(table)
                continue
            cut = tail_start(table)
            done = waiting + ([table.slice(0, cut)] if cut else [])
            waiting = [table.slice(cut)]
            if done:
                yield from emit(pa.concat_tables(done))
        if waiting:
            yield from emit(pa.concat_tables(waiting))

    return run


def add_emas(
    df: DataFrame,
    specs: list[tuple[str, str, int]],
    axis: Axis = TICKER,
    co_located: bool = False,
    state: DataFrame | None = None,
) -> DataFrame:
    """Add one column per (name, source, span): seeded at the first value, alpha = 2 / (span + 1).

    A missing value repeats the last average and ages its weight. `co_located` says the
    rows already are partitioned by the entity (a repartition upstream), which saves the
    exchange; the sort is planned either way and dropped when already there. With `state`
    (see `ema_state`) each entity's averages go on from where an earlier run ended.
    """
    if state is not None:
        return _continued(df, specs, axis, co_located, state)
    laid_out = df if co_located else df.repartition(axis.key)
    laid_out = laid_out.sortWithinPartitions(axis.key, axis.time)
    schema = T.StructType(list(df.schema.fields) + [T.StructField(n, T.DoubleType()) for n, _, _ in specs])
    return laid_out.mapInArrow(_streamer(axis.key, specs, schema.fieldNames()), schema)


def age_column(source: str) -> str:
    return f"age_{source}"


def ema_state(
    df: DataFrame, specs: list[tuple[str, str, int]], axis: Axis = TICKER, carry: tuple[str, ...] = (), by: tuple[str, ...] = ()
) -> DataFrame:
    """The end state of each entity (within each value of the `by` columns): last time, averages, ages, `carry` columns.

    `df` holds the averages under their names. An age is the number of rows since the source last had a value: a missing
    value repeats the average but ages its weight, so a later run needs both.
    """
    aged, last = _aged(df, specs, axis, carry)
    return aged.groupBy(axis.key, *by).agg(F.max_by(last, axis.time).alias("last")).select(axis.key, *by, "last.*")


def add_year_end(df: DataFrame, specs: list[tuple[str, str, int]], axis: Axis = TICKER, carry: tuple[str, ...] = ()) -> DataFrame:
    """Adds `_end`: at each entity's last row of a year what `ema_state` has for that year, else NULL. Rows that are laid out by
    entity need no exchange for it, and the averages themselves may go."""
    aged, last = _aged(df, specs, axis, carry)
    goes_on = F.year(axis.lead(axis.time)).eqNullSafe(F.year(axis.time))
    return aged.withColumn("_end", F.when(~goes_on, last)).drop("_pos", *[age_column(s) for s in dict.fromkeys(src for _, src, _ in specs)])


def _aged(df: DataFrame, specs, axis: Axis, carry: tuple[str, ...]):
    """Rows with the age of each source, and the state of a row."""
    sources = list(dict.fromkeys(src for _, src, _ in specs))
    first_name = {src: n for n, src, _ in reversed(specs)}
    seen = lambda s: F.max(F.when(F.col(s).isNotNull(), F.col("_pos"))).over(axis.sofar())
    aged = df.withColumn("_pos", F.row_number().over(axis.rows())).withColumns({
        age_column(s): F.when(F.col(first_name[s]).isNull(), 0).otherwise(F.col("_pos") - F.coalesce(seen(s), F.lit(0))).cast("int")
        for s in sources
    })
    return aged, F.struct(axis.time, *[n for n, _, _ in specs], *[age_column(s) for s in sources], *carry)


def _continued(df: DataFrame, specs, axis: Axis, co_located: bool, state: DataFrame) -> DataFrame:
    """The state goes before an entity's rows as rows of its own: the average as a value, then as many missing ones as its
    source's age. So the recurrence runs on as if the earlier rows were there, in the same code."""
    sources = list(dict.fromkeys(src for _, src, _ in specs))
    oldest = F.greatest(F.lit(0), *[F.col(age_column(s)) for s in sources])
    seeds = state.select(axis.key, F.explode(F.sequence(F.lit(0), oldest)).alias("_k"), oldest.alias("_oldest"), "*")
    seeds = seeds.select(
        state[axis.key], F.date_add(F.lit("0001-01-01").cast("date"), F.col("_k")).alias(axis.time),
        *[F.when(F.col("_k") == F.col("_oldest") - F.col(age_column(src)), F.col(n)).alias(f"_in_{n}") for n, src, _ in specs],
        F.lit(True).alias("_seed"))
    rows = df.withColumns({f"_in_{n}": F.col(src).cast("double") for n, src, _ in specs} | {"_seed": F.lit(False)})
    both = rows.unionByName(seeds, allowMissingColumns=True)
    out = add_emas(both, [(n, f"_in_{n}", span) for n, _, span in specs], axis)
    return out.filter(~F.col("_seed")).drop("_seed", *[f"_in_{n}" for n, _, _ in specs])
