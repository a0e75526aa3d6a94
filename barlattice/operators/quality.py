"""Data-quality metrics as rows (metric, key, value) and quantile-bucket sanity reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, OutcomeConfig, UniverseConfig
from ..functions.scalar import held
from .bins import bin_of
from .distinct import bitmaps, counted, merged, numbered
from .quantiles import Metric, code_rows, exact_quantiles, wide_quantiles


def as_rows(df: DataFrame, metrics: dict[str, str], key: str | Column | None = None) -> DataFrame:
    """Unpivot columns into (metric, key, value) rows."""
    k = F.lit(None).cast("string") if key is None else (F.col(key) if isinstance(key, str) else key).cast("string")
    slots = F.array(*[
        F.struct(F.lit(name).alias("metric"), k.alias("key"), F.col(col).cast("double").alias("value"))
        for name, col in metrics.items()
    ])
    return df.select(F.explode(slots).alias("s")).select("s.*")


def universe_quality(universe: DataFrame, conf: UniverseConfig = DEFAULT.universe) -> DataFrame:
    """Coverage and plausibility of the universe table.

    Dates are distinct-counted from a per-date pre-aggregate; the median of the eligible
    count is over one number per date.
    """
    per_day = universe.groupBy("date").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(held(F.col("eligible"))).alias("eligible"),
        F.count_if(F.col("market_cap").isNull()).alias("no_cap"),
        F.count_if(F.col("close").isNull() | F.col("high").isNull() | F.col("low").isNull()).alias("no_ohlc"),
        F.count_if(held(F.col("close") > conf.implausible_close)).alias("implausible"),
    )
    days = per_day.agg(
        F.count(F.lit(1)).alias("trading_days"),
        F.median(F.when(F.col("eligible") > 0, F.col("eligible"))).alias("median_eligible_universe_size"),
        (F.sum("no_cap") / F.sum("rows") * 100.0).alias("missing_market_cap_pct"),
        (F.sum("no_ohlc") / F.sum("rows") * 100.0).alias("missing_ohlc_pct"),
        F.sum("implausible").alias("implausible_price_row_count"),
    )
    low = F.coalesce(F.col("median_eligible_universe_size"), F.lit(0.0)) < 50
    days = days.withColumn("warning_small_universe", low.cast("int"))
    # Tickers a year, from bitmaps of its months.
    numbers = universe.select("date", "ticker").join(numbered(universe, "ticker"), "ticker")
    months = bitmaps(numbers, [F.year("date").alias("y"), F.month("date").alias("m")])
    per_year = counted(merged(months, ["y"]), ["y"], "tickers")
    odd_tickers = universe.filter(F.col("close") > conf.implausible_close).select("ticker").distinct()
    odd = odd_tickers.agg(F.count(F.lit(1)).alias("implausible_price_ticker_count"))
    examples = odd_tickers.orderBy("ticker").limit(10).withColumn("one", F.lit(1))
    names = [
        "trading_days", "median_eligible_universe_size", "missing_market_cap_pct", "missing_ohlc_pct",
        "implausible_price_row_count", "warning_small_universe",
    ]
    return (
        as_rows(days, {n: n for n in names})
        .unionByName(as_rows(per_year, {"tickers_per_year": "tickers"}, "y"))
        .unionByName(as_rows(odd, {"implausible_price_ticker_count": "implausible_price_ticker_count"}))
        .unionByName(as_rows(examples, {"implausible_price_ticker_example": "one"}, "ticker"))
    )


def near_threshold_rows(universe: DataFrame, conf: UniverseConfig = DEFAULT.universe) -> DataFrame:
    lo, hi = conf.market_cap_min * (1 - conf.near_band), conf.market_cap_min * (1 + conf.near_band)
    return universe.filter(F.col("market_cap").between(lo, hi))


def volatile_tickers(universe: DataFrame, conf: UniverseConfig = DEFAULT.universe) -> DataFrame:
    """Tickers near the cap cutoff whose mean monthly cap jumps by more than the ratio, either way."""
    known = universe.filter(F.col("market_cap").isNotNull())
    near = near_threshold_rows(known, conf).select("ticker").distinct()
    monthly = (
        known.join(near, "ticker", "left_semi")
        .groupBy("ticker", F.trunc("date", "month").alias("month"))
        .agg(F.avg("market_cap").alias("cap"))
    )
    w = Window.partitionBy("ticker").orderBy("month")
    step = F.try_divide(F.col("cap"), F.lag("cap").over(w))
    spikes = monthly.withColumn("ratio", step).filter(
        (F.col("ratio") > conf.volatile_ratio) | (F.col("ratio") < 1.0 / conf.volatile_ratio)
    )
    return spikes.select("ticker").distinct()


def cap_sensitivity(universe: DataFrame, conf: UniverseConfig = DEFAULT.universe) -> DataFrame:
    """How many rows and tickers sit near the cap cutoff, and which of them are volatile (first ten)."""
    near = near_threshold_rows(universe, conf).groupBy("ticker").agg(F.count(F.lit(1)).alias("rows"))
    counts = near.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("near_threshold_row_count"),
        F.count(F.lit(1)).alias("near_threshold_ticker_count"),
    )
    volatile = volatile_tickers(universe, conf)
    n_volatile = volatile.agg(F.count(F.lit(1)).alias("near_threshold_volatile_ticker_count"))
    top = volatile.orderBy("ticker").limit(10).withColumn("one", F.lit(1))
    return (
        as_rows(counts, {n: n for n in counts.columns})
        .unionByName(as_rows(n_volatile, {n: n for n in n_volatile.columns}))
        .unionByName(as_rows(top, {"near_threshold_volatile_ticker_example": "one"}, "ticker"))
    )


def tie_diagnostics(outcomes: DataFrame, conf: OutcomeConfig = DEFAULT.outcomes) -> DataFrame:
    """Same-row ties, complete windows and tie percent per race column, plus the total."""
    pairs = [(conf.race_name(u, d, h, True), conf.race_name(u, d, h)) for h in conf.horizons for u, d in conf.races()]
    sums = outcomes.agg(
        *[F.coalesce(F.sum(t).cast("long"), F.lit(0)).alias(f"t{i}") for i, (t, _) in enumerate(pairs)],
        *[F.count(b).alias(f"n{i}") for i, (_, b) in enumerate(pairs)],
    )
    slots = F.array(*[
        F.struct(F.lit(t).alias("tie_column"), F.col(f"t{i}").alias("tie_count"), F.col(f"n{i}").alias("window_complete_count"))
        for i, (t, _) in enumerate(pairs)
    ])
    per = sums.select(F.explode(slots).alias("s")).select("s.*")
    total = per.agg(
        F.lit("total").alias("tie_column"), F.sum("tie_count").alias("tie_count"),
        F.sum("window_complete_count").alias("window_complete_count"),
    )
    return per.unionByName(total).withColumn(
        "tie_pct",
        F.when(F.col("window_complete_count") > 0, F.lit(100.0) * F.col("tie_count") / F.col("window_complete_count"))
        .otherwise(F.lit(0.0)),
    )


def component_status(counts: DataFrame, min_expected: int = 90) -> DataFrame:
    """Component-count range with its warning, from one row per date."""
    comp = counts.agg(
        F.median("component_count").alias("qqq_component_count_median"),
        F.min("component_count").alias("qqq_component_count_min"),
        F.max("component_count").alias("qqq_component_count_max"),
        (F.min("component_count") < min_expected).cast("int").alias("warning_few_components"),
    )
    return as_rows(comp, {c: c for c in comp.columns})


def breadth_status(breadth: DataFrame) -> DataFrame:
    """Market-breadth rows and the median future shares, from one row per date."""
    shares = [c for c in ("future_rs80plus_share_20d", "future_rs90plus_share_20d", "future_rs95plus_share_20d")
              if c in breadth.columns]
    market = breadth.agg(
        F.count(F.lit(1)).alias("market_breadth_rows"),
        *[F.median(c).alias(f"market_breadth_{c}_median") for c in shares],
    )
    return as_rows(market, {c: c for c in market.columns})


def index_status(counts: DataFrame, breadth: DataFrame, min_expected: int = 90) -> DataFrame:
    """Component counts and market breadth together."""
    return component_status(counts, min_expected).unionByName(breadth_status(breadth))


def quantile_buckets(
    rows: DataFrame, bucket: str, outcomes: list[str], label: str | None = None, n_buckets: int = 10
) -> DataFrame:
    """Medians and row count per quantile bucket of one column.

    Edges are the exact interpolated quantiles with duplicates dropped; buckets are
    right-closed and the lowest edge belongs to the first. The edges are a handful of
    numbers and become a literal. `rows` is a stored or staged table.
    """
    have = rows.filter(F.col(bucket).isNotNull()).select(bucket, *outcomes)
    probs = tuple(i / n_buckets for i in range(n_buckets + 1))
    found = exact_quantiles(code_rows(have, {"g": F.lit(0)}, [bucket]), [Metric("x", bucket, probs)]).collect()
    edges = sorted({r["value"] for r in found})
    label = label or bucket
    if len(edges) < 2:
        kinds = ", ".join([f"{label}_bucket int", "bucket_lo double", "bucket_hi double"]
                          + [f"{o} double" for o in outcomes] + ["n long"])
        return rows.sparkSession.createDataFrame([], kinds)
    import numpy as np

    lit = np.array(edges)
    ordinal = F.greatest(F.lit(1), bin_of(F.col(bucket), lit))
    coded = code_rows(have, {"_o": ordinal}, outcomes)
    counts = coded.rows.groupBy("_o").agg(F.count(F.lit(1)).alias("n"))
    mids = wide_quantiles(coded, {o: (o, 0.5) for o in outcomes})
    return counts.join(mids, "_o", "left").select(
        F.col("_o").alias(f"{label}_bucket"),
        F.get(F.lit(lit), F.col("_o") - 1).alias("bucket_lo"),
        F.get(F.lit(lit), F.col("_o")).alias("bucket_hi"),
        *outcomes, "n",
    )
