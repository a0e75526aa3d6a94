"""Per-entity features. All windows share one (key, time) spec: one exchange, one sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as cfg
from ..functions.scalar import finite, held, pct_gap, pct_move, ratio
from ..functions.windows import TICKER, Axis, full_max, full_mean, full_min
from .ema import add_emas


def add_returns(df: DataFrame, axis: Axis = TICKER, horizons: dict[str, int] | None = None) -> DataFrame:
    """Percent change over n of the entity's own rows; no fill of missing closes."""
    horizons = cfg.RETURN_HORIZONS if horizons is None else horizons
    return df.withColumns({
        name: pct_move("close", axis.lag("close", n)) for name, n in horizons.items()
    })


def add_true_range(df: DataFrame, axis: Axis = TICKER) -> DataFrame:
    """Largest of the day range and the two gaps to the previous close; missing terms skipped."""
    prev = axis.lag("close")
    return df.withColumn(
        "true_range",
        F.greatest(
            F.col("high") - F.col("low"),
            F.abs(F.col("high") - prev),
            F.abs(F.col("low") - prev),
        ),
    )


def add_atr(df: DataFrame, axis: Axis = TICKER, window: int = 14) -> DataFrame:
    """ATR14 as the simple mean of true range, and its percent of the close."""
    out = add_true_range(df, axis)
    out = out.withColumn("atr14", full_mean("true_range", axis.roll(window), window))
    return out.withColumn("atr_pct", ratio("atr14", "close") * F.lit(100.0))


def add_sma(df: DataFrame, spans: dict[str, int], axis: Axis = TICKER) -> DataFrame:
    return df.withColumns({name: full_mean("close", axis.roll(n), n) for name, n in spans.items()})


def add_moving_averages(df: DataFrame, axis: Axis = TICKER, co_located: bool = False) -> DataFrame:
    """EMA10, EMA20, SMA50 and the distances of the close to the two EMAs."""
    out = add_sma(df, {"sma50": 50}, axis)
    out = add_emas(out, [("ema10", "close", 10), ("ema20", "close", 20)], axis, co_located=co_located)
    return add_ema_distances(out)


def add_ema_distances(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "distance_ema10_pct": pct_gap("close", "ema10"),
        "distance_ema20_pct": pct_gap("close", "ema20"),
    })


def add_sma50_slope(df: DataFrame, axis: Axis = TICKER, lookback: int = 5) -> DataFrame:
    return df.withColumn("sma50_slope_pct", pct_gap("sma50", axis.lag("sma50", lookback)))


def add_sma50_persistence(df: DataFrame, axis: Axis = TICKER) -> DataFrame:
    """Signed run length of the close staying above (+) or not above (-) its SMA50.

    A run starts on the first row, on a flip and at either edge of a stretch without
    SMA50. Its length is the distance to the latest start, so no second sort is needed.
    """
    valid = F.col("sma50").isNotNull()
    above = held(F.col("close") > F.col("sma50"))
    pos = F.row_number().over(axis.rows())
    out = df.withColumns({"_valid": valid, "_above": above, "_pos": pos})
    starts = (
        (F.col("_pos") == 1)
        | ~F.col("_valid")
        | ~F.coalesce(axis.lag("_valid"), F.lit(False))
        | (F.col("_above") != F.coalesce(axis.lag("_above"), F.lit(False)))
    )
    out = out.withColumn("_start", F.when(starts, F.col("_pos")))
    run = (F.col("_pos") - F.max("_start").over(axis.sofar()) + F.lit(1)).cast("double")
    return out.withColumn(
        "sma50_persistence_days",
        F.when(F.col("_valid"), F.when(F.col("_above"), run).otherwise(-run)),
    ).drop("_valid", "_above", "_pos", "_start")


def carry_persistence(df: DataFrame, first, before: str, axis: Axis = TICKER) -> DataFrame:
    """Run lengths of rows from `first` on, where the rows before it are only a lookback and a run may have begun earlier.

    `before` is a column with the entity's true run length at its last row before `first`. Rows that go on the run of that
    row get what it was counted short; NULL (no earlier row) changes nothing.
    """
    value, start = F.col("sma50_persistence_days"), F.lit(first)
    out = df.withColumn("_pos", F.row_number().over(axis.rows()))
    edge = F.max(F.when(F.col(axis.time) < start, F.struct("_pos", "sma50_persistence_days"))).over(Window.partitionBy(axis.key))
    out = out.withColumn("_edge", edge)
    counted = F.col("_edge.sma50_persistence_days")
    same_run = (F.col(axis.time) >= start) & (value == counted + F.signum(counted) * (F.col("_pos") - F.col("_edge._pos")))
    return out.withColumn(
        "sma50_persistence_days", F.when(same_run & F.col(before).isNotNull(), value + F.col(before) - counted).otherwise(value)
    ).drop("_pos", "_edge")


def add_atr_extension(df: DataFrame) -> DataFrame:
    """Gain over SMA50 measured in ATR percents; non-finite becomes missing."""
    out = df.withColumn("gain_from_sma50_pct", pct_gap("close", "sma50"))
    return out.withColumn("atr_extension", finite(ratio("gain_from_sma50_pct", "atr_pct")))


def add_adr(df: DataFrame, axis: Axis = TICKER, window: int = 20, out: str = "adr20") -> DataFrame:
    """Mean of the last `window` daily ranges (high / low - 1) * 100."""
    ranged = df.withColumn("_range_pct", pct_move("high", "low"))
    return ranged.withColumn(out, full_mean("_range_pct", axis.roll(window), window)).drop("_range_pct")


def thrust_emas(source: str = "return_1d") -> list[tuple[str, str, int]]:
    spans = sorted({s for pair in cfg.THRUST_SPANS.values() for s in pair})
    return [(f"_ema_{source}_{s}", source, s) for s in spans]


def thrust_columns(df: DataFrame, source: str = "return_1d", keep: bool = False) -> DataFrame:
    """Short minus long EMA of the daily return, from EMAs already on the rows (which go, unless `keep`)."""
    out = df.withColumns({
        name: F.col(f"_ema_{source}_{short}") - F.col(f"_ema_{source}_{long}")
        for name, (short, long) in cfg.THRUST_SPANS.items()
    })
    return out if keep else out.drop(*[n for n, _, _ in thrust_emas(source)])


def add_thrust(df: DataFrame, axis: Axis = TICKER, co_located: bool = False) -> DataFrame:
    out = df if "return_1d" in df.columns else add_returns(df, axis, {"return_1d": 1})
    return thrust_columns(add_emas(out, thrust_emas(), axis, co_located=co_located))


def add_new_high(df: DataFrame, lookback: int = 20, axis: Axis = TICKER, out: str = "is_new_20d_high") -> DataFrame:
    """High above every one of the previous `lookback` highs; needs a full lookback."""
    prior = full_max("high", axis.past(lookback), lookback)
    return df.withColumn(out, held(F.col("high") > prior))


def add_new_low(df: DataFrame, lookback: int = 20, axis: Axis = TICKER, out: str = "is_new_20d_low") -> DataFrame:
    prior = full_min("low", axis.past(lookback), lookback)
    return df.withColumn(out, held(F.col("low") < prior))


def add_ticker_features(bars: DataFrame, axis: Axis = TICKER, co_located: bool = False) -> DataFrame:
    """Every per-ticker feature of the panel in one pass over rows laid out by ticker.

    The bars are moved once; returns, ranges, averages and runs are windows on that
    layout, and all EMAs (of close and of daily return) are one Arrow pass over it.
    """
    df = bars if co_located else bars.repartition(axis.key)
    df = add_returns(df, axis)
    df = add_atr(df, axis).drop("true_range")
    df = add_adr(df, axis)
    df = add_sma(df, {"sma50": 50}, axis)
    df = add_sma50_slope(df, axis)
    df = add_sma50_persistence(df, axis)
    df = add_atr_extension(df).drop("gain_from_sma50_pct")
    emas = [("ema10", "close", 10), ("ema20", "close", 20)] + thrust_emas()
    df = add_emas(df, emas, axis, co_located=True)
    return thrust_columns(add_ema_distances(df))
