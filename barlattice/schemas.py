"""Explicit table schemas: no inference at scan, fixed projection at write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column lists of the tables.
VENDOR_BAR = T.StructType([
    T.StructField("T", T.StringType()),
    T.StructField("o", T.DoubleType()),
    T.StructField("h", T.DoubleType()),
    T.StructField("l", T.DoubleType()),
    T.StructField("c", T.DoubleType()),
    T.StructField("v", T.DoubleType()),
    T.StructField("vw", T.DoubleType()),
    T.StructField("n", T.LongType()),
    T.StructField("t", T.LongType()),
])

VENDOR_RENAMES = {
    "T": "ticker", "o": "open", "h": "high", "l": "low", "c": "close",
    "v": "volume", "vw": "vwap", "n": "transactions", "t": "epoch_ms",
}

LANDED_BAR = T.StructType([T.StructField(VENDOR_RENAMES[f.name], f.dataType) for f in VENDOR_BAR.fields])

BAR_COLUMNS = ["date", "ticker", "open", "high", "low", "close", "volume", "vwap"]

LANDED_REFERENCE = T.StructType([
    T.StructField("ticker", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("market", T.StringType()),
    T.StructField("locale", T.StringType()),
    T.StructField("primary_exchange", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("active", T.BooleanType()),
    T.StructField("currency_name", T.StringType()),
    T.StructField("cik", T.StringType()),
])

REFERENCE_COLUMNS = ["date"] + LANDED_REFERENCE.fieldNames()

LANDED_MEMBER = T.StructType([
    T.StructField("constituent_ticker", T.StringType()),
    T.StructField("weight", T.DoubleType()),
])

UNIVERSE_COLUMNS = [
    "date", "ticker", "close", "high", "low", "asset_type_ok", "adr20", "adr20_ok",
    "market_cap", "market_cap_ok", "eligible",
]

FEATURE_COLUMNS = [
    "date", "ticker", "eligible", "market_cap", "adr20", "close", "high", "low",
    "return_1d", "return_5d", "return_21d", "return_3m", "return_6m", "return_12m",
    "rs_percentile_1d", "rs_percentile_1w", "rs_percentile_1m",
    "rs_percentile_3m", "rs_percentile_6m", "rs_percentile_12m",
    "thrust_1d", "thrust_1w", "thrust_1m",
    "thrust_percentile_1d", "thrust_percentile_1w", "thrust_percentile_1m",
    "ema10", "ema20", "distance_ema10_pct", "distance_ema20_pct",
    "sma50", "sma50_slope_pct", "sma50_persistence_days",
    "atr14", "atr_pct", "atr_extension",
]
# End of fixed values.

LANDED = {
    "grouped_daily": LANDED_BAR,
    "grouped_daily_unadjusted": LANDED_BAR,
    "qqq_constituents": LANDED_MEMBER,
    "reference_tickers": LANDED_REFERENCE,
}

# What a vendor's own day files hold, and how its columns are named here.
VENDOR = {**LANDED, "grouped_daily": VENDOR_BAR, "grouped_daily_unadjusted": VENDOR_BAR}

BOOLEAN_COLUMNS = {"eligible", "asset_type_ok", "adr20_ok", "market_cap_ok", "active"}
STRING_COLUMNS = {"ticker"} | {
    f.name for f in LANDED_REFERENCE.fields if isinstance(f.dataType, T.StringType)
}


def _absent(name: str) -> Column:
    if name == "date":
        kind = "date"
    elif name in BOOLEAN_COLUMNS:
        kind = "boolean"
    elif name in STRING_COLUMNS:
        kind = "string"
    else:
        kind = "double"
    return F.lit(None).cast(kind).alias(name)


def conform(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly these columns in this order; an absent one becomes typed NULL."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else _absent(c) for c in columns])


def require_columns(df: DataFrame, columns, what: str) -> None:
    """Fail before the plan is built when inputs lack a needed column."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} missing required columns: {missing}")
