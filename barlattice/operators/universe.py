"""Point-in-time eligibility: asset type, daily range, market cap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as cfg
from ..config import DEFAULT, UniverseConfig
from ..functions.scalar import held
from ..functions.windows import TICKER, Axis
from ..schemas import UNIVERSE_COLUMNS, conform
from .technical import add_adr


def asset_type_ok(snapshots: DataFrame, conf: UniverseConfig = DEFAULT.universe) -> DataFrame:
    """Distinct (date, ticker) pairs listed that day as an included type, off the OTC venues.

    Whether a ticker is still active today is not looked at: being on that day's list is
    what counts, so later delistings do not rewrite history.
    """
    kept = snapshots
    if "type" in snapshots.columns:
        kept = kept.filter(
            F.col("type").isin(*cfg.INCLUDED_TYPES) & ~F.col("type").isin(*cfg.EXCLUDED_TYPES)
        )
    if conf.exclude_otc and "primary_exchange" in snapshots.columns:
        kept = kept.filter(~held(F.upper("primary_exchange").startswith("OTC")))
    return kept.select("date", "ticker").dropDuplicates(["date", "ticker"]).withColumn("asset_type_ok", F.lit(True))


def with_unadjusted_close(bars: DataFrame, unadjusted: DataFrame) -> DataFrame:
    """Left join of the close as traded that day."""
    return bars.join(unadjusted.select("date", "ticker", "close_unadjusted"), ["date", "ticker"], "left")


def with_asset_type(bars: DataFrame, listed: DataFrame) -> DataFrame:
    return bars.join(listed.hint("merge"), ["ticker", "date"], "left").withColumn(
        "asset_type_ok", F.coalesce("asset_type_ok", F.lit(False))
    )


def with_shares(bars: DataFrame, shares: DataFrame) -> DataFrame:
    """Left join of the shares known on the first of the bar's month.

    The lookup has one row per (ticker, month) and grows with the tickers, so it is merged
    on the ticker layout and not broadcast.
    """
    keyed = bars.withColumn("bucket_month", F.trunc("date", "month"))
    return keyed.join(
        shares.select("ticker", "bucket_month", F.col("shares").alias("shares_outstanding")).hint("merge"),
        ["ticker", "bucket_month"],
        "left",
    )


def add_gates(df: DataFrame, conf: UniverseConfig = DEFAULT.universe) -> DataFrame:
    """adr20_ok, market_cap, market_cap_ok and eligible from adr20, close_unadjusted, shares.

    A market cap exists only for rows that pass the two cheaper gates.
    """
    out = df.withColumn("adr20_ok", held(F.col("adr20") > conf.adr_min_pct))
    candidate = F.col("asset_type_ok") & F.col("adr20_ok")
    out = out.withColumn(
        "market_cap", F.when(candidate, F.col("close_unadjusted") * F.col("shares_outstanding"))
    )
    out = out.withColumn("market_cap_ok", F.coalesce("market_cap", F.lit(0.0)) >= conf.market_cap_min)
    return out.withColumn("eligible", candidate & F.col("market_cap_ok"))


def market_universe(
    bars: DataFrame,
    unadjusted: DataFrame,
    snapshots: DataFrame,
    shares: DataFrame,
    conf: UniverseConfig = DEFAULT.universe,
    axis: Axis = TICKER,
) -> DataFrame:
    """The universe table."""
    df = add_adr(bars.select("date", "ticker", "close", "high", "low"), axis, conf.adr_window)
    df = with_unadjusted_close(df, unadjusted)
    df = with_asset_type(df, asset_type_ok(snapshots, conf))
    df = with_shares(df, shares)
    return conform(add_gates(df, conf), UNIVERSE_COLUMNS)
