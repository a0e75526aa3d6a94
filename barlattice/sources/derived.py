"""A (date, ticker) panel derived from order lines: one bar per supplier and week.

Exact integer arithmetic and one fixed floating-point expression per price make it
reproducible anywhere. Order lines are combined before the shuffle, so a supplier with
very many lines costs one partial row per week and input split.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The shape of the derived panel.
FIRST_WEEK = "1995-01-02"
ADJUST_EVERY, ADJUST_AT, ADJUST_BY = 7, 2, 2048.0
INDEX_ID = "IDX"
# End of fixed values.

SUPPLIERS_PER_TASK = 500


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def week_number(day="date"):
    return F.expr(f"datediff({day}, date'{FIRST_WEEK}') div 7")


def weekly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-traded bars: date, ticker, open, high, low, close, volume."""
    lines = read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("ticker"),
        F.date_trunc("week", "l_shipdate").cast("date").alias("date"),
        "l_quantity", "l_discount",
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity").alias("ord"),
    )
    wave = F.abs((week_number() + 7 * F.col("ticker")) % 80 - 40) / F.lit(40.0)

    def px(discount: str):
        """A line's price; within a week and supplier it never falls as the discount rises, so extremes and picks are of discounts,
        which take less room in the shuffle, and prices are made of them after it."""
        return F.lit(100) * (F.lit(1) + F.lit(1.5) * F.col(discount)) * (F.lit(1) + F.lit(4) * wave)

    found = lines.groupBy("date", "ticker").agg(
        F.min_by("l_discount", "ord").alias("open"),
        F.max("l_discount").alias("high"),
        F.min("l_discount").alias("low"),
        F.max_by("l_discount", "ord").alias("close"),
        F.sum("l_quantity").alias("volume"),
    )
    return found.select("date", "ticker", *[px(c).alias(c) for c in ("open", "high", "low", "close")], "volume")


def scaled(bars: DataFrame) -> DataFrame:
    """Bars on a build-time-adjusted scale: some tickers carry a large constant factor."""
    factor = F.when(F.col("ticker") % ADJUST_EVERY == ADJUST_AT, F.lit(ADJUST_BY)).otherwise(F.lit(1.0))
    return bars.withColumns({c: F.col(c) * factor for c in ("open", "high", "low", "close")})


def panel_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjusted bars that also carry the close as traded: one pass over the order lines."""
    bars = weekly_bars(spark, sf_dir).withColumn("close_unadjusted", F.col("close"))
    return scaled(bars)


def _weeks(spark: SparkSession, sf_dir: str):
    """First and last bar week, as a scalar array of all weeks between."""
    span = read(spark, sf_dir, "lineitem").select(
        F.expr(
            "sequence(cast(date_trunc('week', min(l_shipdate)) as date), "
            "cast(date_trunc('week', max(l_shipdate)) as date), interval 7 days)"
        )
    )
    return span.scalar()


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier keys, in tasks by their number: each becomes hundreds of rows, and the table is too small to be read by several tasks."""
    keys = read(spark, sf_dir, "supplier").select("s_suppkey")
    return keys.repartition(max(1, math.ceil(keys.count() / SUPPLIERS_PER_TASK)), "s_suppkey")


def reference_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly listing per supplier: type, exchange; one in thirteen delists after week 300."""
    key = F.col("s_suppkey")
    out = suppliers(spark, sf_dir).select(key, F.explode(_weeks(spark, sf_dir)).alias("date"))
    out = out.filter(~((key % 13 == 5) & (week_number() >= 300)))
    return out.select(
        "date",
        key.alias("ticker"),
        F.when(key % 10 == 9, "ETF").otherwise("CS").alias("type"),
        F.when(key % 11 == 4, "OTCQB").otherwise("XNAS").alias("primary_exchange"),
    )


def monthly_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares outstanding per supplier and month."""
    span = read(spark, sf_dir, "lineitem").select(
        F.expr(
            "sequence(trunc(cast(date_trunc('week', min(l_shipdate)) as date), 'MM'), "
            "trunc(cast(date_trunc('week', max(l_shipdate)) as date), 'MM'), interval 1 month)"
        )
    ).scalar()
    key = F.col("s_suppkey")
    out = suppliers(spark, sf_dir).select(key, F.explode(span).alias("bucket_month"))
    mi = F.year("bucket_month") * 12 + F.month("bucket_month")
    base = F.lit(1e6) * (F.lit(3) + (key * 5 + mi) % 5)
    return out.select(
        key.alias("ticker"), "bucket_month",
        F.when((key % 17 == 3) & (mi % 2 == 0), base * F.lit(4.0)).otherwise(base).alias("shares"),
    )


def index_members(bars: DataFrame) -> DataFrame:
    """Half of the bars' tickers, swapped every 26 weeks, equally weighted."""
    picked = bars.filter((F.col("ticker") + F.expr(f"(datediff(date, date'{FIRST_WEEK}') div 7) div 26")) % 2 == 0)
    sizes = picked.groupBy("date").agg(F.count(F.lit(1)).alias("k"))
    return picked.select("date", F.col("ticker").alias("constituent_ticker")).join(F.broadcast(sizes), "date").select(  # one row per date
        F.lit(INDEX_ID).alias("index_id"), "date", "constituent_ticker", (F.lit(1.0) / F.col("k")).alias("weight")
    )


def index_series(bars: DataFrame) -> DataFrame:
    """The index's own bars: mean price of all tickers, in exact thousandths."""
    def mean(c: str):
        return (F.expr(f"sum(cast(round({c} * 1000) as bigint)) div count(*)") / F.lit(1000.0)).alias(c)

    return bars.groupBy("date").agg(*[mean(c) for c in ("open", "high", "low", "close")]).withColumn(
        "index_id", F.lit(INDEX_ID)
    )
