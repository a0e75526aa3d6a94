"""Index membership, breadth of the members, oscillators, price structure and index outcomes.

Every series is keyed (index_id, date), so several indexes run side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, IndexConfig, OutcomeConfig
from ..functions.scalar import finite, held, pct_gap, ratio
from ..functions.windows import INDEX, TICKER, Axis, full_mean
from .distinct import bitmaps, counted, numbered
from .ema import add_emas
from .outcomes import add_outcomes
from .technical import add_atr, add_new_high, add_new_low, add_sma


class MembershipUnavailable(RuntimeError):
    """A bar date has no member list of its own; another day's list is never used instead."""


def membership_gaps(bar_dates: DataFrame, snapshot_dates: DataFrame) -> DataFrame:
    """(index_id, date) of the bar dates without a member list; at most one row per calendar day and index."""
    wanted = bar_dates.select(F.collect_set("date").alias("d")).scalar()
    return (
        snapshot_dates.groupBy("index_id").agg(F.collect_set("date").alias("have"))
        .select("index_id", F.explode(F.array_except(wanted, F.col("have"))).alias("date"))
    )


def first_gaps(gaps: DataFrame, examples: int = 5) -> DataFrame:
    """place, index_id, date of the first gaps, and the number of all."""
    total = gaps.agg(F.count(F.lit(1)).alias("n_missing"))
    first = gaps.orderBy("date", "index_id").limit(examples)
    place = F.row_number().over(Window.orderBy("date", "index_id"))  # a handful of rows
    return first.withColumn("place", place).join(F.broadcast(total))


def checked_members(
    bar_dates: DataFrame, snapshot_dates: DataFrame, members: DataFrame, conf: IndexConfig = DEFAULT.index
) -> DataFrame:
    """Members of each bar date; raises when a date has no snapshot, drops thin dates.

    `bar_dates` (date) and `snapshot_dates` (index_id, date) list days, including those
    whose file is present but empty. Both are at most one row per calendar day and index,
    so the days of one index fit in an array.
    """
    first = first_gaps(membership_gaps(bar_dates, snapshot_dates)).orderBy("place").collect()
    if first:
        named = [f"{r['index_id']}:{r['date']}" for r in first]
        raise MembershipUnavailable(f"{first[0]['n_missing']} date(s) without a member list, e.g. {named}")
    solid = members.groupBy("index_id", "date").agg(F.count(F.lit(1)).alias("k")).filter(
        F.col("k") >= conf.min_components
    )
    if solid.isEmpty():
        raise MembershipUnavailable("no date has a usable member list")
    return members.join(solid.select("index_id", "date"), ["index_id", "date"], "left_semi").select(
        "index_id", "date", "constituent_ticker", "weight"
    )


def component_counts(members: DataFrame) -> DataFrame:
    """Distinct members of each index and date. `members` is read twice: pass a stored or staged table."""
    keys = ["index_id", "date"]
    return counted(bitmaps(_with_numbers(members), keys), keys, "component_count")


def _with_numbers(members: DataFrame) -> DataFrame:
    return members.join(numbered(members, "constituent_ticker"), "constituent_ticker")


# Averages whose share of members above is reported.
BREADTH_SMAS = {"sma5": 5, "sma20": 20, "sma50": 50, "sma200": 200}
BREADTH_EMAS = {"ema10": 10, "ema21": 21}
ABOVE = ("sma5", "ema10", "sma20", "ema21", "sma50", "sma200")
CHANGE_COLUMNS = (
    "mco_raw", "mco_z", "mcsi_z", "pct_above_ema10", "pct_above_ema21", "pct_above_sma50", "high_low_oscillator",
)
# End of fixed values.


def member_panel(bars: DataFrame, conf: IndexConfig = DEFAULT.index, axis: Axis = TICKER) -> DataFrame:
    """Averages, new highs/lows and day direction on each ticker's full own history."""
    df = bars.select("date", "ticker", "close", "high", "low").repartition(axis.key)
    df = add_sma(df, BREADTH_SMAS, axis)
    df = add_new_high(df, conf.high_low_lookback, axis)
    df = add_new_low(df, conf.high_low_lookback, axis)
    prev = axis.lag("close")
    df = df.withColumns({"is_advancer": held(F.col("close") > prev), "is_decliner": held(F.col("close") < prev)})
    return add_emas(df, [(n, "close", s) for n, s in BREADTH_EMAS.items()], axis, co_located=True)


def restrict_to_members(bars: DataFrame, members: DataFrame) -> DataFrame:
    """Bars of tickers that are a member at any time."""
    ever = members.select(F.col("constituent_ticker").alias("ticker")).distinct()
    return bars.join(ever, "ticker", "left_semi")


def members_with_panel(members: DataFrame, panel: DataFrame) -> DataFrame:
    """Left join: a member without a bar that day still counts as a component."""
    return members.join(
        panel.withColumnRenamed("ticker", "constituent_ticker"), ["date", "constituent_ticker"], "left"
    )


def member_breadth(members: DataFrame, panel: DataFrame, conf: IndexConfig = DEFAULT.index) -> DataFrame:
    """Advance/decline, RANA, shares above averages and the high-low oscillator per index and date."""
    joined = members_with_panel(_with_numbers(members), panel)
    keys = ["index_id", "date"]
    one = lambda condition: F.when(condition, F.lit(1)).otherwise(F.lit(0))
    sums = {
        "advancers": one(F.col("is_advancer")), "decliners": one(F.col("is_decliner")),
        "new_20d_highs": one(F.col("is_new_20d_high")), "new_20d_lows": one(F.col("is_new_20d_low")),
        **{f"_over_{ma}": one(held(F.col("close") > F.col(ma))) for ma in ABOVE},
        **{f"_have_{ma}": one(F.col(ma).isNotNull()) for ma in ABOVE},
    }
    out = counted(bitmaps(joined, keys, **sums), keys, "component_count", tuple(sums))
    out = out.withColumns({f"pct_above_{ma}": ratio(f"_over_{ma}", f"_have_{ma}") * F.lit(100.0) for ma in ABOVE})
    out = out.drop(*[c for c in out.columns if c.startswith(("_over_", "_have_"))])
    net = F.col("advancers") - F.col("decliners")
    osc = F.col("new_20d_highs") - F.col("new_20d_lows")
    return out.withColumns({
        "rana": net / F.greatest(F.col("advancers") + F.col("decliners"), F.lit(1)) * F.lit(conf.rana_scale),
        "high_low_oscillator": osc,
        "high_low_pct": ratio(osc, "component_count") * F.lit(100.0),
    })


def add_oscillators(daily: DataFrame, conf: IndexConfig = DEFAULT.index, axis: Axis = INDEX) -> DataFrame:
    """Breadth oscillator (EMA19 - EMA39 of RANA), its running sum, their z-scores and changes."""
    short, long = conf.oscillator_spans
    df = add_emas(daily, [("_short", "rana", short), ("_long", "rana", long)], axis)
    df = df.withColumn("mco_raw", F.col("_short") - F.col("_long")).drop("_short", "_long")

    def z(x: str) -> Column:
        f = axis.roll(conf.z_window)
        return F.when(
            F.count(x).over(f) >= conf.z_min_rows,
            ratio(F.col(x) - F.avg(x).over(f), F.stddev_samp(x).over(f)),
        )

    df = df.repartition(axis.key)
    df = df.withColumns({
        "mco_z": z("mco_raw"),
        "mcsi_raw": F.lit(conf.summation_seed) + F.sum("mco_raw").over(axis.sofar()),
    })
    df = df.withColumn("mcsi_z", z("mcsi_raw"))
    df = df.withColumn("mcsi_z_sma10", full_mean("mcsi_z", axis.roll(conf.summation_smooth), conf.summation_smooth))
    df = df.withColumn("mcsi_z_minus_sma10", F.col("mcsi_z") - F.col("mcsi_z_sma10"))
    return add_changes(df, conf, axis)


def add_changes(df: DataFrame, conf: IndexConfig = DEFAULT.index, axis: Axis = INDEX) -> DataFrame:
    """Differences over 1/3/5 rows of the listed series, and a 5-row mean of the high-low oscillator."""
    have = [c for c in CHANGE_COLUMNS if c in df.columns]
    out = df.withColumns({
        f"{c}_chg_{w}d": F.col(c) - axis.lag(c, w) for c in have for w in conf.change_windows
    })
    if "high_low_oscillator" in df.columns:
        out = out.withColumn("high_low_oscillator_5d_avg", full_mean("high_low_oscillator", axis.roll(5), 5))
    return out


def price_structure(index_bars: DataFrame, axis: Axis = INDEX) -> DataFrame:
    """ATR, averages, distances and comparison flags of the index itself (highs and lows kept)."""
    df = index_bars.select(axis.key, axis.time, "close", "high", "low").repartition(axis.key)
    df = add_atr(df, axis).drop("true_range")
    df = add_sma(df, {"sma50": 50, "sma200": 200}, axis)
    df = add_emas(df, [("ema10", "close", 10), ("ema20", "close", 20)], axis, co_located=True)
    df = df.withColumns({
        "distance_ema10_pct": pct_gap("close", "ema10"),
        "distance_ema20_pct": pct_gap("close", "ema20"),
        "distance_sma50_pct": pct_gap("close", "sma50"),
        "ema10_above_ema20": held(F.col("ema10") > F.col("ema20")),
        "close_above_ema10": held(F.col("close") > F.col("ema10")),
        "close_above_ema20": held(F.col("close") > F.col("ema20")),
        "close_above_sma50": held(F.col("close") > F.col("sma50")),
        "close_above_sma200": held(F.col("close") > F.col("sma200")),
    })
    return df.withColumn("atr_extension", finite(ratio("distance_sma50_pct", "atr_pct")))


def index_health(
    members: DataFrame, bars: DataFrame, index_bars: DataFrame, conf: IndexConfig = DEFAULT.index
) -> DataFrame:
    """Price structure joined with member breadth and its oscillators, one row per index and date."""
    panel = member_panel(restrict_to_members(bars, members), conf)
    daily = add_oscillators(member_breadth(members, panel, conf), conf)
    return price_structure(index_bars).join(daily, ["index_id", "date"])


def max_drawdown(horizon: int, slots: str = "_path") -> Column:
    """Worst low against the running peak (entry close, then each high so far), in percent."""
    start = F.struct(F.col("close").alias("peak"), F.lit(None).cast("double").alias("worst"))

    def step(acc, e):
        peak = F.greatest(acc["peak"], e["h"])
        fall = (ratio(e["l"], peak) - F.lit(1.0)) * F.lit(100.0)
        return F.struct(peak.alias("peak"), F.least(acc["worst"], fall).alias("worst"))

    return F.aggregate(F.slice(slots, 1, horizon), start, step, lambda acc: acc["worst"])


def index_outcomes(
    structure: DataFrame,
    conf: IndexConfig = DEFAULT.index,
    outcomes: OutcomeConfig = DEFAULT.outcomes,
    axis: Axis = INDEX,
) -> DataFrame:
    """Forward return, excursions, drawdown, new highs and EMA20 loss / reclaim of the index."""
    df = structure.select(axis.key, axis.time, "close", "high", "low", "atr14", "close_above_ema20")
    df = add_outcomes(df, outcomes, conf.horizons, axis)
    longest = max(conf.horizons)
    above = F.col("close_above_ema20").cast("int")
    frames = {
        "_path": F.collect_list(F.struct(F.col("high").alias("h"), F.col("low").alias("l"))).over(axis.ahead(longest))
    }
    for h in conf.horizons:
        f = axis.ahead(h)
        frames[f"_rows_{h}"] = F.count(above).over(f)
        frames[f"_highs_{h}"] = F.count("high").over(f)
        frames[f"_all_above_{h}"] = F.min(above).over(f)
        frames[f"_any_above_{h}"] = F.max(above).over(f)
    df = df.withColumns(frames)
    cols = []
    for h in conf.horizons:
        complete = F.col(f"_rows_{h}") == h
        now = F.col("close_above_ema20")
        cols += [
            F.col(f"forward_return_close_{h}d").alias(f"qqq_forward_return_{h}d"),
            F.col(f"mfe_pct_{h}d").alias(f"qqq_mfe_pct_{h}d"),
            F.col(f"mae_pct_{h}d").alias(f"qqq_mae_pct_{h}d"),
            F.col(f"new_20d_high_within_window_{h}d").alias(f"qqq_new_20d_high_within_window_{h}d"),
            F.when((F.col(f"_highs_{h}") == h) & F.col("close").isNotNull(), max_drawdown(h)).alias(f"qqq_max_drawdown_pct_{h}d"),
            F.when(complete, (now & (F.col(f"_all_above_{h}") == 0)).cast("double")).alias(
                f"qqq_ema20_lost_within_window_{h}d"
            ),
            F.when(complete, (~now & (F.col(f"_any_above_{h}") == 1)).cast("double")).alias(
                f"qqq_ema20_reclaimed_within_window_{h}d"
            ),
        ]
    return df.select(axis.key, axis.time, *cols)
