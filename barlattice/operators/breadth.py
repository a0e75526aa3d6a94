"""Market breadth per date: shares, future shares, and the cohort's forward performance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BreadthConfig, DEFAULT
from ..functions.scalar import flag
from ..functions.windows import MARKET, Axis
from .classify import eligible_only
from .quantiles import code_rows, wide_quantiles


def daily_rs_breadth(features: DataFrame, conf: BreadthConfig = DEFAULT.breadth) -> DataFrame:
    """Eligible count and the share of eligible rows at or above each RS level; missing RS is a miss."""
    return eligible_only(features).groupBy("date").agg(
        F.count(F.lit(1)).alias("eligible_count"),
        *[F.avg(flag(F.col(conf.rs_column) >= b)).alias(f"breadth_rs{b}plus_share") for b in conf.rs_buckets],
    )


def future_breadth(daily: DataFrame, conf: BreadthConfig = DEFAULT.breadth, axis: Axis = MARKET) -> DataFrame:
    """The share h rows ahead in the per-date series (dates with at least one eligible row).

    The series has one row per date and market; a market key keeps the window partitioned
    when several markets share the table.
    """
    keyed = daily if axis.key in daily.columns else daily.withColumn(axis.key, F.lit("ALL"))
    out = keyed.withColumns({
        f"future_rs{b}plus_share_{h}d": axis.lead(f"breadth_rs{b}plus_share", h)
        for h in conf.horizons for b in conf.rs_buckets
    })
    return out if axis.key in daily.columns else out.drop(axis.key)


def future_breadth_columns(conf: BreadthConfig = DEFAULT.breadth) -> list[str]:
    return [f"future_rs{b}plus_share_{h}d" for h in conf.horizons for b in conf.rs_buckets]


# Cohort column stem -> (outcome column stem, statistic).
COHORT_STATS = {
    "median_forward_return_{h}d": ("forward_return_close_{h}d", "median"),
    "median_mfe_pct_{h}d": ("mfe_pct_{h}d", "median"),
    "median_mae_pct_{h}d": ("mae_pct_{h}d", "median"),
    "share_mfe_ge_5pct_{h}d": ("reached_plus_5pct_{h}d", "mean"),
    "share_mfe_ge_10pct_{h}d": ("reached_plus_10pct_{h}d", "mean"),
    "share_mfe_ge_2atr_{h}d": ("reached_2atr_{h}d", "mean"),
    "share_mfe_ge_3atr_{h}d": ("reached_3atr_{h}d", "mean"),
    "share_positive_{h}d": ("forward_return_close_{h}d", "positive"),
    "cohort_size_{h}d": ("forward_return_close_{h}d", "count"),
}
# End of fixed values.


def cohort_columns(conf: BreadthConfig = DEFAULT.breadth) -> list[str]:
    return [k.format(h=h) for h in conf.horizons for k in COHORT_STATS]


def cohort_inputs(conf: BreadthConfig = DEFAULT.breadth) -> list[str]:
    """The outcome columns the cohort statistics read."""
    return list(dict.fromkeys(src.format(h=h) for h in conf.horizons for src, _ in COHORT_STATS.values()))


def cohort_performance(rows: DataFrame, conf: BreadthConfig = DEFAULT.breadth) -> DataFrame:
    """Per date, how that date's eligible rows went on to perform, all horizons in one aggregation.

    Hit shares skip missing outcomes; the positive share counts a missing return as not
    positive. `rows` is a stored or staged table of features left-joined to outcomes.
    """
    rows = eligible_only(rows)
    plain, medians = {}, {}
    for h in conf.horizons:
        for stem, (src, stat) in COHORT_STATS.items():
            name, col = stem.format(h=h), src.format(h=h)
            if stat == "median":
                medians[name] = (col, 0.5)
            elif stat == "mean":
                plain[name] = F.avg(col)
            elif stat == "positive":
                plain[name] = F.avg(flag(F.col(col) > 0))
            else:
                plain[name] = F.count(col)
    coded = code_rows(rows, {"date": "date"}, [c for c, _ in medians.values()], keep=cohort_inputs(conf))
    shares = coded.rows.groupBy("date").agg(*[e.alias(k) for k, e in plain.items()])
    mids = wide_quantiles(coded, medians, few_groups=False)
    return shares.join(mids, "date", "left").select("date", *cohort_columns(conf))


def market_breadth(rows: DataFrame, conf: BreadthConfig = DEFAULT.breadth) -> DataFrame:
    """The market-breadth table: cohort performance, future shares, and the same-day shares."""
    daily = daily_rs_breadth(rows, conf)
    ahead = future_breadth(daily, conf)
    return cohort_performance(rows, conf).join(ahead, "date", "full")
