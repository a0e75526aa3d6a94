"""Assembling the panel: bars + lookups -> features and outcomes -> ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as cfg
from ..config import DEFAULT, EngineConfig
from ..functions.windows import TICKER, Axis
from ..operators.classify import eligible_only, refuse_later_years
from ..operators.history import HISTORY_COLUMNS, add_prior_extension_history
from ..operators.outcomes import add_outcomes, outcome_columns
from ..operators.ranks import rank_percentiles
from ..operators.technical import (
    add_adr,
    add_atr,
    add_atr_extension,
    add_ema_distances,
    add_returns,
    add_sma,
    add_sma50_persistence,
    add_sma50_slope,
    carry_persistence,
    thrust_columns,
    thrust_emas,
)
from ..operators.ema import add_emas, add_year_end
from ..operators.universe import add_gates, asset_type_ok, with_asset_type, with_shares
from ..schemas import FEATURE_COLUMNS, UNIVERSE_COLUMNS, conform, require_columns

RANK_SOURCES = {**cfg.RS_SOURCES, **cfg.THRUST_SOURCES}


PANEL_EMAS = [("ema10", "close", 10), ("ema20", "close", 20)] + thrust_emas()


def with_emas_first(
    bars: DataFrame, axis: Axis = TICKER, first=None, state: DataFrame | None = None, keep: bool = True
) -> DataFrame:
    """Bars with the EMAs the panel needs, laid out by ticker again.

    The Arrow pass is the one step outside generated code and ends the known layout, so it runs on the bars' few
    columns; a second exchange of narrow rows costs less than taking the whole panel through Python. With `first` and
    `state` only rows from `first` on get averages, which go on from the state; the rows before are a lookback.
    Without `keep` the averages behind the thrusts go before that exchange, and the thrusts are there instead.
    """
    narrow = add_returns(bars.repartition(axis.key), axis, {"return_1d": 1})
    if state is None:
        averaged = add_emas(narrow, PANEL_EMAS, axis, co_located=True)
        return (averaged if keep else thrust_columns(averaged).drop("return_1d")).repartition(axis.key)
    now = add_emas(narrow.filter(F.col(axis.time) >= F.lit(first)), PANEL_EMAS, axis, state=state)
    return now.unionByName(narrow.filter(F.col(axis.time) < F.lit(first)), allowMissingColumns=True).repartition(axis.key)


def panel_state(panel: DataFrame, axis: Axis = TICKER) -> DataFrame:
    """What a later run needs to go on: each ticker's averages, their ages and its SMA50 run at its last row of each year, which
    the features of `build_features` hold."""
    return panel.filter(F.col("_end").isNotNull()).select(axis.key, F.year(axis.time).alias("year"), "_end.*")


def build_universe(
    bars: DataFrame, snapshots: DataFrame, shares: DataFrame, conf: EngineConfig = DEFAULT, axis: Axis = TICKER
) -> DataFrame:
    """Universe gates only, on one ticker layout (stage it under `joined_by_entity`); `bars` as for the panel."""
    df = with_shares(bars.repartition(axis.key), shares).drop("bucket_month")
    df = with_asset_type(df, asset_type_ok(snapshots.repartition(axis.key), conf.universe))
    return add_gates(add_adr(df, axis, conf.universe.adr_window), conf.universe).select(*UNIVERSE_COLUMNS)


def build_outcomes(bars: DataFrame, conf: EngineConfig = DEFAULT, axis: Axis = TICKER) -> DataFrame:
    """Forward outcomes from bars alone."""
    df = add_atr(bars.repartition(axis.key), axis).drop("true_range")
    return outcomes_table(add_outcomes(df, conf.outcomes, axis=axis))


def build_panel(
    bars: DataFrame,
    snapshots: DataFrame,
    shares: DataFrame,
    conf: EngineConfig = DEFAULT,
    axis: Axis = TICKER,
    outcomes: bool = True,
    history: bool = False,
) -> DataFrame:
    """Universe gates, all features but the cross-sectional ranks, and forward outcomes.

    With `history` also what each row's own past says about its extension, and `key_eligible`, whether a row of the same key is
    eligible (keys may repeat): the same layout serves those windows.
    `bars` carry `close_unadjusted`; of their columns only the ones the panel needs are moved. Everything keyed by ticker is laid out by ticker once;
    lookups are joined on that layout (see `joined_by_entity`) and windows reuse it. The one
    Arrow pass, for EMAs, comes first and is narrow.
    """
    bars = bars.select(axis.time, axis.key, "high", "low", "close", "close_unadjusted")
    df = with_emas_first(bars, axis, keep=False)
    df = with_shares(df, shares).drop("bucket_month")
    listed = asset_type_ok(snapshots.repartition(axis.key), conf.universe)
    df = with_asset_type(df, listed)
    df = add_returns(df, axis)
    df = add_atr(df, axis).drop("true_range")
    df = add_adr(df, axis, conf.universe.adr_window)
    df = add_sma(df, {"sma50": 50}, axis)
    df = add_sma50_slope(df, axis)
    df = add_sma50_persistence(df, axis)
    df = add_atr_extension(df).drop("gain_from_sma50_pct")
    df = add_ema_distances(add_gates(df, conf.universe))
    if history:
        df = df.withColumn("key_eligible", F.max("eligible").over(Window.partitionBy(axis.key, axis.time)))
        df = add_prior_extension_history(df, conf.history, axis)
    return add_outcomes(df, conf.outcomes, axis=axis).drop("is_new_20d_high") if outcomes else df


def build_features(
    bars: DataFrame, universe: DataFrame, axis: Axis = TICKER, first=None, state: DataFrame | None = None
) -> DataFrame:
    """Features from bars and a stored universe table; ranks still missing. Each ticker's last row of a year holds its state.

    A row without a universe entry is not eligible. The universe is merged on the ticker
    layout before the windows, so stage this under `joined_by_entity`. With `first` and `state` (one row a ticker, see
    `panel_state`) only rows from `first` on come out; bars and universe then need only a lookback before it.
    """
    require_columns(universe, ["date", "ticker", "eligible", "market_cap", "adr20"], "market_universe_daily")
    keep = universe.select("date", "ticker", "eligible", "market_cap", "adr20")
    bars = bars.select(axis.time, axis.key, "high", "low", "close")
    df = with_emas_first(bars, axis, first, state).join(keep.hint("merge"), [axis.key, axis.time], "left")
    df = df.withColumn("eligible", F.coalesce("eligible", F.lit(False)))
    df = add_returns(df, axis)
    df = add_atr(df, axis).drop("true_range")
    df = add_sma(df, {"sma50": 50}, axis)
    df = add_sma50_slope(df, axis)
    df = add_sma50_persistence(df, axis)
    if state is not None:
        runs = state.select(axis.key, F.col("sma50_persistence_days").alias("_before"))
        df = carry_persistence(df.join(runs.hint("merge"), axis.key, "left"), first, "_before", axis).drop("_before")
        df = add_atr_extension(df).drop("gain_from_sma50_pct").filter(F.col(axis.time) >= F.lit(first))
    else:
        df = add_atr_extension(df).drop("gain_from_sma50_pct")
    return thrust_columns(add_ema_distances(add_year_end(df, PANEL_EMAS, axis, ("sma50_persistence_days",))))


def panel_ranks(panel: DataFrame, sources: dict[str, str] | None = None) -> DataFrame:
    """RS and thrust percentiles of the eligible rows of a stored or staged panel."""
    sources = RANK_SOURCES if sources is None else sources
    rows = eligible_only(panel).select("date", "ticker", *dict.fromkeys(sources.values()))
    return rank_percentiles(rows, sources)


def with_ranks(panel: DataFrame, sources: dict[str, str] | None = None) -> DataFrame:
    """All rows of the panel; ineligible ones have NULL percentiles and take no part in the join."""
    sources = RANK_SOURCES if sources is None else sources
    ranked = eligible_only(panel).join(panel_ranks(panel, sources), ["date", "ticker"], "left")
    return ranked.unionByName(without_ranks(panel, sources))


def without_ranks(panel: DataFrame, sources: dict[str, str] | None = None) -> DataFrame:
    """The ineligible rows of a panel, with NULL percentiles."""
    sources = RANK_SOURCES if sources is None else sources
    rest = panel.filter(~F.coalesce("eligible", F.lit(False)))
    return rest.withColumns({n: F.lit(None).cast("double") for n in sources})


def features_table(panel: DataFrame, ranks: DataFrame, axis: Axis = TICKER) -> DataFrame:
    """The features of a staged panel and its staged ranks, whole tickers in a task (write it under `joined_by_entity`)."""
    ranked = eligible_only(panel).repartition(axis.key).join(ranks.repartition(axis.key).hint("merge"), [axis.time, axis.key], "left")
    return conform(ranked.unionByName(without_ranks(panel)), FEATURE_COLUMNS)


def outcomes_table(panel: DataFrame) -> DataFrame:
    return panel.select("date", "ticker", *outcome_columns())


def study_rows(features: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Eligible feature rows that have an outcome row (inner join on the key)."""
    require_columns(features, ["date", "ticker", "eligible", *cfg.RS_SOURCES], "stock_features_daily")
    require_columns(outcomes, ["date", "ticker"], "stock_outcomes_daily")
    extra = [c for c in outcomes.columns if c in ("date", "ticker") or c not in features.columns]
    return eligible_only(features).join(outcomes.select(*extra), ["date", "ticker"])


def year_rows(features: DataFrame, outcomes: DataFrame, year: int, conf: EngineConfig = DEFAULT) -> DataFrame:
    """Eligible rows of one year with their prior-extension history.

    History runs over the whole unfiltered input; the year and eligibility filters follow.
    """
    require_columns(
        features,
        ["date", "ticker", "eligible", "atr_extension", "distance_ema10_pct", "distance_ema20_pct",
         *conf.study.state_rs_horizons],
        "stock_features_daily",
    )
    refuse_later_years(features, year)
    # Only what the history needs travels through its windows; the wide rows of the one
    # year's eligible tickers are joined afterwards.
    slim = features.select("date", "ticker", "eligible", "atr_extension", "distance_ema10_pct", "distance_ema20_pct")
    past = eligible_only(add_prior_extension_history(slim, conf.history).filter(F.year("date") == year))
    rows = study_rows(features.filter(F.year("date") == year), outcomes)
    return rows.join(past.select("date", "ticker", *HISTORY_COLUMNS), ["date", "ticker"])
