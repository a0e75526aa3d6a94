"""Forward outcomes of each row over its entity's next H rows.

Horizons of up to SHORT rows use plain offset columns; longer ones take extremes from frames built by doubling and first
hits from one list of the rows ahead. Both give the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, OutcomeConfig, threshold_label
from ..functions.extremes import add_doubled, ahead_extreme, levels_for
from ..functions.scalar import flag, pct_move, ratio
from ..functions.windows import TICKER, Axis
from ..schemas import require_columns
from .technical import add_new_high

SHORT = 60


def add_leads(df: DataFrame, longest: int, axis: Axis = TICKER) -> DataFrame:
    """High and low of each of the next `longest` rows as plain columns `_h<k>`, `_l<k>`.

    A bounded number of offsets into the same sorted partition: everything after it is
    branch-only arithmetic on the row, which compiles, unlike lambdas over an array.
    """
    return df.withColumns({
        f"_{c[0]}{k}": axis.offset(c, k) for c in ("high", "low") for k in range(1, longest + 1)
    })


def lead_names(longest: int) -> list[str]:
    return [f"_{c}{k}" for c in ("h", "l") for k in range(1, longest + 1)]


def first_hit_columns(conf: OutcomeConfig, longest: int) -> dict[str, Column]:
    """First forward row (1-based) whose high reaches +th or whose low reaches -th, NULL for none.

    Found once for the longest horizon; a shorter one only compares the row with its length.
    """
    def first(side: str, test: str) -> Column:
        # (price / close - 1) * 100 in exactly this order, as everywhere else.
        whens = [
            f"WHEN _h{k} IS NOT NULL AND (try_divide(_{side}{k}, close) - 1.0D) * 100.0D {test} THEN {k}"
            for k in range(1, longest + 1)
        ]
        return F.expr(f"CASE {' '.join(whens)} END")

    out = {}
    for th in sorted({t for pair in conf.races() for t in pair}):
        name = threshold_label(th)
        out[f"_up_{name}"] = first("h", f">= {float(th)!r}D")
        out[f"_down_{name}"] = first("l", f"<= {-float(th)!r}D")
    return out


def _hits_in_lists(df: DataFrame, conf: OutcomeConfig, longest: int, axis: Axis) -> DataFrame:
    """The same first hits, found in a list of the next `longest` rows' prices (an infinity where a row has no high)."""
    listed = df.withColumns({
        "_highs": F.collect_list(F.expr("coalesce(high, double('-infinity'))")).over(axis.ahead(longest)),
        "_lows": F.collect_list(F.expr("coalesce(CASE WHEN high IS NOT NULL THEN low END, double('infinity'))")).over(axis.ahead(longest)),
    })

    def first(prices: str, none: str, test: str) -> Column:
        hit = f"x <> double('{none}') AND (try_divide(x, close) - 1.0D) * 100.0D {test}"
        return F.expr(f"cast(nullif(array_position(transform({prices}, x -> coalesce({hit}, false)), true), 0) as int)")

    out = {}
    for th in sorted({t for pair in conf.races() for t in pair}):
        name = threshold_label(th)
        out[f"_up_{name}"] = first("_highs", "-infinity", f">= {float(th)!r}D")
        out[f"_down_{name}"] = first("_lows", "infinity", f"<= {-float(th)!r}D")
    return listed.withColumns(out).drop("_highs", "_lows")


def add_first_hits(df: DataFrame, conf: OutcomeConfig, longest: int, axis: Axis = TICKER) -> DataFrame:
    if longest > SHORT:
        return _hits_in_lists(df, conf, longest, axis)
    out = add_leads(df, longest, axis)
    return out.withColumns(first_hit_columns(conf, longest)).drop(*lead_names(longest))


def _reach_by_offsets(df: DataFrame, conf: OutcomeConfig, horizons: tuple[int, ...], axis: Axis) -> DataFrame:
    """Adds first hits and, for each horizon, whether it is complete and its highest and lowest price."""
    longest = max(horizons)
    out = add_leads(df, longest, axis)
    reach = first_hit_columns(conf, longest)
    for h in horizons:
        highs, lows = ([f"_{c}{k}" for k in range(1, h + 1)] for c in ("h", "l"))
        # A window is complete when all its highs are there.
        reach[f"_full_{h}"] = F.expr(" AND ".join(f"{x} IS NOT NULL" for x in highs))
        reach[f"_top_{h}"] = F.expr(f"greatest({', '.join(highs)})" if h > 1 else highs[0])
        reach[f"_bottom_{h}"] = F.expr(f"least({', '.join(lows)})" if h > 1 else lows[0])
    return out.withColumns(reach).drop(*lead_names(longest))


def _reach_by_doubling(df: DataFrame, conf: OutcomeConfig, horizons: tuple[int, ...], axis: Axis) -> DataFrame:
    """The same columns for horizons of any length (the extremes only where all rows of the horizon are there)."""
    levels = levels_for(max(horizons))
    out = df.withColumn("_highs_so_far", F.count("high").over(axis.sofar()))
    out = add_doubled(out, {"_dh": ("high", "greatest"), "_dl": ("low", "least")}, levels, axis)
    reach = {}
    for h in horizons:
        gone = axis.offset("_highs_so_far", h) - F.col("_highs_so_far")
        reach[f"_full_{h}"] = F.coalesce(gone == h, F.lit(False))
        reach[f"_top_{h}"] = ahead_extreme("_dh", "greatest", h, axis)
        reach[f"_bottom_{h}"] = ahead_extreme("_dl", "least", h, axis)
    out = out.withColumns(reach).drop("_highs_so_far", *[f"_d{c}_{k}" for c in "hl" for k in range(levels)])
    return _hits_in_lists(out, conf, max(horizons), axis)


def hit_within(col: str, horizon: int) -> Column:
    """First-hit row number, or horizon + 1 when not hit inside the horizon."""
    return F.when(F.col(col) <= horizon, F.col(col)).otherwise(F.lit(horizon + 1))


def race_flags(up: float, down: float, horizon: int, complete: Column) -> tuple[Column, Column]:
    """(up strictly first, same-row tie) as 1.0 / 0.0, NULL on incomplete windows."""
    u = hit_within(f"_up_{threshold_label(up)}", horizon)
    d = hit_within(f"_down_{threshold_label(down)}", horizon)
    return (
        F.when(complete, flag(u < d)),
        F.when(complete, flag((u == d) & (u <= F.lit(horizon)))),
    )


def add_outcomes(
    df: DataFrame,
    conf: OutcomeConfig = DEFAULT.outcomes,
    horizons: tuple[int, ...] | None = None,
    axis: Axis = TICKER,
    atr: str = "atr14",
) -> DataFrame:
    """All outcome columns for all horizons, added to the rows without any join."""
    require_columns(df, [axis.key, axis.time, "close", "high", "low", atr], "outcome input")
    horizons = tuple(conf.horizons if horizons is None else horizons)
    out = df if "is_new_20d_high" in df.columns else add_new_high(df, conf.new_high_lookback, axis)
    close, atr0 = F.col("close"), F.col(atr)
    longest = max(horizons)

    ahead = {}
    for h in horizons:
        seen_new = F.col("is_new_20d_high") & F.col("high").isNotNull()
        ahead[f"_new_{h}"] = F.max(seen_new.cast("int")).over(axis.ahead(h))
        ahead[f"_end_{h}"] = axis.lead("close", h)
    reached = _reach_by_offsets if longest <= SHORT else _reach_by_doubling
    out = reached(out.withColumns(ahead), conf, horizons, axis)

    # In layers, so that each extreme is computed once and reused by its flags.
    extremes = {}
    for h in horizons:
        complete = F.col(f"_full_{h}")
        extremes[f"forward_return_close_{h}d"] = pct_move(f"_end_{h}", close)
        extremes[f"mfe_pct_{h}d"] = F.when(complete, pct_move(f"_top_{h}", close))
        extremes[f"mae_pct_{h}d"] = F.when(complete, pct_move(f"_bottom_{h}", close))
        extremes[f"mfe_atr_multiple_{h}d"] = F.when(complete, ratio(F.col(f"_top_{h}") - close, atr0))
        extremes[f"mae_atr_multiple_{h}d"] = F.when(complete, ratio(F.col(f"_bottom_{h}") - close, atr0))
    out = out.withColumns(extremes)

    flags = {}
    for h in horizons:
        complete = F.col(f"_full_{h}")
        for th in conf.pct_moves:
            flags[f"reached_plus_{threshold_label(th)}pct_{h}d"] = F.when(
                complete, flag(F.col(f"mfe_pct_{h}d") >= F.lit(th))
            )
        for m in conf.atr_multiples:
            # A complete window without a usable ATR counts as not reached.
            flags[f"reached_{threshold_label(m)}atr_{h}d"] = F.when(
                complete, flag(F.col(f"mfe_atr_multiple_{h}d") >= F.lit(m))
            )
        flags[f"new_20d_high_within_window_{h}d"] = F.when(complete, F.col(f"_new_{h}").cast("double"))
        for up, down in conf.races():
            first, tie = race_flags(up, down, h, complete)
            flags[conf.race_name(up, down, h)] = first
            flags[conf.race_name(up, down, h, True)] = tie
    out = out.withColumns(flags)
    return out.drop(*[c for c in out.columns if c.startswith(("_full_", "_top_", "_bottom_", "_new_", "_end_", "_up_", "_down_"))])


def outcome_columns(conf: OutcomeConfig = DEFAULT.outcomes) -> list[str]:
    return [c for h in conf.horizons for c in conf.columns(h)]


def stock_outcomes(features: DataFrame, conf: OutcomeConfig = DEFAULT.outcomes, axis: Axis = TICKER) -> DataFrame:
    """The outcomes table: key columns plus every outcome column."""
    require_columns(features, [axis.time, axis.key, "close", "high", "low", "atr14"], "stock_features_daily")
    slim = features.select(axis.time, axis.key, "close", "high", "low", "atr14")
    return add_outcomes(slim, conf, axis=axis).select(axis.time, axis.key, *outcome_columns(conf))
