"""The SQL twin of each registered query, by name."""

from __future__ import annotations

from .sql import (
    ALL_OUTCOMES, CHG_COLS, COHORT, CROSS, CTES, DECILES, DFINE, DIST, EXT, FINE, FUTURE, H, H_YEAR, HISTORY, HV, IX_FLAG, IX_NUM,
    IXO, MAS, MB_INT, MB_NUM, MROUND, MSQL, PREV, RETURNS, RS, STATE_RS, THRUST, baseline, bucket,
    outcome_names, query, r, rr, state_case, values,
)

K = "date, ticker"
FEATURES = (
    "market_cap", "adr20", "close", "high", "low", *RETURNS, *RS, "thrust_1d", "thrust_1w", "thrust_1m", *THRUST,
    "ema10", "ema20", "distance_ema10_pct", "distance_ema20_pct", "sma50", "sma50_slope_pct",
    "sma50_persistence_days", "atr14", "atr_pct", "atr_extension",
)
BREADTH = ("breadth_rs80plus_share", "breadth_rs90plus_share", "breadth_rs95plus_share")
OSC = ("mco_raw", "mco_z", "mcsi_raw", "mcsi_z", "mcsi_z_sma10", "mcsi_z_minus_sma10")
Q: dict[str, str] = {}


def simple(name: str, source: str, cols, keys: str = K) -> None:
    Q[name] = f"SELECT {keys}, {rr(*cols)} FROM {source}"


simple("panel_bars", "adj", ("open", "high", "low", "close", "volume", "close_unadjusted"))
Q["reference_snapshots"] = "SELECT date, ticker, type, primary_exchange FROM refs"
Q["monthly_shares"] = "SELECT ticker, bucket_month, shares FROM shares"
simple("returns", "f1", RETURNS)
simple("true_range_atr", "f4", ("true_range", "atr14", "atr_pct"))
simple("adr20", "f3", ("adr20",))
simple("moving_averages", "f7", ("ema10", "ema20", "sma50", "distance_ema10_pct", "distance_ema20_pct"))
simple("sma50_slope", "f4", ("sma50_slope_pct",))
simple("sma50_streak", "f6", ("sma50_persistence_days",))
Q["atr_extension"] = f"SELECT {K}, {r('gain', 'gain_from_sma50_pct')}, {rr('atr_extension')} FROM f5"
simple("thrust", "f7", ("thrust_1d", "thrust_1w", "thrust_1m"))
Q["asset_type"] = "SELECT date, ticker, asset_type_ok FROM listed"
simple("unadjusted_join", "adj", ("close", "close_unadjusted"))
Q["market_cap"] = f"""SELECT a.date, a.ticker, {r('shares', 'shares_outstanding')}, {r('close_unadjusted * shares', 'market_cap')}
FROM adj a LEFT JOIN shares s ON a.ticker = s.ticker AND CAST(date_trunc('month', a.date) AS DATE) = s.bucket_month"""
Q["universe_daily"] = (
    f"SELECT {K}, {rr('close', 'high', 'low', 'adr20', 'market_cap')}, asset_type_ok, adr20_ok, market_cap_ok, eligible FROM universe"
)
Q["universe_from_two_scans"] = Q["universe_daily"]
simple("rs_percentile", "features", RS)
Q["rs_percentile"] += " WHERE eligible"
simple("thrust_percentile", "features", THRUST)
Q["thrust_percentile"] += " WHERE eligible"
simple("features_daily", "features", FEATURES, f"{K}, eligible")
Q["top_rs"] = f"""SELECT date, place, ticker, {rr('rs_percentile_1m', 'return_21d')} FROM (
SELECT *, row_number() OVER (PARTITION BY date ORDER BY rs_percentile_1m DESC, ticker) AS place
FROM features WHERE eligible AND rs_percentile_1m IS NOT NULL) WHERE place <= 10"""
Q["new_high_low"] = "SELECT date, ticker, nh AS is_new_20d_high, nl AS is_new_20d_low FROM mp1"
for name, stems in {
    "forward_return": ("forward_return",), "mfe_mae": ("mfe_pct", "mae_pct"), "atr_multiples": ("mfe_atr", "mae_atr"),
    "reached_flags": ("reached_plus_5pct", "reached_plus_10pct", "reached_2atr", "reached_3atr"),
    "new_high_within": ("new_20d",), "race_flags": ("reached_plus_5_before", "reached_plus_10_before"),
}.items():
    simple(name, "outcomes", [c for c in ALL_OUTCOMES if c.startswith(stems)])
Q["first_hit_day"] = """SELECT a.date, a.ticker, up5 AS first_up_5, up10 AS first_up_10, down5 AS first_down_5, down10 AS first_down_10
FROM adj a LEFT JOIN hits h ON a.ticker = h.ticker AND a.rn = h.rn"""
simple("outcomes_daily", "outcomes", ALL_OUTCOMES)
simple("outcomes_year", "outcomes_year", [n for h in H_YEAR for n in outcome_names(h)])
simple("outcomes_from_features", "outcomes", outcome_names(10))
simple("study_join", "rows", ("rs_percentile_3m", "atr_extension", "mfe_pct_20d", "reached_3atr_20d"))
simple("stored_year", "features", ("rs_percentile_6m", "sma50", "thrust_1m"), f"{K}, eligible")
Q["stored_year"] += " WHERE year(date) = 2000"
simple("prior_extension", "history", [c for c in HISTORY if not c.startswith("n_valid")], f"{K}, n_valid_days_prior_peak_window")
simple("prior_extension_year", "history_year", [
    "max_atr_extension_prior_20d", "max_atr_extension_prior_252d", "days_since_atr_extension_peak", "atr_extension_drawdown_from_peak",
    "min_distance_ema10_pct_since_peak", "min_distance_ema20_pct_since_peak"], f"{K}, n_valid_days_prior_peak_window")
Q["candidate_state"] = f"""SELECT h.date, h.ticker, {state_case('10')} AS candidate_state_ema10, {state_case('20')} AS candidate_state_ema20
FROM history h JOIN (SELECT ticker, rn, atr_extension, distance_ema10_pct, distance_ema20_pct FROM f7) f
ON h.ticker = f.ticker AND h.rn = f.rn"""
simple("rs_breadth", "daily", BREADTH, "date, eligible_count")
simple("future_breadth", "future", FUTURE, "date")
SIZES = [c for c in COHORT if c.startswith("cohort_size")]
COHORT_NUM = [c for c in COHORT if c not in SIZES]
simple("cohort_performance", "cohort", COHORT_NUM, "date, " + ", ".join(SIZES))
simple("market_breadth_daily", "breadth", COHORT_NUM + FUTURE + list(BREADTH), "date, eligible_count, " + ", ".join(SIZES))


# --- studies
def benchmark(where: str) -> str:
    parts = []
    for scheme, name in ((DECILES, "coarse"), (FINE, "fine_above_80")):
        parts.append(f"""SELECT '{name}' AS scheme, d.rs_horizon, d.outcome_horizon, d.bucket, coalesce(n, 0) AS n, {MROUND}
FROM (SELECT * FROM {values('rs_horizon', RS)}, {HV}, {values('bucket', scheme[1])}) d
LEFT JOIN (SELECT rs_horizon, outcome_horizon, {bucket('rs', scheme, True)} AS bucket, {MSQL} FROM rsh {where}
  GROUP BY rs_horizon, outcome_horizon, bucket) c
ON c.rs_horizon = d.rs_horizon AND c.outcome_horizon = d.outcome_horizon AND c.bucket = d.bucket""")
    return "\nUNION ALL\n".join(parts)


COMMON = "WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in RS)
Q["rs_benchmark"] = benchmark("")
Q["rs_benchmark_common"] = benchmark(COMMON)
Q["common_sample_summary"] = f"""SELECT n_common_sample, n_full_eligible,
{r('CASE WHEN n_full_eligible > 0 THEN round(100::DOUBLE * n_common_sample / n_full_eligible, 2) ELSE 0 END', 'retained_pct')}
FROM (SELECT count(*) FILTER ({COMMON}) AS n_common_sample, count(*) AS n_full_eligible FROM rows)"""


def cross(source: str, uni: str, horizons, key2: str, expr2: str, labels2, extra2=None) -> str:
    """RS bucket x second bucket with universe and RS-bucket baselines."""
    rb = bucket("rs", CROSS)
    return f"""SELECT d.rs_horizon, d.outcome_horizon, d.rs_bucket, d.{key2}, coalesce(c.n, 0) AS n, {MROUND},
{baseline('u', 'universe')}, {baseline('b', 'rs_bucket')}
FROM (SELECT * FROM {values('rs_horizon', horizons)}, {HV}, {values('rs_bucket', CROSS[1])}, {values(key2, labels2)}) d
LEFT JOIN (SELECT rs_horizon, outcome_horizon, {rb} AS rs_bucket, {expr2} AS {key2}, {MSQL} FROM {source}
  GROUP BY rs_horizon, outcome_horizon, rs_bucket, {key2}) c
  ON c.rs_horizon = d.rs_horizon AND c.outcome_horizon = d.outcome_horizon AND c.rs_bucket = d.rs_bucket AND c.{key2} = d.{key2}
LEFT JOIN {uni} u ON u.outcome_horizon = d.outcome_horizon
LEFT JOIN (SELECT rs_horizon, outcome_horizon, {rb} AS rs_bucket, {MSQL} FROM {source} GROUP BY rs_horizon, outcome_horizon, rs_bucket) b
  ON b.rs_horizon = d.rs_horizon AND b.outcome_horizon = d.outcome_horizon AND b.rs_bucket = d.rs_bucket"""


Q["rs_x_atr"] = cross("rsh", "uni", RS, "atr_bucket", bucket("atr_extension", EXT), EXT[1])
Q["rs_bucket_baseline"] = f"""SELECT d.rs_horizon, d.outcome_horizon, d.rs_bucket, coalesce(c.n, 0) AS n, {MROUND}
FROM (SELECT * FROM {values('rs_horizon', RS)}, {HV}, {values('rs_bucket', CROSS[1])}) d
LEFT JOIN (SELECT rs_horizon, outcome_horizon, {bucket('rs', CROSS)} AS rs_bucket, {MSQL} FROM rsh GROUP BY rs_horizon, outcome_horizon, rs_bucket) c
ON c.rs_horizon = d.rs_horizon AND c.outcome_horizon = d.outcome_horizon AND c.rs_bucket = d.rs_bucket"""
Q["universe_baseline"] = f"SELECT c.outcome_horizon, c.n, {MROUND} FROM uni c"
Q["rs_atr_small_cells"] = f"SELECT rs_horizon, outcome_horizon, rs_bucket, atr_bucket, n FROM ({Q['rs_x_atr']}) WHERE n < 30"


def metric_rows(source: str, items) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{m}' AS metric, {k} AS key, {r('(' + v + ')::DOUBLE', 'value')} FROM {source}" for m, k, v in items
    )


NOKEY = "NULL::VARCHAR"
cov = [("n_eligible_total", NOKEY, "count(*)")]
for x in RS:
    strong = f"count(*) FILTER (WHERE {x} >= 90)"
    cov += [
        ("rs_coverage_n", f"'{x}'", f"count({x})"),
        ("rs_coverage_pct", f"'{x}'", f"round(100::DOUBLE * count({x}) / count(*), 2)"),
        ("high_rs_n", f"'{x}'", strong),
        ("high_rs_pct_of_eligible", f"'{x}'", f"round(100::DOUBLE * {strong} / count(*), 2)"),
    ]
Q["rs_coverage"] = metric_rows("rows", cov)

for e in ("10", "20"):
    eb = f"ema{e}_bucket"
    dist = bucket(f"distance_ema{e}_pct", DIST)
    prev = bucket("atr_extension_peak", PREV)
    Q[f"rs_x_ema{e}"] = cross("yrsh", "yuni", STATE_RS, eb, dist, DIST[1])
    Q[f"candidate_states_ema{e}"] = cross(
        "yrsh", "yuni", STATE_RS, "candidate_state", f"state{e}", ["Normal", "Extended", "Resetting"])
    Q[f"prior_extension_x_ema{e}"] = f"""SELECT d.outcome_horizon, d.prev_ext_bucket, d.{eb}, coalesce(c.n, 0) AS n, {MROUND},
{baseline('u', 'universe')}, {baseline('b', 'ema_bucket')}
FROM (SELECT * FROM {HV}, {values('prev_ext_bucket', PREV[1])}, {values(eb, DIST[1])}) d
LEFT JOIN (SELECT outcome_horizon, {prev} AS prev_ext_bucket, {dist} AS {eb}, {MSQL} FROM yrowsh GROUP BY outcome_horizon, prev_ext_bucket, {eb}) c
  ON c.outcome_horizon = d.outcome_horizon AND c.prev_ext_bucket = d.prev_ext_bucket AND c.{eb} = d.{eb}
LEFT JOIN yuni u ON u.outcome_horizon = d.outcome_horizon
LEFT JOIN (SELECT outcome_horizon, {dist} AS {eb}, {MSQL} FROM yrowsh GROUP BY outcome_horizon, {eb}) b
  ON b.outcome_horizon = d.outcome_horizon AND b.{eb} = d.{eb}"""
    cells = (f"SELECT rs_horizon, outcome_horizon, {prev} AS prev_ext_bucket, {dist} AS {eb}, {MSQL}, "
             f"quantile_cont(rs, 0.5) AS med_rs FROM yrsh WHERE rs >= 90 GROUP BY rs_horizon, outcome_horizon, prev_ext_bucket, {eb}")
    Q[f"repeat_offender_ema{e}"] = f"""SELECT d.rs_horizon, d.outcome_horizon, d.prev_ext_bucket, d.{eb}, coalesce(c.n, 0) AS n, {MROUND},
{baseline('u', 'universe')}, {baseline('g', 'rs_ge90_cohort')}, {baseline('k', 'no_prior_extension_control')},
{r('c.med_rs', 'median_current_rs_in_cell')}
FROM (SELECT * FROM {values('rs_horizon', STATE_RS)}, {HV}, {values('prev_ext_bucket', PREV[1])}, {values(eb, DIST[1])}) d
JOIN (SELECT rs_horizon, outcome_horizon, {MSQL} FROM yrsh WHERE rs >= 90 GROUP BY rs_horizon, outcome_horizon) g
  ON g.rs_horizon = d.rs_horizon AND g.outcome_horizon = d.outcome_horizon
LEFT JOIN ({cells}) c ON c.rs_horizon = d.rs_horizon AND c.outcome_horizon = d.outcome_horizon
  AND c.prev_ext_bucket = d.prev_ext_bucket AND c.{eb} = d.{eb}
LEFT JOIN (SELECT rs_horizon, outcome_horizon, {dist} AS {eb}, {MSQL} FROM yrsh WHERE rs >= 90 AND {prev} = '<4'
  GROUP BY rs_horizon, outcome_horizon, {eb}) k
  ON k.rs_horizon = d.rs_horizon AND k.outcome_horizon = d.outcome_horizon AND k.{eb} = d.{eb}
LEFT JOIN yuni u ON u.outcome_horizon = d.outcome_horizon"""

Q["prior_extension_coverage"] = metric_rows(
    "(SELECT *, max(n_valid_days_prior_peak_window) OVER () AS most FROM yrows)", [
        ("n_with_valid_peak", NOKEY, "count(atr_extension_peak)"),
        ("pct_with_valid_peak", NOKEY, "round(100::DOUBLE * count(atr_extension_peak) / count(*), 2)"),
        ("n_with_partial_lookback_window", NOKEY, "count(*) FILTER (WHERE n_valid_days_prior_peak_window < most)"),
    ])
Q["state_population"] = "\nUNION ALL\n".join(
    f"SELECT 'ema{e}' AS ema, '{s}' AS candidate_state, count(*) FILTER (WHERE coalesce(state{e}, "
    f"'unclassified_missing_current_extension') = '{s}') AS n FROM yrows"
    for e in ("10", "20") for s in ("Normal", "Extended", "Resetting", "unclassified_missing_current_extension")
)

Q["small_sample_counts"] = "\nUNION ALL\n".join(
    f"SELECT 'small_sample_cells' AS metric, 'candidate_states_by_rs_bucket_ema{e}' AS key, "
    f"{r('count(*)::DOUBLE', 'value')} FROM ({Q[f'candidate_states_ema{e}']}) WHERE n < 30" for e in ("10", "20")
)

# --- pullback: one row per (ema, rs horizon) a row is strong in
STRONG = "\nUNION ALL\n".join(
    f"SELECT *, '{e}' AS ema, '{x}' AS rs_horizon, {x} AS rs, distance_ema{e}_pct AS dist FROM {{src}} "
    f"WHERE {x} >= 90 AND coalesce(state{e}, '') <> 'Resetting'"
    for e in ("10", "20") for x in STATE_RS
)
SLICE = {
    "RS>=90": "rs >= 90", "90-95": "rs >= 90 AND rs < 95", "95-97.5": "rs >= 95 AND rs < 97.5",
    "97.5-100": "rs >= 97.5 AND rs < 100.000001",
}
SLICED = "\nUNION ALL\n".join(
    f"SELECT *, '{n}' AS rs_population_slice FROM ({STRONG.format(src='yrowsh')}) WHERE {c}" for n, c in SLICE.items()
)
PUSH = {"plus5_before_minus5": "r5", "plus10_before_minus5": "r10"}
PCTS = {"p2_5": 0.025, "p5": 0.05, "p10": 0.10, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.90, "p95": 0.95, "p97_5": 0.975}
PUSHED = "\nUNION ALL\n".join(f"SELECT *, '{n}' AS push_type FROM ({SLICED}) WHERE {c} = 1" for n, c in PUSH.items())
DIMS = f"{values('ema', ('10', '20'))}, {values('rs_horizon', STATE_RS)}, {values('rs_population_slice', SLICE)}, {HV}"
Q["push_distance_distribution"] = f"""SELECT d.*, coalesce(n, 0) AS n, {", ".join(r(f'c.q_{n}', n) for n in PCTS)},
{r('c.q_p10', 'range80_lo')}, {r('c.q_p90', 'range80_hi')}, {r('c.q_p5', 'range90_lo')}, {r('c.q_p95', 'range90_hi')},
{r('c.q_p2_5', 'range95_lo')}, {r('c.q_p97_5', 'range95_hi')}
FROM (SELECT * FROM {DIMS}, {values('push_type', PUSH)}) d
LEFT JOIN (SELECT ema, rs_horizon, rs_population_slice, outcome_horizon, push_type, count(dist) AS n,
  {", ".join(f"quantile_cont(dist, {p}) AS q_{n}" for n, p in PCTS.items())} FROM ({PUSHED})
  GROUP BY ema, rs_horizon, rs_population_slice, outcome_horizon, push_type) c
ON c.ema = d.ema AND c.rs_horizon = d.rs_horizon AND c.rs_population_slice = d.rs_population_slice
  AND c.outcome_horizon = d.outcome_horizon AND c.push_type = d.push_type"""
Q["push_distance_buckets"] = f"""SELECT d.*, coalesce(n, 0) AS n, {MROUND}
FROM (SELECT * FROM {DIMS}, {values('distance_bucket', DFINE[1])}) d
LEFT JOIN (SELECT ema, rs_horizon, rs_population_slice, outcome_horizon, {bucket('dist', DFINE)} AS distance_bucket, {MSQL}
  FROM ({SLICED}) GROUP BY ema, rs_horizon, rs_population_slice, outcome_horizon, distance_bucket) c
ON c.ema = d.ema AND c.rs_horizon = d.rs_horizon AND c.rs_population_slice = d.rs_population_slice
  AND c.outcome_horizon = d.outcome_horizon AND c.distance_bucket = d.distance_bucket"""
RANGES = [("v1_dashboard_-5_to_+5", -5.0, 5.0, "true")] + [
    (f"{a:+d}% to {b:+d}%", float(a), float(b), "false") for a in range(-8, -1) for b in range(2, 7)
]
RANGE_VALUES = "(VALUES " + ", ".join(f"('{a}', {b}::DOUBLE, {c}::DOUBLE, {d})" for a, b, c, d in RANGES) + \
    ") AS g(range_label, range_lo, range_hi, is_v1_reference)"
S10 = f"({STRONG.format(src='(SELECT * FROM yrowsh WHERE outcome_horizon = 10)')})"
_range_cols = []
for n, c in PUSH.items():
    _range_cols += [
        f"coalesce(t.{c}_total, 0) AS n_successful_{n}_total",
        r(f"CASE WHEN t.{c}_total > 0 THEN round(100::DOUBLE * coalesce(c.{c}_hits, 0) / t.{c}_total, 2) END",
          f"share_of_successful_{n}_in_range"),
        r(f"c.{c}_share", f"{n}_share_in_range"),
    ]
Q["pullback_range_comparison"] = f"""SELECT d.ema, d.rs_horizon, d.range_label, d.range_lo, d.range_hi, d.is_v1_reference,
coalesce(c.n, 0) AS n_in_range, {", ".join(_range_cols)},
{r('c.m1', 'median_mfe_pct')}, {r('c.m2', 'median_mae_pct')}, {r('c.m3', 'median_forward_return')}
FROM (SELECT * FROM {values('ema', ('10', '20'))}, {values('rs_horizon', STATE_RS)}, {RANGE_VALUES}) d
LEFT JOIN (SELECT ema, rs_horizon, range_label, count(*) AS n,
  {", ".join(f"count(*) FILTER (WHERE {c} = 1) AS {c}_hits, avg({c}) AS {c}_share" for c in PUSH.values())},
  quantile_cont(mfe, 0.5) AS m1, quantile_cont(mae, 0.5) AS m2, quantile_cont(fwd, 0.5) AS m3
  FROM {S10} s JOIN {RANGE_VALUES} ON dist >= range_lo AND dist <= range_hi GROUP BY ema, rs_horizon, range_label) c
  ON c.ema = d.ema AND c.rs_horizon = d.rs_horizon AND c.range_label = d.range_label
LEFT JOIN (SELECT ema, rs_horizon, {", ".join(f"count(*) FILTER (WHERE {c} = 1) AS {c}_total" for c in PUSH.values())}
  FROM {S10} GROUP BY ema, rs_horizon) t ON t.ema = d.ema AND t.rs_horizon = d.rs_horizon"""
Q["extended_among_pushes"] = f"""SELECT 'ema' || d.ema AS ema, d.rs_horizon, coalesce(n, 0) AS n_successful_pushes_10d,
coalesce(x, 0) AS n_extended_among_them, {r('CASE WHEN n > 0 THEN round(100::DOUBLE * x / n, 2) ELSE 0 END', 'pct_extended_among_them')}
FROM (SELECT * FROM {values('ema', ('10', '20'))}, {values('rs_horizon', STATE_RS)}) d
LEFT JOIN (SELECT ema, rs_horizon, count(*) AS n, count(*) FILTER (WHERE atr_extension >= 8) AS x FROM {S10} WHERE r5 = 1
  GROUP BY ema, rs_horizon) c ON c.ema = d.ema AND c.rs_horizon = d.rs_horizon"""
Q["pullback_exclusions"] = metric_rows("yrows", [
    *[("n_resetting_excluded", f"'ema{e}'", f"count(*) FILTER (WHERE state{e} = 'Resetting')") for e in ("10", "20")],
    *[("n_remaining", f"'ema{e}'", f"count(*) FILTER (WHERE coalesce(state{e}, '') <> 'Resetting')") for e in ("10", "20")],
    *[("missing_values", f"'{c}'", f"count(*) - count({c})")
      for c in ("distance_ema10_pct", "distance_ema20_pct", "atr_extension", *STATE_RS)],
])

# Table of a study: the query that has it.
SMALL_SAMPLE_TABLES = {
    "cross_matrix": "rs_x_atr",
    **{t: t for e in ("10", "20") for t in (f"rs_x_ema{e}", f"prior_extension_x_ema{e}", f"repeat_offender_ema{e}")},
    **{f"candidate_states_by_rs_bucket_ema{e}": f"candidate_states_ema{e}" for e in ("10", "20")},
    "push_distance_distribution": "push_distance_distribution", "push_distance_buckets": "push_distance_buckets",
    "ema_pullback_candidate_comparison": "pullback_range_comparison",
}
Q["small_sample_studies"] = "\nUNION ALL\n".join(
    f"SELECT 'small_sample_cells' AS metric, '{name}' AS key, {r('count(*)::DOUBLE', 'value')} FROM ({Q[q]}) "
    f"WHERE {'n_in_range' if q == 'pullback_range_comparison' else 'n'} < 30" for name, q in SMALL_SAMPLE_TABLES.items()
)

# --- index
IK = "index_id, date"
Q["index_members"] = f"SELECT {IK}, constituent_ticker, {rr('weight')} FROM members"
Q["component_counts"] = f"SELECT {IK}, component_count FROM mb"
Q["restricted_bars"] = f"SELECT {K}, {rr('close')} FROM adj WHERE ticker IN (SELECT constituent_ticker FROM members)"
Q["member_panel"] = f"""SELECT {K}, {rr('sma5', 'ema10', 'sma20', 'ema21', 'sma50', 'sma200')}, nh AS is_new_20d_high,
nl AS is_new_20d_low, adv AS is_advancer, dec AS is_decliner FROM mpanel"""
PA = [f"pct_above_{m}" for m in MAS]
simple("index_breadth", "mb1", ["rana", *PA, "high_low_pct"], f"{IK}, {', '.join(MB_INT)}")
simple("oscillators", "osc", OSC, IK)
simple("breadth_changes", "osc", [*CHG_COLS, "high_low_oscillator_5d_avg"], IK)
simple("index_structure", "ix", IX_NUM, f"{IK}, {', '.join(IX_FLAG)}")
Q["index_health_daily"] = f"""SELECT i.index_id, i.date, {rr(*IX_NUM, src='i')}, {', '.join('i.' + c for c in IX_FLAG)},
{', '.join('o.' + c for c in MB_INT)}, {rr(*MB_NUM, src='o')} FROM ix i JOIN osc o ON i.index_id = o.index_id AND i.date = o.date"""
simple("index_outcomes_daily", "ixo", IXO, IK)

# --- quality
DAYS = """(SELECT date, count(*) AS k, count(*) FILTER (WHERE eligible) AS e, count(*) FILTER (WHERE market_cap IS NULL) AS nc,
 count(*) FILTER (WHERE close IS NULL OR high IS NULL OR low IS NULL) AS no, count(*) FILTER (WHERE close > 1000000) AS imp
 FROM universe GROUP BY date)"""
MED = "quantile_cont(CASE WHEN e > 0 THEN e END, 0.5)"
Q["universe_quality"] = metric_rows(DAYS, [
    ("trading_days", NOKEY, "count(*)"), ("median_eligible_universe_size", NOKEY, MED),
    ("missing_market_cap_pct", NOKEY, "sum(nc)::DOUBLE / sum(k) * 100"),
    ("missing_ohlc_pct", NOKEY, "sum(no)::DOUBLE / sum(k) * 100"),
    ("implausible_price_row_count", NOKEY, "sum(imp)"),
    ("warning_small_universe", NOKEY, f"(coalesce({MED}, 0) < 50)::INT"),
]) + "\nUNION ALL\n" + (
    f"SELECT 'tickers_per_year' AS metric, year(date)::VARCHAR AS key, {r('count(DISTINCT ticker)::DOUBLE', 'value')} FROM universe GROUP BY year(date)"
) + "\nUNION ALL\n" + metric_rows("(SELECT * FROM universe WHERE close > 1000000)", [
    ("implausible_price_ticker_count", NOKEY, "count(DISTINCT ticker)")]) + """
UNION ALL SELECT 'implausible_price_ticker_example' AS metric, ticker::VARCHAR AS key, 1::DOUBLE AS value
FROM (SELECT DISTINCT ticker FROM universe WHERE close > 1000000 ORDER BY ticker LIMIT 10)"""
NEAR = "(SELECT * FROM universe WHERE market_cap BETWEEN 850000000 AND 1150000000)"
VOL = f"""(SELECT DISTINCT ticker FROM (SELECT ticker, cap / lag(cap) OVER (PARTITION BY ticker ORDER BY m) AS q FROM (
SELECT ticker, date_trunc('month', date) AS m, avg(market_cap) AS cap FROM universe
WHERE market_cap IS NOT NULL AND ticker IN (SELECT ticker FROM {NEAR}) GROUP BY ticker, m)) WHERE q > 3 OR q < 1 / 3::DOUBLE)"""
Q["cap_sensitivity"] = metric_rows(NEAR, [
    ("near_threshold_row_count", NOKEY, "count(*)"), ("near_threshold_ticker_count", NOKEY, "count(DISTINCT ticker)"),
]) + "\nUNION ALL\n" + metric_rows(VOL, [("near_threshold_volatile_ticker_count", NOKEY, "count(*)")]) + f"""
UNION ALL SELECT 'near_threshold_volatile_ticker_example' AS metric, ticker::VARCHAR AS key, 1::DOUBLE AS value
FROM (SELECT ticker FROM {VOL} ORDER BY ticker LIMIT 10)"""
TIES = "\nUNION ALL\n".join(
    f"SELECT 'reached_plus_{u}_before_minus_{d}_tie_{h}d' AS tie_column, "
    f"coalesce(sum(reached_plus_{u}_before_minus_{d}_tie_{h}d), 0)::BIGINT AS tie_count, "
    f"count(reached_plus_{u}_before_minus_{d}_{h}d) AS window_complete_count FROM outcomes"
    for h in H for u, d in ((5, 5), (10, 10), (10, 5))
)
TIEPCT = r("CASE WHEN window_complete_count > 0 THEN 100::DOUBLE * tie_count / window_complete_count ELSE 0 END", "tie_pct")
Q["tie_diagnostics"] = f"""SELECT tie_column, tie_count, window_complete_count, {TIEPCT} FROM ({TIES} UNION ALL
SELECT 'total' AS tie_column, sum(tie_count)::BIGINT AS tie_count, sum(window_complete_count)::BIGINT AS window_complete_count FROM ({TIES}))"""
Q["index_status"] = metric_rows("mb", [
    ("qqq_component_count_median", NOKEY, "quantile_cont(component_count, 0.5)"),
    ("qqq_component_count_min", NOKEY, "min(component_count)"), ("qqq_component_count_max", NOKEY, "max(component_count)"),
    ("warning_few_components", NOKEY, "(min(component_count) < 90)::INT"),
]) + "\nUNION ALL\n" + metric_rows("breadth", [
    ("market_breadth_rows", NOKEY, "count(*)"),
    *[(f"market_breadth_future_rs{b}plus_share_20d_median", NOKEY, f"quantile_cont(future_rs{b}plus_share_20d, 0.5)") for b in (80, 90, 95)],
])


def decile(source: str, column: str, outs, label: str) -> str:
    """Medians per right-closed decile bucket; edges interpolated by hand, duplicates dropped."""
    return f"""SELECT o AS {label}_bucket, {r('edges[o]', 'bucket_lo')}, {r('edges[o + 1]', 'bucket_hi')},
{", ".join(r(f'quantile_cont({x}, 0.5)', x) for x in outs)}, count(*) AS n
FROM (SELECT *, greatest(1, len(list_filter(edges, lambda e: e < {column}))) AS o FROM {source} s,
 (SELECT list_sort(list_distinct(list(lo + (hi - lo) * frac))) AS edges FROM (
  SELECT p, max(CASE WHEN i = floor(spot) THEN x END) AS lo, max(CASE WHEN i = ceil(spot) THEN x END) AS hi, max(spot - floor(spot)) AS frac
  FROM (SELECT {column} AS x, row_number() OVER (ORDER BY {column}) - 1 AS i, count(*) OVER () AS n FROM {source} WHERE {column} IS NOT NULL) v,
   (SELECT unnest(range(0, 11)) / 10::DOUBLE AS p) g, LATERAL (SELECT (n - 1) * p AS spot) l
  GROUP BY p)) b WHERE {column} IS NOT NULL) GROUP BY o, edges"""


TWO = ("mfe_pct_10d", "mae_pct_10d")
Q["sanity_rs_decile"] = decile("rows", "rs_percentile_1m", TWO, "rs_decile")
Q["sanity_atr_extension"] = decile("rows", "atr_extension", TWO, "atr_extension")
Q["sanity_ema20_distance"] = decile("rows", "distance_ema20_pct", TWO, "ema20_distance")
FOUR = ("median_forward_return_10d", "median_mfe_pct_10d", "median_mae_pct_10d", "share_positive_10d")
for b in ("80", "90"):
    c = f"breadth_rs{b}plus_share"
    Q[f"sanity_breadth_rs{b}"] = decile("breadth", c, FOUR, c)
IFOUR = ("qqq_forward_return_10d", "qqq_mfe_pct_10d", "qqq_mae_pct_10d", "qqq_max_drawdown_pct_10d")
HJOIN = "(SELECT osc.*, " + ", ".join(f"ixo.{c}" for c in IFOUR) + " FROM osc JOIN ixo ON osc.date = ixo.date JOIN ix ON ix.date = osc.date)"
for c in ("mco_z", "mcsi_z", "pct_above_ema21", "high_low_pct"):
    Q[f"sanity_{c}"] = decile(HJOIN, c, IFOUR, c)

# --- landing
WK = "datediff('day', DATE '1995-01-02', date) // 7"
simple("landed_scan", "bars", ("open", "high", "low", "close", "volume"))
simple("bounded_scan", "bars", ("open", "high", "low", "close", "volume"))
Q["bounded_scan"] += " WHERE year(date) = 1996"
Q["reference_scan"] = "SELECT date, ticker, type, primary_exchange FROM refs WHERE year(date) = 1996"
RAW_MEMBERS = """(SELECT date, ticker FROM bars WHERE (ticker + datediff('day', DATE '1995-01-02', date) // 7 // 26) % 2 = 0)"""
Q["member_scan"] = f"""SELECT 'IDX' AS index_id, date, ticker AS constituent_ticker,
{r('1.0::DOUBLE / count(*) OVER (PARTITION BY date)', 'weight')} FROM {RAW_MEMBERS} WHERE year(date) = 1996"""
Q["reference_scan_whole"] = "SELECT date, ticker, type, primary_exchange FROM refs"
Q["member_scan_whole"] = f"""SELECT 'IDX' AS index_id, date, ticker AS constituent_ticker,
{r('1.0::DOUBLE / count(*) OVER (PARTITION BY date)', 'weight')} FROM {RAW_MEMBERS}"""
Q["shares_scan"] = f"SELECT ticker, bucket_month, {r('shares::DOUBLE', 'shares')} FROM shares"
LINEAGE = "min(date)::DATE::VARCHAR AS data_start, max(date)::DATE::VARCHAR AS data_end"
Q["lineage_round_trip"] = f"""SELECT 'market_breadth_daily' AS "table", 'available' AS status, {LINEAGE}, 'bars' AS source,
'abc' AS code_commit_hash, CAST(NULL AS VARCHAR) AS error FROM bars
UNION ALL SELECT 'qqq_health_daily', 'unavailable', {LINEAGE}, 'members', 'abc', 'no members' FROM bars"""
Q["report_round_trip"] = "SELECT ticker, count(*) AS bars FROM bars GROUP BY ticker"
Q["ranks_with_gaps"] = """SELECT date, count(*) AS n_rows, count(CASE WHEN ticker % 5 <> 2 THEN return_21d END) AS n_known,
count(CASE WHEN ticker % 5 <> 2 THEN return_21d END) AS n_ranked FROM features WHERE eligible GROUP BY date"""
simple("streamed_landing", "bars", ("open", "high", "low", "close", "volume"))
GAPS = f"""SELECT 'grouped_daily' AS source, date, count(*) AS row_count FROM bars WHERE ({WK}) % 7 <> 3 GROUP BY date
UNION ALL SELECT 'grouped_daily_unadjusted' AS source, date, count(*) AS row_count FROM bars
WHERE ({WK}) % 7 <> 3 AND ({WK}) % 5 <> 1 GROUP BY date"""
Q["raw_manifest"] = f"""SELECT s.source, date, count(*) AS row_count FROM bars,
{values('source', ('grouped_daily', 'grouped_daily_unadjusted'))} s GROUP BY ALL
UNION ALL SELECT 'qqq_constituents', date, count(*) FROM {RAW_MEMBERS} GROUP BY date
UNION ALL SELECT 'reference_tickers', date, count(*) FROM refs GROUP BY date
UNION ALL SELECT 'grouped_daily', DATE '1990-01-02', 0"""
CAL = """(SELECT date FROM (SELECT CAST(unnest(range(lo, hi + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS date
FROM (SELECT min(date) AS lo, max(date) AS hi FROM bars)) WHERE isodow(date) <= 5)"""
Q["candidate_weekdays"] = f"SELECT date FROM {CAL}"
SOURCES = ("grouped_daily", "grouped_daily_unadjusted", "qqq_constituents", "reference_tickers")
Q["coverage_gaps"] = f"""SELECT s.source, c.date FROM {CAL} c, {values('source', SOURCES)} s
WHERE NOT EXISTS (SELECT 1 FROM ({GAPS}) m WHERE m.source = s.source AND m.date = c.date)"""
Q["time_splits"] = """SELECT split, count(*) AS n, min(d) AS first_date, max(d) AS last_date FROM (
SELECT d, CASE WHEN d BETWEEN DATE '2023-01-01' AND DATE '2024-12-31' THEN 'fitting'
 WHEN d BETWEEN DATE '2025-01-01' AND DATE '2025-12-31' THEN 'validation'
 WHEN d >= DATE '2026-01-01' THEN 'out_of_sample' END AS split
FROM (SELECT CAST(date + INTERVAL 336 MONTH AS DATE) AS d FROM bars)) GROUP BY split"""

# --- the jobs, as they store their tables
for job, same in {"universe": "universe_daily", "features": "features_daily", "outcomes": "outcomes_daily", "market_breadth": "market_breadth_daily",
                  "index_health": "index_health_daily", "index_outcomes": "index_outcomes_daily", "reference_tickers": "reference_scan_whole"}.items():
    Q[f"job_{job}"] = Q[same]
Q["job_manifest"] = f"""SELECT s.source, date, count(*) AS row_count FROM bars,
{values('source', ('grouped_daily', 'grouped_daily_unadjusted'))} s GROUP BY ALL
UNION ALL SELECT 'reference_tickers', date, count(*) FROM refs GROUP BY date"""
BY_NAME = "ORDER BY ticker::VARCHAR LIMIT"  # landed tickers are strings
Q["job_quality"] = "\nUNION ALL\n".join([
    Q["universe_quality"].replace("ORDER BY ticker LIMIT", BY_NAME), Q["cap_sensitivity"].replace("ORDER BY ticker LIMIT", BY_NAME), Q["index_status"],
    metric_rows("features", [("stock_feature_rows", NOKEY, "count(*)")]), metric_rows("outcomes", [("stock_outcome_rows", NOKEY, "count(*)")]),
    metric_rows("(SELECT i.date FROM ix i JOIN osc o ON i.index_id = o.index_id AND i.date = o.date)", [
        ("qqq_health_rows", NOKEY, "count(*)"), ("qqq_health_available", NOKEY, "(count(*) > 0)::INT")]),
    metric_rows("ixo", [("qqq_health_outcome_rows", NOKEY, "count(*)")]),
])
Q["job_lineage"] = "\nUNION ALL\n".join(
    f"""SELECT '{t}' AS "table", 'available' AS status, {LINEAGE}, '{source}' AS source FROM {rows}"""
    for t, source, rows in (
        ("market_universe_daily", "grouped_daily+reference_tickers+shares", "universe"), ("stock_features_daily", "grouped_daily+universe", "features"),
        ("stock_outcomes_daily", "stock_features_daily", "outcomes"),
        ("qqq_health_daily", "grouped_daily+qqq_constituents", "(SELECT i.date FROM ix i JOIN osc o ON i.index_id = o.index_id AND i.date = o.date)")))
Q["member_gaps"] = f"""SELECT 'IDX' AS index_id, date, row_number() OVER (ORDER BY date)::INT AS place, n AS n_missing
FROM (SELECT date, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM bars WHERE date NOT IN (
  SELECT date FROM {RAW_MEMBERS} WHERE ({WK}) % 9 <> 4))) ORDER BY date LIMIT 5"""
Q["range_guards"] = """SELECT a.lo AS start, b.hi AS "end", a.y = b.y AS single_year, a.y < b.y AS lookback
FROM (SELECT year(date) AS y, min(date) AS lo FROM bars GROUP BY 1) a JOIN (SELECT year(date) AS y, max(date) AS hi FROM bars GROUP BY 1) b ON a.y <= b.y"""

ORACLES = {name: query(sql) for name, sql in Q.items()}

# The job's outcomes run over the rows of the health table, which has only days with members.
_HELD = "(SELECT *, row_number() OVER (ORDER BY date) AS held FROM {0} WHERE date IN (SELECT date FROM osc))"
_OUTCOMES_OF_HELD = {
    "ixo1": CTES["ixo1"].replace("FROM ix ", f"FROM {_HELD.format('ix')} ix "),
    "ixpath": CTES["ixpath"].replace("FROM idx a JOIN idx b", f"FROM {_HELD.format('idx')} a JOIN {_HELD.format('idx')} b")
    .replace("b.rn - a.rn", "b.held - a.held").replace("ORDER BY b.rn", "ORDER BY b.held").replace("b.rn BETWEEN a.rn + 1 AND a.rn + 20", "b.held BETWEEN a.held + 1 AND a.held + 20"),
}
for job in ("job_index_outcomes", "job_quality"):
    ORACLES[job] = query(Q[job], **_OUTCOMES_OF_HELD)

# --- the whole panel after a day's bars were corrected
CORRECTED_OUTCOMES = ("mfe_pct_20d", "mae_pct_20d", "new_20d_high_within_window_20d", "reached_plus_5_before_minus_5_20d", "forward_return_close_5d")
CORRECTED_BARS = CTES["adj"].replace(
    "THEN 2048::DOUBLE ELSE 1::DOUBLE END AS f",
    "THEN 2048::DOUBLE ELSE 1::DOUBLE END * CASE WHEN date = DATE '2000-06-05' AND ticker % 3 = 0 THEN 1.5::DOUBLE ELSE 1::DOUBLE END AS f")
ORACLES["corrected_day"] = query(
    f"SELECT f.date, f.ticker, f.eligible, {rr(*FEATURES, src='f')}, {rr(*CORRECTED_OUTCOMES, src='o')} "
    "FROM features f JOIN outcomes o ON o.date = f.date AND o.ticker = f.ticker", adj=CORRECTED_BARS)
