"""SQL for every registered query, built from shared common table expressions.

Written against the raw tables alone; nothing here uses the Spark package.
"""

from __future__ import annotations

import re

H = (5, 10, 20)
H_YEAR = (63, 252)
RS = {
    "rs_percentile_1d": "return_1d", "rs_percentile_1w": "return_5d", "rs_percentile_1m": "return_21d",
    "rs_percentile_3m": "return_3m", "rs_percentile_6m": "return_6m", "rs_percentile_12m": "return_12m",
}
THRUST = {
    "thrust_percentile_1d": "thrust_1d", "thrust_percentile_1w": "thrust_1w", "thrust_percentile_1m": "thrust_1m",
}
STATE_RS = ("rs_percentile_1w", "rs_percentile_1m", "rs_percentile_3m", "rs_percentile_6m")
RETURNS = {"return_1d": 1, "return_5d": 5, "return_21d": 21, "return_3m": 63, "return_6m": 126, "return_12m": 252}
RACES = ((5, 5), (10, 10), (10, 5))
YEAR = 2000


def r(expr: str, name: str) -> str:
    """Rounded output column; the shift keeps exact decimal halves from going either way."""
    return f"round({expr} + 3.7e-8::DOUBLE, 6) + 0::DOUBLE AS {name}"


def rr(*names: str, src: str = "") -> str:
    p = f"{src}." if src else ""
    return ", ".join(r(f"{p}{n}", n) for n in names)


ORD = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity"

CTES: dict[str, str] = {}

CTES["priced"] = """
SELECT *, 100::DOUBLE * (1::DOUBLE + 1.5::DOUBLE * l_discount)
  * (1::DOUBLE + 4::DOUBLE * (abs((w + 7 * ticker) % 80 - 40) / 40::DOUBLE)) AS px
FROM (SELECT *, datediff('day', DATE '1995-01-02', date) // 7 AS w
      FROM (SELECT *, l_suppkey AS ticker, CAST(date_trunc('week', l_shipdate) AS DATE) AS date FROM lineitem))
"""
CTES["bars"] = f"""
SELECT date, ticker, first(px ORDER BY {ORD}) AS open, max(px) AS high, min(px) AS low,
  last(px ORDER BY {ORD}) AS close, sum(l_quantity) AS volume
FROM priced GROUP BY date, ticker
"""
CTES["adj"] = """
SELECT date, ticker, open * f AS open, high * f AS high, low * f AS low, close * f AS close, volume,
  close AS close_unadjusted, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn
FROM (SELECT *, CASE WHEN ticker % 7 = 2 THEN 2048::DOUBLE ELSE 1::DOUBLE END AS f FROM bars)
"""
CTES["f1"] = (
    "SELECT *, lag(close) OVER wt AS pc, (high / low - 1::DOUBLE) * 100::DOUBLE AS rng, "
    + ", ".join(f"(close / lag(close, {n}) OVER wt - 1::DOUBLE) * 100::DOUBLE AS {c}" for c, n in RETURNS.items())
    + " FROM adj WINDOW wt AS (PARTITION BY ticker ORDER BY date)"
)
CTES["f2"] = """
SELECT *, CASE WHEN pc IS NULL THEN high - low
  ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS true_range FROM f1
"""


def full(fn: str, x: str, n: int, frame: str) -> str:
    w = f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {frame})"
    return f"CASE WHEN count({x}) {w} >= {n} THEN {fn}({x}) {w} END"


CTES["f3"] = f"""
SELECT *, {full('avg', 'true_range', 14, '13 PRECEDING AND CURRENT ROW')} AS atr14,
  {full('avg', 'rng', 20, '19 PRECEDING AND CURRENT ROW')} AS adr20,
  {full('avg', 'close', 50, '49 PRECEDING AND CURRENT ROW')} AS sma50 FROM f2
"""
CTES["f4"] = """
SELECT *, atr14 / close * 100::DOUBLE AS atr_pct, (close - sma50) / sma50 * 100::DOUBLE AS gain,
  (sma50 - lag(sma50, 5) OVER wt) / lag(sma50, 5) OVER wt * 100::DOUBLE AS sma50_slope_pct,
  sma50 IS NOT NULL AS ok, coalesce(close > sma50, false) AS up
FROM f3 WINDOW wt AS (PARTITION BY ticker ORDER BY date)
"""
CTES["f5"] = """
SELECT *, CASE WHEN atr_pct <> 0 THEN gain / atr_pct END AS atr_extension,
  CASE WHEN NOT ok OR rn = 1 OR NOT lag(ok) OVER wt OR up <> lag(up) OVER wt THEN 1 ELSE 0 END AS cut
FROM f4 WINDOW wt AS (PARTITION BY ticker ORDER BY date)
"""
CTES["f6"] = """
SELECT *, CASE WHEN ok THEN (CASE WHEN up THEN 1 ELSE -1 END)
  * row_number() OVER (PARTITION BY ticker, seg ORDER BY date)::DOUBLE END AS sma50_persistence_days
FROM (SELECT *, sum(cut) OVER (PARTITION BY ticker ORDER BY date) AS seg FROM f5)
"""


def ema_step(prev: str, x: str, span: int) -> str:
    a = f"(1::DOUBLE / (1::DOUBLE + {span - 1}::DOUBLE / 2::DOUBLE))"
    return (
        f"CASE WHEN {prev} IS NULL THEN {x} WHEN {x} IS NULL OR {prev} = {x} THEN {prev} "
        f"ELSE ((1::DOUBLE - {a}) * {prev} + {a} * {x}) / ((1::DOUBLE - {a}) + {a}) END"
    )


def ema_cte(name: str, source: str, key: str, specs: list[tuple[str, str, int]]) -> str:
    """Recursion over the row number; the inputs have no interior gaps."""
    seed = ", ".join(f"{x} AS {o}" for o, x, _ in specs)
    step = ", ".join(f"{ema_step('p.' + o, 'n.' + x, s)}" for o, x, s in specs)
    return (
        f"SELECT {key}, rn, {seed} FROM {source} WHERE rn = 1 UNION ALL "
        f"SELECT n.{key}, n.rn, {step} FROM {name} p JOIN {source} n ON n.{key} = p.{key} AND n.rn = p.rn + 1"
    )


CTES["ema"] = ema_cte("ema", "f1", "ticker", [
    ("ema10", "close", 10), ("ema20", "close", 20), ("t2", "return_1d", 2), ("t5", "return_1d", 5),
    ("t10", "return_1d", 10), ("t15", "return_1d", 15), ("t25", "return_1d", 25),
])
CTES["f7"] = """
SELECT f6.*, ema10, ema20, (close - ema10) / ema10 * 100::DOUBLE AS distance_ema10_pct,
  (close - ema20) / ema20 * 100::DOUBLE AS distance_ema20_pct,
  t2 - t5 AS thrust_1d, t5 - t15 AS thrust_1w, t10 - t25 AS thrust_1m
FROM f6 JOIN ema ON f6.ticker = ema.ticker AND f6.rn = ema.rn
"""
CTES["span"] = """
SELECT CAST(date_trunc('week', min(l_shipdate)) AS DATE) AS lo,
  CAST(date_trunc('week', max(l_shipdate)) AS DATE) AS hi FROM lineitem
"""
CTES["refs"] = """
SELECT date, s_suppkey AS ticker, CASE WHEN s_suppkey % 10 = 9 THEN 'ETF' ELSE 'CS' END AS type,
  CASE WHEN s_suppkey % 11 = 4 THEN 'OTCQB' ELSE 'XNAS' END AS primary_exchange
FROM supplier, (SELECT CAST(unnest(range(lo, hi + INTERVAL 1 DAY, INTERVAL 7 DAY)) AS DATE) AS date FROM span)
WHERE NOT (s_suppkey % 13 = 5 AND datediff('day', DATE '1995-01-02', date) // 7 >= 300)
"""
CTES["listed"] = """
SELECT DISTINCT date, ticker, true AS asset_type_ok FROM refs
WHERE type = 'CS' AND NOT starts_with(upper(primary_exchange), 'OTC')
"""
CTES["shares"] = """
SELECT s_suppkey AS ticker, m AS bucket_month,
  1000000::DOUBLE * (3 + (s_suppkey * 5 + mi) % 5)
  * CASE WHEN s_suppkey % 17 = 3 AND mi % 2 = 0 THEN 4::DOUBLE ELSE 1::DOUBLE END AS shares
FROM (SELECT *, year(m) * 12 + month(m) AS mi FROM supplier,
      (SELECT CAST(unnest(range(date_trunc('month', lo), date_trunc('month', hi) + INTERVAL 1 DAY, INTERVAL 1 MONTH)) AS DATE) AS m
       FROM span))
"""
CTES["gates"] = """
SELECT f3.date, f3.ticker, f3.close, f3.high, f3.low, coalesce(asset_type_ok, false) AS asset_type_ok, adr20,
  coalesce(adr20 > 4, false) AS adr20_ok, close_unadjusted * shares AS cap
FROM f3 LEFT JOIN listed ON f3.date = listed.date AND f3.ticker = listed.ticker
LEFT JOIN shares ON f3.ticker = shares.ticker AND CAST(date_trunc('month', f3.date) AS DATE) = shares.bucket_month
"""
CTES["universe"] = """
SELECT date, ticker, close, high, low, asset_type_ok, adr20, adr20_ok, market_cap,
  coalesce(market_cap, 0) >= 1e9 AS market_cap_ok,
  asset_type_ok AND adr20_ok AND coalesce(market_cap, 0) >= 1e9 AS eligible
FROM (SELECT *, CASE WHEN asset_type_ok AND adr20_ok THEN cap END AS market_cap FROM gates)
"""
CTES["feat"] = """
SELECT f7.*, u.market_cap, u.eligible FROM f7 JOIN universe u ON f7.date = u.date AND f7.ticker = u.ticker
"""
CTES["pct_long"] = "\nUNION ALL\n".join(
    f"SELECT date, ticker, '{p}' AS h, (rank() OVER (PARTITION BY date ORDER BY {s}) - 1 "
    f"+ (count(*) OVER (PARTITION BY date, {s}) + 1) / 2::DOUBLE) / count(*) OVER (PARTITION BY date) * 100::DOUBLE AS pct "
    f"FROM feat WHERE eligible AND {s} IS NOT NULL"
    for p, s in {**RS, **THRUST}.items()
)
CTES["pcts"] = (
    "SELECT date, ticker, " + ", ".join(f"max(CASE WHEN h = '{p}' THEN pct END) AS {p}" for p in {**RS, **THRUST})
    + " FROM pct_long GROUP BY date, ticker"
)
CTES["features"] = (
    "SELECT feat.*, " + ", ".join({**RS, **THRUST})
    + " FROM feat LEFT JOIN pcts ON feat.date = pcts.date AND feat.ticker = pcts.ticker"
)

# --- outcomes
CTES["o0"] = (
    "SELECT date, ticker, rn, close, high, low, atr14, coalesce(high > "
    + full("max", "high", 20, "20 PRECEDING AND 1 PRECEDING") + ", false) AS is_new FROM f3"
)


def _ahead(horizons) -> str:
    return (
        "SELECT *, " + ", ".join(
            f"count(high) OVER w{h} AS n{h}, max(high) OVER w{h} AS top{h}, min(low) OVER w{h} AS bot{h}, "
            f"max(is_new::INT) OVER w{h} AS new{h}, lead(close, {h}) OVER wt AS end{h}" for h in horizons
        )
        + " FROM o0 WINDOW wt AS (PARTITION BY ticker ORDER BY date), "
        + ", ".join(f"w{h} AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)" for h in horizons)
    )


CTES["o1"] = _ahead(H)
CTES["o1_year"] = _ahead(H_YEAR)
CTES["hits"] = (
    "SELECT a.ticker, a.rn, " + ", ".join(
        f"min(CASE WHEN (b.high / a.close - 1::DOUBLE) * 100::DOUBLE >= {t} THEN b.rn - a.rn END) AS up{t}, "
        f"min(CASE WHEN (b.low / a.close - 1::DOUBLE) * 100::DOUBLE <= -{t} THEN b.rn - a.rn END) AS down{t}"
        for t in (5, 10)
    )
    + " FROM adj a JOIN adj b ON a.ticker = b.ticker AND b.rn BETWEEN a.rn + 1 AND a.rn + 20 GROUP BY a.ticker, a.rn"
)
CTES["hits_year"] = CTES["hits"].replace("a.rn + 20 ", f"a.rn + {max(H_YEAR)} ")


def _outcome_cols(h: int) -> list[str]:
    done = f"n{h} = {h}"
    cols = [
        f"(end{h} / close - 1::DOUBLE) * 100::DOUBLE AS forward_return_close_{h}d",
        f"CASE WHEN {done} THEN (top{h} / close - 1::DOUBLE) * 100::DOUBLE END AS mfe_pct_{h}d",
        f"CASE WHEN {done} THEN (bot{h} / close - 1::DOUBLE) * 100::DOUBLE END AS mae_pct_{h}d",
    ]
    cols += [
        f"CASE WHEN {done} THEN ((top{h} / close - 1::DOUBLE) * 100::DOUBLE >= {t})::INT::DOUBLE END AS reached_plus_{t}pct_{h}d"
        for t in (5, 10)
    ]
    cols += [
        f"CASE WHEN {done} AND atr14 <> 0 THEN (top{h} - close) / atr14 END AS mfe_atr_multiple_{h}d",
        f"CASE WHEN {done} AND atr14 <> 0 THEN (bot{h} - close) / atr14 END AS mae_atr_multiple_{h}d",
    ]
    cols += [
        f"CASE WHEN {done} THEN coalesce(atr14 <> 0 AND (top{h} - close) / atr14 >= {m}, false)::INT::DOUBLE END AS reached_{m}atr_{h}d"
        for m in (2, 3)
    ]
    cols.append(f"CASE WHEN {done} THEN new{h}::DOUBLE END AS new_20d_high_within_window_{h}d")
    for u, d in RACES:
        uu = f"CASE WHEN up{u} <= {h} THEN up{u} ELSE {h + 1} END"
        dd = f"CASE WHEN down{d} <= {h} THEN down{d} ELSE {h + 1} END"
        cols += [
            f"CASE WHEN {done} THEN ({uu} < {dd})::INT::DOUBLE END AS reached_plus_{u}_before_minus_{d}_{h}d",
            f"CASE WHEN {done} THEN ({uu} = {dd} AND {uu} <= {h})::INT::DOUBLE END AS reached_plus_{u}_before_minus_{d}_tie_{h}d",
        ]
    return cols


def outcome_names(h: int) -> list[str]:
    return [c.rsplit(" AS ", 1)[1] for c in _outcome_cols(h)]


ALL_OUTCOMES = [n for h in H for n in outcome_names(h)]
CTES["outcomes"] = (
    "SELECT o1.date, o1.ticker, o1.rn, " + ", ".join(c for h in H for c in _outcome_cols(h))
    + " FROM o1 LEFT JOIN hits ON o1.ticker = hits.ticker AND o1.rn = hits.rn"
)
CTES["outcomes_year"] = (
    "SELECT o.date, o.ticker, o.rn, " + ", ".join(c for h in H_YEAR for c in _outcome_cols(h))
    + " FROM o1_year o LEFT JOIN hits_year y ON o.ticker = y.ticker AND o.rn = y.rn"
)

# --- history
CTES["prior"] = """
SELECT a.ticker, a.rn, max(b.atr_extension) AS peak, count(b.atr_extension) AS n_valid,
  max(CASE WHEN b.rn >= a.rn - 20 THEN b.atr_extension END) AS p20,
  max(CASE WHEN b.rn >= a.rn - 40 THEN b.atr_extension END) AS p40
FROM f7 a JOIN f7 b ON a.ticker = b.ticker AND b.rn BETWEEN a.rn - 60 AND a.rn - 1 GROUP BY a.ticker, a.rn
"""
CTES["peaks"] = """
SELECT p.ticker, p.rn, min(b.rn) AS peak_rn FROM prior p JOIN f7 b
  ON b.ticker = p.ticker AND b.rn BETWEEN p.rn - 60 AND p.rn - 1 AND b.atr_extension = p.peak GROUP BY p.ticker, p.rn
"""
CTES["since"] = """
SELECT p.ticker, p.rn, min(b.distance_ema10_pct) AS m10, min(b.distance_ema20_pct) AS m20
FROM peaks p JOIN f7 b ON b.ticker = p.ticker AND b.rn BETWEEN p.peak_rn + 1 AND p.rn GROUP BY p.ticker, p.rn
"""
CTES["history"] = """
SELECT a.date, a.ticker, a.rn, p20 AS max_atr_extension_prior_20d, p40 AS max_atr_extension_prior_40d,
  peak AS max_atr_extension_prior_60d, peak AS atr_extension_peak,
  coalesce(n_valid, 0) AS n_valid_days_prior_peak_window,
  (a.rn - peak_rn)::DOUBLE AS days_since_atr_extension_peak,
  a.atr_extension - peak AS atr_extension_drawdown_from_peak,
  m10 AS min_distance_ema10_pct_since_peak, m20 AS min_distance_ema20_pct_since_peak,
  (m10 <= 0)::INT::DOUBLE AS touched_ema10_since_peak, (m20 <= 0)::INT::DOUBLE AS touched_ema20_since_peak
FROM f7 a LEFT JOIN prior ON a.ticker = prior.ticker AND a.rn = prior.rn
LEFT JOIN peaks ON a.ticker = peaks.ticker AND a.rn = peaks.rn
LEFT JOIN since ON a.ticker = since.ticker AND a.rn = since.rn
"""
# The same over a year of rows.
for _name in ("prior", "peaks", "since"):
    CTES[f"{_name}_year"] = re.sub(r"\b(prior|peaks)\b", r"\1_year", CTES[_name]).replace("- 60", "- 252")
CTES["history_year"] = """
SELECT a.date, a.ticker, p20 AS max_atr_extension_prior_20d, peak AS max_atr_extension_prior_252d,
  coalesce(n_valid, 0) AS n_valid_days_prior_peak_window, (a.rn - peak_rn)::DOUBLE AS days_since_atr_extension_peak,
  a.atr_extension - peak AS atr_extension_drawdown_from_peak,
  m10 AS min_distance_ema10_pct_since_peak, m20 AS min_distance_ema20_pct_since_peak
FROM f7 a LEFT JOIN prior_year p ON a.ticker = p.ticker AND a.rn = p.rn
LEFT JOIN peaks_year k ON a.ticker = k.ticker AND a.rn = k.rn
LEFT JOIN since_year s ON a.ticker = s.ticker AND a.rn = s.rn
"""
HISTORY = [
    "max_atr_extension_prior_20d", "max_atr_extension_prior_40d", "max_atr_extension_prior_60d", "atr_extension_peak",
    "n_valid_days_prior_peak_window", "days_since_atr_extension_peak", "atr_extension_drawdown_from_peak",
    "min_distance_ema10_pct_since_peak", "min_distance_ema20_pct_since_peak",
    "touched_ema10_since_peak", "touched_ema20_since_peak",
]


def state_case(e: str) -> str:
    return (
        f"CASE WHEN atr_extension IS NULL THEN NULL WHEN atr_extension >= 8 THEN 'Extended' "
        f"WHEN atr_extension_peak >= 8 AND atr_extension < 4 AND distance_ema{e}_pct <= 0 THEN 'Resetting' ELSE 'Normal' END"
    )


# --- study rows
CTES["rows"] = (
    "SELECT f.*, " + ", ".join(f"o.{c}" for c in ALL_OUTCOMES)
    + " FROM features f JOIN outcomes o ON f.date = o.date AND f.ticker = o.ticker WHERE eligible"
)
CTES["yrows"] = (
    "SELECT *, " + ", ".join(f"{state_case(e)} AS state{e}" for e in ("10", "20"))
    + " FROM (SELECT r.*, " + ", ".join(f"h.{c}" for c in HISTORY)
    + f" FROM rows r JOIN history h ON r.date = h.date AND r.ticker = h.ticker WHERE year(r.date) = {YEAR})"
)
SHORT = ("mfe", "mae", "fwd", "p5", "p10", "a2", "a3", "r5", "r10")


def long_h(source: str) -> str:
    """One row per outcome horizon with short outcome names."""
    return "\nUNION ALL\n".join(
        f"SELECT *, {h} AS outcome_horizon, mfe_pct_{h}d AS mfe, mae_pct_{h}d AS mae, forward_return_close_{h}d AS fwd, "
        f"reached_plus_5pct_{h}d AS p5, reached_plus_10pct_{h}d AS p10, reached_2atr_{h}d AS a2, reached_3atr_{h}d AS a3, "
        f"reached_plus_5_before_minus_5_{h}d AS r5, reached_plus_10_before_minus_5_{h}d AS r10 FROM {source}"
        for h in H
    )


METRICS = {
    "median_mfe_pct": "quantile_cont(mfe, 0.5)", "mean_mfe_pct": "avg(mfe)",
    "p75_mfe_pct": "quantile_cont(mfe, 0.75)", "p90_mfe_pct": "quantile_cont(mfe, 0.9)",
    "median_mae_pct": "quantile_cont(mae, 0.5)", "mean_mae_pct": "avg(mae)",
    "median_forward_return": "quantile_cont(fwd, 0.5)", "mean_forward_return": "avg(fwd)",
    "reached_plus_5pct_share": "avg(p5)", "reached_plus_10pct_share": "avg(p10)",
    "reached_2atr_share": "avg(a2)", "reached_3atr_share": "avg(a3)",
    "reached_plus_5_before_minus_5_share": "avg(r5)", "reached_plus_10_before_minus_5_share": "avg(r10)",
}
MSQL = "count(*) AS n, " + ", ".join(f"{e} AS {m}" for m, e in METRICS.items())

DECILES = ([float(x) for x in range(0, 101, 10)], [f"{x}-{x + 10}" for x in range(0, 100, 10)])
FINE = ([80 + 2.5 * i for i in range(9)], [f"{80 + 2.5 * i:g}-{82.5 + 2.5 * i:g}" for i in range(8)])
CROSS = ([0, 80, 90, 95, 97.5, 100.000001], ["<80", "80-90", "90-95", "95-97.5", "97.5-100"])
EXT = ([None, 0, 2, 4, 6, 8, 10, None], ["<0", "0-2", "2-4", "4-6", "6-8", "8-10", ">=10"])
DIST = ([None, -5, -2, 0, 2, 5, 10, None],
        ["<-5%", "-5% to -2%", "-2% to 0%", "0% to +2%", "+2% to +5%", "+5% to +10%", ">=+10%"])
PREV = ([None, 4, 6, 8, 10, None], ["<4", "4-6", "6-8", "8-10", ">=10"])
DFINE = ([None, -10, -7.5, -5, -3, -2, -1, 0, 1, 2, 3, 5, 7.5, 10, None],
         ["<-10%", "-10 to -7.5%", "-7.5 to -5%", "-5 to -3%", "-3 to -2%", "-2 to -1%", "-1 to 0%", "0 to +1%",
          "+1 to +2%", "+2 to +3%", "+3 to +5%", "+5 to +7.5%", "+7.5 to +10%", ">=+10%"])


def bucket(x: str, scheme, right: bool = False) -> str:
    edges, labels = scheme
    whens = []
    for i, label in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        conds = []
        if lo is not None:
            conds.append(f"{x} {'>' if right and i else '>='} {lo}::DOUBLE")
        if hi is not None:
            conds.append(f"{x} {'<=' if right else '<'} {hi}::DOUBLE")
        whens.append(f"WHEN {' AND '.join(conds)} THEN '{label}'")
    return "CASE " + " ".join(whens) + " END"


def values(name: str, labels) -> str:
    return f"(SELECT unnest([{', '.join(repr(x) for x in labels)}]) AS {name})"


def baseline(alias: str, name: str) -> str:
    return ", ".join(
        r(f"{alias}.{m}", f"baseline_{name}_{m}") + ", " + r(f"c.{m} - {alias}.{m}", f"delta_vs_{name}_{m}")
        for m in METRICS
    )


MROUND = ", ".join(r(f"c.{m}", m) for m in METRICS)
CTES["rowsh"] = long_h("rows")
CTES["yrowsh"] = long_h("yrows")


def unpivot_rs(source: str, horizons) -> str:
    return "\nUNION ALL\n".join(f"SELECT *, '{x}' AS rs_horizon, {x} AS rs FROM {source}" for x in horizons)


CTES["rsh"] = unpivot_rs("rowsh", RS)
CTES["yrsh"] = unpivot_rs("yrowsh", STATE_RS)
CTES["uni"] = f"SELECT outcome_horizon, {MSQL} FROM rowsh GROUP BY outcome_horizon"
CTES["yuni"] = f"SELECT outcome_horizon, {MSQL} FROM yrowsh GROUP BY outcome_horizon"
HV = "(SELECT unnest([5, 10, 20]) AS outcome_horizon)"

# --- index
CTES["members"] = """
SELECT 'IDX' AS index_id, date, ticker AS constituent_ticker, 1::DOUBLE / count(*) OVER (PARTITION BY date) AS weight
FROM bars WHERE (ticker + (datediff('day', DATE '1995-01-02', date) // 7) // 26) % 2 = 0
QUALIFY count(*) OVER (PARTITION BY date) >= 2
"""
CTES["idx"] = (
    "SELECT 'IDX' AS index_id, date, row_number() OVER (ORDER BY date) AS rn, "
    + ", ".join(f"(sum(CAST(round({c} * 1000) AS BIGINT)) // count(*))::DOUBLE / 1000::DOUBLE AS {c}"
                for c in ("open", "high", "low", "close"))
    + " FROM bars GROUP BY date"
)
CTES["mp0"] = ema_cte("mp0", "adj", "ticker", [("ema10", "close", 10), ("ema21", "close", 21)])
CTES["mp1"] = (
    "SELECT adj.*, "
    + ", ".join(f"{full('avg', 'close', n, f'{n - 1} PRECEDING AND CURRENT ROW')} AS sma{n}" for n in (5, 20, 50, 200))
    + f", coalesce(high > {full('max', 'high', 20, '20 PRECEDING AND 1 PRECEDING')}, false) AS nh"
    + f", coalesce(low < {full('min', 'low', 20, '20 PRECEDING AND 1 PRECEDING')}, false) AS nl"
    + ", coalesce(close > lag(close) OVER (PARTITION BY ticker ORDER BY date), false) AS adv"
    + ", coalesce(close < lag(close) OVER (PARTITION BY ticker ORDER BY date), false) AS dec FROM adj"
)
CTES["mpanel"] = (
    "SELECT mp1.*, ema10, ema21 FROM mp1 JOIN mp0 ON mp1.ticker = mp0.ticker AND mp1.rn = mp0.rn"
)
MAS = ("sma5", "ema10", "sma20", "ema21", "sma50", "sma200")
CTES["mb"] = (
    "SELECT m.index_id, m.date, count(DISTINCT constituent_ticker) AS component_count, "
    "count(*) FILTER (WHERE adv) AS advancers, count(*) FILTER (WHERE dec) AS decliners, "
    + ", ".join(f"count(*) FILTER (WHERE close > {m})::DOUBLE / nullif(count({m}), 0) * 100::DOUBLE AS pct_above_{m}" for m in MAS)
    + ", count(*) FILTER (WHERE nh) AS new_20d_highs, count(*) FILTER (WHERE nl) AS new_20d_lows, "
    "row_number() OVER (ORDER BY m.date) AS rn "
    "FROM members m LEFT JOIN mpanel p ON m.date = p.date AND m.constituent_ticker = p.ticker GROUP BY m.index_id, m.date"
)
CTES["mb1"] = """
SELECT *, (advancers - decliners)::DOUBLE / greatest(advancers + decliners, 1) * 1000::DOUBLE AS rana,
  new_20d_highs - new_20d_lows AS high_low_oscillator,
  (new_20d_highs - new_20d_lows)::DOUBLE / nullif(component_count, 0) * 100::DOUBLE AS high_low_pct FROM mb
"""
CTES["mbe"] = ema_cte("mbe", "mb1", "index_id", [("s", "rana", 19), ("l", "rana", 39)])
CTES["mb2"] = "SELECT mb1.*, s - l AS mco_raw FROM mb1 JOIN mbe ON mb1.index_id = mbe.index_id AND mb1.rn = mbe.rn"


def zscore(x: str) -> str:
    w = "OVER (PARTITION BY index_id ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} >= 80 THEN ({x} - avg({x}) {w}) / nullif(stddev_samp({x}) {w}, 0) END"


CTES["mb3"] = (
    f"SELECT *, {zscore('mco_raw')} AS mco_z, sum(mco_raw) OVER (PARTITION BY index_id ORDER BY date) AS mcsi_raw FROM mb2"
)
CTES["mb4"] = f"SELECT *, {zscore('mcsi_raw')} AS mcsi_z FROM mb3"


def imean(x: str, n: int) -> str:
    w = f"OVER (PARTITION BY index_id ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} >= {n} THEN avg({x}) {w} END"


CHG = ("mco_raw", "mco_z", "mcsi_z", "pct_above_ema10", "pct_above_ema21", "pct_above_sma50", "high_low_oscillator")
CHG_COLS = [f"{c}_chg_{w}d" for c in CHG for w in (1, 3, 5)]
CTES["osc"] = (
    f"SELECT *, mcsi_z - mcsi_z_sma10 AS mcsi_z_minus_sma10 FROM (SELECT *, {imean('mcsi_z', 10)} AS mcsi_z_sma10, "
    f"{imean('high_low_oscillator', 5)} AS high_low_oscillator_5d_avg, "
    + ", ".join(f"({c} - lag({c}, {w}) OVER (PARTITION BY index_id ORDER BY date))::DOUBLE AS {c}_chg_{w}d"
                for c in CHG for w in (1, 3, 5))
    + " FROM mb4)"
)
CTES["ixe"] = ema_cte("ixe", "idx", "index_id", [("ema10", "close", 10), ("ema20", "close", 20)])
CTES["ix1"] = """
SELECT idx.*, ema10, ema20, CASE WHEN pc IS NULL THEN high - low
  ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr
FROM (SELECT *, lag(close) OVER (ORDER BY date) AS pc FROM idx) idx
JOIN ixe ON idx.index_id = ixe.index_id AND idx.rn = ixe.rn
"""
CTES["ix2"] = (
    f"SELECT *, {imean('tr', 14)} AS atr14, {imean('close', 50)} AS sma50, {imean('close', 200)} AS sma200 FROM ix1"
)
CTES["ix"] = """
SELECT *, atr14 / close * 100::DOUBLE AS atr_pct, (close - ema10) / ema10 * 100::DOUBLE AS distance_ema10_pct,
  (close - ema20) / ema20 * 100::DOUBLE AS distance_ema20_pct, (close - sma50) / sma50 * 100::DOUBLE AS distance_sma50_pct,
  coalesce(ema10 > ema20, false) AS ema10_above_ema20, coalesce(close > ema10, false) AS close_above_ema10,
  coalesce(close > ema20, false) AS close_above_ema20, coalesce(close > sma50, false) AS close_above_sma50,
  coalesce(close > sma200, false) AS close_above_sma200,
  ((close - sma50) / sma50 * 100::DOUBLE) / (atr14 / close * 100::DOUBLE) AS atr_extension FROM ix2
"""
IX_NUM = ("close", "high", "low", "ema10", "ema20", "sma50", "sma200", "distance_ema10_pct", "distance_ema20_pct",
          "distance_sma50_pct", "atr14", "atr_pct", "atr_extension")
IX_FLAG = ("ema10_above_ema20", "close_above_ema10", "close_above_ema20", "close_above_sma50", "close_above_sma200")
MB_INT = ("component_count", "advancers", "decliners", "new_20d_highs", "new_20d_lows", "high_low_oscillator")
MB_NUM = ("rana", *[f"pct_above_{m}" for m in MAS], "high_low_pct", "mco_raw", "mco_z", "mcsi_raw", "mcsi_z",
          "mcsi_z_sma10", "mcsi_z_minus_sma10", "high_low_oscillator_5d_avg", *CHG_COLS)
CTES["ixo1"] = (
    "SELECT *, coalesce(high > (CASE WHEN count(high) OVER p >= 20 THEN max(high) OVER p END), false) AS is_new "
    "FROM ix WINDOW p AS (ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
)
CTES["ixo2"] = (
    "SELECT *, " + ", ".join(
        f"count(high) OVER w{h} AS n{h}, max(high) OVER w{h} AS top{h}, min(low) OVER w{h} AS bot{h}, "
        f"max(is_new::INT) OVER w{h} AS new{h}, lead(close, {h}) OVER wt AS end{h}, "
        f"min(close_above_ema20::INT) OVER w{h} AS allup{h}, max(close_above_ema20::INT) OVER w{h} AS anyup{h}" for h in H
    )
    + " FROM ixo1 WINDOW wt AS (ORDER BY date), "
    + ", ".join(f"w{h} AS (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)" for h in H)
)
CTES["ixpath"] = """
SELECT a.rn, b.rn - a.rn AS k, (b.low / greatest(a.close, max(b.high) OVER (PARTITION BY a.rn ORDER BY b.rn)) - 1::DOUBLE)
  * 100::DOUBLE AS fall
FROM idx a JOIN idx b ON b.rn BETWEEN a.rn + 1 AND a.rn + 20
"""
CTES["ixdd"] = (
    "SELECT rn, " + ", ".join(f"min(CASE WHEN k <= {h} THEN fall END) AS dd{h}" for h in H) + " FROM ixpath GROUP BY rn"
)
IXO = [
    n for h in H for n in (
        f"qqq_forward_return_{h}d", f"qqq_mfe_pct_{h}d", f"qqq_mae_pct_{h}d", f"qqq_new_20d_high_within_window_{h}d",
        f"qqq_max_drawdown_pct_{h}d", f"qqq_ema20_lost_within_window_{h}d", f"qqq_ema20_reclaimed_within_window_{h}d",
    )
]
CTES["ixo"] = (
    "SELECT index_id, date, " + ", ".join(
        f"(end{h} / close - 1::DOUBLE) * 100::DOUBLE AS qqq_forward_return_{h}d, "
        f"CASE WHEN n{h} = {h} THEN (top{h} / close - 1::DOUBLE) * 100::DOUBLE END AS qqq_mfe_pct_{h}d, "
        f"CASE WHEN n{h} = {h} THEN (bot{h} / close - 1::DOUBLE) * 100::DOUBLE END AS qqq_mae_pct_{h}d, "
        f"CASE WHEN n{h} = {h} THEN new{h}::DOUBLE END AS qqq_new_20d_high_within_window_{h}d, "
        f"CASE WHEN n{h} = {h} THEN dd{h} END AS qqq_max_drawdown_pct_{h}d, "
        f"CASE WHEN n{h} = {h} THEN (close_above_ema20 AND allup{h} = 0)::INT::DOUBLE END AS qqq_ema20_lost_within_window_{h}d, "
        f"CASE WHEN n{h} = {h} THEN (NOT close_above_ema20 AND anyup{h} = 1)::INT::DOUBLE END AS qqq_ema20_reclaimed_within_window_{h}d"
        for h in H
    )
    + " FROM ixo2 LEFT JOIN ixdd ON ixo2.rn = ixdd.rn"
)

# --- breadth
CTES["daily"] = (
    "SELECT date, count(*) AS eligible_count, "
    + ", ".join(f"avg(coalesce(rs_percentile_1m >= {b}, false)::INT) AS breadth_rs{b}plus_share" for b in (80, 90, 95))
    + " FROM features WHERE eligible GROUP BY date"
)
FUTURE = [f"future_rs{b}plus_share_{h}d" for h in H for b in (80, 90, 95)]
CTES["future"] = (
    "SELECT *, " + ", ".join(
        f"lead(breadth_rs{b}plus_share, {h}) OVER (ORDER BY date) AS future_rs{b}plus_share_{h}d"
        for h in H for b in (80, 90, 95))
    + " FROM daily"
)
CTES["frows"] = (
    "SELECT f.*, " + ", ".join(f"o.{c}" for c in ALL_OUTCOMES)
    + " FROM features f LEFT JOIN outcomes o ON f.date = o.date AND f.ticker = o.ticker WHERE eligible"
)
COHORT = [
    n for h in H for n in (
        f"median_forward_return_{h}d", f"median_mfe_pct_{h}d", f"median_mae_pct_{h}d", f"share_mfe_ge_5pct_{h}d",
        f"share_mfe_ge_10pct_{h}d", f"share_mfe_ge_2atr_{h}d", f"share_mfe_ge_3atr_{h}d", f"share_positive_{h}d",
        f"cohort_size_{h}d",
    )
]
CTES["cohort"] = (
    "SELECT date, " + ", ".join(
        f"quantile_cont(forward_return_close_{h}d, 0.5) AS median_forward_return_{h}d, "
        f"quantile_cont(mfe_pct_{h}d, 0.5) AS median_mfe_pct_{h}d, quantile_cont(mae_pct_{h}d, 0.5) AS median_mae_pct_{h}d, "
        f"avg(reached_plus_5pct_{h}d) AS share_mfe_ge_5pct_{h}d, avg(reached_plus_10pct_{h}d) AS share_mfe_ge_10pct_{h}d, "
        f"avg(reached_2atr_{h}d) AS share_mfe_ge_2atr_{h}d, avg(reached_3atr_{h}d) AS share_mfe_ge_3atr_{h}d, "
        f"avg(coalesce(forward_return_close_{h}d > 0, false)::INT) AS share_positive_{h}d, "
        f"count(forward_return_close_{h}d) AS cohort_size_{h}d" for h in H)
    + " FROM frows GROUP BY date"
)
CTES["breadth"] = (
    "SELECT f.*, " + ", ".join(f"c.{n}" for n in COHORT) + " FROM future f JOIN cohort c ON f.date = c.date"
)

_RECURSIVE = {"ema", "mp0", "mbe", "ixe"}


def _uses(sql: str) -> set[str]:
    import re

    return {m for m in re.findall(r"(?:FROM|JOIN)\s+\(?\s*([a-z0-9_]+)", sql) if m in CTES} | {
        m for m in re.findall(r",\s+([a-z0-9_]+)\s+(?:WHERE|GROUP|ORDER|$)", sql) if m in CTES
    }


def query(select: str, **other: str) -> str:
    """Prefix a SELECT with the expressions it needs, in definition order; `other` ones replace those of their name."""
    ctes = CTES | other
    need, todo = set(), _uses(select)
    while todo:
        name = todo.pop()
        if name not in need:
            need.add(name)
            todo |= _uses(ctes[name]) - need
    parts = [f"{n} AS ({ctes[n].strip()})" for n in ctes if n in need]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + select
