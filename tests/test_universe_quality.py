from datetime import date

import numpy as np
import pandas as pd
import pytest

from barlattice.operators import quality, universe
from barlattice.config import UniverseConfig


def snapshots(spark, rows):
    return spark.createDataFrame(rows, "date date, ticker string, type string, primary_exchange string, active boolean")


def test_listing_is_point_in_time(spark):
    d1, d2 = date(2024, 1, 2), date(2024, 1, 3)
    df = snapshots(spark, [
        (d1, "OLD", "CS", "XNYS", False), (d1, "KEEP", "CS", "XNAS", True), (d2, "KEEP", "CS", "XNAS", True),
        (d1, "PINK", "CS", "otc markets", True), (d1, "FUNDX", "ETF", "XNAS", True), (d1, "KEEP", "CS", "XNAS", True),
        (d1, "NOEX", "CS", None, True),
    ])
    got = {(r["date"], r["ticker"]) for r in universe.asset_type_ok(df).collect()}
    assert got == {(d1, "OLD"), (d1, "KEEP"), (d2, "KEEP"), (d1, "NOEX")}
    assert universe.asset_type_ok(df).count() == 4


def build(spark, frame, factor=1.0, unadjusted=10.0, shares=2e8):
    n = 25
    days = pd.bdate_range("2024-01-01", periods=n)
    pdf = pd.DataFrame({"date": days, "ticker": "AAA", "close": 10.0 * factor, "high": 10.6 * factor, "low": 10.0 * factor})
    un = pd.DataFrame({"date": days, "ticker": "AAA", "close_unadjusted": unadjusted})
    snap = snapshots(spark, [(d.date(), "AAA", "CS", "XNAS", True) for d in days])
    sh = spark.createDataFrame([("AAA", date(2024, 1, 1), shares)], "ticker string, bucket_month date, shares double")
    return universe.market_universe(frame(pdf), frame(un), snap, sh)


def test_gates(spark, frame, collected):
    out = collected(build(spark, frame), "date")
    assert out.eligible.tolist() == [i >= 19 and d.month == 1 for i, d in enumerate(out.date)]
    assert out.market_cap[:19].isna().all()  # only candidates have a cap
    assert out.market_cap[19] == pytest.approx(2e9)
    assert out.market_cap[24] != out.market_cap[24]  # February has no shares


def test_cap_uses_the_unadjusted_close(spark, frame, collected):
    a = collected(build(spark, frame), "date")
    b = collected(build(spark, frame, factor=1000.0), "date")
    assert (a.eligible == b.eligible).all()
    np.testing.assert_allclose(a.market_cap, b.market_cap)
    np.testing.assert_allclose(a.adr20, b.adr20)


def caps(spark, rows):
    return spark.createDataFrame(
        rows, "date date, ticker string, close double, high double, low double, market_cap double, eligible boolean")


def test_cap_sensitivity(spark):
    rows = []
    for m, stable, wild, far in ((1, 1.0e9, 1.0e9, 5e9), (2, 1.05e9, 4.0e9, 50e9), (3, 1.1e9, 1.0e9, 5e9)):
        for t, cap in (("STABLE", stable), ("WILD", wild), ("FAR", far)):
            rows.append((date(2024, m, 5), t, 1.0, 1.0, 1.0, cap, True))
    rows.append((date(2024, 1, 8), "NOCAP", 1.0, 1.0, 1.0, None, False))
    out = {(r["metric"], r["key"]): r["value"] for r in quality.cap_sensitivity(caps(spark, rows)).collect()}
    assert out[("near_threshold_row_count", None)] == 5
    assert out[("near_threshold_ticker_count", None)] == 2
    assert out[("near_threshold_volatile_ticker_count", None)] == 1
    assert ("near_threshold_volatile_ticker_example", "WILD") in out


def test_universe_metrics(spark):
    rows = [
        (date(2023, 1, 5), "A", 2e6, 1.0, 1.0, 2e9, True), (date(2023, 1, 5), "B", 1.0, None, 1.0, None, False),
        (date(2024, 1, 5), "A", 1.0, 1.0, 1.0, 2e9, True), (date(2024, 1, 5), "C", 1.0, 1.0, 1.0, 2e9, True),
    ]
    out = {(r["metric"], r["key"]): r["value"] for r in quality.universe_quality(caps(spark, rows)).collect()}
    assert out[("trading_days", None)] == 2
    assert out[("tickers_per_year", "2023")] == 2 and out[("tickers_per_year", "2024")] == 2
    assert out[("median_eligible_universe_size", None)] == 1.5
    assert out[("missing_market_cap_pct", None)] == 25 and out[("missing_ohlc_pct", None)] == 25
    assert out[("implausible_price_row_count", None)] == 1 and out[("implausible_price_ticker_count", None)] == 1
    assert out[("warning_small_universe", None)] == 1


def test_tie_diagnostics(spark):
    from barlattice.config import OutcomeConfig

    conf = OutcomeConfig(horizons=(5,), pct_moves=(5.0,), extra_races=())
    df = spark.createDataFrame([(0.0, 1.0), (1.0, 0.0), (None, None)],
                               "reached_plus_5_before_minus_5_5d double, reached_plus_5_before_minus_5_tie_5d double")
    out = {r["tie_column"]: r for r in quality.tie_diagnostics(df, conf).collect()}
    r = out["reached_plus_5_before_minus_5_tie_5d"]
    assert (r["tie_count"], r["window_complete_count"], r["tie_pct"]) == (1, 2, 50.0)
    assert out["total"]["tie_count"] == 1


def test_defaults_are_the_documented_gates():
    c = UniverseConfig()
    assert (c.adr_min_pct, c.market_cap_min, c.adr_window) == (4.0, 1e9, 20)
