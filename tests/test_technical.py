import numpy as np
import pandas as pd
import pytest

from barlattice.operators import technical as t
from barlattice.operators.ema import add_emas

from conftest import ohlcv


def one(values, ticker="AAA", start="2023-01-02", **extra):
    n = len(values)
    base = {"date": pd.bdate_range(start, periods=n), "ticker": ticker, "close": np.array(values, dtype=float)}
    base["high"] = extra.get("high", base["close"])
    base["low"] = extra.get("low", base["close"])
    return pd.DataFrame(base)


def test_returns_count_own_rows(frame, collected):
    pdf = ohlcv(30)
    out = collected(t.add_returns(frame(pdf)), "ticker", "date")
    for name, n in (("return_1d", 1), ("return_5d", 5), ("return_21d", 21)):
        want = pdf.groupby("ticker").close.pct_change(n, fill_method=None) * 100
        np.testing.assert_allclose(out[name], want, atol=1e-9)
    assert out["return_3m"].isna().all()


def test_true_range_by_hand(frame, collected):
    pdf = one([10, 12, 9], high=[11, 13, 12.5], low=[9, 11.5, 8])
    out = collected(t.add_true_range(frame(pdf)), "date")
    assert out.true_range.tolist() == [2.0, 3.0, 4.5]


def test_atr_is_simple_mean_and_forgets(frame, collected):
    n = 30
    high = np.full(n, 101.0)
    high[2] = 150.0
    pdf = one(np.full(n, 100.0), high=high, low=np.full(n, 99.0))
    out = collected(t.add_atr(frame(pdf)), "date")
    assert out.atr14[:13].isna().all()
    assert out.atr14[13] == pytest.approx((13 * 2 + 51) / 14)
    assert out.atr14[16] == pytest.approx(2.0)
    assert out.atr_pct[20] == pytest.approx(2.0)


def test_adr_constant_range(frame, collected):
    pdf = one(np.full(25, 100.0), high=np.full(25, 105.0), low=np.full(25, 100.0))
    out = collected(t.add_adr(frame(pdf)), "date")
    assert out.adr20[:19].isna().all()
    np.testing.assert_allclose(out.adr20[19:], 5.0)


def test_ema_equals_pandas_even_across_arrow_batches(spark, frame, collected):
    pdf = ohlcv(90, tickers=("A", "B", "C", "D", "E"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        out = collected(add_emas(frame(pdf), [("e10", "close", 10), ("e39", "close", 39)]), "ticker", "date")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for name, span in (("e10", 10), ("e39", 39)):
        want = pdf.groupby("ticker").close.transform(lambda s: s.ewm(span=span, adjust=False).mean())
        np.testing.assert_allclose(out[name], want, rtol=1e-12)
    assert len(out) == len(pdf)


def test_ema_of_one_long_entity_in_small_batches(spark, frame, collected):
    pdf = ohlcv(120, tickers=("A",))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        out = collected(add_emas(frame(pdf), [("e", "close", 5)]), "date")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    np.testing.assert_allclose(out.e, pdf.close.ewm(span=5, adjust=False).mean(), rtol=1e-12)


def test_ema_null_gaps(frame, collected):
    vals = [np.nan, 1.0, np.nan, np.nan, 4.0, 2.0, np.nan, 3.0]
    pdf = one(vals)
    out = collected(add_emas(frame(pdf), [("e", "close", 3)]), "date")
    want = pd.Series(vals).ewm(span=3, adjust=False).mean()
    np.testing.assert_allclose(out.e, want)


def test_distances_and_slope(frame, collected):
    pdf = ohlcv(70)
    out = collected(t.add_sma50_slope(t.add_moving_averages(frame(pdf))), "ticker", "date")
    sma = pdf.groupby("ticker").close.transform(lambda s: s.rolling(50, min_periods=50).mean())
    ema = pdf.groupby("ticker").close.transform(lambda s: s.ewm(span=10, adjust=False).mean())
    np.testing.assert_allclose(out.sma50, sma, rtol=1e-12)
    np.testing.assert_allclose(out.distance_ema10_pct, (pdf.close - ema) / ema * 100, atol=1e-9)
    lag = sma.groupby(pdf.ticker).shift(5)
    np.testing.assert_allclose(out.sma50_slope_pct, (sma - lag) / lag * 100, atol=1e-9)


def streak(frame, collected, pdf):
    return collected(t.add_sma50_persistence(t.add_sma(frame(pdf), {"sma50": 50})), "ticker", "date")


def test_streak_flat_up_down(frame, collected):
    closes = [100.0] * 50 + [110, 111, 112, 113, 114] + [50, 49, 48, 47]
    out = streak(frame, collected, one(closes))
    assert out.sma50_persistence_days[:49].isna().all()
    # Equal to the average counts as below.
    assert out.sma50_persistence_days[49:].tolist() == [-1, 1, 2, 3, 4, 5, -1, -2, -3, -4]


def test_streak_stops_at_ticker_boundary(frame, collected):
    a = one(np.linspace(10, 20, 60), "AAA")
    b = one(np.linspace(10, 20, 55), "BBB")
    out = streak(frame, collected, pd.concat([a, b]))
    assert out[out.ticker == "AAA"].sma50_persistence_days.iloc[-1] == 11
    assert out[out.ticker == "BBB"].sma50_persistence_days.iloc[-1] == 6


def test_extension_is_null_when_not_finite(spark, collected):
    df = spark.createDataFrame(
        [(10.0, 8.0, 2.0), (10.0, 8.0, 0.0), (10.0, None, 2.0)], "close double, sma50 double, atr_pct double"
    )
    out = t.add_atr_extension(df).collect()
    assert out[0]["atr_extension"] == pytest.approx(12.5)
    assert out[1]["atr_extension"] is None and out[2]["atr_extension"] is None


def test_thrust_matches_pandas(frame, collected):
    pdf = ohlcv(60)
    out = collected(t.add_thrust(frame(pdf)), "ticker", "date")
    r = pdf.groupby("ticker").close.pct_change(fill_method=None) * 100
    for name, (s, l) in {"thrust_1d": (2, 5), "thrust_1w": (5, 15), "thrust_1m": (10, 25)}.items():
        fast = r.groupby(pdf.ticker).transform(lambda x: x.ewm(span=s, adjust=False).mean())
        slow = r.groupby(pdf.ticker).transform(lambda x: x.ewm(span=l, adjust=False).mean())
        np.testing.assert_allclose(out[name], fast - slow, atol=1e-9)


def test_new_high_needs_a_full_lookback(frame, collected):
    high = np.full(25, 10.0)
    high[22] = 11.0
    high[5] = 10.5
    out = collected(t.add_new_high(frame(one(np.full(25, 9.0), high=high, low=np.full(25, 8.0)))), "date")
    assert out.is_new_20d_high.tolist() == [i == 22 for i in range(25)]
