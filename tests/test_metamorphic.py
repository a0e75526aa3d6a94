"""The past must not depend on the future, on scale, on row order or on the number of partitions."""

import numpy as np

from barlattice.operators.technical import add_ticker_features

from conftest import ohlcv

KEY = ["ticker", "date"]


def features(frame, collected, pdf, partitions=None):
    df = frame(pdf.drop(columns=["volume"]))
    if partitions:
        df = df.repartition(partitions, "close")
    return collected(add_ticker_features(df), *KEY)


def same(a, b, cols):
    for c in cols:
        np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), rtol=1e-9, atol=1e-9, err_msg=c)


def numeric(df):
    return [c for c in df.columns if c not in KEY]


def test_changing_the_future_leaves_the_past(frame, collected):
    pdf = ohlcv(90)
    other = pdf.copy()
    late = other.groupby("ticker").cumcount() >= 80
    other.loc[late, ["open", "high", "low", "close"]] *= 3.0
    a, b = features(frame, collected, pdf), features(frame, collected, other)
    early = a.groupby("ticker").cumcount() < 80
    same(a[early], b[early], numeric(a))


def test_cutting_the_future_leaves_the_past(frame, collected):
    pdf = ohlcv(90)
    cut = pdf[pdf.groupby("ticker").cumcount() < 65]
    a, b = features(frame, collected, pdf), features(frame, collected, cut)
    same(a[a.groupby("ticker").cumcount() < 65].reset_index(drop=True), b, numeric(a))


def test_price_scale_cancels_in_ratios(frame, collected):
    pdf = ohlcv(80)
    big = pdf.copy()
    big[["open", "high", "low", "close"]] *= 1024.0
    a, b = features(frame, collected, pdf), features(frame, collected, big)
    levels = {"open", "high", "low", "close", "sma50", "atr14", "ema10", "ema20"}
    same(a, b, [c for c in numeric(a) if c not in levels])


def test_row_order_and_partition_count_do_not_matter(frame, collected):
    pdf = ohlcv(70, tickers=("A", "B", "C"))
    a = features(frame, collected, pdf)
    b = features(frame, collected, pdf.sample(frac=1.0, random_state=1), partitions=7)
    same(a, b, numeric(a))


def test_features_take_one_exchange(frame):
    plan = add_ticker_features(frame(ohlcv(30)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort ") == 1 and plan.count("MapInArrow") == 1
