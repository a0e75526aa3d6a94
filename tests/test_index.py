from datetime import date

import numpy as np
import pandas as pd
import pytest

from barlattice.config import IndexConfig
from barlattice.operators import index_health as ih

from conftest import ohlcv

CONF = IndexConfig(min_components=2)
DAYS = [date(2024, 1, d) for d in (2, 3, 4)]


def members(spark, rows):
    return spark.createDataFrame([("QQQ", d, t, 0.5) for d, t in rows],
                                 "index_id string, date date, constituent_ticker string, weight double")


def dates(spark, days):
    return spark.createDataFrame([(d,) for d in days], "date date")


def snaps(spark, days):
    return spark.createDataFrame([("QQQ", d) for d in days], "index_id string, date date")


def test_missing_day_is_a_hard_stop(spark):
    m = members(spark, [(DAYS[0], "A"), (DAYS[0], "B")])
    with pytest.raises(ih.MembershipUnavailable, match="2024-01-03"):
        ih.checked_members(dates(spark, DAYS[:2]), snaps(spark, DAYS[:1]), m, CONF)


def test_thin_day_is_dropped_and_nothing_left_raises(spark):
    m = members(spark, [(DAYS[0], "A"), (DAYS[0], "B"), (DAYS[1], "A")])
    out = ih.checked_members(dates(spark, DAYS[:2]), snaps(spark, DAYS[:2]), m, CONF)
    assert {r["date"] for r in out.collect()} == {DAYS[0]}
    with pytest.raises(ih.MembershipUnavailable):
        ih.checked_members(dates(spark, DAYS[:2]), snaps(spark, DAYS[:2]), m, IndexConfig(min_components=9))


def test_breadth_by_hand_with_member_swap(spark, frame, collected):
    pdf = pd.DataFrame({
        "date": pd.to_datetime(DAYS * 3), "ticker": ["A"] * 3 + ["B"] * 3 + ["C"] * 3,
        "close": [10, 11, 12, 10, 9, 8, 5, 5, 6.0], "high": 20.0, "low": 1.0,
    })
    m = members(spark, [(d, t) for d in DAYS[:2] for t in "AB"] + [(DAYS[2], t) for t in ("A", "C", "GONE")])
    out = collected(ih.member_breadth(m, ih.member_panel(frame(pdf), CONF), CONF), "date")
    assert out.component_count.tolist() == [2, 2, 3]  # a member without bars still counts
    assert out.advancers.tolist() == [0, 1, 2] and out.decliners.tolist() == [0, 1, 0]
    assert out.rana.tolist() == [0.0, 0.0, 1000.0]
    assert out.pct_above_sma5.isna().all()
    assert out.pct_above_ema10.tolist() == [0.0, 50.0, 100.0]
    assert ih.component_counts(m).count() == 3


def test_oscillator_sum_and_z(frame, collected):
    rng = np.random.default_rng(8)
    n = 250
    pdf = pd.DataFrame({"index_id": "QQQ", "date": pd.bdate_range("2023-01-02", periods=n), "rana": rng.normal(0, 300, n)})
    out = collected(ih.add_oscillators(frame(pdf), CONF), "date")
    mco = pdf.rana.ewm(span=19, adjust=False).mean() - pdf.rana.ewm(span=39, adjust=False).mean()
    np.testing.assert_allclose(out.mco_raw, mco, atol=1e-9)
    np.testing.assert_allclose(out.mcsi_raw, mco.cumsum(), atol=1e-9)
    z = (mco - mco.rolling(200, min_periods=80).mean()) / mco.rolling(200, min_periods=80).std()
    np.testing.assert_allclose(out.mco_z, z, atol=1e-9)
    assert out.mco_z[:79].isna().all()
    s = mco.cumsum()
    zs = (s - s.rolling(200, min_periods=80).mean()) / s.rolling(200, min_periods=80).std()
    np.testing.assert_allclose(out.mcsi_z_minus_sma10, zs - zs.rolling(10, min_periods=10).mean(), atol=1e-8)
    np.testing.assert_allclose(out.mco_raw_chg_3d, mco.diff(3), atol=1e-9)


def test_series_of_two_indexes_do_not_mix(frame, collected):
    a = pd.DataFrame({"index_id": "X", "date": pd.bdate_range("2023-01-02", periods=30), "rana": np.arange(30.0)})
    both = pd.concat([a, a.assign(index_id="Y", rana=-a.rana)])
    out = collected(ih.add_oscillators(frame(both), CONF), "index_id", "date")
    x, y = out[out.index_id == "X"].mcsi_raw.to_numpy(), out[out.index_id == "Y"].mcsi_raw.to_numpy()
    np.testing.assert_allclose(x, -y)


def test_structure_flags_and_drawdown(frame, collected):
    pdf = ohlcv(80, tickers=("QQQ",)).rename(columns={"ticker": "index_id"})
    s = ih.price_structure(frame(pdf))
    out = collected(s, "date")
    ema20 = pdf.close.ewm(span=20, adjust=False).mean()
    assert (out.close_above_ema20 == (pdf.close > ema20)).all()
    assert not out.close_above_sma200.any()
    res = collected(ih.index_outcomes(s, CONF), "date")
    for i in (0, 13, 40):
        w = pdf.iloc[i + 1:i + 11]
        peak = np.maximum.accumulate(np.r_[pdf.close[i], w.high])[1:]
        assert res.qqq_max_drawdown_pct_10d[i] == pytest.approx(((w.low / peak - 1) * 100).min())
        above = (pdf.close > ema20)
        lost = above[i] and (~above[i + 1:i + 11]).any()
        back = (not above[i]) and above[i + 1:i + 11].any()
        assert res.qqq_ema20_lost_within_window_10d[i] == float(lost)
        assert res.qqq_ema20_reclaimed_within_window_10d[i] == float(back)
    assert res.qqq_max_drawdown_pct_10d[70:].isna().all()


def test_distinct_counts_by_bitmaps(spark):
    from pyspark.sql import functions as F

    from barlattice.operators.distinct import bitmaps, counted, merged, numbered

    rows = spark.range(60_000).select((F.col("id") % 40_000).cast("string").alias("who"), (F.col("id") % 3).alias("g"), (F.col("id") % 12).alias("fine"))
    rows = rows.unionByName(spark.createDataFrame([(None, 0, 0)], "who string, g long, fine long"))
    numbers = numbered(rows, "who")
    assert numbers.count() == numbers.select("number").distinct().count() == 40_000
    fine = bitmaps(rows.join(numbers, "who"), ["g", "fine"], times=F.lit(1))
    want = {r["g"]: (r["n"], r["k"]) for r in rows.groupBy("g").agg(F.countDistinct("who").alias("n"), F.count("who").alias("k")).collect()}
    assert {r["g"]: r["n"] for r in counted(merged(fine, ["g"]), ["g"]).collect()} == {g: n for g, (n, _) in want.items()}
    assert sum(r["times"] for r in counted(fine, ["g", "fine"], sums=("times",)).collect()) == 60_000


def test_index_breadth_has_no_distinct_aggregate(spark):
    from barlattice.operators.index_health import component_counts

    members = spark.createDataFrame([("I", 1, "A"), ("I", 1, "A"), ("I", 1, "B"), ("I", 2, "A")], "index_id string, date int, constituent_ticker string")
    counts = component_counts(members)
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "count(distinct" not in plan.lower() and "Expand" not in plan and "bitmap_construct_agg" in plan
    assert {(r["date"], r["component_count"]) for r in counts.collect()} == {(1, 2), (2, 1)}
