import numpy as np
import pandas as pd
import pytest

from barlattice.config import OutcomeConfig
from barlattice.operators.outcomes import add_outcomes, outcome_columns, stock_outcomes

from conftest import ohlcv


def series(close, high, low, atr=2.0):
    n = len(close)
    atr = [atr] * n if np.isscalar(atr) else atr
    return pd.DataFrame({
        "date": pd.bdate_range("2023-01-02", periods=n), "ticker": "AAA", "close": np.array(close, float),
        "high": np.array(high, float), "low": np.array(low, float), "atr14": np.array(atr, float),
        "is_new_20d_high": False,
    })


@pytest.fixture
def simple():
    return series([100] * 10, [100, 108, 103, 96, 112, 101, 101, 101, 101, 101], [100, 99, 97, 94, 99, 99, 99, 99, 99, 99])


def run(frame, collected, pdf, *horizons, conf=None):
    conf = conf or OutcomeConfig(horizons=horizons)
    return collected(add_outcomes(frame(pdf), conf), "ticker", "date")


def test_extremes_and_multiples(frame, collected, simple):
    out = run(frame, collected, simple, 4)
    r = out.iloc[0]
    assert r.forward_return_close_4d == pytest.approx(0)
    assert r.mfe_pct_4d == pytest.approx(12) and r.mae_pct_4d == pytest.approx(-6)
    assert r.mfe_atr_multiple_4d == pytest.approx(6) and r.mae_atr_multiple_4d == pytest.approx(-3)
    assert r.reached_2atr_4d == 1 and r.reached_3atr_4d == 1


def test_incomplete_windows_are_null(frame, collected, simple):
    out = run(frame, collected, simple, 5)
    tail = out.iloc[5:][[c for c in out.columns if c.endswith("_5d")]]
    assert tail.isna().all().all()


def test_race_order_and_ties(frame, collected):
    up_first = run(frame, collected, series([100] * 4, [100, 106, 100, 100], [100, 99, 94, 99]), 3).iloc[0]
    assert up_first.reached_plus_5_before_minus_5_3d == 1 and up_first.reached_plus_5_before_minus_5_tie_3d == 0
    down_first = run(frame, collected, series([100] * 4, [100, 100, 106, 100], [100, 94, 99, 99]), 3).iloc[0]
    assert down_first.reached_plus_5_before_minus_5_3d == 0
    tie = run(frame, collected, series([100] * 4, [100, 106, 100, 100], [100, 94, 99, 99]), 3).iloc[0]
    assert tie.reached_plus_5_before_minus_5_3d == 0 and tie.reached_plus_5_before_minus_5_tie_3d == 1
    never = run(frame, collected, series([100] * 4, [100] * 4, [99] * 4), 3).iloc[0]
    assert never.reached_plus_5_before_minus_5_3d == 0 and never.reached_plus_5_before_minus_5_tie_3d == 0


def test_asymmetric_race(frame, collected):
    r = run(frame, collected, series([100] * 4, [100, 106, 111, 100], [100, 99, 99, 94]), 3).iloc[0]
    assert r.reached_plus_10_before_minus_5_3d == 1
    with pytest.raises(ValueError):
        OutcomeConfig(extra_races=((7.0, 5.0),)).races()


def test_missing_or_zero_atr_counts_as_not_reached(frame, collected):
    for atr in (np.nan, 0.0):
        r = run(frame, collected, series([100] * 4, [100, 120, 120, 120], [99] * 4, [atr, 2, 2, 2]), 3).iloc[0]
        assert r.reached_2atr_3d == 0 and np.isnan(r.mfe_atr_multiple_3d)


def test_only_the_signal_days_atr_matters(frame, collected):
    a = run(frame, collected, series([100] * 5, [104] * 5, [99] * 5, [2, 2, 2, 2, 2]), 3).iloc[0]
    b = run(frame, collected, series([100] * 5, [104] * 5, [99] * 5, [2, 99, 99, 99, 99]), 3).iloc[0]
    assert a.mfe_atr_multiple_3d == b.mfe_atr_multiple_3d == pytest.approx(2)


def test_missing_forward_high_makes_the_window_incomplete(frame, collected):
    r = run(frame, collected, series([100] * 4, [100, 106, np.nan, 100], [99] * 4), 3).iloc[0]
    assert np.isnan(r.mfe_pct_3d) and np.isnan(r.reached_plus_5_before_minus_5_3d)
    assert r.forward_return_close_3d == pytest.approx(0)


def brute(pdf, h, conf):
    """Row-by-row restatement of the definitions."""
    rows = []
    for _, g in pdf.groupby("ticker"):
        g = g.reset_index(drop=True)
        new = [i >= 20 and g.high[i] > g.high[i - 20:i].max() for i in range(len(g))]
        for i in range(len(g)):
            w = g.iloc[i + 1:i + 1 + h]
            c, a, done = g.close[i], g.atr14[i], len(w) == h
            r = {"ticker": g.ticker[i], "date": g.date[i]}
            r[f"mfe_pct_{h}d"] = (w.high.max() / c - 1) * 100 if done else np.nan
            r[f"mae_pct_{h}d"] = (w.low.min() / c - 1) * 100 if done else np.nan
            r[f"new_20d_high_within_window_{h}d"] = float(any(new[i + 1:i + 1 + h])) if done else np.nan
            for up, down in conf.races():
                hits_u = [k for k, x in enumerate(w.high) if (x / c - 1) * 100 >= up] or [h]
                hits_d = [k for k, x in enumerate(w.low) if (x / c - 1) * 100 <= -down] or [h]
                r[conf.race_name(up, down, h)] = float(hits_u[0] < hits_d[0]) if done else np.nan
                r[conf.race_name(up, down, h, True)] = float(hits_u[0] == hits_d[0] < h) if done else np.nan
            rows.append(r)
    return pd.DataFrame(rows)


def test_random_walks_against_brute_force(frame, collected):
    pdf = ohlcv(60, tickers=("A", "B", "C")).assign(atr14=1.5)
    conf = OutcomeConfig()
    out = collected(stock_outcomes(frame(pdf), conf), "ticker", "date")
    assert list(out.columns) == ["date", "ticker", *outcome_columns(conf)]
    for h in conf.horizons:
        want = brute(pdf, h, conf)
        for c in want.columns[2:]:
            np.testing.assert_allclose(out[c], want[c], atol=1e-9, err_msg=c)


def test_required_columns(frame, simple):
    with pytest.raises(ValueError, match="atr14"):
        stock_outcomes(frame(simple).drop("atr14"))


@pytest.mark.parametrize("horizons", [(5, 20), (1, 7, 16, 60)])
def test_long_way_agrees(frame, collected, monkeypatch, horizons):
    """Doubling and lists give what offset columns give, with missing prices and incomplete ends."""
    from barlattice.operators import outcomes

    pdf = ohlcv(120, seed=11).assign(atr14=2.0)
    pdf.loc[pdf.index % 17 == 3, "high"] = np.nan
    pdf.loc[pdf.index % 19 == 5, "low"] = np.nan
    pdf.loc[40, "close"] = 0.0
    pdf.loc[41, "close"] = -3.0
    conf = OutcomeConfig(horizons=horizons)
    short = collected(stock_outcomes(frame(pdf), conf), "ticker", "date")
    hits = collected(outcomes.add_first_hits(frame(pdf), conf, max(horizons)), "ticker", "date")
    monkeypatch.setattr(outcomes, "SHORT", 0)
    pd.testing.assert_frame_equal(short, collected(stock_outcomes(frame(pdf), conf), "ticker", "date"))
    pd.testing.assert_frame_equal(hits, collected(outcomes.add_first_hits(frame(pdf), conf, max(horizons)), "ticker", "date"))


def test_year_needs_no_column_a_row(frame):
    df = stock_outcomes(frame(ohlcv(30, seed=2).assign(atr14=2.0)), OutcomeConfig(horizons=(252,)))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "_h252" not in plan and plan.count("lead(") < 60
