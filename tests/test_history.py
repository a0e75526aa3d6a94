import numpy as np
import pandas as pd
import pytest

from barlattice.config import HistoryConfig
from barlattice.operators.classify import candidate_state, check_lookback, check_single_year, is_resetting
from barlattice.operators.history import add_prior_extension_history


def make(n, seed=5, tickers=("A", "B")):
    rng = np.random.default_rng(seed)
    out = []
    for t in tickers:
        ext = np.round(rng.normal(3, 4, n), 1)
        ext[rng.random(n) < 0.15] = np.nan
        out.append(pd.DataFrame({
            "date": pd.bdate_range("2023-01-02", periods=n), "ticker": t, "atr_extension": ext,
            "distance_ema10_pct": rng.normal(1, 3, n), "distance_ema20_pct": rng.normal(2, 3, n),
        }))
    return pd.concat(out, ignore_index=True)


def brute(g, w):
    ext, d10 = g.atr_extension.to_numpy(), g.distance_ema10_pct.to_numpy()
    rows = []
    for i in range(len(g)):
        lo = max(0, i - w)
        past = ext[lo:i]
        if past.size == 0 or np.isnan(past).all():
            rows.append((np.nan, np.nan, 0, np.nan, np.nan))
            continue
        p = lo + int(np.nanargmax(past))
        rows.append((ext[p], float(i - p), int((~np.isnan(past)).sum()), ext[i] - ext[p], np.nanmin(d10[p + 1:i + 1])))
    return pd.DataFrame(rows, columns=["peak", "days", "n", "dd", "m10"])


def test_against_brute_force(frame, collected):
    pdf = make(100)
    out = collected(add_prior_extension_history(frame(pdf)), "ticker", "date")
    want = pd.concat([brute(g.reset_index(drop=True), 60) for _, g in pdf.groupby("ticker")], ignore_index=True)
    np.testing.assert_allclose(out.atr_extension_peak, want.peak)
    np.testing.assert_allclose(out.max_atr_extension_prior_60d, want.peak)
    np.testing.assert_allclose(out.days_since_atr_extension_peak, want.days)
    assert out.n_valid_days_prior_peak_window.tolist() == want.n.tolist()
    np.testing.assert_allclose(out.atr_extension_drawdown_from_peak, want.dd)
    np.testing.assert_allclose(out.min_distance_ema10_pct_since_peak, want.m10)
    np.testing.assert_allclose(out.touched_ema10_since_peak, np.where(want.m10.isna(), np.nan, want.m10 <= 0))
    w20 = pdf.groupby("ticker").atr_extension.transform(lambda s: s.shift(1).rolling(20, min_periods=1).max())
    np.testing.assert_allclose(out.max_atr_extension_prior_20d, w20)


@pytest.mark.parametrize("w", [61, 64, 252])
def test_long_windows(frame, collected, w):
    pdf = make(420)
    df = add_prior_extension_history(frame(pdf), HistoryConfig(windows=(20, w), peak_window=w))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "_d10_" not in plan and plan.count("lag(") + plan.count("lead(") < 120
    out = collected(df, "ticker", "date")
    want = pd.concat([brute(g.reset_index(drop=True), w) for _, g in pdf.groupby("ticker")], ignore_index=True)
    np.testing.assert_allclose(out.atr_extension_peak, want.peak)
    np.testing.assert_allclose(out[f"max_atr_extension_prior_{w}d"], want.peak)
    np.testing.assert_allclose(out.days_since_atr_extension_peak, want.days)
    assert out.n_valid_days_prior_peak_window.tolist() == want.n.tolist()
    np.testing.assert_allclose(out.min_distance_ema10_pct_since_peak, want.m10)


def test_both_ways_agree(frame, collected, monkeypatch):
    from barlattice.operators import history

    pdf = make(150, seed=9)
    pdf.loc[::7, "distance_ema20_pct"] = np.nan
    short = collected(add_prior_extension_history(frame(pdf)), "ticker", "date")
    monkeypatch.setattr(history, "SHORT", 0)
    pd.testing.assert_frame_equal(short, collected(add_prior_extension_history(frame(pdf)), "ticker", "date")[list(short.columns)])


def test_first_of_equal_peaks_wins(frame, collected):
    ext = [1, 9, 2, 9, 3, 0]
    pdf = make(6, tickers=("A",)).assign(atr_extension=[float(x) for x in ext])
    out = collected(add_prior_extension_history(frame(pdf)), "date")
    assert out.days_since_atr_extension_peak.tolist()[1:] == [1, 1, 2, 3, 4]


def test_peak_window_must_be_a_window():
    with pytest.raises(ValueError):
        HistoryConfig(windows=(20,), peak_window=60)


def test_states(spark):
    rows = [
        ("a", 8.0, None, -1.0, 1.0), ("b", 3.9, 8.0, 0.0, 1.0), ("c", 4.0, 8.0, -1.0, -1.0), ("d", 3.9, 7.9, -1.0, -1.0),
        ("e", None, 9.0, -1.0, -1.0), ("f", 1.0, None, -1.0, -1.0), ("g", 1.0, 9.0, 0.1, 0.0), ("h", 9.0, 9.0, -1.0, -1.0),
    ]
    df = spark.createDataFrame(
        rows, "id string, atr_extension double, atr_extension_peak double, distance_ema10_pct double, distance_ema20_pct double")
    out = {r["id"]: (r["s10"], r["s20"], r["x"]) for r in df.select(
        "id", candidate_state("10").alias("s10"), candidate_state("20").alias("s20"), is_resetting("10").alias("x")).collect()}
    assert out["a"][:2] == ("Extended", "Extended")
    assert out["b"] == ("Resetting", "Normal", True)
    assert out["c"][0] == "Normal" and out["d"][0] == "Normal" and out["f"][0] == "Normal"
    assert out["e"] == (None, None, False)
    assert out["g"][:2] == ("Normal", "Resetting") and out["h"][0] == "Extended"
    with pytest.raises(ValueError):
        candidate_state("15")


def test_range_guards():
    from datetime import date

    assert check_single_year(date(2024, 1, 1), date(2024, 12, 31)) == 2024
    assert check_lookback(date(2023, 1, 1), date(2024, 12, 31)) == 2024
    for bad in ((date(2024, 1, 1), date(2024, 5, 1)),):
        with pytest.raises(ValueError):
            check_lookback(*bad)
    with pytest.raises(ValueError):
        check_single_year(date(2023, 1, 1), date(2024, 1, 1))
