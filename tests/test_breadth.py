import numpy as np
import pandas as pd

from barlattice.config import BreadthConfig
from barlattice.operators import breadth
from barlattice.session import stage

D = pd.to_datetime(["2024-01-01", "2024-01-02", "2024-01-03"])


def test_same_day_shares_and_missing_rs_is_a_miss(frame, collected):
    pdf = pd.DataFrame({
        "date": [D[0]] * 4 + [D[1]] * 2, "ticker": list("ABCD") + list("AB"),
        "eligible": [True, True, True, False, True, True], "rs_percentile_1m": [95.0, 81.0, np.nan, 99.0, 10.0, 90.0],
    })
    out = collected(breadth.daily_rs_breadth(frame(pdf)), "date")
    assert out.eligible_count.tolist() == [3, 2]
    np.testing.assert_allclose(out.breadth_rs80plus_share, [2 / 3, 1 / 2])
    np.testing.assert_allclose(out.breadth_rs95plus_share, [1 / 3, 0])


def test_future_share_is_that_days_own_universe(frame, collected):
    """Membership swaps at D+2: the share there is of the tickers eligible then."""
    rows = []
    for i, d in enumerate(pd.bdate_range("2024-01-01", periods=4)):
        for t in "ABCD":
            early, late = t in "AB", t in "CD"
            rows.append((d, t, early if i < 2 else late, 95.0 if t in "AC" else 10.0 if i < 3 else 96.0))
    pdf = pd.DataFrame(rows, columns=["date", "ticker", "eligible", "rs_percentile_1m"])
    conf = BreadthConfig(horizons=(2,), rs_buckets=(90,))
    out = collected(breadth.future_breadth(breadth.daily_rs_breadth(frame(pdf), conf), conf), "date")
    assert out.future_rs90plus_share_2d.tolist()[:2] == [0.5, 1.0]
    assert out.future_rs90plus_share_2d[2:].isna().all()


def test_shift_counts_only_dates_with_an_eligible_row(frame, collected):
    pdf = pd.DataFrame({"date": D, "ticker": "A", "eligible": [True, False, True], "rs_percentile_1m": [10.0, 99.0, 95.0]})
    conf = BreadthConfig(horizons=(1,), rs_buckets=(90,))
    out = collected(breadth.future_breadth(breadth.daily_rs_breadth(frame(pdf), conf), conf), "date")
    assert len(out) == 2 and out.future_rs90plus_share_1d[0] == 1.0


def test_cohort_null_rules(frame, collected):
    base = dict(mfe_pct_5d=[4.0, np.nan, 50.0], mae_pct_5d=[-1.0, np.nan, -9.0], forward_return_close_5d=[2.0, np.nan, 9.0],
                reached_plus_5pct_5d=[0.0, np.nan, 1.0], reached_plus_10pct_5d=[0.0, np.nan, 1.0],
                reached_2atr_5d=[1.0, np.nan, 1.0], reached_3atr_5d=[0.0, np.nan, 1.0])
    pdf = pd.DataFrame({"date": D[0], "ticker": list("ABC"), "eligible": [True, True, False], **base})
    out = breadth.cohort_performance(stage(frame(pdf)), BreadthConfig(horizons=(5,))).toPandas().iloc[0]
    assert out.cohort_size_5d == 1
    assert out.median_mfe_pct_5d == 4.0
    assert out.share_mfe_ge_2atr_5d == 1.0  # missing skipped
    assert out.share_positive_5d == 0.5  # missing counts as not positive
