"""Registered queries against their SQL twins at the smallest scale."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
TABLES = ("lineitem", "supplier")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")

# A cross-section of every operator family; the whole list is checked by the driver.
CHECKED = [
    "panel_bars", "sma50_streak", "thrust", "universe_daily", "features_daily", "top_rs", "outcomes_daily",
    "prior_extension", "candidate_state", "market_breadth_daily", "rs_benchmark_common", "rs_x_atr",
    "repeat_offender_ema20", "candidate_states_ema10", "push_distance_distribution", "pullback_range_comparison",
    "index_health_daily", "index_outcomes_daily", "universe_quality", "cap_sensitivity", "sanity_atr_extension",
    "coverage_gaps", "time_splits", "prior_extension_year", "outcomes_year",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(pdf):
    pdf = pdf[sorted(pdf.columns)].copy()
    for c in pdf.columns:
        if pdf[c].dtype == object or str(pdf[c].dtype).startswith(("datetime", "str")):
            pdf[c] = pdf[c].map(lambda x: str(x)[:10] if hasattr(x, "year") else "" if x is None or x != x else str(x))
        else:
            pdf[c] = pdf[c].astype(float)
    return pdf.sort_values(list(pdf.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, duck, name):
    got = plain(entry_module.queries()[name](spark, SF).toPandas())
    want = plain(duck.execute(entry_module.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    for c in got.columns:
        if got[c].dtype == float and want[c].dtype == float:
            np.testing.assert_allclose(got[c], want[c], atol=1e-9, err_msg=c)
        else:
            assert got[c].tolist() == want[c].tolist(), c


def test_small_samples_of_every_study(spark, duck):
    test_matches_sql(spark, duck, "small_sample_studies")
    assert len(entry_module.SMALL_SAMPLE_TABLES) == 12


@pytest.mark.parametrize("name", ["reference_scan", "member_scan"])
def test_landed_files_are_read_whole(spark, duck, name):
    test_matches_sql(spark, duck, f"{name}_whole")
    bounded, whole = (duck.execute(entry_module.oracle_sql()[n]).df() for n in (name, f"{name}_whole"))
    assert len(whole) > len(bounded)


def test_every_query_has_a_twin():
    assert set(entry_module._QUERIES) == set(entry_module.ORACLES)
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry_runs(spark):
    assert entry_module.entry(spark).count() > 0
