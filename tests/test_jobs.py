"""Landed files -> universe -> features -> outcomes -> breadth, index and studies, on disk."""

from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlattice.config import EngineConfig, IndexConfig
from barlattice.plans.jobs import Engine
from barlattice.schemas import FEATURE_COLUMNS, LANDED
from barlattice.sources import landing
from barlattice.sources.warehouse import Warehouse

START, END, CUT = date(2023, 1, 2), date(2024, 7, 31), date(2024, 1, 1)
TICKERS = [f"T{i:02d}" for i in range(12)]


def market(poison=1.0):
    """Daily bars for 12 tickers and the index; `poison` multiplies the first year's prices."""
    rng = np.random.default_rng(11)
    days = pd.bdate_range(START, END)
    out = []
    for i, t in enumerate([*TICKERS, "QQQ"]):
        close = 40 * np.exp(np.cumsum(rng.normal(0.001, 0.03, len(days))))
        spread = rng.uniform(0.02, 0.06, len(days))
        out.append(pd.DataFrame({"date": days, "ticker": t, "open": close, "high": close * (1 + spread),
                                 "low": close * (1 - spread / 2), "close": close, "volume": 1e6}))
    pdf = pd.concat(out, ignore_index=True)
    pdf.loc[pdf.date < pd.Timestamp(CUT), ["open", "high", "low", "close"]] *= poison
    return pdf


def land(spark, frame, root, pdf):
    bars = frame(pdf)
    for source in ("grouped_daily", "grouped_daily_unadjusted"):
        df = bars.select(
            *[F.col(f.name) if f.name in bars.columns else F.lit(None).cast(f.dataType).alias(f.name)
              for f in LANDED[source].fields], "date")
        landing.write_days(df, root, source)
    stocks = bars.filter("ticker <> 'QQQ'").select("date", "ticker")
    ref = stocks.select(*[
        {"ticker": F.col("ticker"), "type": F.lit("CS"), "primary_exchange": F.lit("XNAS"), "active": F.lit(False)}.get(
            f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in LANDED["reference_tickers"].fields], "date")
    landing.write_days(ref, root, "reference_tickers")
    members = stocks.filter("ticker < 'T08'").select(F.col("ticker").alias("constituent_ticker"), F.lit(0.125).alias("weight"), "date")
    landing.write_days(members, root, "qqq_constituents")
    months = pd.date_range("2023-01-01", "2024-07-01", freq="MS")
    return frame(pd.DataFrame([(t, m, 1e9) for t in TICKERS for m in months], columns=["ticker", "bucket_month", "shares"]))


def engine(spark, tmp, conf=None):
    conf = conf or EngineConfig(index=IndexConfig(min_components=3))
    return Engine(spark, str(tmp / "raw"), Warehouse(spark, str(tmp / "wh")), conf, commit="test")


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    tmp = tmp_path_factory.mktemp("jobs")

    def frame(pdf):
        pdf = pdf.copy()
        for c in pdf.columns:
            if str(pdf[c].dtype).startswith("datetime"):
                pdf[c] = pdf[c].dt.date
        return spark.createDataFrame(pdf)

    shares = land(spark, frame, str(tmp / "raw"), market())
    e = engine(spark, tmp)
    e.universe(START, END, shares)
    e.features(START, END)
    e.outcomes(START, END)
    return e


def test_tables_and_lineage(built):
    f = built.warehouse.read("stock_features_daily")
    assert f.columns == FEATURE_COLUMNS
    assert f.count() == 13 * len(pd.bdate_range(START, END))
    assert f.filter("eligible").count() > 1000
    # The index itself is not listed, so never eligible and never ranked.
    assert f.filter("ticker = 'QQQ' and (eligible or rs_percentile_1m is not null)").count() == 0
    assert built.warehouse.read_lineage("stock_outcomes_daily").first()["code_commit_hash"] == "test"


def test_ranks_follow_from_stored_eligibility(built):
    pdf = built.warehouse.read("stock_features_daily", [2024]).filter("eligible").toPandas()
    want = pdf.groupby("date").return_21d.rank(pct=True) * 100
    np.testing.assert_allclose(pdf.rs_percentile_1m, want, atol=1e-9)


def test_reference_and_manifest(built):
    assert built.reference_tickers(START, END).count() == 12 * len(pd.bdate_range(START, END))
    m = built.raw_manifest(START, date(2023, 1, 31))
    assert {r["source"]: r["n"] for r in m.groupBy("source").agg(F.count("*").alias("n")).collect()} == dict.fromkeys(
        ["grouped_daily", "grouped_daily_unadjusted", "qqq_constituents", "reference_tickers"], 22)


def test_breadth_index_and_verify(built):
    b = built.market_breadth(START, END)
    row = b.agg(F.avg("future_rs80plus_share_20d").alias("x")).first()
    assert 0.1 < row["x"] < 0.4
    assert built.index_health(START, END).count() == len(pd.bdate_range(START, END))
    o = built.index_outcomes(START, END)
    assert o.filter("qqq_max_drawdown_pct_20d is not null").count() == len(pd.bdate_range(START, END)) - 20
    tables = built.verify()
    assert {"metrics", "tie_diagnostics", "rs_decile", "breadth_rs80plus_share_bucket", "mco_z_bucket"} <= set(tables)
    assert built.spark.read.json(f"{built.warehouse.root}/reports/data_quality/summary").count() > 10


def test_breadth_stages_only_what_it_reads(built, monkeypatch):
    from barlattice.plans import jobs

    e, seen = built[0] if isinstance(built, tuple) else built, []
    monkeypatch.setattr(jobs, "stage", lambda df, name="stage", f=jobs.stage: seen.append((name, df.columns)) or f(df, name))
    assert e._breadth().count() > 0
    (name, columns), = seen
    assert name == "breadth" and "mfe_pct_10d" in columns and not any(c.startswith(("new_20d", "mae_atr")) for c in columns)


def test_missing_members_are_recorded_not_replaced(built, spark, tmp_path):
    e = engine(spark, tmp_path, EngineConfig(index=IndexConfig(min_components=99)))
    e.landed = built.landed
    assert e.index_health(START, END) is None
    line = e.warehouse.read_lineage("qqq_health_daily").first()
    assert line["status"] == "unavailable" and "member list" in line["error"]
    assert e.warehouse.read("qqq_health_daily") is None


def test_studies_run_and_write_reports(built):
    year = (date(2024, 1, 1), date(2024, 7, 31))
    assert built.rs_benchmark(*year).count() == 6 * 18 * 3
    assert built.rs_benchmark_common(*year).count() == 6 * 18 * 3
    assert built.rs_atr_study(*year)["cross_matrix"].count() == 630
    tables = built.opportunity_study(START, END)
    assert tables["rs_x_ema10"].count() == 420 and tables["prior_extension_x_ema20"].count() == 105
    assert tables["repeat_offender_ema10"].count() == 420
    states = built.candidate_states(START, END)
    assert states["candidate_states_by_rs_bucket_ema10"].count() == 180
    pull = built.pullback_study(START, END)
    assert [pull[k].count() for k in ("push_distance_distribution", "push_distance_buckets", "ema_pullback_candidate_comparison")] == [192, 1344, 288]
    cross = built.spark.read.parquet(f"{built.warehouse.root}/reports/rs_atr_extension_study/parquet/cross_matrix")
    assert cross.count() == 630
    with pytest.raises(ValueError):
        built.rs_benchmark(START, END)
    with pytest.raises(ValueError):
        built.opportunity_study(date(2024, 1, 1), END)


def test_pullback_summary_has_small_samples(built):
    built.pullback_study(START, END)
    summary = built.spark.read.json(f"{built.warehouse.root}/reports/ema_pullback_range_study/summary")
    got = {r["key"] for r in summary.filter("metric = 'small_sample_cells'").collect()}
    assert got == {"push_distance_distribution", "push_distance_buckets", "ema_pullback_candidate_comparison"}


def test_studies_agree_on_the_universe(built):
    """Every eligible row with an RS value sits in exactly one cell per RS horizon."""
    rows = built._year(date(2024, 1, 1), date(2024, 7, 31))
    n = rows.filter("rs_percentile_1m is not null").count()
    t = built.rs_benchmark(date(2024, 1, 1), date(2024, 7, 31))
    got = t.filter("rs_horizon = 'rs_percentile_1m' and scheme = 'coarse' and outcome_horizon = 5").agg(F.sum("n")).first()[0]
    assert got == n


def test_warm_up_year_never_reaches_the_report(spark, frame, tmp_path):
    """First-year prices times 10^7: next year's long lookbacks change, same-year outcomes do not explode."""
    shares = land(spark, frame, str(tmp_path / "raw"), market(poison=1e7))
    e = engine(spark, tmp_path)
    e.universe(START, END, shares)
    e.features(START, END)
    e.outcomes(START, END)
    t = e.rs_benchmark(date(2024, 3, 1), date(2024, 7, 31)).toPandas()
    assert t.mean_mfe_pct.abs().max() < 1000
    tickers = e.warehouse.read("stock_features_daily", [2024]).filter("eligible and date >= '2024-03-01'").toPandas()
    assert tickers.close.max() < 1e5
