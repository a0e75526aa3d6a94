"""Committed batches, changed days, carried states, and rebuilding only the years that a correction reaches."""

import os
from datetime import date

import numpy as np
import pandas as pd
import pytest
from conftest import ohlcv
from pyspark.sql import functions as F

from barlattice.config import EngineConfig, IndexConfig
from barlattice.operators.ema import add_emas, add_year_end, ema_state
from barlattice.operators.technical import add_sma, add_sma50_persistence, carry_persistence
from barlattice.plans import refresh as R
from barlattice.plans.jobs import Engine
from barlattice.schemas import LANDED, LANDED_BAR
from barlattice.sources import batches, landing
from barlattice.sources.warehouse import Warehouse

D = [date(2024, 1, k) for k in (2, 3, 4)]


def bars(spark, days, close, tickers=("A", "B")):
    rows = [(t, close, close, close, close, 1.0, close, 1, 0, d) for d in days for t in tickers]
    return spark.createDataFrame(rows, LANDED_BAR.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", date date")


def closes(spark, root, *span):
    return {r["date"]: r["close"] for r in landing.scan_bars(spark, root, *span).collect()}


def test_a_batch_shows_all_its_days_or_none(spark, tmp_path):
    root = str(tmp_path)
    landing.write_days(bars(spark, D[:2], 1.0), root, "grouped_daily")
    batch = batches.write_batch(bars(spark, D[1:], 2.0), root, "grouped_daily")  # a run that is killed here
    assert closes(spark, root) == {D[0]: 1.0, D[1]: 1.0}
    assert batches.commit_batch(spark, root, "grouped_daily", batch) == D[1:]
    assert batches.commit_batch(spark, root, "grouped_daily", batch) == D[1:]
    assert closes(spark, root) == {D[0]: 1.0, D[1]: 2.0, D[2]: 2.0}
    assert closes(spark, root, D[1], D[1]) == {D[1]: 2.0}
    assert {r["date"]: r["row_count"] for r in landing.raw_manifest(spark, root).collect()} == dict.fromkeys(D, 2)
    batches.publish_days(bars(spark, D[1:], 3.0), root, "grouped_daily")
    assert closes(spark, root) == {D[0]: 1.0, D[1]: 3.0, D[2]: 3.0}
    assert batches.drop_superseded(spark, root, "grouped_daily") == 1
    assert not os.path.exists(f"{root}/grouped_daily_batches/batch={batch}")
    assert closes(spark, root) == {D[0]: 1.0, D[1]: 3.0, D[2]: 3.0}


def test_out_of_range_days_are_not_listed(spark, tmp_path):
    root = str(tmp_path)
    landing.write_days(bars(spark, D, 1.0), root, "grouped_daily")
    batches.publish_days(bars(spark, [date(2024, 2, 1), date(2024, 2, 2)], 2.0), root, "grouped_daily")
    paths = landing._file_paths(spark, root, "grouped_daily", D[2], date(2024, 2, 1))
    assert paths[0] == f"{root}/grouped_daily/date=2024-01-04" and len(paths) == 2 and paths[1].endswith("/date=2024-02-01")
    os.remove(next(f for f in (os.path.join(d, x) for d, _, fs in os.walk(f"{root}/grouped_daily/date=2024-01-02") for x in fs) if f.endswith(".parquet")))
    assert landing.landed_files(spark, root, "grouped_daily", D[2], D[2]).count() == 1


def test_only_small_files_are_opened_for_their_footers(spark, tmp_path, monkeypatch):
    src = tmp_path / "grouped_daily" / "year=2024"
    os.makedirs(src)
    pd.DataFrame.from_records([]).to_parquet(src / "date=2024-01-03.parquet", index=False)
    big = pd.DataFrame({"T": [f"T{k}" for k in range(4000)], "c": np.random.default_rng(1).random(4000)})
    big.to_parquet(src / "date=2024-01-02.parquet", index=False)
    limit = os.path.getsize(src / "date=2024-01-03.parquet")
    assert os.path.getsize(src / "date=2024-01-02.parquet") > 10 * limit
    monkeypatch.setattr(landing, "FOOTER_BYTES", limit)
    found = landing.columnless_files(spark, [str(tmp_path)])
    assert [p["path"].rsplit("/", 1)[-1] for p in found.collect()] == ["date=2024-01-03.parquet"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length" in plan  # the reader itself leaves the others closed


def test_changed_days(spark, tmp_path):
    root, source = str(tmp_path), "grouped_daily"
    batches.publish_days(bars(spark, D[:2], 1.0), root, source)
    first = landing.changed_days(spark, root, [source])
    assert {r["date"]: r["change"] for r in first.collect()} == {D[0]: "new", D[1]: "new"}
    known = spark.createDataFrame(first.drop("change").collect(), first.drop("change").schema)
    assert {r["change"] for r in landing.changed_days(spark, root, [source], known).collect()} == {"same"}
    batches.publish_days(bars(spark, D[:1], 1.0, ("B", "A")), root, source)  # the same rows in new files
    batches.publish_days(bars(spark, D[1:], 5.0), root, source)
    now = {r["date"]: (r["change"], r["row_count"]) for r in landing.changed_days(spark, root, [source], known).collect()}
    assert now == {D[0]: ("same", 2), D[1]: ("changed", 2), D[2]: ("new", 2)}
    gone = landing.changed_days(spark, str(tmp_path / "none"), [source], known)
    assert {r["change"] for r in gone.collect()} == {"gone"}


def test_averages_go_on_from_a_state(spark, frame):
    pdf = ohlcv(90, ("AAA", "BBB", "CCC"))
    pdf.loc[(pdf.ticker == "AAA") & (pdf.index % 7 == 3), "close"] = np.nan  # gaps, one across the cut
    cut = pdf.date.sort_values().unique()[45]
    pdf.loc[(pdf.ticker == "AAA") & (pdf.date < cut) & (pdf.date > cut - pd.Timedelta(days=6)), "close"] = np.nan
    pdf = pdf[~((pdf.ticker == "CCC") & (pdf.date < cut))]  # no state at all
    specs = [("e5", "close", 5), ("e20", "close", 20), ("h9", "high", 9)]
    df = frame(pdf[["date", "ticker", "close", "high"]])
    whole = add_emas(df, specs).toPandas().sort_values(["ticker", "date"]).reset_index(drop=True)
    head, tail = (df.filter(F.col("date") < cut.date()), df.filter(F.col("date") >= cut.date()))
    state = ema_state(add_emas(head, specs), specs)
    parts = add_emas(head, specs).unionByName(add_emas(tail, specs, state=state)).toPandas()
    parts = parts.sort_values(["ticker", "date"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(whole, parts, rtol=1e-13, atol=0)


def test_year_ends_hold_the_state_of_each_year(spark, frame):
    pdf = ohlcv(300, ("AAA", "BBB", "CCC"), start="2022-06-01")
    pdf.loc[(pdf.ticker == "AAA") & (pdf.index % 7 == 3), "close"] = np.nan
    pdf.loc[(pdf.ticker == "BBB") & (pdf.date > "2022-12-20") & (pdf.date < "2023-02-01"), "close"] = np.nan  # old at the year's end
    pdf = pdf[~((pdf.ticker == "CCC") & (pdf.date < "2023-01-01"))]
    specs = [("e5", "close", 5), ("h9", "high", 9)]
    df = add_emas(frame(pdf[["date", "ticker", "close", "high", "low"]]), specs).withColumn("year", F.year("date"))
    want = ema_state(df, specs, carry=("low",), by=("year",))
    got = add_year_end(df, specs, carry=("low",)).filter("_end IS NOT NULL").select("ticker", "year", "_end.*")
    assert got.columns == want.columns and got.count() == 5
    assert sorted(got.collect()) == sorted(want.collect()) and max(r["age_close"] for r in got.collect()) > 5


def test_runs_go_on_across_the_cut(spark, frame):
    days = pd.bdate_range("2022-01-03", periods=420)
    pdf = pd.DataFrame({"date": days, "ticker": "UP", "close": np.arange(420.0) + 10})
    down = pdf.assign(ticker="DN", close=np.r_[np.arange(300.0) + 10, 310 - 2 * np.arange(120.0)])
    df = frame(pd.concat([pdf, down]))
    whole = add_sma50_persistence(add_sma(df, {"sma50": 50}))
    cut = days[330].date()
    kept = R.around(df, cut, None, 60, 0)
    runs = whole.filter(F.col("date") < F.lit(cut)).groupBy("ticker").agg(F.max_by("sma50_persistence_days", "date").alias("before"))
    part = add_sma50_persistence(add_sma(kept, {"sma50": 50})).join(runs, "ticker")
    part = carry_persistence(part, cut, "before").filter(F.col("date") >= F.lit(cut))
    want = {(r["ticker"], r["date"]): r["sma50_persistence_days"] for r in whole.filter(F.col("date") >= F.lit(cut)).collect()}
    assert {(r["ticker"], r["date"]): r["sma50_persistence_days"] for r in part.collect()} == want
    assert max(v for v in want.values()) == 371.0


def test_around_and_reach(spark):
    rows = spark.createDataFrame([("A", date(2024, 1, k)) for k in range(1, 20)] + [("S", date(2023, 5, 1)), ("S", date(2024, 1, 10))], "ticker string, date date")
    near = R.around(rows, date(2024, 1, 10), date(2024, 1, 11), 2, 3)
    assert sorted(r["date"].day for r in near.filter("ticker = 'A'").collect()) == [8, 9, 10, 11, 12, 13, 14]
    assert R.reach(rows, date(2024, 1, 10), date(2024, 1, 11), 2, 3) == (date(2023, 5, 1), date(2024, 1, 14))
    assert R.reach(rows, date(2025, 1, 1), date(2025, 1, 1), 0, 5) == (date(2025, 1, 1), date(2025, 1, 1))


def land(spark, root, pdf):
    for source in ("grouped_daily", "grouped_daily_unadjusted"):
        df = spark.createDataFrame(pdf.assign(date=pdf.date.dt.date))
        landing.ingest_days(df.select(*[
            F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in LANDED[source].fields], "date"), root, source, force=True)


@pytest.fixture(scope="module")
def corrected(spark, tmp_path_factory):
    """Five years; a day of the third is corrected after the build."""
    tmp = tmp_path_factory.mktemp("refresh")
    pdf = ohlcv(1290, [f"T{k}" for k in range(5)], start="2019-01-01")
    pdf = pdf[pdf.date.isin(pdf.date.sort_values().unique()[::3])].copy()  # a third of the days: fewer folders
    pdf["close"] = pdf.close.clip(5, 5000)
    root = str(tmp / "raw")
    land(spark, root, pdf)
    ref = spark.createDataFrame(pdf[["date", "ticker"]].assign(date=pdf.date.dt.date))
    landing.ingest_days(ref.select(*[
        {"ticker": F.col("ticker"), "type": F.lit("CS"), "primary_exchange": F.lit("XNAS")}.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name)
        for f in LANDED["reference_tickers"].fields], "date"), root, "reference_tickers")
    months = pd.date_range("2019-01-01", pdf.date.max(), freq="MS").date
    shares = spark.createDataFrame([(t, m, 1e9) for t in pdf.ticker.unique() for m in months], "ticker string, bucket_month date, shares double")
    conf = EngineConfig(index=IndexConfig(min_components=3))
    engine = Engine(spark, root, Warehouse(spark, str(tmp / "wh")), conf)
    first = engine.refresh(shares)
    day = pdf[pdf.date == pdf.date.sort_values().unique()[100]].copy()
    day.loc[day.ticker != "T4", ["high", "low", "close"]] *= 1.4
    before = files(tmp)
    land(spark, root, day)
    second = engine.refresh(shares)
    fresh = Engine(spark, root, Warehouse(spark, str(tmp / "again")), conf)
    fresh.refresh(shares)
    return engine, fresh, first, second, before, files(tmp), day.date.iloc[0].year, shares


def files(tmp):
    out = {}
    for d, _, names in os.walk(tmp / "wh"):
        for x in names:
            if x.endswith(".parquet") and "year=" in d:
                out.setdefault((os.path.relpath(d, tmp / "wh").split("/")[0], int(d.rsplit("year=", 1)[1][:4])), set()).add((x, os.stat(os.path.join(d, x)).st_mtime_ns))
    return out


def test_only_reached_years_are_rebuilt(corrected):
    _, _, first, second, before, after, year, _ = corrected
    assert first["stock_features_daily"] == list(range(2019, 2024))
    assert second["stock_features_daily"][0] == year and len(second["stock_features_daily"]) < 5
    for (table, y), held in before.items():
        if table in second:
            assert (held == after[table, y]) == (y not in second[table]), (table, y)


def test_rebuilt_tables_equal_a_full_build(corrected):
    engine, fresh, *_ = corrected
    for table in ("market_universe_daily", "stock_features_daily", "stock_outcomes_daily", "market_breadth_daily"):
        a, b = (e.warehouse.read(table).toPandas() for e in (engine, fresh))
        keys = [c for c in ("date", "ticker") if c in a.columns]
        a, b = (x.sort_values(keys).reset_index(drop=True)[sorted(x.columns)] for x in (a, b))
        pd.testing.assert_frame_equal(a, b, rtol=1e-8, atol=1e-8)


def test_nothing_to_do(corrected):
    engine, *_, shares = corrected
    assert engine.refresh(shares) == {}
