import os
from datetime import date

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlattice.schemas import BAR_COLUMNS, LANDED_BAR
from barlattice.sources import landing
from barlattice.sources.warehouse import Warehouse
from barlattice.streaming.ingest import ingest_stream

D = [date(2024, 1, 2), date(2024, 1, 3), date(2024, 1, 4)]


def bars(spark, days, tickers=("A", "B"), close=10.0):
    rows = [(t, close, close, close, close, 1.0, close, 1, 0, d) for d in days for t in tickers]
    return spark.createDataFrame(rows, LANDED_BAR.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", date date")


def test_manifest_tells_empty_from_missing(spark, tmp_path):
    root = str(tmp_path)
    landing.write_days(bars(spark, D[:1]), root, "grouped_daily")
    landing.write_empty_day(spark, root, "grouped_daily", D[1])
    got = {(r["source"], r["date"]): r["row_count"] for r in landing.raw_manifest(spark, root).collect()}
    assert got == {("grouped_daily", D[0]): 2, ("grouped_daily", D[1]): 0}
    assert landing.scan_bars(spark, root).columns == BAR_COLUMNS
    assert landing.scan_bars(spark, root, D[1], D[2]).count() == 0
    assert landing.scan_members(spark, root).count() == 0


def test_nan_is_missing_after_the_scan(spark, tmp_path):
    landing.write_days(bars(spark, D[:1], close=float("nan")), str(tmp_path), "grouped_daily")
    row = landing.scan_bars(spark, str(tmp_path)).first()
    assert row["close"] is None and row["volume"] == 1.0


def test_date_filter_prunes_directories(spark, tmp_path):
    root = str(tmp_path)
    landing.write_days(bars(spark, D), root, "grouped_daily")
    df = landing.scan_bars(spark, root, D[1], D[1])
    assert df.count() == 2
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan


def test_ingest_skips_landed_days_unless_forced(spark, tmp_path):
    root = str(tmp_path)
    assert landing.ingest_days(bars(spark, D[:2]), root, "grouped_daily") == {"landed": 2, "skipped_existing": 0}
    assert landing.ingest_days(bars(spark, D, close=99.0), root, "grouped_daily") == {"landed": 1, "skipped_existing": 2}
    closes = {r["date"]: r["close"] for r in landing.scan_bars(spark, root).collect()}
    assert closes == {D[0]: 10.0, D[1]: 10.0, D[2]: 99.0}
    landing.ingest_days(bars(spark, D[:1], close=5.0), root, "grouped_daily", force=True)
    closes = {r["date"]: r["close"] for r in landing.scan_bars(spark, root).collect()}
    assert closes == {D[0]: 5.0, D[1]: 10.0, D[2]: 99.0}


def test_stream_lands_new_files_once(spark, tmp_path):
    incoming, root, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    bars(spark, D[:1]).write.parquet(incoming)
    ingest_stream(spark, incoming, root, "grouped_daily", ck)
    bars(spark, D, close=7.0).write.mode("append").parquet(incoming)
    ingest_stream(spark, incoming, root, "grouped_daily", ck)
    ingest_stream(spark, incoming, root, "grouped_daily", ck)
    got = {(r["date"], r["ticker"]): r["close"] for r in landing.scan_bars(spark, root).collect()}
    assert len(got) == 6 and got[(D[0], "A")] == 10.0 and got[(D[2], "B")] == 7.0


@pytest.mark.parametrize("force", [False, True])
def test_stream_lands_a_day_that_spans_batches(spark, tmp_path, force):
    incoming, root, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    bars(spark, D[:1], ("A",)).coalesce(1).write.parquet(incoming)
    bars(spark, D[:1], ("B",)).coalesce(1).write.mode("append").parquet(incoming)
    ingest_stream(spark, incoming, root, "grouped_daily", ck, force, files_per_trigger=1)
    assert {r["ticker"] for r in landing.scan_bars(spark, root).collect()} == {"A", "B"}
    bars(spark, D[:1], ("C",)).coalesce(1).write.mode("append").parquet(incoming)
    bars(spark, D[:1], ("E",)).coalesce(1).write.mode("append").parquet(incoming)
    ingest_stream(spark, incoming, root, "grouped_daily", ck, force, files_per_trigger=1)
    want = {"C", "E"} if force else {"A", "B"}
    assert {r["ticker"] for r in landing.scan_bars(spark, root).collect()} == want


def test_stream_lands_what_a_failed_run_held(spark, tmp_path):
    incoming, root, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    bars(spark, D[:1], ("A",)).write.parquet(f"{ck}-held/batch=0")  # an earlier run broke off before landing
    bars(spark, D[:1], ("B",)).write.parquet(incoming)
    ingest_stream(spark, incoming, root, "grouped_daily", ck + "x")
    assert {r["ticker"] for r in landing.scan_bars(spark, root).collect()} == {"B"}
    bars(spark, D[1:2], ("B",)).write.mode("append").parquet(incoming)
    os.rename(f"{ck}-held", f"{ck}x-held")
    os.rename(f"{ck}x-held/batch=0", f"{ck}x-held/batch=7")
    ingest_stream(spark, incoming, root, "grouped_daily", ck + "x", force=True)
    assert {(r["date"], r["ticker"]) for r in landing.scan_bars(spark, root).collect()} == {(D[0], "A"), (D[1], "B")}


def test_vendor_files_with_an_empty_one(spark, tmp_path):
    src = tmp_path / "vendor" / "grouped_daily" / "year=2024"
    os.makedirs(src)
    full = pd.DataFrame({"T": ["A"], "o": [1.0], "h": [2.0], "l": [0.5], "c": [1.5], "v": [9.0], "vw": [1.2], "n": [3], "t": [1]})
    full.to_parquet(src / "date=2024-01-02.parquet", index=False)
    pd.DataFrame.from_records([]).to_parquet(src / "date=2024-01-03.parquet", index=False)
    vendor, root = str(tmp_path / "vendor"), str(tmp_path / "own")
    with landing.case_sensitive(spark):
        counts = {r["date"]: r["row_count"] for r in landing.foreign_manifest(spark, vendor, "grouped_daily").collect()}
    assert counts == {D[0]: 1, D[1]: 0}
    assert landing.ingest_foreign(spark, vendor, root, "grouped_daily")["empty_days"] == 1
    row = landing.scan_bars(spark, root).first()
    assert (row["ticker"], row["close"], row["date"]) == ("A", 1.5, D[0])
    assert {r["date"]: r["row_count"] for r in landing.raw_manifest(spark, root).collect()} == {D[0]: 1, D[1]: 0}


def test_calendar_and_gaps(spark, tmp_path):
    cal = landing.candidate_weekdays(spark, date(2024, 1, 5), date(2024, 1, 9))
    assert [r["date"].day for r in cal.orderBy("date").collect()] == [5, 8, 9]
    landing.write_days(bars(spark, [date(2024, 1, 8)]), str(tmp_path), "grouped_daily")
    gaps = landing.coverage_gaps(cal, landing.raw_manifest(spark, str(tmp_path)))
    assert gaps.filter("source = 'grouped_daily'").count() == 2 and gaps.count() == 11


def test_year_sink_replaces_only_its_years(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path))
    df = spark.createDataFrame([(date(2023, 5, 1), "A", 1.0), (date(2024, 5, 1), "A", 2.0)], "date date, ticker string, x double")
    assert w.read("stock_features_daily") is None
    w.write("stock_features_daily", df)
    w.write("stock_features_daily", df.filter("x = 2").withColumn("x", F.lit(5.0)))
    assert sorted(r["x"] for r in w.read("stock_features_daily").collect()) == [1.0, 5.0]
    only = w.read("stock_features_daily", [2024])
    assert only.count() == 1 and "year" not in only.columns
    assert "PartitionFilters: [isnotnull(year" in only._jdf.queryExecution().executedPlan().toString() or \
        "PartitionFilters: [year" in only._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(KeyError):
        w.path("nope")


def test_lineage_and_reports(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path))
    w.write_lineage("raw_manifest", D[0], D[2], "files", "abc")
    row = w.read_lineage("raw_manifest").first()
    assert (row["status"], row["data_start"], row["code_commit_hash"]) == ("available", "2024-01-02", "abc")
    w.write_lineage("qqq_health_daily", D[0], D[2], "members", error="no members")
    assert w.read_lineage("qqq_health_daily").first()["status"] == "unavailable"
    w.write_report("r", {"t": spark.range(3)}, spark.range(1))
    assert spark.read.parquet(f"{tmp_path}/reports/r/parquet/t").count() == 3
    assert spark.read.option("header", True).csv(f"{tmp_path}/reports/r/csv/t").count() == 3
