"""Bucketed tables join without an exchange; writes observe what they store."""

from datetime import date

from conftest import ohlcv
from pyspark.sql import functions as F

from barlattice.session import joined_by_entity
from barlattice.sources.warehouse import Warehouse


def rows(frame, **more):
    return frame(ohlcv(400, ("AAA", "BBB", "CCC"), **more)).select("date", "ticker", "close", "high")


def nodes(df):
    df.collect()  # the final plan
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_tables_join_where_they_lie(spark, frame, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for buckets in (None, 3):
            w = Warehouse(spark, str(tmp_path / f"b{buckets}"), buckets)
            w.write("stock_features_daily", rows(frame))
            w.write("stock_outcomes_daily", rows(frame, seed=8).withColumnRenamed("close", "out").drop("high"))
            again = Warehouse(spark, w.root, buckets)  # as another session opens it
            with joined_by_entity(spark):
                both = again.read("stock_features_daily").join(again.read("stock_outcomes_daily"), ["date", "ticker"])
                plan = nodes(both)
            assert both.count() == 1200 and ("Exchange" in plan) == (buckets is None)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_buckets_keep_other_years(spark, frame, tmp_path):
    w = Warehouse(spark, str(tmp_path), 2)
    w.write("stock_features_daily", rows(frame))
    part = rows(frame).filter(F.year("date") == 2024).withColumn("close", F.lit(-1.0))
    seen = w.write("stock_features_daily", part, years=[2024])
    assert seen["years"] == [2024] and seen["rows"] == part.count()
    df = w.read("stock_features_daily")
    assert df.count() == 1200 and df.filter("close = -1").count() == part.count()
    assert {r["y"] for r in w.read("stock_features_daily", [2023]).select(F.year("date").alias("y")).distinct().collect()} == {2023}
    w.write("stock_features_daily", part.limit(0), years=[2024])
    assert w.read("stock_features_daily").filter(F.year("date") == 2024).count() == 0


def test_writes_observe_their_rows(spark, frame, tmp_path):
    w = Warehouse(spark, str(tmp_path))
    df = rows(frame).withColumn("close", F.when(F.col("ticker") != "BBB", F.col("close")))
    seen = w.write("stock_outcomes_daily", df)
    assert (seen["rows"], seen["missing_close"], seen["missing_high"]) == (1200, 400, 0)
    assert seen["first"] == date(2023, 1, 2) and sorted(seen["years"]) == [2023, 2024]
    w.write_missing("stock_outcomes_daily", seen)
    assert {(r["column"], r["n_missing"], r["n_rows"]) for r in w.read_missing("stock_outcomes_daily").collect()} == {("close", 400, 1200), ("high", 0, 1200)}


def test_rows_that_are_laid_out_are_written_by_their_tasks(spark, frame, tmp_path):
    w = Warehouse(spark, str(tmp_path))
    w.write("stock_features_daily", rows(frame).repartition(2, "ticker"), laid_out=True)
    df = w.read("stock_features_daily")
    held = {(r["ticker"], r["year"], r["file"].rsplit("part-", 1)[1][:5]) for r in df.select(
        "ticker", F.year("date").alias("year"), F.input_file_name().alias("file")).collect()}
    assert df.count() == 1200 and len(held) == 6  # each ticker and year in one file
    assert len({task for _, _, task in held}) == 2 and len({(t, task) for t, _, task in held}) == 3
