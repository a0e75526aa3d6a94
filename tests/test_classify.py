from datetime import date

from pyspark.sql import functions as F

from barlattice.operators import classify


def test_time_splits_and_warm_up(spark):
    days = [date(2022, 12, 30), date(2023, 1, 1), date(2024, 12, 31), date(2025, 6, 1), date(2026, 3, 1), date(2026, 9, 1)]
    df = spark.createDataFrame([(d,) for d in days], "date date")
    out = df.select(
        "date", classify.time_split("date", F.lit(date(2026, 8, 11))).alias("s"), classify.in_fitting_window().alias("w")
    ).orderBy("date").collect()
    assert [r["s"] for r in out] == [None, "fitting", "fitting", "validation", "out_of_sample", None]
    assert [r["w"] for r in out] == [False, True, True, True, True, True]


def test_common_sample_and_high_rs(spark):
    df = spark.createDataFrame([(1.0, 95.0), (None, 90.0), (2.0, None), (3.0, 89.9)], "a double, b double")
    got = df.select(classify.common_sample(("a", "b")).alias("c"), classify.high_rs("b").alias("h")).collect()
    assert [(r["c"], r["h"]) for r in got] == [(True, True), (False, True), (False, False), (True, False)]


def test_later_years_are_refused(spark):
    import pytest

    df = spark.createDataFrame([(date(2024, 1, 2),), (date(2025, 1, 2),)], "date date")
    classify.refuse_later_years(df, 2025)
    with pytest.raises(ValueError):
        classify.refuse_later_years(df, 2024)
