"""The derived tables: what they cost, and which jobs run for them."""

import time

import __spark_entry__ as entry_module
from barlattice.session import stage
from barlattice.sources import derived

SF = "/root/testdata/sf0.001"


def test_listings_are_made_in_tasks_by_suppliers(spark, tmp_path):
    n = 4 * derived.SUPPLIERS_PER_TASK
    spark.range(n).selectExpr("id AS s_suppkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    days = "timestamp'1996-01-01', timestamp'1996-03-01'"
    spark.sql(f"SELECT explode(array({days})) AS l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    for made in (derived.reference_snapshots, derived.monthly_shares):
        df = made(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() == 4
        assert df.select("ticker").distinct().count() == n


def test_a_job_builds_only_what_its_table_needs(spark):
    entry_module.forget()
    jobs = entry_module._jobs(entry_module.Frames(spark, SF))
    assert jobs.read("reference_tickers").count() > 0
    assert jobs.done == {"land reference_tickers", "reference_tickers"}
    assert jobs.read("market_universe_daily").count() > 0
    assert jobs.warehouse.read("stock_features_daily") is None and jobs.warehouse.read("qqq_health_daily") is None
    entry_module.forget()


def test_study_join_builds_one_panel(spark):
    entry_module.forget()
    entry_module.q_study_join(entry_module.Frames(spark, SF))
    assert {key[2] for key in entry_module._shared} == {"raw", "panel"}
    entry_module.forget()


def test_shuffled_rows_come_in_small_tasks(spark):
    """Some 100 MB of shuffled rows make tasks of at most about 16 MB each, not one for each core."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    rows = spark.range(6_000_000, numPartitions=4).selectExpr("id % 100000 AS ticker", "id", "rand(1) AS x")
    files = stage(rows.repartition("ticker"), "small-tasks").inputFiles()
    assert len(files) >= 6 and spark.conf.get("spark.sql.shuffle.partitions") == before


def order_lines(spark, root, suppliers=30, weeks=75):
    """Two lines a week and supplier from 1999 on, and their suppliers: prices move, so that some rows are eligible and some not."""
    spark.range(suppliers).selectExpr("id AS s_suppkey").coalesce(1).write.parquet(f"{root}/supplier.parquet")
    spark.range(suppliers * weeks * 2).selectExpr(
        "id AS l_orderkey", "cast(1 AS int) AS l_linenumber", f"id % {suppliers} AS l_suppkey", "id AS l_partkey",
        "cast(1 + id % 7 AS double) AS l_quantity", "cast(100 + id % 11 AS double) AS l_extendedprice",
        f"cast((id * 7 + id div {suppliers}) % 11 AS double) / 100 AS l_discount",
        f"cast(date_add(date'1999-02-01', cast(7 * (id div {2 * suppliers}) + (id div {suppliers}) % 2 AS int)) AS timestamp) AS l_shipdate",
    ).coalesce(2).write.parquet(f"{root}/lineitem.parquet")
    return str(root)


def staged_rows(monkeypatch):
    """What the queries stage: (name, rows, columns) of each table."""
    seen = []

    def noted(df, name="stage"):
        out = stage(df, name)
        seen.append((name, out.count(), out.columns))
        return out

    monkeypatch.setattr(entry_module, "stage", noted)
    return seen


def test_studies_stage_eligible_rows_only(spark, tmp_path, monkeypatch):
    f = entry_module.Frames(spark, order_lines(spark, tmp_path))
    entry_module.forget()
    seen = staged_rows(monkeypatch)
    year, rows = f.year(), f.rows()
    bars = next(n for name, n, _ in seen if name == "raw")
    panels = [(n, columns) for name, n, columns in seen if name == "panel"]
    assert [n for n, _ in panels] == [year.count(), rows.count()]
    assert 0 < year.count() < rows.count() < bars
    assert all("sma50" not in columns for _, columns in panels)
    whole = entry_module.P.with_ranks(entry_module.classify.eligible_only(f.panel()))
    for name in ("rs_percentile_1m", "mfe_pct_10d", "atr_extension"):
        assert sorted(rows.select("ticker", "date", name).collect()) == sorted(whole.select("ticker", "date", name).collect())
    entry_module.forget()


def test_studies_of_all_rows_and_of_a_year_share_a_panel(spark, tmp_path, monkeypatch):
    f = entry_module.Frames(spark, order_lines(spark, tmp_path))
    entry_module.forget()
    f.rows(), f.year()
    alone = [sorted(df.select(*sorted(df.columns)).collect(), key=str) for df in (f.rows(), f.year())]
    columns = sorted(f.rows().columns)
    entry_module.forget()
    seen = staged_rows(monkeypatch)
    f.rows_and_year()
    both = [sorted(df.select(*c).collect(), key=str) for df, c in ((f.rows(), columns), (f.year(), sorted(f.year().columns)))]
    assert [name for name, _, _ in seen].count("panel") == 1 and both == alone
    entry_module.forget()


def test_year_rows_have_the_history_of_all_earlier_rows(spark, tmp_path):
    entry_module.forget()
    f = entry_module.Frames(spark, order_lines(spark, tmp_path))
    names = ["ticker", "date", *entry_module.history.HISTORY_COLUMNS]
    slim = f.panel().select("ticker", "date", "eligible", "atr_extension", "distance_ema10_pct", "distance_ema20_pct")
    want = entry_module.classify.eligible_only(entry_module.history.add_prior_extension_history(slim)).filter("year(date) = 2000")
    got = f.year().select(*names).collect()
    assert sorted(got, key=str) == sorted(want.select(*names).collect(), key=str) and any(r["atr_extension_peak"] is not None for r in got)
    entry_module.forget()


def test_shuffled_files_go_when_a_table_is_staged(spark):
    def left():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(1 for i in range(blocks.size()) if blocks.apply(i).getName().startswith("shuffle_"))

    rows = spark.range(20_000).selectExpr("id % 100 AS ticker", "rand(1) AS x")
    for _ in range(50):  # files of earlier tests' actions may still be going
        before = left()
        time.sleep(0.2)
        if left() == before:
            break
    assert stage(rows.repartition(4, "ticker"), "cleaned").count() == 20_000
    for _ in range(50):
        if left() <= before:
            break
        time.sleep(0.2)
    assert left() <= before
