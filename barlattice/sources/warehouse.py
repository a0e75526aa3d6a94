"""Processed tables partitioned by year, their lineage records, and report files."""

from __future__ import annotations

import zlib
from contextlib import contextmanager
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import PROCESSED_TABLES
from .batches import children, path_exists, remove_path

LINEAGE = (
    "table string, status string, build_timestamp_utc string, data_start string, data_end string, "
    "config_version int, code_commit_hash string, source string, feature_definition_version string, error string"
)


@contextmanager
def _dynamic_overwrite(spark: SparkSession):
    key = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(key, "static")
    spark.conf.set(key, "dynamic")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Warehouse:
    """A root folder with <table>/year=YYYY data, <table>/_lineage records and reports.

    With `buckets`, tables that have tickers are stored in that many buckets by ticker, sorted by (ticker, date). Two such
    tables then join on (ticker, date) without moving a row (read them under `session.joined_by_entity`). The number is a
    property of the stored tables: choose it for their size at full length (a bucket of one year at 100 to 200 MB), and
    open them with the same number each time. The layout is given to Spark as an external table over the folder, which
    every session sets up for itself.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def path(self, table: str) -> str:
        if table not in PROCESSED_TABLES:
            raise KeyError(f"unknown table {table!r}; known: {list(PROCESSED_TABLES)}")
        return f"{self.root}/{table}"

    def write(self, table: str, df: DataFrame, cluster_by: str = "ticker", years=None, laid_out: bool = False) -> dict:
        """Replace the years that occur in `df` and no others; of the given `years`, those without rows go.

        Rows are rebalanced by year and a hash of the ticker and sorted inside files:
        per-ticker reads skip row groups, large pieces are split by size, small ones merged.
        `laid_out` says that each task already holds whole tickers: then the tasks write their years as they are, and the
        wide rows need not be shuffled again.
        What the rows hold is observed while they are written: their number, the first and last date, and how many lack
        each column. Nothing is read again for it.
        """
        seen = Observation()
        held = [c for c in df.columns if c not in ("date", cluster_by)]
        out = df.observe(
            seen, F.count(F.lit(1)).alias("rows"), F.min("date").alias("first"), F.max("date").alias("last"),
            F.collect_set(F.year("date")).alias("years"), *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in held],
        ).withColumn("year", F.year("date"))
        order = [c for c in (cluster_by, "source", "date") if c in df.columns]
        if self.buckets and cluster_by in df.columns:
            name = self._registered(table, df, cluster_by)
            laid_out = out.repartition(self.buckets, cluster_by).sortWithinPartitions("year", *order)
            with _dynamic_overwrite(self.spark):
                laid_out.write.mode("overwrite").insertInto(name)
        else:
            if laid_out:
                pass
            elif cluster_by in df.columns:
                out = out.withColumn("_piece", F.pmod(F.xxhash64(cluster_by), F.lit(1024)))
                out = out.hint("rebalance", F.col("year"), F.col("_piece")).drop("_piece")
            else:
                out = out.hint("rebalance", F.col("year"))
            (
                out.sortWithinPartitions("year", *order)
                .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
                .partitionBy("year").parquet(f"{self.path(table)}/data")
            )
        found = dict(seen.get)
        for name in children(self.spark, f"{self.path(table)}/data") if years is not None else ():
            if name.startswith("year=") and int(name[5:]) in set(years) - set(found["years"]):
                remove_path(self.spark, f"{self.path(table)}/data/{name}")
                if self.buckets and cluster_by in df.columns:
                    self.spark.sql(f"ALTER TABLE {self._registered(table)} DROP IF EXISTS PARTITION ({name})")
        return found

    def _registered(self, table: str, like: DataFrame | None = None, cluster_by: str = "ticker") -> str:
        """Name of the external table that tells Spark how the folder is laid out."""
        name = f"{table}_{zlib.crc32(self.root.encode()):08x}_{self.buckets}"
        path = f"{self.path(table)}/data"
        if not self.spark.catalog.tableExists(name):
            like = self.spark.read.parquet(path).drop("year") if like is None else like
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema.fields)
            self.spark.sql(
                f"CREATE TABLE {name} ({columns}, year int) USING parquet PARTITIONED BY (year) "
                f"CLUSTERED BY ({cluster_by}) SORTED BY ({cluster_by}, date) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        if path_exists(self.spark, path):  # years that other sessions have stored
            self.spark.catalog.recoverPartitions(name)
            self.spark.catalog.refreshTable(name)
        return name

    def read(self, table: str, years=None) -> DataFrame | None:
        """The table, or only some of its year directories; None when it was never built."""
        path = f"{self.path(table)}/data"
        if not path_exists(self.spark, path):
            return None
        df = self.spark.read.parquet(path)
        if self.buckets and "ticker" in df.columns:
            df = self.spark.table(self._registered(table))
        if years is not None:
            df = df.filter(F.col("year").isin(*[int(y) for y in years]))
        return df.drop("year")

    def write_state(self, name: str, df: DataFrame, by_year: bool = False) -> None:
        """Keep what a later run goes on from: the years in `df` (by_year), or all of it, in place of what was kept."""
        out = df.write.mode("overwrite")
        if by_year:
            out = out.option("partitionOverwriteMode", "dynamic").partitionBy("year")
        out.parquet(f"{self.root}/_state/{name}")

    def read_state(self, name: str) -> DataFrame | None:
        path = f"{self.root}/_state/{name}"
        return self.spark.read.parquet(path) if path_exists(self.spark, path) else None

    def write_lineage(
        self, table: str, start: date, end: date, source: str, commit: str = "unknown",
        config_version: int = 1, definition_version: str = "v1", error: str | None = None,
    ) -> None:
        """One row saying what was built from what; status "unavailable" when it could not be."""
        row = (
            table, "unavailable" if error else "available", datetime.now(timezone.utc).isoformat(),
            start.isoformat(), end.isoformat(), config_version, commit, source, definition_version, error,
        )
        self.spark.createDataFrame([row], LINEAGE).coalesce(1).write.mode("overwrite").json(
            f"{self.path(table)}/_lineage"
        )

    def write_missing(self, table: str, seen: dict) -> None:
        """Rows and missing values of each column of the last build, as its write observed them."""
        rows = [(table, k.removeprefix("missing_"), int(v), int(seen["rows"])) for k, v in seen.items() if k.startswith("missing_")]
        self.spark.createDataFrame(rows, "table string, column string, n_missing long, n_rows long").coalesce(1).write.mode("overwrite").json(
            f"{self.path(table)}/_missing")

    def read_missing(self, table: str) -> DataFrame | None:
        path = f"{self.path(table)}/_missing"
        schema = "table string, column string, n_missing long, n_rows long"
        return self.spark.read.schema(schema).json(path) if path_exists(self.spark, path) else None

    def read_lineage(self, table: str) -> DataFrame | None:
        path = f"{self.path(table)}/_lineage"
        return self.spark.read.schema(LINEAGE).json(path) if path_exists(self.spark, path) else None

    def write_report(self, report: str, tables: dict[str, DataFrame], summary: DataFrame | None = None) -> None:
        """Each table as Parquet and CSV, the summary rows as JSON, under the report's own folder."""
        base = f"{self.root}/reports/{report}"
        for name, df in tables.items():
            df.coalesce(1).write.mode("overwrite").parquet(f"{base}/parquet/{name}")
            self.spark.read.parquet(f"{base}/parquet/{name}").coalesce(1).write.mode("overwrite").option(
                "header", True
            ).csv(f"{base}/csv/{name}")
        if summary is not None:
            summary.coalesce(1).write.mode("overwrite").json(f"{base}/summary")
