"""Landed daily files: scans, listing, coverage, incremental ingest.

Own layout:      <root>/<source>/date=YYYY-MM-DD/*.parquet, empty days with full schema; and committed batches
                 (see `batches`), whose days take the place of plain ones.
Foreign layout:  <root>/<source>/year=YYYY/date=YYYY-MM-DD.parquet, possibly without columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import RAW_SOURCES
from ..schemas import BAR_COLUMNS, LANDED, REFERENCE_COLUMNS, VENDOR, VENDOR_RENAMES, conform
from .batches import batches_path, children, day_folders, live_folders, path_exists, publish_days, remove_path

_DATE_IN_PATH = r"date=(\d{4}-\d{2}-\d{2})"


def source_path(root: str, source: str) -> str:
    return f"{root.rstrip('/')}/{source}"


def _date_of(path: Column) -> Column:
    return F.to_date(F.regexp_extract(path, _DATE_IN_PATH, 1))


def _between(df: DataFrame, start, end) -> DataFrame:
    if start is not None:
        df = df.filter(F.col("date") >= F.lit(start))
    if end is not None:
        df = df.filter(F.col("date") <= F.lit(end))
    return df


def _missing_as_null(df: DataFrame) -> DataFrame:
    """NaN doubles become NULL here, once, so that no later comparison meets a NaN."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({n: F.nanvl(n, F.lit(None).cast("double")) for n in doubles}) if doubles else df


def _with_date(schema: T.StructType) -> T.StructType:
    return T.StructType(list(schema.fields) + [T.StructField("date", T.DateType())])


def _within(day: date, start, end) -> bool:
    return (start is None or day >= start) and (end is None or day <= end)


def _day_paths(spark: SparkSession, root: str, source: str, start, end) -> list[tuple[str, list[str]]]:
    """(base, folders) to read for the days in range: plain days that no batch replaces, and the batches' days.

    One listing of the source's folder finds the days; folders out of range are not opened. A source without batches
    and without bounds is read as a whole.
    """
    path, out = source_path(root, source), []
    live, folders = live_folders(spark, root, source, lambda d: _within(d, start, end))
    if path_exists(spark, path):
        if start is None and end is None and not live:
            return [(path, [path])]
        there = day_folders(spark, path)
        days = [d for d in there if _within(d, start, end) and d not in live]
        if days and 2 * len(days) >= len(there) and not live.keys() & set(there):
            out.append((path, [path]))  # most of the folder: listed as one, and cut by the filter on the date
        elif days:
            out.append((path, [f"{path}/date={d}" for d in days]))
    if folders:
        out.append((batches_path(root, source), folders))
    return out


def scan_landed(spark: SparkSession, root: str, source: str, start=None, end=None) -> DataFrame:
    """One source's days in [start, end]; only those date directories are listed and opened."""
    schema, out = _with_date(LANDED[source]), None
    for base, folders in _day_paths(spark, root, source, start, end):
        df = spark.read.schema(schema).option("basePath", base).parquet(*folders).select(*schema.fieldNames())
        out = df if out is None else out.unionByName(df)
    if out is None:
        return spark.createDataFrame([], schema)
    return _missing_as_null(_between(out, start, end))


def scan_bars(spark: SparkSession, root: str, start=None, end=None) -> DataFrame:
    """Adjusted bars."""
    df = scan_landed(spark, root, "grouped_daily", start, end)
    return conform(df, BAR_COLUMNS)


def scan_unadjusted(spark: SparkSession, root: str, start=None, end=None) -> DataFrame:
    df = scan_landed(spark, root, "grouped_daily_unadjusted", start, end)
    return df.select("date", "ticker", F.col("close").alias("close_unadjusted"))


def scan_reference(spark: SparkSession, root: str, start=None, end=None) -> DataFrame:
    """Ticker list as of each date."""
    return conform(scan_landed(spark, root, "reference_tickers", start, end), REFERENCE_COLUMNS)


def scan_members(spark: SparkSession, root: str, start=None, end=None, index_id: str = "QQQ") -> DataFrame:
    df = scan_landed(spark, root, "qqq_constituents", start, end)
    return df.select(F.lit(index_id).alias("index_id"), "date", "constituent_ticker", "weight")


def scan_shares(spark: SparkSession, path: str) -> DataFrame:
    """Shares outstanding as known on the first of each month: (ticker, bucket_month, shares)."""
    return spark.read.schema("ticker string, bucket_month date, shares double").parquet(path)


def _file_paths(spark: SparkSession, root: str, source: str, start, end) -> list[str]:
    """Folders (or files) to list for the range, in the own or in the foreign layout."""
    path = source_path(root, source)
    names = children(spark, path)
    years = [c for c in names if c.startswith("year=") and _within(date(int(c[5:]), 12, 31), start, None) and _within(date(int(c[5:]), 1, 1), None, end)]
    flat = [c for c in names if c.startswith("date=") and c.endswith(".parquet") and _within(date.fromisoformat(c[5:15]), start, end)]
    if any(c.startswith("year=") or c.endswith(".parquet") for c in names):
        return [f"{path}/{c}" for c in years + flat]
    return [f for _, folders in _day_paths(spark, root, source, start, end) for f in folders]


def landed_files(spark: SparkSession, root: str, source: str, start=None, end=None) -> DataFrame:
    """(date, path, length, modified) of every file of a source's days, empty ones included; contents are not read, and
    folders of days (or years) out of range are not listed."""
    paths = _file_paths(spark, root, source, start, end)
    if not paths:
        return spark.createDataFrame([], "date date, path string, length long, modified timestamp")
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet").load(paths)
        .select(_date_of(F.col("path")).alias("date"), "path", "length", F.col("modificationTime").alias("modified"))
    )
    return _between(files.filter(F.col("date").isNotNull()), start, end)


def landed_dates(spark: SparkSession, root: str, source: str, start=None, end=None) -> DataFrame:
    """Dates with at least one file."""
    return landed_files(spark, root, source, start, end).select("date").distinct()


def raw_manifest(spark: SparkSession, root: str, start=None, end=None, sources=RAW_SOURCES) -> DataFrame:
    """(source, date, row_count) per landed day; 0 rows is a landed day, a missing day has no row."""
    out = None
    for source in sources:
        rows = scan_landed(spark, root, source, start, end).groupBy("date").agg(F.count(F.lit(1)).alias("k"))
        one = landed_dates(spark, root, source, start, end).join(rows, "date", "left").select(
            F.lit(source).alias("source"), "date", F.coalesce("k", F.lit(0)).alias("row_count")
        )
        out = one if out is None else out.unionByName(one)
    return out


def candidate_weekdays(spark: SparkSession, start: date, end: date) -> DataFrame:
    """Monday to Friday in [start, end], holidays included."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("date"))
    return days.filter(F.weekday("date") < 5)


def coverage_gaps(calendar: DataFrame, manifest: DataFrame) -> DataFrame:
    """Candidate days without a landed file, per source listed in the manifest's sources."""
    sources = F.array(*[F.lit(s) for s in RAW_SOURCES])
    wanted = calendar.select(F.explode(sources).alias("source"), "date")
    return wanted.join(manifest.select("source", "date"), ["source", "date"], "left_anti")


def write_days(df: DataFrame, root: str, source: str) -> None:
    """Write rows as day directories, replacing just the days that occur in them.

    Rows are rebalanced by date: a day holding a large part of all rows is split over
    several tasks by size, and small days share a task.
    """
    (
        df.hint("rebalance", F.col("date"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("date").parquet(source_path(root, source))
    )


def write_empty_day(spark: SparkSession, root: str, source: str, day: date) -> None:
    """A landed day without rows: a file with the full schema, so later scans still work."""
    empty = spark.createDataFrame([], LANDED[source])
    empty.coalesce(1).write.mode("overwrite").parquet(f"{source_path(root, source)}/date={day.isoformat()}")


def ingest_days(incoming: DataFrame, root: str, source: str, force: bool = False) -> dict[str, int]:
    """Land only the days not landed yet (all of them with `force`), all at once; counts of days."""
    spark = incoming.sparkSession
    done = landed_dates(spark, root, source)
    days = incoming.select("date").distinct().join(done.withColumn("known", F.lit(1)), "date", "left")
    known, fresh = days.agg(F.count("known"), F.count_if(F.col("known").isNull())).first()
    todo = incoming if force else incoming.join(F.broadcast(done), "date", "left_anti")  # calendar-sized
    if force or fresh:
        publish_days(todo, root, source)
    return {"landed": fresh + (known if force else 0), "skipped_existing": 0 if force else known}


# --- foreign layout ---------------------------------------------------------------


def _columns_of(batches: Iterator) -> Iterator:
    """path -> number of columns, from the files' footers."""
    import io

    import pandas as pd
    import pyarrow.parquet as pq

    for pdf in batches:
        n = [pq.ParquetFile(io.BytesIO(bytes(b))).metadata.num_columns for b in pdf["content"]]
        yield pd.DataFrame({"path": pdf["path"], "n_columns": n})


FOOTER_BYTES = 1 << 20


def columnless_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Paths of files that hold no columns, as their footers say.

    Such a file is its footer and nothing else, so only files of at most FOOTER_BYTES are opened; the length is known
    from the listing, and larger files are never read.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(paths)
        .filter(F.col("length") <= FOOTER_BYTES).select("path", "content")
    )
    return files.mapInPandas(_columns_of, "path string, n_columns long").filter("n_columns = 0").select("path")


@contextmanager
def case_sensitive(spark: SparkSession):
    """Vendor bar files have both `T` and `t`; reading them needs case-sensitive names."""
    key = "spark.sql.caseSensitive"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def scan_foreign(spark: SparkSession, root: str, source: str, start=None, end=None) -> DataFrame:
    """Vendor day files, dated by file name, with tidy column names; run it under `case_sensitive`.

    Files without columns are empty days and skipped. The list of files is one entry per
    day, so it is small enough for the driver.
    """
    schema, paths = VENDOR[source], _file_paths(spark, root, source, start, end)
    if not paths:
        return spark.createDataFrame([], _with_date(LANDED[source]))
    files = landed_files(spark, root, source, start, end)
    good = [r["path"] for r in files.join(columnless_files(spark, paths), "path", "left_anti").select("path").collect()]
    if not good:
        return spark.createDataFrame([], _with_date(LANDED[source]))
    df = spark.read.schema(schema).parquet(*good).withColumn("date", _date_of(F.col("_metadata.file_name")))
    names = {c: VENDOR_RENAMES.get(c, c) for c in schema.fieldNames()} if schema is not LANDED[source] else {}
    return _missing_as_null(df.select(*[F.col(c).alias(names.get(c, c)) for c in schema.fieldNames()], "date"))


def ingest_foreign(
    spark: SparkSession, vendor_root: str, root: str, source: str, start=None, end=None, force: bool = False
) -> dict[str, int]:
    """Land vendor day files in the own layout; days without rows become landed empty days."""
    with case_sensitive(spark):
        rows = scan_foreign(spark, vendor_root, source, start, end)
        result = ingest_days(rows, root, source, force)
    present = landed_dates(spark, vendor_root, source, start, end)
    empty = present.join(landed_dates(spark, root, source), "date", "left_anti").orderBy("date").collect()
    for r in empty:  # one entry per empty calendar day
        write_empty_day(spark, root, source, r["date"])
    return {**result, "empty_days": len(empty)}


def foreign_manifest(spark: SparkSession, root: str, source: str, start=None, end=None) -> DataFrame:
    """(source, date, row_count) of a vendor folder; run it under `case_sensitive`."""
    rows = scan_foreign(spark, root, source, start, end).groupBy("date").agg(F.count(F.lit(1)).alias("k"))
    return landed_dates(spark, root, source, start, end).join(rows, "date", "left").select(
        F.lit(source).alias("source"), "date", F.coalesce("k", F.lit(0)).alias("row_count")
    )


# --- what has changed -------------------------------------------------------------

MARKS = "source string, date date, files_key decimal(38,0), row_count long, content_key decimal(38,0)"


def _key_sum(*columns) -> Column:
    """A sum of row hashes: the same for the same rows in any order, with repeats counted."""
    return F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))


def changed_days(spark: SparkSession, root: str, sources, known: DataFrame | None = None) -> DataFrame:
    """Each landed day with its marks and how it differs from `known` marks: same, new, changed or gone.

    Listings alone show which days have other files than before; only those days' rows are read, and a day whose files
    were written again with the same rows is the same.
    """
    known = spark.createDataFrame([], MARKS) if known is None else known.select(*(c.split(" ")[0] for c in MARKS.split(", ")))
    listed = None
    for source in sources:
        files = landed_files(spark, root, source).groupBy("date").agg(_key_sum("path", "length", "modified").alias("files_key"))
        one = files.select(F.lit(source).alias("source"), "date", "files_key")
        listed = one if listed is None else listed.unionByName(one)
    old = known.select("source", "date", *(F.col(c).alias(f"old_{c}") for c in ("files_key", "row_count", "content_key")))
    met = listed.join(old, ["source", "date"], "full")
    stale = met.filter("files_key IS NOT NULL AND NOT files_key <=> old_files_key")
    days = {s: [r["date"] for r in stale.filter(F.col("source") == s).select("date").collect()] for s in sources}  # calendar days
    read = None
    for source, todo in days.items():
        if todo:
            rows = scan_landed(spark, root, source, min(todo), max(todo)).filter(F.col("date").isin(todo))
            one = rows.groupBy("date").agg(F.count(F.lit(1)).alias("row_count"), _key_sum(*LANDED[source].fieldNames()).alias("content_key"))
            one = one.select(F.lit(source).alias("source"), "date", "row_count", "content_key")
            read = one if read is None else read.unionByName(one)
    if read is None:
        read = spark.createDataFrame([], "source string, date date, row_count long, content_key decimal(38,0)")
    out = met.join(read, ["source", "date"], "left")
    stale = F.col("files_key").isNotNull() & ~F.col("files_key").eqNullSafe(F.col("old_files_key"))
    rows, content = (F.when(stale, F.coalesce(c, F.lit(0))).otherwise(F.col(f"old_{c}")) for c in ("row_count", "content_key"))
    change = (
        F.when(F.col("files_key").isNull(), "gone").when(F.col("old_files_key").isNull(), "new")
        .when(rows.eqNullSafe(F.col("old_row_count")) & content.eqNullSafe(F.col("old_content_key")), "same").otherwise("changed")
    )
    return out.select("source", "date", "files_key", rows.cast("long").alias("row_count"), content.cast("decimal(38,0)").alias("content_key"),
                      change.alias("change"))
