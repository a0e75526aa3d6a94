"""Landed batches that become visible all at once.

Layout beside a source's plain day folders: <root>/<source>_batches/batch=<id>/date=YYYY-MM-DD/*.parquet, and one commit
record a batch, <root>/<source>_batches/_commits/<id>.json, with a line for each of its days. A batch without a record is
not there for any scan, so a run that is killed between writing and committing shows none of its days; the record is put
in place by one rename, so a committed batch shows all of them. Of several batches with a day the last one committed
counts, and any batch takes the place of a plain day folder.
"""

from __future__ import annotations

import json
import re
import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DAY = re.compile(r"date=(\d{4}-\d{2}-\d{2})")


def file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def path_exists(spark: SparkSession, path: str) -> bool:
    system, hadoop = file_system(spark, path)
    return system.exists(hadoop)


def remove_path(spark: SparkSession, path: str) -> None:
    system, hadoop = file_system(spark, path)
    system.delete(hadoop, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of a folder's entries, by one listing of that folder alone."""
    system, hadoop = file_system(spark, path)
    if not system.exists(hadoop):
        return []
    return [status.getPath().getName() for status in system.listStatus(hadoop)]


def day_folders(spark: SparkSession, path: str) -> list[date]:
    """Days that have a date= folder directly below the path."""
    return sorted(date.fromisoformat(m[1]) for m in map(_DAY.fullmatch, children(spark, path)) if m)


def batches_path(root: str, source: str) -> str:
    return f"{root.rstrip('/')}/{source}_batches"


def _records(spark: SparkSession, root: str, source: str) -> DataFrame | None:
    path = f"{batches_path(root, source)}/_commits"
    return spark.read.schema("batch string, turn long, date date").json(path) if path_exists(spark, path) else None


def live_days(spark: SparkSession, root: str, source: str) -> dict[date, str]:
    """day -> the batch that counts for it; one entry a calendar day."""
    records = _records(spark, root, source)
    if records is None:
        return {}
    last = records.groupBy("date").agg(F.max(F.struct("turn", "batch")).alias("top"))
    return {r["date"]: r["top"]["batch"] for r in last.collect()}


def live_folders(spark: SparkSession, root: str, source: str, within) -> tuple[dict[date, str], list[str]]:
    """The live days, and the folders that hold those for which `within(day)` holds: a batch that counts as a whole is
    one folder, of others each day is."""
    live, base = live_days(spark, root, source), batches_path(root, source)
    if not live:
        return live, []
    size = {r["batch"]: r["n"] for r in _records(spark, root, source).groupBy("batch").agg(F.count(F.lit(1)).alias("n")).collect()}
    mine: dict[str, list[date]] = {}
    for day, batch in live.items():
        if within(day):
            mine.setdefault(batch, []).append(day)
    folders = []
    for batch, days in sorted(mine.items()):
        whole = len(days) == size[batch]
        folders += [f"{base}/batch={batch}"] if whole else [f"{base}/batch={batch}/date={d}" for d in sorted(days)]
    return live, folders


def write_batch(df: DataFrame, root: str, source: str) -> str:
    """Write the rows' days as a batch that no scan sees yet; a day with a large part of all rows is split by size."""
    batch = uuid.uuid4().hex[:16]
    df.hint("rebalance", F.col("date")).write.partitionBy("date").parquet(f"{batches_path(root, source)}/batch={batch}")
    return batch


def commit_batch(spark: SparkSession, root: str, source: str, batch: str) -> list[date]:
    """Make a written batch visible; the days it holds. Committing it again changes nothing."""
    base = batches_path(root, source)
    days = day_folders(spark, f"{base}/batch={batch}")
    records = _records(spark, root, source)
    turn = 1 + ((records.agg(F.max("turn")).first()[0] or 0) if records is not None else 0)
    system, final = file_system(spark, f"{base}/_commits/{batch}.json")
    if days and not system.exists(final):
        _, draft = file_system(spark, f"{base}/_drafts/{batch}.json")
        out = system.create(draft, True)
        out.write(bytearray("".join(json.dumps({"batch": batch, "turn": turn, "date": d.isoformat()}) + "\n" for d in days), "utf-8"))
        out.close()
        system.mkdirs(final.getParent())
        if not system.rename(draft, final):
            raise RuntimeError(f"batch {batch} of {source} could not be committed")
    return days


def publish_days(df: DataFrame, root: str, source: str) -> list[date]:
    """Write and commit: all days of the rows appear together, in place of what was there for them."""
    return commit_batch(df.sparkSession, root, source, write_batch(df, root, source))


def drop_superseded(spark: SparkSession, root: str, source: str) -> int:
    """Remove committed batches none of whose days counts any more (run it when no reader holds an older plan)."""
    records = _records(spark, root, source)
    if records is None:
        return 0
    old = {r["batch"] for r in records.select("batch").distinct().collect()} - set(live_days(spark, root, source).values())
    for batch in sorted(old):
        remove_path(spark, f"{batches_path(root, source)}/batch={batch}")
        remove_path(spark, f"{batches_path(root, source)}/_commits/{batch}.json")
    return len(old)
