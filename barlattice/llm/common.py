"""Helpers that several corpus operators share."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlattice.session import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A word of the contracts: ASCII white space parts it, or (second) anything in ASCII but letters and digits.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_PRUNE = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1b",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "2g",
    "spark.sql.optimizer.runtime.bloomFilter.maxNumItems": "4000000",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lowered(text: Column) -> Column:
    """A-Z to lower case, nothing else; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def own_names(docs: DataFrame, **columns: str) -> DataFrame:
    """Only the needed columns, under the operator's own names, so that no further column can clash."""
    return docs.select(*(F.col(f"`{theirs}`").alias(ours) for ours, theirs in columns.items()))


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def pruned_joins(spark: SparkSession):
    """While a job runs: a join with a filtered table drops most other rows, by a runtime Bloom filter, before its shuffle.

    The filter has no false negatives, so results are the same with and without it.
    """
    return _settings(spark, _PRUNE)


def small_batches(spark: SparkSession, size: int = 4 << 20):
    """While a job runs: Arrow batches end at about `size` bytes, so that long texts don't add up in a batch."""
    return _settings(spark, {"spark.sql.execution.arrow.maxBytesPerBatch": str(size)})


def staged(df: DataFrame, name: str) -> DataFrame:
    """Written below spark.checkpoint.dir and read again; lineage ends there."""
    return stage(df, name)


__all__ = ["LOWER", "PLAIN_WORD", "SPACED_WORD", "UPPER", "lowered", "own_names", "pruned_joins", "small_batches", "staged", "table"]
