"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

1. Lengths are counted; a text of a unique length is unique.
2. Of texts that share a length, (length, hash of the first bytes) is counted; a unique pair is a unique text.
3. Only the texts that are left send their content to the full hash (SHA-256), and equal hashes form a group.

Steps 1 and 2 move a few bytes a row. For step 3 Spark drops the settled rows with a runtime Bloom filter at the
scan, so that only surviving content is shuffled. Counts and the kept id are partial aggregates, and the rows
of a large group meet their one summary row in a join that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlattice.llm.common import pruned_joins, staged

PREFIX_CHARS = 64


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: dict | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, and the `carry` columns (name -> expression over docs).

    Null text counts as empty. keep_id is the group's largest id; a null id is below all others, and keep_id is
    null only where all ids of a group are. Rows that repeat an id and its text count in group_size and are kept
    together (they are one document). An empty table gives no rows; other columns of docs are ignored.
    """
    spark, carry = docs.sparkSession, carry or {}
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), *(e.alias(f"carry_{n}") for n, e in carry.items()), text.alias("content"),
        F.octet_length(text).alias("n_bytes"),
    ).withColumn("prefix_key", F.xxhash64("n_bytes", F.substring("content", 1, PREFIX_CHARS)))
    kept_columns = [f"carry_{n}" for n in carry]

    shared_length = rows.groupBy("n_bytes").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("n_bytes")
    by_prefix = staged(
        rows.select("n_bytes", "prefix_key").join(shared_length, "n_bytes", "left_semi")
        .groupBy("prefix_key").agg(F.count(F.lit(1)).alias("n")),
        "exact-prefixes",
    )
    shared_prefix = by_prefix.filter("n > 1").select("prefix_key")

    survivors = rows.join(shared_prefix, "prefix_key", "left_semi").select(
        "doc_id", *kept_columns, "n_bytes", F.sha2("content", 256).alias("full_hash"))
    with pruned_joins(spark):
        hashed = staged(survivors, "exact-hashed")
    groups = hashed.groupBy("full_hash", "n_bytes").agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id"))
    members = hashed.join(groups, ["full_hash", "n_bytes"])
    settled = rows.join(shared_prefix, "prefix_key", "left_anti").select(
        "doc_id", *kept_columns, F.lit(1).cast("long").alias("group_size"), F.col("doc_id").alias("keep_id"))
    columns = ["doc_id", "keep_id", "group_size", *kept_columns]
    return members.select(*columns).unionByName(settled.select(*columns)).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        *(F.col(f"carry_{n}").alias(n) for n in carry),
    )


def op9_exact_dedup(spark, sf_dir):
    from barlattice.llm.common import table

    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    return exact_groups(table(spark, sf_dir, "documents"), carry={"text_sha256": digest})


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
