"""Pipeline over the documents table: toxicity, line dedup, n-gram Jaccard join, decontamination, mixing.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of docs. Stages read what their predecessor
kept, whole. `run` stores each stage's result below spark.checkpoint.dir and reads it again for the next one.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from barlattice.llm.common import staged, table
from barlattice.llm.decontaminate import contamination
from barlattice.llm.jaccard_join import near_groups
from barlattice.llm.line_dedup import dedup_runs
from barlattice.llm.mixing import mix_sources
from barlattice.llm.toxicity import score_toxicity


def toxicity(spark, docs, sf_dir):
    """Documents that the classifier chain rejects go; documents without text stay."""
    kept = score_toxicity(docs, table(spark, sf_dir, "labels")).filter("NOT rejected")
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def line_dedup(spark, docs, sf_dir):
    """Runs of two or more lines that stand earlier in the corpus are cut; a text that is cut whole goes with its row."""
    cut = dedup_runs(docs).filter("NOT line_stats.emptied")
    return cut.select(*(F.col(f"`{c}`") for c in docs.columns))


def jaccard_join(spark, docs, sf_dir):
    """Of each group of near duplicates the document with the smallest id stays; a row that stands twice stays once."""
    groups = staged(near_groups(docs.select("doc_id", "text")), "pipeline-groups")
    first = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("first_id")).distinct()
    kept = docs.join(first, docs["doc_id"].eqNullSafe(first["first_id"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"])


def decontaminate(spark, docs, sf_dir):
    """Documents that hold a window of a benchmark item go."""
    found = contamination(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    bad = staged(found.filter("contaminated").select(F.col("doc_id").alias("bad_id")).distinct(), "pipeline-contaminated")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]), "left_anti")


def mix(spark, docs, sf_dir):
    """Documents that the mix takes, with how often (copies), and the sizes and target behind it."""
    mixed = mix_sources(docs.select("doc_id", "source", "text")).filter("copies > 0")
    taken = mixed.groupBy(F.col("doc_id").alias("taken_id")).agg(
        *(F.max(c).alias(f"mix_{c}") for c in ("size", "source_size", "target", "copies", "taken")))
    return docs.join(taken, docs["doc_id"].eqNullSafe(taken["taken_id"])).drop("taken_id")


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("benchmark_decontamination", decontaminate),
    ("mixing", mix),
]
ORACLE_SQL = None  # the classifier and the sampling have no SQL form; tests hold each stage against brute force


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
