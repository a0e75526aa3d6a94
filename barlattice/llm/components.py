"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlattice.llm.common import staged
from barlattice.session import drop_staged


def _starred(links: DataFrame) -> DataFrame:
    """Large star: larger neighbours of u move to u's smallest neighbour (or u)."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    low = staged(low, "star-low")
    moved = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    moved = staged(moved, "large-star")
    drop_staged(low)
    return moved


def _small(links: DataFrame) -> DataFrame:
    """Small star over links with u > v: u and its smaller neighbours move to the smallest."""
    low = staged(links.groupBy("u").agg(F.min("v").alias("m")), "star-small")
    met = links.join(low, "u")
    moved = met.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    moved = staged(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small-star")
    drop_staged(low)
    return moved


def _stars(links: DataFrame) -> bool:
    """Whether every node is only a center, or points to one node alone: nothing would move any more."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        links.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    ends = ends.groupBy("node").agg(F.sum("out").alias("out"), F.sum("into").alias("into"))
    return ends.filter("out > 1 OR out > 0 AND into > 0").agg(F.count(F.lit(1))).first()[0] == 0


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node in links (u, v: non-null longs); each round is a stored table
    (dropped when the next is there), and so is the result.

    Self links are ignored; an empty table gives no rows. Rounds grow with the logarithm of the longest path.
    """
    now = staged(
        links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while not _stars(now):
        large = _starred(now)
        drop_staged(now)
        now = _small(large)
        drop_staged(large)
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    out = staged(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "components")
    drop_staged(now)
    return out
