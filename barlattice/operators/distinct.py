"""Exact distinct counts that merge: bitmaps over dense numbers, from day to month to year or over any coarser key.

A number's bitmap is kept in buckets of 32,768 numbers (4 KB), so a set of entities costs 4 KB for each bucket it touches.
Bitmaps of finer groups are or-ed into those of coarser ones; nothing goes back to the rows, and no row is expanded for a
second distinct count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECE = 16_384


def numbered(entities: DataFrame, column: str) -> DataFrame:
    """(column, number) for each distinct non-null entity: dense enough for bitmaps, and numbered in many tasks at once.

    Entities are dealt to pieces of about PIECE by a hash and numbered within them; a piece owns twice that many numbers,
    and one that holds more (a hash can't be that uneven) would run into the next one's, so that is refused.
    """
    distinct = entities.filter(F.col(column).isNotNull()).select(column).distinct()
    pieces = -(-distinct.count() // PIECE) or 1
    piece = F.pmod(F.xxhash64(column), F.lit(pieces))
    turn = F.row_number().over(Window.partitionBy("_piece").orderBy(column))
    fits = F.when(turn <= 2 * PIECE, turn - 1).otherwise(F.raise_error(F.lit("too many entities in a piece")).cast("int"))
    return distinct.withColumn("_piece", piece).select(column, (F.col("_piece") * 2 * PIECE + fits).cast("long").alias("number"))


def bitmaps(rows: DataFrame, keys: list, number: str = "number", **sums: Column) -> DataFrame:
    """One row per group and bucket of numbers: its bitmap `bits`, and the given sums (of the bucket's rows)."""
    return rows.groupBy(*keys, F.bitmap_bucket_number(number).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits"), *[F.sum(e).alias(n) for n, e in sums.items()])


def merged(maps: DataFrame, keys: list) -> DataFrame:
    """Bitmaps of coarser groups."""
    return maps.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def counted(maps: DataFrame, keys: list, name: str = "n", sums: tuple[str, ...] = ()) -> DataFrame:
    """Distinct count of each group, and the sums of its buckets added up."""
    return maps.groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias(name), *[F.sum(s).alias(s) for s in sums])
