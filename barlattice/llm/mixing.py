"""Mixing sources to target weights by the cube method.

A source's rate is target / size, from 0 to 3. Its whole part is taken of every document; its fraction is the
inclusion probability of one copy more. The flight phase moves these probabilities along vectors of the null space
of the two balancing constraints (words and documents taken), so both totals stay as they are while one probability
after the other becomes 0 or 1. With three undecided documents in hand the null space is one vector, the cross
product of the constraint rows, so each step is a few operations. A block of documents ends with two undecided at
most; undecided documents of many blocks meet in the next round, until one block per source is left. The landing
problem there has two or three documents: all of its outcomes are weighed and the nearest total wins.

Blocks are dealt by a hash of the id, sized by count, so a source with a third of all rows is many tasks.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlattice.llm.common import SPACED_WORD, staged

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3.0
BLOCK_ROWS = 20_000
_EDGE = 1e-9


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target of each source (one row each) from rows (source, size).

    Sources in code point order, null last, take the weights in turn. The targets share the total of all sizes and
    stop at max_epochs times their source; what is over is shared again by weight. In the order of cap / weight the
    capped sources come first, so the last common factor is that of the first source which its factor doesn't cap.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source from here on
    pick = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("k") % len(weights) + 1).cast("int"))
    weighed = totals.withColumn("k", F.row_number().over(order) - 1).withColumn("weight", pick)
    weighed = weighed.withColumn("cap", max_epochs * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "k")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    factor = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    found = weighed.withColumn("factor", factor)
    found = found.withColumn("open_factor", F.when(F.col("cap") >= F.col("factor") * F.col("weight"), F.col("factor")))
    first = F.first("open_factor", ignorenulls=True).over(everything)
    return found.withColumn("target", F.least("cap", first * F.col("weight"))).select("source", "source_size", "target")


def flight(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight phase: all but two at most are 0 or 1, and sum(p) and sum(p * size) are kept."""
    p, draws = p.astype(float).copy(), iter(())
    hand: list[int] = []
    for i in range(len(p)):
        if not _EDGE < p[i] < 1 - _EDGE:
            continue
        hand.append(i)
        if len(hand) < 3:
            continue
        a, b, c = hand
        u = [size[b] - size[c], size[c] - size[a], size[a] - size[b]]
        if not any(u):
            u = [1.0, -1.0, 0.0]
        up = min(((1 - p[k]) / v if v > 0 else -p[k] / v) for k, v in zip(hand, u) if v)
        down = min((p[k] / v if v > 0 else (p[k] - 1) / v) for k, v in zip(hand, u) if v)
        draw = next(draws, None)
        if draw is None:
            draws = iter(rng.random(4096).tolist())
            draw = next(draws)
        step = up if draw * (up + down) < down else -down
        for k, v in zip(hand, u):
            p[k] += step * v
            if p[k] < _EDGE:
                p[k] = 0.0
            elif p[k] > 1 - _EDGE:
                p[k] = 1.0
        hand = [k for k in hand if 0 < p[k] < 1]
    return p


def landing(size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """0 or 1 for the few undecided: the outcome nearest to the words, then to the documents, that are due."""
    left = [i for i in range(len(p)) if 0 < p[i] < 1]
    due_words, due_docs = sum(p[i] * size[i] for i in left), sum(p[i] for i in left)
    best = min(
        itertools.product((0.0, 1.0), repeat=len(left)),
        key=lambda x: (abs(sum(s * size[i] for s, i in zip(x, left)) - due_words), abs(sum(x) - due_docs), x),
    )
    p = p.copy()
    p[left] = best
    return p


def _decider(last: bool, level: int, seed: int):
    def decide(block: pa.Table) -> pa.Table:
        block = block.sort_by([("size", "descending"), ("doc_id", "ascending")])
        size = block["size"].to_numpy().astype(float)
        rng = np.random.default_rng([seed, level, len(size), int(size.sum()) % (1 << 60)])
        p = flight(size, block["p"].to_numpy(), rng)
        p = landing(size, p) if last else p
        return block.select(["doc_id", "source", "size"]).append_column("p", pa.array(p))

    return decide


def balanced_sample(rows: DataFrame, block_rows: int = BLOCK_ROWS, seed: int = 0) -> DataFrame:
    """rows (doc_id, source, size, p) with p decided, 0 or 1, balanced on words and documents within each source."""
    schema = "doc_id long, source string, size long, p double"
    done, undecided, level = [], rows.select("doc_id", "source", "size", "p"), 0
    while True:
        n_blocks = undecided.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks"))
        last = not n_blocks.filter("blocks > 1").head(1)
        key = F.pmod(F.xxhash64("doc_id", "size", F.lit(seed + level)), F.col("blocks"))
        dealt = undecided.withColumn("source_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
        n_blocks = n_blocks.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("source_key"), "blocks")
        dealt = dealt.join(n_blocks, "source_key").withColumn("block", key)

        moved = staged(dealt.groupBy("source_key", "block").applyInArrow(_decider(last, level, seed), schema), f"mix-{level}")
        done.append(moved.filter("p = 0 or p = 1"))
        if last:
            break
        undecided, level = moved.filter("p > 0 and p < 1"), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def mix_sources(docs: DataFrame, weights=WEIGHTS, max_epochs: float = MAX_EPOCHS, block_rows: int = BLOCK_ROWS, seed: int = 0) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies, taken (copies * size).

    A null text has size 0; a null source is a source of its own, last in order; null ids are documents too.
    Sizes of 0 get no target of their own: a source without words has target 0 and copies 0. Rows that repeat
    (also with the same id) are decided one by one. An empty table gives no rows. Other columns are ignored.
    The draw depends on ids, sizes and the seed only, so reruns agree.
    """
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(SPACED_WORD)).cast("long")
    rows = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size")), "mix-sizes")
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))
    targets = staged(source_targets(rows, weights, max_epochs).withColumn("source_key", key), "mix-targets").drop("source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(F.col("rate") + _EDGE)
    rated = rows.withColumn("source_key", key).join(targets, "source_key").withColumn("rate", rate)
    p = F.greatest(F.col("rate") - whole, F.lit(0.0))
    sample = balanced_sample(rated.withColumn("p", F.when(p < _EDGE, 0.0).otherwise(p)), block_rows, seed)
    out = sample.withColumn("source_key", key).join(targets, "source_key").withColumn("rate", rate)
    copies = (whole + F.col("p")).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op6_mix_sources(spark, sf_dir):
    from barlattice.llm.common import table

    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
