"""Substring dedup of word windows with a count-min prefilter.

A window (13 words) is represented in the sketch by its anchor: the smallest hash of the 5-word grams in it. Neighbouring
windows share anchors, so the sketch holds about a fifth of the windows' number; each appearance of an anchor in a
document counts once, hence a window's count is at most its anchor's count, which the sketch never underestimates.

1. Every partition fills a sketch of the anchors of its documents; Spark merges the sketches block by block.
2. A second pass emits (window hash, document, position) only for windows whose anchor may be repeated, and groups
   them exactly: the smallest document of each window, from partial aggregates.
3. Windows that started in a smaller document cover the words that go.

The sketch is sized by the input up to MAX_CELLS counters (two bits each when sent); beyond that size it lets more
windows through to the exact pass and still loses none. Both passes read Arrow batches bounded by bytes and work on small
slices of them; the sketch leaves executors and workers as soon as the windows are stored. A common passage is one summary row per window; the join with
its many places is split by adaptive execution.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlattice.llm.common import pruned_joins, small_batches, staged, table
from barlattice.llm.sketch import Filling, at_least_two, cells_for, few_tasks, merged
from barlattice.llm.textbytes import Words, pieces, signed

WINDOW, GRAM = 13, 5
MAX_CELLS = 1 << 28
_SLICE = 1 << 18  # bytes of text at once
_NO_ID = -(1 << 63)  # a null id is below all others


def _anchors(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts, their anchors, and where an anchor differs from the window's before (or the text does)."""
    start, grams = words.grams(gram)
    at_word = np.zeros(len(words.start) + 1, np.int64)
    at_word[start] = np.arange(len(start))
    starts, _ = words.grams(window)
    if not len(starts):
        return starts, np.zeros(0, np.uint64), np.zeros(0, bool)
    low, width, span = grams, 1, window - gram + 1
    while width * 2 <= span:
        low = np.minimum(low, np.concatenate([low[width:], low[-1:].repeat(width)])[: len(low)])
        width *= 2
    g = at_word[starts]
    anchor = np.minimum(low[g], low[g + span - width])
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (np.diff(starts) != 1)
    return starts, anchor, new


def repeated_sketch(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, max_cells: int = MAX_CELLS) -> tuple[np.ndarray, int]:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = cells_for(size / 30, 5, max_cells)

    def fill(batches):
        filling = Filling(cells)
        for batch in pieces(batches, most=_SLICE):
            _, anchor, new = _anchors(Words(batch.column("text")), window, gram)
            filling.add(anchor[new])
        for block, counters in filling.blocks():
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "counters": pa.array([counters], pa.binary())})

    return merged(few_tasks(docs.select("text")).mapInArrow(fill, "block int, counters binary"), cells), cells


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, max_cells: int = MAX_CELLS) -> tuple[DataFrame, Broadcast]:
    """doc_id, pos: first words of windows that also start in a document with a smaller id (docs: doc_id, text); and the
    sketch they are found with, which the caller destroys once they are stored."""
    sketch, cells = repeated_sketch(docs, window, gram, max_cells)
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def emit(batches):
        for batch in pieces(batches, most=_SLICE):
            words = Words(batch.column("text"))
            starts, anchor, _ = _anchors(words, window, gram)
            starts = starts[at_least_two(shared.value, anchor, cells)]
            doc = np.searchsorted(words.first, starts, "right") - 1
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_pydict({
                "window": pa.array(signed(words.spans(starts, starts + window))), "doc_id": pa.array(ids[doc]),
                "pos": pa.array((starts - words.first[doc]).astype(np.int32))})

    found = docs.mapInArrow(emit, "window long, doc_id long, pos int")
    first = found.groupBy("window").agg(F.min("doc_id").alias("first"))
    return found.join(first, "window").filter("doc_id > first").select("doc_id", "pos"), shared


_CUT = "given_id long, doc_id long, n_words long, n_removed long, kept string"


def _cutter(window: int):
    """Rows (given_id, doc_id, text, gone: window starts or null) to counts and the words that stay."""

    def cut(batches):
        for batch in pieces(batches, most=_SLICE):
            words = Words(batch.column("text"))
            at = batch.column("gone")
            number = at.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            covered = np.zeros(len(words.start) + 1, np.int64)
            begin = np.repeat(words.first[:-1], number) + at.flatten().to_numpy(zero_copy_only=False)
            np.add.at(covered, begin, 1)
            np.add.at(covered, begin + window, -1)
            removed = np.cumsum(covered)[:-1] > 0
            kept, n_removed = [], []
            for low, high in zip(words.first[:-1], words.first[1:]):
                stays = np.flatnonzero(~removed[low:high]) + low
                kept.append(b" ".join(words.data[s:e].tobytes() for s, e in zip(words.start[stays], words.end[stays])))
                n_removed.append(int(high - low - len(stays)))
            yield pa.RecordBatch.from_pydict({
                "given_id": batch.column("given_id"), "doc_id": batch.column("doc_id"), "n_words": pa.array(words.counts.astype(np.int64)),
                "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    return cut


def cut_repeats(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, max_cells: int = MAX_CELLS,
    finish: Callable[[Column], Column] = lambda kept: kept,
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept (the words that stay, joined by one space).

    Words are parted by ASCII white space and compared as bytes. Null text has no words (kept is empty). A text of
    fewer words than a window stays. Null ids are below all others; rows that repeat an id are one document,
    so they don't remove each other's words. An empty table gives no rows; other columns are ignored.

    `finish` is applied to kept before rows move, so a caller that needs a digest moves no text of untouched documents;
    touched ones are joined with their windows behind a runtime Bloom filter.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("given_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), "text")
    with small_batches(docs.sparkSession):
        gone, sketch = repeated_windows(rows.select("doc_id", "text"), window, gram, max_cells)
        gone = staged(gone.groupBy("doc_id").agg(F.collect_list("pos").alias("gone"), F.lit(1).alias("listed")), "substring-gone")
    sketch.destroy()
    out = lambda df: df.select("doc_id", F.col("given_id"), "n_words", "n_removed", finish(F.col("kept")).alias("kept"))
    with pruned_joins(docs.sparkSession), small_batches(docs.sparkSession):
        met = rows.join(gone.filter("listed > 0").select("doc_id", "gone"), "doc_id").select("given_id", "doc_id", "text", "gone")
        touched = staged(out(met.mapInArrow(_cutter(window), _CUT)), "substring-touched")
    bare = rows.withColumn("gone", F.lit(None).cast("array<int>")).select("given_id", "doc_id", "text", "gone")
    rest = out(bare.mapInArrow(_cutter(window), _CUT)).join(gone.select("doc_id"), "doc_id", "left_anti")
    both = touched.unionByName(rest)
    return both.select(F.col("given_id").alias("doc_id"), "n_words", "n_removed", "kept")


def op5_substring_dedup(spark, sf_dir):
    found = cut_repeats(table(spark, sf_dir, "documents"), finish=lambda kept: F.sha2(kept, 256))
    return found.withColumnRenamed("kept", "kept_sha256")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, k, array_to_string(w[k + 1:k + 13], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(0, len(w) - 12)) AS k FROM d WHERE len(w) >= 13)),
hits AS (SELECT doc_id, k FROM (SELECT *, min(doc_id) OVER (PARTITION BY g) AS first FROM windows) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS p FROM hits),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n
  FROM (SELECT doc_id, generate_subscripts(w, 1) - 1 AS p, unnest(w) AS word FROM d) ANTI JOIN gone USING (doc_id, p)
  GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

