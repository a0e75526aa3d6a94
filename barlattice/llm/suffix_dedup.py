"""Repeated byte strings across a corpus by prefix-free parsing.

Parsing. The trigger of a string of LENGTH bytes is the smallest rolling hash (of GRAM bytes) in its first SPREAD places,
so every such string has one, at the same distance in all of its copies. The phrase of a trigger is the PHRASE bytes from
it on, which every string of that trigger holds. Phrases have one length, hence none is a prefix of another. The distinct
phrases are the dictionary; a text's triggers in order are its parse, about one for SPREAD / 2 bytes.

Order. Two strings are equal at depth LENGTH only if their phrases are; so of the parse only places of repeated dictionary
entries are looked at again, with their whole context (all bytes of all strings of the trigger):
* contexts that are equal stand together in any order of the corpus: all their strings repeat;
* within an entry with several contexts, the strings of each distinct context (the suffixes of the dictionary, once each,
  however often the context stands in the corpus) are put together by content, and those that meet repeat.
Only whether neighbours in that order agree to depth LENGTH matters here, so fingerprints of 64 bits are grouped
instead of ranks being kept; suffix arrays of the whole corpus are not written out.

Rows are one for a trigger or, for dictionary suffixes at the edges of repeats only, one for a byte. Counting is partial
aggregation; a phrase that a third of all texts hold is one row of the dictionary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlattice.llm.common import pruned_joins, staged, table
from barlattice.llm.textbytes import flat, mixed, pieces, powers, running, signed, spans_hash

LENGTH, SPREAD, GRAM = 400, 128, 16
_B = 0xC2B2AE3D27D4EB4F | 1
_PLACE = np.uint64((1 << 28) - 1)


class Parse:
    """Triggers of a batch of texts: lowest and highest string start of each, trigger place, text number."""

    def __init__(self, texts: pa.Array, length: int = LENGTH, spread: int = SPREAD, gram: int = GRAM):
        self.data, self.at = flat(texts)
        self.total = running(self.data.astype(np.uint64) + np.uint64(1), _B)
        n = len(self.data)
        none = np.zeros(0, np.int64)
        self.low = self.high = self.trigger = self.text = none
        size = np.diff(self.at)
        if n < length or not (size >= length).any():
            return
        down = powers(_B, n + 1)[1]
        grams = mixed((self.total[gram:] - self.total[:-gram]) * down[: n + 1 - gram])
        place = np.arange(len(grams), dtype=np.uint64)
        least = (grams & ~_PLACE) | (place & _PLACE)  # ties go to the leftmost
        width = 1
        while width * 2 <= spread:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        rest = spread - width
        least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
        start = np.flatnonzero(np.repeat(size >= length, size))
        of = np.searchsorted(self.at, start, "right") - 1
        inside = start + length <= self.at[of + 1]
        start, of = start[inside], of[inside]
        trigger = start + ((least[start] - start.astype(np.uint64)) & _PLACE).astype(np.int64)
        new = np.ones(len(start), bool)
        new[1:] = (trigger[1:] != trigger[:-1]) | (np.diff(start) != 1)
        first = np.flatnonzero(new)
        self.low, self.trigger, self.text = start[first], trigger[first], of[first]
        self.high = start[np.append(first[1:], len(start)) - 1]

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return signed(spans_hash(self.total, start, end, _B))


def repeated_starts(rows: DataFrame, length: int = LENGTH, spread: int = SPREAD, gram: int = GRAM) -> DataFrame:
    """row_key, low, high: every string that starts from low to high (bytes) in that row stands elsewhere too."""
    spark, phrase = rows.sparkSession, length - spread + 1

    def parse(batches):
        for batch in pieces(batches):
            p = Parse(batch.column("text"), length, spread, gram)
            key = batch.column("row_key").to_numpy()[p.text]
            base = p.at[p.text]
            yield pa.RecordBatch.from_pydict({
                "phrase": pa.array(p.hashes(p.trigger, p.trigger + phrase)), "context": pa.array(p.hashes(p.low, p.high + length)),
                "row_key": pa.array(key), "low": pa.array((p.low - base).astype(np.int32)), "high": pa.array((p.high - base).astype(np.int32))})

    triggers = rows.mapInArrow(parse, "phrase long, context long, row_key long, low int, high int")
    dictionary = staged(
        triggers.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"), F.min("context").alias("least"), F.max("context").alias("most"))
        .select("phrase", "n", (F.col("least") != F.col("most")).alias("several")), "phrase-dictionary")
    with pruned_joins(spark):
        places = staged(triggers.join(dictionary.filter("n > 1").select("phrase", "several"), "phrase"), "phrase-places")
    alike = places.filter("NOT several").select("row_key", "low", "high")

    several = places.filter("several")
    contexts = staged(several.groupBy("phrase", "context").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("row_key", "low", "high")).alias("one")), "phrase-contexts")
    again = several.join(contexts.filter("n > 1").select("phrase", "context"), ["phrase", "context"], "left_semi").select("row_key", "low", "high")

    wanted = contexts.select("one.row_key", F.struct("one.low", "one.high", F.col("n") > 1).alias("range"))
    wanted = staged(wanted.groupBy("row_key").agg(F.collect_list("range").alias("ranges"), F.count(F.lit(1)).alias("n")), "phrase-ranges")

    def suffixes(batches):
        """The strings of the wanted places. Where the context itself repeats they only vouch for others (row_key null)."""
        for batch in pieces(batches):
            p = Parse(batch.column("text"), 1 << 40)  # no string is that long: only the running sum is made
            ranges = batch.column("ranges")
            number = ranges.value_lengths().to_numpy()
            at = ranges.flatten()
            low, high = (at.field(k).to_numpy().astype(np.int64) for k in (0, 1))
            known = at.field(2).to_numpy(zero_copy_only=False)
            text = np.repeat(np.arange(batch.num_rows), number)
            count = high - low + 1
            start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
            text, known = np.repeat(text, count), np.repeat(known, count)
            base = p.at[text] + start
            yield pa.RecordBatch.from_pydict({
                "suffix": pa.array(p.hashes(base, base + length)),
                "row_key": pa.array(batch.column("row_key").to_numpy()[text], mask=known), "start": pa.array(start.astype(np.int32))})

    with pruned_joins(spark):
        texts = rows.join(wanted.filter("n > 0").select("row_key", "ranges"), "row_key").dropDuplicates(["row_key"])
        edges = staged(texts.select("row_key", "text", "ranges").mapInArrow(suffixes, "suffix long, row_key long, start int"), "phrase-suffixes")
    met = edges.groupBy("suffix").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    single = edges.filter("row_key IS NOT NULL").join(met.select("suffix"), "suffix", "left_semi")
    return alike.unionByName(again).unionByName(single.select("row_key", F.col("start").alias("low"), F.col("start").alias("high")))


def cut_repeats(docs: DataFrame, length: int = LENGTH, spread: int = SPREAD, gram: int = GRAM) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (binary).

    A byte goes if a string of `length` bytes over it starts anywhere else, in the same text or in another, judged on the input;
    all copies go, the first one too. Null text counts as empty; texts shorter than `length` stay. Rows that repeat an id
    count as texts of their own, so they are copies of each other; ids may be null. An empty table gives no rows; other
    columns are ignored. The bytes kept need not be valid UTF-8, hence the binary type.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64("doc_id", text).alias("row_key"))
    spans = repeated_starts(rows.select("row_key", "text"), length, spread, gram)
    # A row twice in the table has every place twice, which counts them as repeated, as it should.
    spans = spans.groupBy("row_key").agg(F.collect_list(F.struct("low", "high")).alias("spans"))

    def cut(batches):
        for batch in pieces(batches):
            data, at = flat(batch.column("text"))
            spans_of = batch.column("spans")
            number = spans_of.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            both = spans_of.flatten()
            base = np.repeat(at[:-1], number)
            change = np.zeros(len(data) + 1, np.int64)
            np.add.at(change, base + both.field(0).to_numpy(), 1)
            np.add.at(change, base + both.field(1).to_numpy() + length, -1)
            gone = np.cumsum(change)[:-1] > 0
            n_removed, n_spans, kept = [], [], []
            for low, high in zip(at[:-1], at[1:]):
                mine = gone[low:high]
                n_removed.append(int(mine.sum()))
                n_spans.append(int(mine[:1].sum() + (mine[1:] & ~mine[:-1]).sum()))
                kept.append(data[low:high][~mine].tobytes())
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_bytes": pa.array(np.diff(at)), "n_removed": pa.array(n_removed, pa.int64()),
                "n_spans": pa.array(n_spans, pa.int64()), "kept": pa.array(kept, pa.binary())})

    met = rows.join(spans, "row_key", "left").select("doc_id", "text", "spans")
    return met.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op3_suffix_dedup(spark, sf_dir):
    found = cut_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
