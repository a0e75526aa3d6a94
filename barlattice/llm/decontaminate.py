"""Benchmark decontamination with a distributed positional inverted index (DataFrame functions only).

1. Document frequencies of the benchmark's terms are counted over all documents.
2. Every window of an item (n consecutive words; a shorter item is one window) names its two rarest positions.
3. The terms at these positions are indexed: postings (term, document, position), stored as a table by term.
4. Lists are intersected after shifting each by the term's place in the item: postings that agree in
   (document, item, document position - item position) lie on one alignment. An alignment with both rare positions
   of a window can hold it; all others can't.
5. For these alignments the item's words are compared with the document's words, place by place, which gives
   exact phrase matches. With a slop, postings whose alignments differ by no more than that give proximity matches.

Terms of the benchmark are broadcast only while their number is below a bound; beyond it the same join is shuffled.
Frequent words never get a posting unless a window has nothing rarer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlattice.llm.common import PLAIN_WORD, lowered, pruned_joins, staged, table

WINDOW = 10
BROADCAST_ROWS = 200_000


def _words(text):
    return F.regexp_extract_all(lowered(text), F.lit(PLAIN_WORD), F.lit(0))


def _small(df: DataFrame) -> DataFrame:
    """A staged table as a broadcast side, if it is within the bound."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def item_words(benchmark: DataFrame) -> DataFrame:
    """item_id (string), words, n_item: items that have a word, identical rows once."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), _words(F.col("text")).alias("words")).distinct()
    return items.withColumn("n_item", F.size("words")).filter("n_item > 0").withColumn("item_key", F.xxhash64("item_id", "words"))


def rare_positions(terms: DataFrame, frequency: DataFrame, window: int, present: bool = False) -> DataFrame:
    """item_key, item_pos, term: the two rarest positions of every window of every item (of terms that occur, if `present`).

    A term that no document has is the rarest: a window with it stands nowhere, and its lists are empty.
    """
    ranked = terms.join(frequency, "term", "inner" if present else "left").fillna(0, ["df"])
    ahead = Window.partitionBy("item_key").orderBy("item_pos").rangeBetween(0, window - 1)
    near = ranked.withColumn("near", F.slice(F.array_sort(F.collect_list(F.struct("df", "item_pos")).over(ahead)), 1, 2))
    if not present:
        near = near.filter((F.col("item_pos") + window <= F.col("n_item")) | (F.col("item_pos") == 0))
    chosen = near.select("item_key", F.explode("near.item_pos").alias("item_pos")).distinct()
    return terms.join(chosen, ["item_key", "item_pos"])


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Stored positional postings (term, doc_id, pos) of the given terms, from whole texts."""
    words = docs.select("doc_id", F.posexplode(_words(F.col("text"))).alias("pos", "term"))
    return staged(words.join(_small(staged(terms.select("term").distinct(), "index-terms")), "term"), "postings")


def alignments(postings: DataFrame, rare: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_key, diag: places in documents where two rare positions of an item stand in step."""
    shifted = postings.join(rare, "term").select(
        "doc_id", "item_key", (F.col("pos") - F.col("item_pos")).alias("diag"), "item_pos", "n_item")
    met = shifted.groupBy("doc_id", "item_key", "diag").agg(
        F.min("item_pos").alias("low"), F.max("item_pos").alias("high"), F.first("n_item").alias("n_item"))
    return met.filter((F.col("low") < F.col("high")) | (F.col("n_item") == 1)).select("doc_id", "item_key", "diag")


def proximity_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 3) -> DataFrame:
    """doc_id, item_id, first_pos, last_pos: two rare terms of one item at their distance, give or take `slop` words."""
    items, _, rare = _rare(docs, benchmark, window, present=True)
    found = build_index(docs, rare).join(rare, "term").withColumn("diag", F.col("pos") - F.col("item_pos"))
    # Alignments within the slop share a cell or lie in neighbouring ones.
    cell = F.floor(F.col("diag") / (slop + 1))
    left = found.withColumn("cell", F.explode(F.array(cell, cell + 1))).alias("l")
    right = found.withColumn("cell", cell).alias("r")
    more = found.withColumn("cell", cell + 1).alias("r")
    condition = F.expr(
        f"l.doc_id = r.doc_id AND l.item_key = r.item_key AND l.cell = r.cell AND l.item_pos < r.item_pos "
        f"AND r.item_pos - l.item_pos < {window} AND abs(l.diag - r.diag) <= {slop}")
    pair = F.expr("l.doc_id"), F.expr("l.item_key"), F.least("l.pos", "r.pos").alias("first_pos"), F.greatest("l.pos", "r.pos").alias("last_pos")
    both = left.join(right, condition).select(*pair).unionByName(left.join(more, condition).select(*pair)).distinct()
    return both.join(items.select("item_key", "item_id"), "item_key").select("doc_id", "item_id", "first_pos", "last_pos")


def _rare(docs: DataFrame, benchmark: DataFrame, window: int, present: bool = False):
    items = staged(item_words(benchmark), "bench-items")
    terms = staged(items.select("item_key", "n_item", F.posexplode("words").alias("item_pos", "term")), "bench-terms")
    vocabulary = _small(staged(terms.select("term").distinct(), "bench-vocabulary"))
    seen = docs.select(F.explode(F.array_distinct(_words(F.col("text")))).alias("term"))
    frequency = staged(seen.join(vocabulary, "term").groupBy("term").agg(F.count(F.lit(1)).alias("df")), "bench-df")
    return items, terms, staged(rare_positions(terms, frequency, window, present), "bench-rare")


def phrase_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, item_id, diag, starts: item positions of the windows that stand in the document at diag + start."""
    items, _, rare = _rare(docs, benchmark, window)
    found = alignments(build_index(docs, rare), _small(rare), items).withColumn("listed", F.lit(1))
    found = staged(found, "alignments")
    wanted = staged(found.filter("listed > 0").select("doc_id", "listed").distinct(), "aligned-docs").filter("listed > 0")
    with pruned_joins(docs.sparkSession):
        texts = staged(docs.join(wanted.select("doc_id"), "doc_id", "left_semi").select("doc_id", _words(F.col("text")).alias("doc_words")), "aligned-words")
    keyed = items.select("item_key", "item_id", F.col("words").alias("item_words"), "n_item")
    both = found.join(texts, "doc_id").join(_small(keyed), "item_key")
    span = F.least(F.lit(window), F.col("n_item"))
    here = both.withColumn("span", span).withColumn("beside", F.expr(
        "slice(doc_words, greatest(diag, 0) + 1, n_item + least(diag, 0))")).withColumn("skipped", F.expr("greatest(-diag, 0)"))
    starts = F.expr(
        "filter(sequence(skipped, n_item - span), k -> slice(item_words, k + 1, span) = slice(beside, k - skipped + 1, span))")
    here = here.filter("skipped <= n_item - span").withColumn("starts", starts).filter(F.size("starts") > 0)
    return here.select("doc_id", "item_id", "diag", "starts", "span")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, item_ids (sorted strings), contaminated.

    Null or empty text has no words. Null ids join with each other; rows that repeat an id count as one document (hits
    are united). Items without words match nothing; repeated items count once per item_id. Empty tables on either
    side give no hits. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id"), F.col("text"))
    keyed = docs.withColumn("given_id", F.col("doc_id")).withColumn("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    matched = phrase_matches(keyed.select("doc_id", "text"), benchmark, window)
    places = F.expr("flatten(transform(starts, k -> sequence(diag + k, diag + k + span - 1)))")
    hits = matched.withColumn("places", F.array_distinct(places)).groupBy("doc_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("places")))).cast("long").alias("n_hit"),
        F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    counted = keyed.select("doc_id", "given_id", F.regexp_count(lowered(F.col("text")), F.lit(PLAIN_WORD)).cast("long").alias("n_words"))
    out = counted.join(hits, "doc_id", "left").withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long")))
    return out.select(
        F.col("given_id").alias("doc_id"), "n_words", "n_hit",
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_benchmark_decontamination(spark, sf_dir):
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
full_windows AS (
  SELECT item_id, array_to_string(w[k + 1:k + 10], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(0, len(w) - 9)) AS k FROM b WHERE len(w) >= 10)),
short_items AS (SELECT item_id, array_to_string(w, ' ') AS g, len(w) AS n FROM b WHERE len(w) BETWEEN 1 AND 9),
doc_grams AS (
  SELECT doc_id, k, 10 AS n, array_to_string(w[k + 1:k + 10], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(0, len(w) - 9)) AS k FROM d WHERE len(w) >= 10)),
short_grams AS (
  SELECT doc_id, k, n, array_to_string(w[k + 1:k + n], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS k
        FROM d, (SELECT DISTINCT n FROM short_items) WHERE len(w) >= n)),
hits AS (
  SELECT doc_id, k, n, item_id FROM doc_grams JOIN full_windows USING (g)
  UNION SELECT doc_id, k, n, item_id FROM short_grams JOIN short_items USING (g, n)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""
