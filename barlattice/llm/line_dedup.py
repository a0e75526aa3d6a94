"""Line dedup with content-defined chunks of lines (DataFrame functions only).

Lines are hashed, and a rolling hash over two line hashes marks a line as trigger. A chunk ends at a trigger that does
not follow one, so boundaries depend on three lines only: inserting or deleting lines moves no boundary further on.
Chunks of two or more lines with content that stand in several places are removed everywhere but at the first place
(smallest id, then smallest position).

1. Narrow pass: (place, 64-bit key) of every chunk; keys with two places are stored. Partial aggregation, no text.
2. Chunks with such a key are compared byte by byte: they are grouped on their text. A runtime Bloom filter keeps the
   text of all other chunks out of the shuffle; a chunk with thousands of places meets its one first place in a join
   that adaptive execution splits.
3. Documents are put together from the chunks that stay.

A chunk is found again only where its borders are the same, and borders settle after the first lines of a passage, so
most passages of a few lines inside own text are kept. `dedup_runs` misses none of two lines or more: it judges the chunks
and, pooled with them, the chunkings of every phase whose chunks have just two lines with content, and cuts the union.
Its spans are told apart by SHA-256, so no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlattice.llm.common import pruned_joins, staged, table

TRIGGERS, OF = 505, 1009  # a line pair is a trigger with probability TRIGGERS / OF
MIN_LINES = 2  # lines with content that a chunk must have to be removed


def bounded(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with `lines` and `spans`: array of (low, high), the first and last line of each chunk."""
    lines = docs.withColumn("lines", F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1))
    hashed = lines.withColumn("line_hash", F.expr("transform(lines, x -> CAST(conv(left(md5(x), 7), 16, 10) AS BIGINT))"))
    marked = hashed.withColumn("trigger", F.expr(
        f"transform(line_hash, (x, i) -> i > 0 AND (get(line_hash, i - 1) * 31 + x) % {OF} < {TRIGGERS})"))
    ended = marked.withColumn("ends", F.expr(
        "filter(sequence(0, size(trigger) - 1), i -> i = size(trigger) - 1 OR (get(trigger, i) AND NOT get(trigger, i - 1)))"))
    return ended.withColumn("spans", F.expr(
        "transform(ends, (e, k) -> struct(if(k = 0, 0, get(ends, k - 1) + 1) AS low, e AS high))")).drop("line_hash", "trigger", "ends")


def chunked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with `chunks`: array of (text, lines, full) in order; joined by newlines they are the text."""
    return bounded(docs, text_col).withColumn("chunks", F.expr(
        "transform(spans, s -> struct("
        "array_join(slice(lines, s.low + 1, s.high - s.low + 1), '\n') AS text, s.high - s.low + 1 AS lines, "
        "size(filter(slice(lines, s.low + 1, s.high - s.low + 1), x -> trim(x) <> '')) AS full))")
    ).drop("lines", "spans")


def repeated_chunks(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """doc_id, chunk_no: places of chunks that stand at an earlier place too."""
    # The outer form, for the plain one makes Spark infer a filter on the whole expression of the array and copy it down.
    every = chunked(docs.select("doc_id", "text")).select("doc_id", F.posexplode_outer("chunks").alias("chunk_no", "chunk"))
    every = every.filter(F.col("chunk.full") >= min_lines).select(
        F.struct("doc_id", "chunk_no").alias("place"), F.col("chunk.text").alias("chunk"), F.xxhash64("chunk.text").alias("key"))
    places = every.groupBy("key").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    keys = staged(places.select("key", (F.col("first") != F.col("last")).cast("int").alias("repeated")), "chunk-keys")
    with pruned_joins(docs.sparkSession):
        same_key = staged(every.join(keys.filter("repeated > 0").select("key"), "key", "left_semi"), "chunk-candidates")
    first = same_key.groupBy("key", "chunk").agg(F.min("place").alias("first"))
    again = same_key.join(first, ["key", "chunk"]).filter(F.col("place") != F.col("first"))
    return again.select("place.doc_id", "place.chunk_no")


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """docs with text cut to what stays, and line_stats: (lines, removed_lines, removed_chunks, emptied).

    Null text stays null and counts as one empty line. Lines end at newline only. Blank lines never make a chunk
    repeated. Rows that repeat an id are one document: they share their places, so they don't count as repeats of each
    other; null ids are the first in order and one document too. Other columns are kept, whatever their names.
    An empty table gives no rows. Texts whose every line goes become empty (emptied is then true).
    """
    doc = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    packed = docs.select(doc).select("doc", F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text"))
    gone = repeated_chunks(packed, min_lines).groupBy("doc_id").agg(F.array_distinct(F.collect_list("chunk_no")).alias("gone"))
    gone = gone.withColumnRenamed("doc_id", "gone_id")
    met = packed.join(gone, packed["doc_id"].eqNullSafe(gone["gone_id"]), "left").select(
        "doc", F.col("doc.text").alias("text"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    split = chunked(met).withColumn("stays", F.expr("array_except(sequence(0, size(chunks) - 1), gone)"))
    built = split.withColumn("kept_text", F.when(F.size("gone") == 0, F.col("text")).otherwise(
        F.expr("array_join(transform(stays, k -> get(chunks, k).text), '\n')")))
    lines = F.expr("aggregate(chunks, 0L, (a, c) -> a + c.lines)")
    removed = F.expr("aggregate(gone, 0L, (a, k) -> a + get(chunks, k).lines)")
    stats = F.struct(
        lines.alias("lines"), removed.alias("removed_lines"), F.size("gone").cast("long").alias("removed_chunks"),
        ((F.size("gone") > 0) & (F.trim("kept_text") == "")).alias("emptied")).alias("line_stats")
    return built.select("doc", "kept_text", stats).select(
        *(F.col("kept_text").alias(c) if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns), "line_stats")


def spanned(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """docs with `lines` and `spans`: array of (low, high), first and last line of each chunk with min_lines lines with
    content, and of each run that begins and ends with content and has just so many."""
    filled = bounded(docs).withColumn("filled", F.expr("filter(sequence(0, size(lines) - 1), i -> trim(get(lines, i)) <> '')"))
    # As one number each, for arrays of numbers are made distinct by hashing and arrays of structs by comparing all pairs.
    return filled.withColumn("spans", F.expr(
        "transform(array_distinct(concat("
        "transform(filter(spans, s -> size(filter(slice(lines, s.low + 1, s.high - s.low + 1), x -> trim(x) <> '')) "
        f">= {min_lines}), s -> shiftleft(CAST(s.low AS BIGINT), 32) + s.high), "
        f"if(size(filled) < {min_lines}, array(), transform(sequence(0, greatest(size(filled) - {min_lines}, 0)), "
        f"j -> shiftleft(CAST(get(filled, j) AS BIGINT), 32) + get(filled, j + {min_lines - 1}))))), "
        "x -> struct(CAST(shiftright(x, 32) AS INT) AS low, CAST(x & 4294967295 AS INT) AS high))")).drop("filled")


def repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """doc_id, text_key, gone: numbers of the lines (from 0) in spans that stand at an earlier place too."""
    found = spanned(docs.select("doc_id", "text"), min_lines)
    joined = "array_join(slice(lines, s.low + 1, s.high - s.low + 1), '\n')"
    # The outer form, for the plain one makes Spark infer a filter on the whole expression of the array and copy it down.
    every = found.select("doc_id", F.posexplode_outer(F.expr(f"transform(spans, s -> struct(s.low, xxhash64({joined}) AS key))")).alias("k", "s"))
    every = every.filter("s IS NOT NULL").select(F.struct("doc_id", "s.low").alias("place"), "s.key")
    places = every.groupBy("key").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    keys = staged(places.filter(F.col("first") != F.col("last")).select("key", F.lit(1).alias("repeated")), "run-keys")
    signed = found.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode_outer(F.expr(
        f"transform(spans, s -> struct(s.low, s.high, xxhash64({joined}) AS key, unhex(sha2({joined}, 256)) AS sha))")).alias("k", "s"))
    signed = signed.filter("s IS NOT NULL").select(F.struct("doc_id", "s.low").alias("place"), "text_key", "s.high", "s.key", "s.sha")
    with pruned_joins(docs.sparkSession):
        same = staged(signed.join(keys.filter("repeated > 0").select("key").hint("merge"), "key", "left_semi").drop("key"), "run-candidates")
    first = staged(same.groupBy("sha").agg(F.min("place").alias("first")), "run-first")  # stored, so that a common span can be split
    again = same.join(first.hint("merge"), "sha").filter(F.col("place") != F.col("first"))
    lines = F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("place.low"), F.col("high")))))
    return again.groupBy("place.doc_id", "text_key").agg(lines.alias("gone"))


def dedup_runs(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """docs with text cut to what stays, and line_stats: (lines, removed_lines, emptied).

    As dedup_lines, but every run of min_lines or more lines with content that stands at an earlier place goes, whatever
    stands around it. A line that goes has an equal one earlier, and the first of them all stays. Single lines stay.
    Spans that overlap are judged each by itself, so a first place may lose its end to a still earlier passage.
    Texts under one repeated id are cut each by its own lines. emptied: lines went and none with content stays.
    """
    doc = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    packed = docs.select(doc).select("doc", F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text"))
    gone = staged(repeated_lines(packed, min_lines), "run-lines").withColumnsRenamed({"doc_id": "gone_id", "text_key": "gone_key"})
    met = packed.join(
        gone.hint("merge"), packed["doc_id"].eqNullSafe(gone["gone_id"]) & (F.xxhash64(packed["text"]) == gone["gone_key"]), "left")
    split = met.select(
        "doc", F.col("doc.text").alias("text"), F.split(F.coalesce(F.col("doc.text"), F.lit("")), "\n", -1).alias("split"),
        F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    kept = split.withColumn("kept", F.expr("transform(array_except(sequence(0, size(split) - 1), gone), i -> get(split, i))"))
    stats = F.struct(
        F.size("split").cast("long").alias("lines"), F.size("gone").cast("long").alias("removed_lines"),
        ((F.size("gone") > 0) & F.expr("forall(kept, x -> trim(x) = '')")).alias("emptied")).alias("line_stats")
    built = kept.select("doc", F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join("kept", "\n")).alias("kept_text"), stats)
    return built.select(
        *(F.col("kept_text").alias(c) if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns), "line_stats")


def op7_line_dedup(spark, sf_dir):
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", F.col("line_stats.lines").alias("n_lines"), F.col("line_stats.removed_lines").alias("n_removed"),
        F.col("line_stats.removed_chunks").alias("n_chunks_removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"), F.col("line_stats.emptied").alias("emptied"))


def line_runs(spark, sf_dir):
    found = dedup_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", F.col("line_stats.lines").alias("n_lines"), F.col("line_stats.removed_lines").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"), F.col("line_stats.emptied").alias("emptied"))


# The hash of a line is its md5's first seven hex digits, which both dialects can read as a number.
CHUNK_SQL = f"""
lines AS (
  SELECT doc_id, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS line, len(l) AS n
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM {{source}})),
hashed AS (SELECT *, CAST('0x' || substr(md5(line), 1, 7) AS BIGINT) AS h FROM lines),
marked AS (
  SELECT *, coalesce((lag(h) OVER o * 31 + h) % {OF} < {TRIGGERS}, false) AS t FROM hashed
  WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
ended AS (
  SELECT *, i = n - 1 OR (t AND NOT coalesce(lag(t) OVER o, false)) AS e FROM marked
  WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (
  SELECT *, coalesce(sum(CAST(e AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k
  FROM ended),
chunks AS (
  SELECT doc_id, k, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS n,
         count(*) FILTER (WHERE trim(line, ' ') <> '') AS filled
  FROM numbered GROUP BY 1, 2),
judged AS (
  SELECT *, filled >= {MIN_LINES} AND row_number() OVER (PARTITION BY chunk, filled >= {MIN_LINES} ORDER BY doc_id, k) > 1 AS gone FROM chunks),
cut AS (
  SELECT doc_id, sum(n) AS n_lines, coalesce(sum(n) FILTER (WHERE gone), 0) AS n_removed,
         count(*) FILTER (WHERE gone) AS n_chunks_removed,
         coalesce(string_agg(chunk, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '') AS kept
  FROM judged GROUP BY 1)"""

OP7_SQL = "WITH " + CHUNK_SQL.format(source="documents") + """
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed,
       CAST(n_chunks_removed AS BIGINT) AS n_chunks_removed, sha256(kept) AS kept_sha256,
       n_chunks_removed > 0 AND trim(kept, ' ') = '' AS emptied
FROM cut
"""

LINE_RUNS_SQL = "WITH " + CHUNK_SQL.format(source="documents") + f""",
filled AS (SELECT doc_id, i AS low, lead(i, {MIN_LINES - 1}) OVER (PARTITION BY doc_id ORDER BY i) AS high FROM lines WHERE trim(line, ' ') <> ''),
spans AS (
  SELECT doc_id, low, high FROM filled WHERE high IS NOT NULL
  UNION SELECT doc_id, min(i), max(i) FROM numbered GROUP BY doc_id, k HAVING count(*) FILTER (WHERE trim(line, ' ') <> '') >= {MIN_LINES}),
texts AS (
  SELECT s.doc_id, low, high, string_agg(line, chr(10) ORDER BY i) AS span
  FROM spans s JOIN lines l ON l.doc_id = s.doc_id AND l.i BETWEEN low AND high GROUP BY 1, 2, 3),
again AS (SELECT doc_id, low, high FROM texts QUALIFY row_number() OVER (PARTITION BY span ORDER BY doc_id, low) > 1),
out_lines AS (SELECT DISTINCT doc_id, unnest(range(low, high + 1)) AS i FROM again),
kept_lines AS (SELECT l.*, o.i IS NOT NULL AS out FROM lines l LEFT JOIN out_lines o ON o.doc_id = l.doc_id AND o.i = l.i)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE out) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT out), '')) AS kept_sha256,
       bool_or(out) AND count(*) FILTER (WHERE NOT out AND trim(line, ' ') <> '') = 0 AS emptied
FROM kept_lines GROUP BY doc_id
"""
