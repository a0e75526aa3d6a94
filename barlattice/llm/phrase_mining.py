"""Phrase collocation mining by vertical partitioning of a word suffix tree.

1. Prefixes of one word are counted. One that stands more often than a group can hold is extended by a word, and its
   extensions are counted, and so on; each level is one pass over the texts.
2. Each prefix (the shortest one of a suffix that isn't extended) belongs to one group. A group holds GROUP_SUFFIXES
   suffixes on average, so memory is bounded, and a common word's suffixes are spread over groups.
3. Partitions send each group its suffixes, cut after max_words words or at the end of the piece; equal ones of a chunk are
   sent once, with a count.
4. A group builds its depth-truncated subtree independently: sorted suffixes with the lengths of their common prefixes.
   The leaves below a node add up to its phrase's count. Counts of extended prefixes are known from the first step.
5. Scores, the drop of parts and ranks are joins and aggregates over phrases that stand min_count times or more.

Null text is empty; null lang is 'und' (one language with rows that say so). Repeated rows count as often as they stand. An
empty table, or one without any candidate, gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlattice.llm.common import own_names, staged, table
from barlattice.llm.textbytes import mixed

GROUP_SUFFIXES = 1_000_000
MAX_PREFIXES = 1 << 20  # extended prefixes of a level: each is more than this share of all words, so there are never more
CHUNK_WORDS, CHUNK_ENTRIES = 1 << 20, 250_000
_BREAK = b"\xff"  # no byte of UTF-8: ends a piece
_TABLE = bytearray(range(256))
for _c in range(65, 91):
    _TABLE[_c] = _c + 32
for _c in b".,;:!?\n\x0b\x0c\r":
    _TABLE[_c] = 0xFF
_TABLE[9] = 32


def tokens(text: bytes) -> list[bytes]:
    """Words in order, with a break between pieces."""
    return text.translate(_TABLE).replace(_BREAK, b" \xff ").split()


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
            yield lang, text.as_py()


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, count) of single words, summed up to CHUNK_ENTRIES of them."""
    counts: dict[str, Counter] = {}

    def spill():
        for lang, words in counts.items():
            words.pop(_BREAK, None)
            yield pa.record_batch({"lang": pa.array([lang] * len(words), pa.string()), "phrase": pa.array(list(words), pa.binary()).cast(pa.string()),
                                   "count": pa.array(list(words.values()), pa.int64())})
        counts.clear()

    for lang, text in _texts(batches):
        counts.setdefault(lang, Counter()).update(tokens(text))
        if sum(map(len, counts.values())) >= CHUNK_ENTRIES:
            yield from spill()
    yield from spill()


class _Numbers(dict):
    """Numbers words from 1 as they come; a break is 0."""

    def __init__(self):
        super().__init__({_BREAK: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, list[bytes]]]:
    """(lang, word numbers with 0 for breaks, words by number): about CHUNK_WORDS words of one language at a time."""
    numbers: dict[str, _Numbers] = {}
    parts: dict[str, list[np.ndarray]] = {}
    held: Counter = Counter()

    def ended(lang: str):
        names = numbers.pop(lang)
        held.pop(lang)
        return lang, np.concatenate(parts.pop(lang)), list(names)

    for lang, text in _texts(batches):
        words = tokens(text)
        if not words:
            continue
        words.append(_BREAK)
        parts.setdefault(lang, []).append(np.fromiter(map(numbers.setdefault(lang, _Numbers()).__getitem__, words), np.int64, len(words)))
        held[lang] += len(words)
        if held[lang] >= CHUNK_WORDS:
            yield ended(lang)
        elif held.total() >= 2 * CHUNK_WORDS:
            yield ended(held.most_common(1)[0][0])
    for lang in list(parts):
        yield ended(lang)


def suffixes(ids: np.ndarray, depth: int, names: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct suffixes of two words or more, cut after `depth` (rows of word numbers, 0 after the end), and their counts."""
    columns = [ids]
    for k in range(1, depth):
        after = np.zeros_like(ids)
        after[:-k] = ids[k:]
        columns.append(np.where(columns[-1] > 0, after, 0))
    long_enough = columns[1] > 0
    columns = [c[long_enough] for c in columns]
    bits = names.bit_length()
    if bits * depth > 63:
        return np.unique(np.column_stack(columns), axis=0, return_counts=True)
    key = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        key = key << bits | c
    key, counts = np.unique(key, return_counts=True)
    return np.column_stack([key >> bits * (depth - 1 - k) & (1 << bits) - 1 for k in range(depth)]), counts


def joined(names: pa.Array, rows: np.ndarray) -> pa.Array:
    """Phrases of rows of word numbers; words after the end are left out."""
    columns = [names.take(pa.array(rows[:, k], mask=rows[:, k] <= 0)) for k in range(rows.shape[1])]
    return pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.binary()), null_handling="skip").cast(pa.string())


def _extended(rows: np.ndarray, names: list[bytes], lang: str, depth: int, hot: set[tuple[str, bytes]]) -> np.ndarray:
    """Which rows' first `depth` words are an extended prefix; rows of a prefix are next to each other."""
    cut = np.ones(len(rows), bool)
    cut[1:] = (rows[1:, :depth] != rows[:-1, :depth]).any(axis=1)
    first = np.flatnonzero(cut)
    is_hot = np.array([bool(r[-1]) and (lang, b" ".join([names[i] for i in r])) in hot for r in rows[first, :depth]], bool)
    return is_hot[np.cumsum(cut) - 1] if len(rows) else np.zeros(0, bool)


def _count_extensions(depth: int, hot):
    """(lang, phrase, count) of the phrases of depth + 1 words whose first `depth` words are extended."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, ids, names in chunks(batches):
            rows, counts = suffixes(ids, depth + 1, len(names))
            mine = (rows[:, -1] > 0) & _extended(rows, names, lang, depth, hot.value)
            phrases = joined(pa.array(names, pa.binary()), rows[mine])
            yield pa.record_batch({"lang": pa.array([lang] * len(phrases), pa.string()), "phrase": phrases, "count": pa.array(counts[mine])})

    return count


def _deal(max_words: int, groups: int, hot):
    """A chunk's suffixes by group: (group, lang, phrases, counts)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, ids, names in chunks(batches):
            rows, counts = suffixes(ids, max_words, len(names))
            salt = zlib.crc32(lang.encode())
            codes = np.array([zlib.crc32(w, salt) for w in names], np.uint64)
            key, more = mixed(codes[rows[:, 0]] + np.uint64(salt)), np.ones(len(rows), bool)
            for depth in range(1, max_words):
                more[more] = _extended(rows[more], names, lang, depth, hot.value)
                if not more.any():
                    break
                key[more] = mixed(key[more] * np.uint64(0x9E3779B97F4A7C15) + codes[rows[more, depth]])
            group = (key % np.uint64(groups)).astype(np.int32)
            order = np.argsort(group, kind="stable")
            rows, counts, group = rows[order], counts[order], group[order]
            vocabulary = pa.array(names, pa.binary())
            there, first = np.unique(group, return_index=True)
            first = np.append(first, len(group))
            for k in range(0, len(there), 32):
                at = first[k : k + 33]
                part = slice(at[0], at[-1])
                offsets = pa.array((at - at[0]).astype(np.int32))
                yield pa.record_batch({
                    "group": pa.array(there[k : k + 32]), "lang": pa.array([lang] * (len(at) - 1), pa.string()),
                    "phrases": pa.ListArray.from_arrays(offsets, joined(vocabulary, rows[part])),
                    "counts": pa.ListArray.from_arrays(offsets, pa.array(counts[part]))})

    return deal


def subtree(phrases: pa.Array, counts: pa.Array, max_words: int, min_count: int) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(depth, phrases, counts) of the nodes of two words or more of the tree of the given suffixes with min_count or more."""
    leaves = pa.table({"phrase": phrases, "n": counts}).group_by("phrase").aggregate([("n", "sum")])
    words = pc.split_pattern(leaves["phrase"].combine_chunks(), " ")
    coded = words.flatten().cast(pa.binary()).dictionary_encode()
    names = pa.concat_arrays([pa.array([_BREAK]), coded.dictionary])
    length = np.diff(words.offsets.to_numpy())
    rows = np.zeros((len(length), max_words), np.int32)
    rows[np.arange(max_words) < length[:, None]] = coded.indices.to_numpy() + 1
    order = np.lexsort(rows.T[::-1])
    rows, n = rows[order], leaves["n_sum"].to_numpy()[order]
    differs = np.cumsum(rows[1:] != rows[:-1], axis=1) > 0
    common = max_words - differs.sum(axis=1)  # words that a suffix shares with the one before
    for depth in range(2, max_words + 1):
        first = np.concatenate([[0], np.flatnonzero(common < depth) + 1])
        total = np.add.reduceat(n, first)
        node = (rows[first, depth - 1] > 0) & (total >= min_count)
        yield depth, joined(names, rows[first[node], :depth]), total[node]


def _grow(max_words: int, min_count: int, hot):
    def grow(group: pa.Table) -> pa.Table:
        out = []
        for lang in pc.unique(group["lang"]).to_pylist():
            mine = group.filter(pc.equal(group["lang"], lang))
            for depth, phrases, n in subtree(pc.list_flatten(mine["phrases"].combine_chunks()), pc.list_flatten(mine["counts"].combine_chunks()), max_words, min_count):
                whole = np.array([(lang, p.as_py().encode()) not in hot.value for p in phrases], bool)  # an extended one has parts elsewhere
                out.append(pa.table({"lang": pa.array([lang] * int(whole.sum()), pa.string()), "phrase": phrases.filter(pa.array(whole)),
                                     "words": pa.array(np.full(whole.sum(), depth, np.int32)), "count": pa.array(n[whole])}))
        return pa.concat_tables(out)

    return grow


def frequent_phrases(docs: DataFrame, max_words: int = 3, min_count: int = 10, group_suffixes: int = GROUP_SUFFIXES) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, count) of all phrases of up to max_words words with min_count or more; (lang, n): words of each."""
    spark, schema = docs.sparkSession, "lang string, phrase string, count long"

    def summed(count, name):
        return staged(docs.mapInArrow(count, schema).groupBy("lang", "phrase").agg(F.sum("count").alias("count")), name)

    level = singles = summed(count_words, "phrase-words")
    sizes = singles.groupBy("lang").agg(F.sum("count").alias("n"))
    total = singles.agg(F.sum("count")).first()[0] or 0
    many = max(group_suffixes // 8, -(-total // MAX_PREFIXES))
    extended, known = set(), [singles.withColumn("words", F.lit(1))]
    for depth in range(1, max_words):
        crowded = {(r["lang"], r["phrase"].encode()) for r in level.filter(F.col("count") > many).collect()}
        if depth > 1:
            known.append(level.filter(F.col("count") > many).withColumn("words", F.lit(depth)))
        extended |= crowded
        if not crowded or depth == max_words - 1:
            break
        level = summed(_count_extensions(depth, spark.sparkContext.broadcast(crowded)), f"phrase-prefixes-{depth + 1}")
    groups, hot = max(1, -(-total // group_suffixes)), spark.sparkContext.broadcast(extended)
    dealt = docs.mapInArrow(_deal(max_words, groups, hot), "group int, lang string, phrases array<string>, counts array<long>")
    nodes = dealt.groupBy("group").applyInArrow(_grow(max_words, min_count, hot), "lang string, phrase string, words int, count long")
    columns = ["lang", "phrase", "words", "count"]
    phrases = nodes.select(*columns)
    for part in known:
        phrases = phrases.unionByName(part.filter(F.col("count") >= min_count).select(*columns))
    return staged(phrases, "phrases"), sizes


def collocations(docs: DataFrame, max_words: int = 3, min_count: int = 10, cover_percent: int = 50, top: int = 2000,
                 lang: str = "lang", text: str = "text", group_suffixes: int = GROUP_SUFFIXES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases by their weakest cut."""
    own = own_names(docs, lang=lang, text=text).select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    phrases, sizes = frequent_phrases(own, max_words, min_count, group_suffixes)
    found = phrases.filter("words > 1").withColumnRenamed("count", "a").withColumn("w", F.split("phrase", " "))
    part = lambda at, n: F.array_join(F.slice("w", at, n), " ")
    k = F.col("k")
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "lang", "phrase", "a", "k", part(F.lit(1), k).alias("first"), part(k + 1, F.col("words") - k).alias("rest"))
    counts = phrases.select("lang", "phrase", "count")
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("count").alias("l")), ["lang", "first"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("rest"), F.col("count").alias("r")), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    score = F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (wide("a") * wide("a")), wide("l") * wide("r"))
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.col("words") - n + 1), lambda at: F.array_join(F.slice("w", at, n), " "))))
    within = found.filter("words > 2").select("lang", "a", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(within, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(cover_percent) * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    best = kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score")).withColumn(
        "rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrase_mining(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
one AS (SELECT lang, unnest(w) AS phrase, 1 AS m FROM p),
two AS (SELECT lang, array_to_string(w[k:k + 1], ' ') AS phrase, 2 AS m FROM (SELECT lang, w, unnest(range(1, len(w))) AS k FROM p WHERE len(w) >= 2)),
three AS (SELECT lang, array_to_string(w[k:k + 2], ' ') AS phrase, 3 AS m FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS k FROM p WHERE len(w) >= 3)),
f AS (SELECT lang, phrase, m, count(*)::HUGEINT AS c FROM (FROM one UNION ALL FROM two UNION ALL FROM three) GROUP BY ALL),
n AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, phrase, m, c AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND c >= 10),
cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS lo, array_to_string(w[k + 1:], ' ') AS hi
         FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, k, l.c AS l, r.c AS r, (1000000 * a * a) // (l.c * r.c) AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = lo
  JOIN f r ON r.lang = cuts.lang AND r.phrase = hi),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, sub AS phrase, max(a) AS longer FROM (
    SELECT lang, a, array_to_string(w[1:2], ' ') AS sub FROM c WHERE m = 3
    UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM c WHERE m = 3) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.longer IS NULL OR 100 * i.longer < 50 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l,
       r::BIGINT AS r, n, score::BIGINT AS score
FROM kept JOIN n USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
