"""Source divergence audit: how far the sources of a language differ in their use of terms, by in-mapper stripes.

1. A partition folds whole documents into stripes: term -> (documents with it, counts by source), for each language. A
   table of stripes that grows to SPILL_ENTRIES is spilled: its rows go out and a new one is begun.
2. Stripes merge by key. Counts are first added by (language, term, source), so that a term that every partition holds
   meets only its partial counts of one source in a task; then each term's stripe is put together (a count a source).
3. Stripes of kept terms give the totals, and then directly the divergences: the term part from the stripe's own
   entries; the pair part from matrices of BLOCK x BLOCK sources, added up over slices of a language's stripes.

Values are integers (see `share`), so sums in any order are the same. A pair of sources is one output row, as asked; the
matrices hold a bounded block of sources and no pair of documents or terms is ever formed.

Null text, lang and source are ''. A document without terms still makes its (lang, source) known. Repeated rows count as
often as they stand. A language without kept terms has pairs of value 0 and no terms. An empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlattice.llm.common import own_names, staged, table

SPILL_ENTRIES, SPILL_BYTES = 300_000, 1 << 26
BLOCK, SLICE_TERMS = 128, 4096
SCALE, PRIOR = 1_000_000_000, 5
TERM = re.compile(rb"[a-z\x80-\xff]+")  # of lower-cased UTF-8: letters of ASCII, and all characters beyond


def fold(batches: Iterator[pa.RecordBatch], most: int = SPILL_ENTRIES) -> Iterator[pa.RecordBatch]:
    """Stripes (lang, term, n_docs, sources, counts) of documents (lang, source, text)."""
    stripes: dict[tuple[str, bytes], list] = {}
    entries = held = 0

    def spill() -> pa.RecordBatch:
        keys, rows = list(stripes), list(stripes.values())
        return pa.record_batch({
            "lang": pa.array([k[0] for k in keys], pa.string()), "term": pa.array([k[1] for k in keys], pa.binary()).cast(pa.string()),
            "n_docs": pa.array([r[0] for r in rows], pa.int64()), "sources": pa.array([list(r[1]) for r in rows], pa.list_(pa.string())),
            "counts": pa.array([list(r[1].values()) for r in rows], pa.list_(pa.int64()))})

    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts, strict=True):
            seen: dict[bytes, int] = {}
            for term in TERM.findall(text.as_py().lower()):
                seen[term] = seen.get(term, 0) + 1
            for term, n in seen.items():
                stripe = stripes.get((lang, term))
                if stripe is None:
                    stripe = stripes[lang, term] = [0, {}]
                    held += len(term)
                stripe[0] += 1
                by_source = stripe[1]
                if source not in by_source:
                    entries += 1
                    by_source[source] = n
                else:
                    by_source[source] += n
            if entries >= most or held >= SPILL_BYTES:
                yield spill()
                stripes.clear()
                entries = held = 0
    if stripes:
        yield spill()


def merged_stripes(docs: DataFrame, min_docs: int, most: int = SPILL_ENTRIES) -> DataFrame:
    """lang, term, stripe (array of source and count) of the terms that stand in at least min_docs documents of the language."""
    folded = docs.mapInArrow(lambda batches: fold(batches, most), "lang string, term string, n_docs long, sources array<string>, counts array<long>")
    entries = folded.select("lang", "term", "n_docs", F.posexplode(F.arrays_zip("sources", "counts")).alias("place", "entry"))
    added = entries.groupBy("lang", "term", F.col("entry.sources").alias("source")).agg(
        F.sum("entry.counts").alias("count"), F.sum(F.when(F.col("place") == 0, F.col("n_docs")).otherwise(0)).alias("n_docs"))
    # n_docs of a spilled stripe stands with one of its sources, so it adds up over the term's sources
    together = added.groupBy("lang", "term").agg(F.sum("n_docs").alias("n_docs"), F.collect_list(F.struct("source", "count")).alias("stripe"))
    return together.filter(F.col("n_docs") >= min_docs).drop("n_docs")


def share(count, total, terms) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), exactly."""
    wide = F.lit(SCALE).cast("decimal(10,0)") * (count + F.lit(PRIOR)).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", wide, (total + F.lit(PRIOR) * terms).cast("decimal(20,0)"))


def _shares(counts: np.ndarray, totals: np.ndarray, terms: int) -> np.ndarray:
    """`share` of a matrix of counts (terms x sources)."""
    if terms == 0:
        return np.zeros(counts.shape, np.int64)
    if int(counts.max(initial=0)) < 9_000_000_000:  # the product fits 64 bits
        return 1 + SCALE * (counts + PRIOR) // (totals + PRIOR * terms)
    exact = SCALE * (counts.astype(object) + PRIOR) // (totals.astype(object) + PRIOR * terms)
    return 1 + exact.astype(np.int64)


def _distances(key: tuple, stripes: pa.Table, groups: pa.Table, block: int) -> pa.Table:
    """Sums over a slice's terms of |p - q| for the sources of one block with those of another."""
    row_block, column_block = key[1].as_py(), key[2].as_py()
    groups = groups.sort_by("number")
    names, number, totals = groups["source"].to_pylist(), groups["number"].to_numpy(), groups["total"].to_numpy()
    terms, counts = groups["terms"][0].as_py(), np.zeros((len(stripes), len(groups)), np.int64)
    if len(stripes):
        held = stripes["numbers"].combine_chunks()
        row = np.repeat(np.arange(len(stripes)), np.diff(held.offsets.to_numpy()))
        counts[row, np.searchsorted(number, held.flatten().to_numpy())] = stripes["counts"].combine_chunks().flatten().to_numpy()
    p = _shares(counts, totals, terms)
    rows, columns = (np.flatnonzero(number // block == b) for b in (row_block, column_block))
    out = {"source": [], "item": [], "value": []}
    for i in rows:
        for j, value in zip(columns, np.abs(p[:, [i]] - p[:, columns]).sum(axis=0).tolist(), strict=True):
            if i != j:
                for a, b in {(i, j), (j, i)} if row_block != column_block else {(i, j)}:
                    out["source"].append(names[a]), out["item"].append(names[b]), out["value"].append(value)
    return pa.table({"lang": pa.array([key[0].as_py()] * len(out["value"]), pa.string()), "source": pa.array(out["source"], pa.string()),
                     "item": pa.array(out["item"], pa.string()), "value": pa.array(out["value"], pa.int64())})


def divergences(docs: DataFrame, min_docs: int = 30, top_terms: int = 50, lang: str = "lang", source: str = "source", text: str = "text",
                block: int = BLOCK, slice_terms: int = SLICE_TERMS, spill_entries: int = SPILL_ENTRIES) -> DataFrame:
    """lang, source, part, item, value, rank: pairs of sources, and the terms a source uses more than its language does."""
    own = own_names(docs, lang=lang, source=source, text=text)
    own = own.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in own.columns))
    stripes = staged(merged_stripes(own, min_docs, spill_entries), "audit-stripes")
    entries = stripes.select("lang", "term", F.inline("stripe"))
    terms = stripes.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    known = own.groupBy("lang", "source").agg(F.lit(1).alias("one"))
    totals = entries.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    numbered = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = staged(
        known.join(totals, ["lang", "source"], "left").join(terms, "lang", "left")
        .select("lang", "source", F.coalesce("total", F.lit(0).cast("long")).alias("total"), F.coalesce("terms", F.lit(0).cast("long")).alias("terms"),
                numbered.alias("number")), "audit-groups")
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.count(F.lit(1)).alias("sources"))

    in_lang = stripes.select("lang", "term", F.aggregate("stripe", F.lit(0).cast("long"), lambda a, x: a + x["count"]).alias("lang_count"), F.inline("stripe"))
    p = share(F.col("count"), F.col("total"), F.col("terms"))
    q = share(F.col("lang_count"), F.col("lang_total"), F.col("terms"))
    by_value = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    more = (
        in_lang.join(groups.join(langs, "lang"), ["lang", "source"])
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).alias("value")).filter("value > 0")
        .withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top_terms))

    slices = F.greatest(F.lit(1), F.ceil(F.col("terms") / slice_terms)).cast("int")
    blocks = F.sequence(F.lit(0), F.expr(f"(sources - 1) div {block}").cast("int"))
    pairs = F.filter(F.flatten(F.transform(blocks, lambda i: F.transform(blocks, lambda j: F.struct(i.alias("i"), j.alias("j"))))), lambda b: b["i"] <= b["j"])
    plan = groups.join(langs, "lang").withColumn("slices", slices)
    dealt = plan.withColumn("b", F.explode(pairs)).filter(F.expr(f"number div {block} in (b.i, b.j)")).select(
        "lang", "b.i", "b.j", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "source", "number", "total", "terms")
    # every term goes to every pair of blocks, for two sources without it may differ as well
    placed = in_lang.join(plan.select("lang", "source", "number", "slices", "sources"), ["lang", "source"]).groupBy("lang", "term", "slices", "sources").agg(
        F.collect_list(F.struct("number", "count")).alias("stripe"))
    sent = placed.withColumn("b", F.explode(pairs)).select(
        "lang", "b.i", "b.j", F.pmod(F.xxhash64("term"), F.col("slices")).cast("int").alias("slice"),
        F.filter("stripe", lambda x: F.floor(x["number"] / block).isin(F.col("b.i"), F.col("b.j"))).alias("stripe"),
    ).select("lang", "i", "j", "slice", F.col("stripe.number").alias("numbers"), F.col("stripe.count").alias("counts"))
    keys = ["lang", "i", "j", "slice"]
    parts = sent.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(
        lambda key, left, right: _distances(key, left, right, block), "lang string, source string, item string, value long")
    pair = parts.groupBy("lang", "source", F.lit("pair").alias("part"), "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(by_value))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pair.select(*columns).unionByName(more.select(*columns))


def op11_source_divergence(spark, sf_dir):
    return divergences(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS nd FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n)::HUGEINT AS lang_count FROM t GROUP BY ALL HAVING sum(nd) >= 30),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(lang_count)::HUGEINT AS nl FROM kept GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
k AS (SELECT g.lang, g.source, kept.term, coalesce(t.n, 0)::HUGEINT AS n, lang_count
      FROM g JOIN kept USING (lang) LEFT JOIN t ON t.lang = g.lang AND t.source = g.source AND t.term = kept.term),
s AS (SELECT lang, source, sum(n)::HUGEINT AS ns FROM k GROUP BY ALL),
p AS (SELECT k.lang, k.source, k.term, k.n, 1 + (1000000000 * (k.n + 5)) // (ns + 5 * v) AS p, 1 + (1000000000 * (lang_count + 5)) // (nl + 5 * v) AS q
      FROM k JOIN s USING (lang, source) JOIN v USING (lang)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
             FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
    ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM terms
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= 50
"""
