"""Source divergence audit against a plain Python version, and its awkward cases."""

import re

import pytest
from helpers import LOW, SCHEMA, Counter, clashing, corpus, defaultdict, frame, ordered
from pyspark.sql import functions as F

from barlattice.llm import source_audit
from barlattice.llm.source_audit import divergences

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
COLUMNS = ("lang", "source", "part", "item", "value", "rank")


def brute(rows, min_docs, top):
    docs, groups = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        terms = Counter(TERM.findall((text or "").translate(LOW)))
        docs[lang].update(set(terms))
        groups[lang, source].update(terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = {t for t, n in docs[lang].items() if n >= min_docs}
        mine = {s: {t: c[t] for t in kept} for (g, s), c in groups.items() if g == lang}
        whole = {t: sum(c[t] for c in mine.values()) for t in kept}

        def p(counts, t, kept=kept):
            return 1 + 1_000_000_000 * (counts[t] + 5) // (sum(counts.values()) + 5 * len(kept))

        for s, counts in mine.items():
            pairs = [(sum(abs(p(counts, t) - p(other, t)) for t in kept), o) for o, other in mine.items() if o != s]
            terms = [(p(counts, t) - p(whole, t), t) for t in kept if counts[t] and p(counts, t) > p(whole, t)]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return ordered(out)


def got(df):
    return ordered([tuple(r[c] for c in COLUMNS) for r in df.collect()])


@pytest.mark.parametrize("min_docs, top", [(3, 50), (8, 4)])
def test_matches_brute_force(spark, min_docs, top):
    rows = corpus(5, 60)
    assert got(divergences(clashing(frame(spark, rows)), min_docs, top)) == brute(rows, min_docs, top)


def test_small_stripes_blocks_and_slices(spark):
    rows = [(i, t, lang, f"s{i % 7}" if i % 5 else None, 1) for i, t, lang, _, _ in corpus(6, 40) if i is not None]
    assert got(divergences(frame(spark, rows), 2, block=3, slice_terms=5, spill_entries=20)) == brute(rows, 2, 50)


def test_no_kept_terms_no_rows_long_and_odd_texts(spark):
    rows = [(1, None, None, None, None), (2, "", "", "x", 0), (3, "one ÄÖ one", "de", "b", 1), (4, "1 2 3", "de", "a", 1), (5, "W" * 300_000, "de", None, 1)]
    assert got(divergences(frame(spark, rows), 30)) == brute(rows, 30, 50)
    assert {r[4] for r in got(divergences(frame(spark, rows), 30))} == {0}
    assert got(divergences(frame(spark, rows * 40), 30)) == brute(rows * 40, 30, 50)
    assert got(divergences(spark.createDataFrame([], SCHEMA))) == []


def test_shares_are_exact_beyond_64_bits(spark):
    big = 10**13
    row = spark.range(1).select(source_audit.share(F.lit(big), F.lit(3 * big + 1), F.lit(7)).alias("p")).first()
    import numpy as np

    want = 1 + 1_000_000_000 * (big + 5) // (3 * big + 1 + 35)
    assert row["p"] == want == source_audit._shares(np.array([[big]]), np.array([3 * big + 1]), 7)[0, 0]
