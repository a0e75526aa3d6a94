"""Phrase mining against a plain Python version, with small groups (extended prefixes) and longer phrases."""

import re

import pyarrow as pa
import pytest
from helpers import LOW, SCHEMA, Counter, clashing, corpus, defaultdict, frame, ordered

from barlattice.llm import phrase_mining
from barlattice.llm.phrase_mining import collocations, subtree

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def brute(rows, max_words, min_count, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, _, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOW)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for m in range(1, max_words + 1):
                f[lang].update(" ".join(w[k : k + m]) for k in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: c for p, c in counts.items() if " " in p and c >= min_count}
        found = []
        for p, a in cand.items():
            w = p.split(" ")
            cuts = []
            for k in range(1, len(w)):
                left, right = counts[" ".join(w[:k])], counts[" ".join(w[k:])]
                cuts.append((1_000_000 * a * a // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            if not any(len(q) > len(p) and f" {p} " in f" {q} " and 100 * c >= 50 * a for q, c in cand.items()):
                found.append((-score, -a, p.encode(), left, right))
        for k, (score, a, p, left, right) in enumerate(sorted(found)[:top]):
            out.append((lang, k + 1, p.decode(), -a, left, right, n[lang], -score))
    return ordered(out)


def got(df):
    return ordered([tuple(r[c] for c in COLUMNS) for r in df.collect()])


def rows():
    odd = ["The cat, the cat; THE CAT sat\ton the mat. The cat sat on" + " the cat" * 30, "a\x1fb c d " * 20 + "é ü é ü", "...!?", "x\xa0y z x\xa0y z\rx\xa0y z"]
    return corpus(9, 50) + [(900 + k, t, None if k % 2 else "und", "s", 1) for k, t in enumerate(odd * 3)]


@pytest.mark.parametrize("max_words, min_count, top, size", [(3, 10, 2000, 2_000_000), (3, 3, 40, 64), (4, 3, 2000, 200), (2, 2, 2000, 16)])
def test_matches_brute_force(spark, max_words, min_count, top, size):
    want = brute(rows(), max_words, min_count, top)
    assert len(want) > 20
    assert got(collocations(clashing(frame(spark, rows())), max_words, min_count, 50, top, group_suffixes=size)) == want


def test_small_chunks_and_wide_vocabularies(spark, monkeypatch):
    tokens = [(lang, text) for _, text, lang, _, _ in rows()]
    batch = pa.record_batch({"lang": [lang or "und" for lang, _ in tokens], "text": [text or "" for _, text in tokens]})
    whole = Counter()
    for lang, ids, names in phrase_mining.chunks(iter([batch])):
        found, counts = phrase_mining.suffixes(ids, 3, len(names))
        wide, wide_counts = phrase_mining.suffixes(ids, 3, 1 << 40)
        assert found.tolist() == wide.tolist() and counts.tolist() == wide_counts.tolist()
        whole.update({(lang, *(names[i] for i in r if i)): n for r, n in zip(found, counts.tolist(), strict=True)})
    monkeypatch.setattr(phrase_mining, "CHUNK_WORDS", 50)
    parts = Counter()
    for lang, ids, names in phrase_mining.chunks(iter([batch])):
        for r, n in zip(*phrase_mining.suffixes(ids, 3, len(names)), strict=True):
            parts[lang, *(names[i] for i in r if i)] += int(n)
    assert parts == whole


def test_leaf_totals():
    leaves = {"a b": 2, "a b c": 3, "a b d": 1, "a c": 4, "b c d": 5}
    tree = {p.as_py(): int(n) for _, ps, ns in subtree(pa.array(list(leaves)), pa.array(list(leaves.values())), 3, 2) for p, n in zip(ps, ns, strict=True)}
    assert tree == {"a b": 6, "a c": 4, "b c": 5, "a b c": 3, "b c d": 5}


def test_empty(spark):
    assert got(collocations(spark.createDataFrame([], SCHEMA))) == []
    assert got(collocations(frame(spark, [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "one two", "en", "a", 1)]))) == []
