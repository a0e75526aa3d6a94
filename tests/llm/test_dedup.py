"""Exact, substring, suffix, line and near duplicates against plain Python versions."""

import hashlib
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import Counter, below, by_id, clashing, corpus, defaultdict, frame, ordered, spaced

from barlattice.llm import exact_dedup, jaccard_join, line_dedup, substring_dedup, suffix_dedup
from barlattice.llm.components import components
from barlattice.llm.sketch import Filling, at_least_two, pack, unpack
from barlattice.llm.textbytes import Words


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def test_exact_groups(docs, rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    want = []
    for i, t, *_ in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        want.append((i, keep, len(ids), i == keep))
    got = by_id(exact_dedup.exact_groups(clashing(docs)), "doc_id", "keep_id", "group_size", "kept")
    assert got == ordered(want)


def test_substring_repeats(docs, rows):
    first = {}
    for i, t, *_ in rows:
        w = spaced(t)
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(first.get(g, 10**9), below(i))
    want = []
    for i, t, *_ in rows:
        w = spaced(t)
        gone = {p for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < below(i) for p in range(k, k + 13)}
        want.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    got = by_id(substring_dedup.cut_repeats(clashing(docs)), "doc_id", "n_words", "n_removed", "kept")
    assert got == ordered(want)
    small = by_id(substring_dedup.cut_repeats(docs, max_cells=1 << 16), "doc_id", "n_words", "n_removed", "kept")
    assert small == got  # a full sketch lets more through and loses none


def cut_bytes(rows, length):
    places = Counter(b[k : k + length] for b in rows for k in range(len(b) - length + 1))
    out = []
    for b in rows:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if places[b[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = sum(1 for flag, _ in itertools.groupby(gone) if flag)
        out.append((len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize("length,spread,gram", [(400, 128, 16), (60, 20, 6)])
def test_suffix_repeats(docs, rows, length, spread, gram):
    texts = [(t or "").encode() for _, t, *_ in rows]
    want = [(i, *rest) for (i, *_), rest in zip(rows, cut_bytes(texts, length))]
    got = by_id(suffix_dedup.cut_repeats(clashing(docs), length, spread, gram), "doc_id", "n_bytes", "n_removed", "n_spans", "kept")
    assert [(*g[:4], bytes(g[4])) for g in got] == ordered(want)


def test_suffix_low_entropy(spark):
    texts = ["ab" * 500, "a" * 399, "a" * 400, "b" * 401, "abc" * 200 + "x" + "abc" * 200, "ab" * 200 + "q" + "ab" * 199]
    df = frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])
    want = [(i, *r) for i, r in enumerate(cut_bytes([t.encode() for t in texts], 400))]
    got = by_id(suffix_dedup.cut_repeats(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept")
    assert [(*g[:4], bytes(g[4])) for g in got] == want


def chunks_of(text):
    lines = (text or "").split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
    t = [i > 0 and (h[i - 1] * 31 + h[i]) % line_dedup.OF < line_dedup.TRIGGERS for i in range(len(h))]
    out, at = [], 0
    for i in range(len(lines)):
        if i == len(lines) - 1 or (t[i] and not t[i - 1]):
            out.append(lines[at : i + 1])
            at = i + 1
    return out


def test_line_chunks(docs, rows):
    first = {}
    for i, t, *_ in rows:
        for k, c in enumerate(chunks_of(t)):
            if sum(x.strip(" ") != "" for x in c) >= 2:
                first["\n".join(c)] = min(first.get("\n".join(c), (10**9, 0)), (below(i), k))
    want = []
    for i, t, *_ in rows:
        kept, removed = [], 0
        for k, c in enumerate(chunks_of(t)):
            joined = "\n".join(c)
            if joined in first and sum(x.strip(" ") != "" for x in c) >= 2 and first[joined] != (below(i), k):
                removed += len(c)
            else:
                kept.append(joined)
        want.append((i, None if t is None else "\n".join(kept), removed))
    out = line_dedup.dedup_lines(clashing(docs))
    assert set(clashing(docs).columns) < set(out.columns)
    got = [(r["doc_id"], r["text"], r["line_stats"]["removed_lines"]) for r in out.collect()]
    assert ordered(got) == ordered(want)
    assert sum(w[2] for w in want) > 10


def test_line_chunks_resist_shifts(spark):
    rng = random.Random(5)
    passage = [f"line {rng.random()}" for _ in range(40)]
    rows = [(k, "\n".join([f"own {k} {j}" for j in range(k)] + passage), None, None, None) for k in range(4)]
    out = {r["doc_id"]: r["line_stats"]["removed_lines"] for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert out[0] == 0 and all(out[k] >= 30 for k in (1, 2, 3))


def test_line_runs_inside_own_text(spark):
    """Passages of 2 to 5 lines of 25 to 60 words, each in two texts of own lines: every line of the later copy goes."""
    rng = random.Random(9)
    line = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(25, 61)))
    rows, size = [], {}
    for k in range(40):
        passage = [line() for _ in range(2 + k % 4)]
        for half in (0, 1):
            before, after = ([line() for _ in range(rng.randrange(1, 6))] for _ in range(2))
            rows.append((100 * half + k, "\n".join(before + passage + after), None, None, None))
        size[100 + k] = (len(passage), "\n".join(before + after))
    for r in line_dedup.dedup_runs(frame(spark, rows)).collect():
        assert (r["line_stats"]["removed_lines"], r["text"]) == size.get(r["doc_id"], (0, rows[2 * (r["doc_id"] % 100)][1]))


def test_line_runs(docs, rows):
    """Against plain Python: chunks and pairs of lines with content, pooled."""
    spans, first = [], {}
    for i, t, *_ in rows:
        lines, at, low = (t or "").split("\n"), 0, set()
        for c in chunks_of(t):
            if sum(x.strip(" ") != "" for x in c) >= 2:
                low.add((at, at + len(c) - 1))
            at += len(c)
        filled = [k for k, x in enumerate(lines) if x.strip(" ") != ""]
        low |= set(itertools.pairwise(filled))
        spans.append((lines, low))
        for a, b in low:
            s = "\n".join(lines[a : b + 1])
            first[s] = min(first.get(s, (10**9, 0)), (below(i), a))
    want = []
    for (i, t, *_), (lines, low) in zip(rows, spans, strict=True):
        gone = {k for a, b in low if first["\n".join(lines[a : b + 1])] != (below(i), a) for k in range(a, b + 1)}
        kept = [x for k, x in enumerate(lines) if k not in gone]
        want.append((i, None if t is None else "\n".join(kept), len(lines), len(gone), bool(gone) and not any(x.strip(" ") for x in kept)))
    out = line_dedup.dedup_runs(clashing(docs))
    assert set(clashing(docs).columns) < set(out.columns)
    assert ordered([(r["doc_id"], r["text"], *r["line_stats"]) for r in out.collect()]) == ordered(want)
    assert line_dedup.dedup_runs(docs.limit(0)).count() == 0
    # Every line that went has an equal one that stays.
    left = {x for _, t, *_ in want for x in (t or "").split("\n")}
    assert all(x in left for lines, _ in spans for x in lines if x.strip(" "))


def shingles(text):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in spaced(text)]
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_wanted(rows):
    """doc_id, n_shingles, component for rows of distinct ids."""
    sets = {i: shingles(t) for i, t, *_ in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y) and root(a) != root(b):
            up[max(root(a), root(b))] = min(root(a), root(b))
    return [(i, len(s), root(i)) for i, s in sets.items()]


def test_near_groups(docs, rows):
    known = [r for r in rows if r[0] is not None]
    got = by_id(jaccard_join.near_groups(clashing(docs)), "doc_id", "n_shingles", "component_id")
    null_row = [g for g in got if g[0] is None]
    assert len(null_row) == 1 and len(got) == len(rows)
    # The null id stands below all, so what it links with has a null component.
    linked = {g[0] for g in got if g[2] is None}
    want = {w for w in near_wanted(known)}
    assert {g for g in got if g[0] not in linked} <= want and linked
    assert {w[0] for w in want} == {g[0] for g in got} - {None}


def small_sets(seed):
    """Texts of few shingles: variants of short word runs, at and around the threshold."""
    rng, rows = random.Random(seed), []
    for base in range(12):
        words = [f"b{base}x{j}" for j in range(rng.randrange(1, 26))]
        for _ in range(6):
            w = list(words)
            for _ in range(rng.randrange(0, 3)):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], [w[k], "more"], ["else"]])
                w = w or ["one"]
            rows.append((len(rows) * 7, " ".join(w), None, None, None))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_groups_of_small_sets(spark, seed, monkeypatch):
    rows = small_sets(seed)
    assert len(near_wanted(rows)) - len({w[2] for w in near_wanted(rows)}) > 5
    for boundary in (None, 0, 12):
        if boundary is not None:
            monkeypatch.setattr(jaccard_join, "choose_boundary", lambda *a, b=boundary: b)
        got = by_id(jaccard_join.near_groups(frame(spark, rows)), "doc_id", "n_shingles", "component_id")
        assert got == ordered(near_wanted(rows)), boundary


def test_small_sets_with_two_centers(spark, monkeypatch):
    """A set that links with two others, themselves far apart: one link only shows in a key whose center isn't its smallest."""
    monkeypatch.setattr(jaccard_join, "choose_boundary", lambda *a: 12)
    rows = []
    for k in range(40):
        words = [f"g{k}w{i}" for i in range(14)]  # seven shingles a text; neighbours share six of eight, others fewer
        for shift in (0, 1, 2, 3):
            rows.append((10 * k + shift, " ".join(words[shift : shift + 11]), "en", "a", 0))
    want = near_wanted(rows)
    assert {w[2] % 10 for w in want} == {0}
    assert by_id(jaccard_join.near_groups(frame(spark, rows)), "doc_id", "n_shingles", "component_id") == ordered(want)


def test_outliers_of_near_copies_meet_few(spark, monkeypatch):
    """Outliers that link with few of a group's many near copies: more centers find those, so few pairs are left to compare."""
    rng, rows, left, staged = np.random.default_rng(5), [], [], jaccard_join.staged
    words = [f"w{i}" for i in range(150)]
    for k in range(300):
        text = list(words)
        for at in rng.choice(np.arange(4, 146, 6), 1 if k % 20 == 0 else 3 if k % 4 == 1 else 2, replace=False):
            text[at] = f"x{k}y{at}"
        rows.append((k, " ".join(text), "en", "a", 0))

    def counted(df, name):
        out = staged(df, name)
        if name == "jaccard-rest":
            left.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "staged", counted)
    got = by_id(jaccard_join.near_groups(frame(spark, rows)), "doc_id", "n_shingles", "component_id")
    assert got == ordered(near_wanted(rows))
    assert left[0] < 1000, left


def test_largest_partner_by_place(spark):
    """The bound by place equals a search, and bands never part a size from one that it may reach."""
    from pyspark.sql import functions as F

    rows = [(n, p) for n in (1, 2, 3, 7, 20, 146, 1000) for p in range(jaccard_join.prefix_length(n))]
    df = spark.createDataFrame(rows, "n int, place int").withColumn("most", F.expr(jaccard_join.largest_partner()))
    df = df.withColumn("bands", F.expr(f"{jaccard_join.band('most')} - {jaccard_join.band('n')}"))
    for r in df.collect():
        fit = [m for m in jaccard_join.partner_sizes(r["n"]) if jaccard_join.needed(r["n"], m) <= r["n"] - r["place"]]
        assert r["most"] == max(fit) and r["bands"] <= 4, r


def test_boundary_follows_cost():
    assert jaccard_join.choose_boundary({}) == 0
    few, many = jaccard_join.choose_boundary({8: 1000}), jaccard_join.choose_boundary({14: 1000})
    assert few >= 8 and many <= 14
    assert jaccard_join.subset_cost(4, 14) == sum(1 for _ in jaccard_join.partner_sizes(4)) + 3


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 30), (30, 31), (5, 5), (3, 2)] + [(100 + k, 101 + k) for k in range(20)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "u long, v long")).collect()))
    assert {k: v for k, v in got.items() if k < 50} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 30: 7, 31: 7}
    assert {v for k, v in got.items() if k >= 100} == {100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_sketch_never_underestimates():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 1 << 62, 3000).astype(np.uint64)
    twice = keys[:1000]
    filling = Filling(1 << 16)
    filling.add(keys)
    filling.add(twice)
    assert at_least_two(filling.packed, twice, 1 << 16).all()
    assert at_least_two(filling.packed, keys[1000:], 1 << 16).mean() < 0.05
    assert (pack(unpack(filling.packed)) == filling.packed).all()
    assert int(unpack(filling.packed).max()) <= 3


def test_words_of_batches():
    texts = [None, "", " a\tB  c", "d", "\n", "é x y\x00z", "a"]
    words = Words(pa.array(texts))
    assert words.counts.tolist() == [len(spaced(t)) for t in texts]
    assert words.hash[0] == words.hash[-1] and len(set(words.hash.tolist())) == len(words.hash) - 1
    sliced = Words(pa.array(texts).slice(2, 3))
    assert sliced.hash.tolist() == words.hash[:4].tolist()


def test_empty_tables(spark):
    none = frame(spark, [], 1)
    assert exact_dedup.exact_groups(none).count() == 0
    assert substring_dedup.cut_repeats(none).count() == 0
    assert suffix_dedup.cut_repeats(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0
    assert jaccard_join.near_groups(none).count() == 0
