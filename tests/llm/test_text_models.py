"""License scan, decontamination, language, toxicity and mixing."""

import random

import numpy as np
import pytest
from helpers import by_id, clashing, corpus, defaultdict, frame, ordered, passages, plain, spaced
from pyspark.sql import functions as F

from barlattice.llm import decontaminate, language_id, license_scan, mixing, toxicity


@pytest.fixture(scope="module")
def rows():
    return corpus(3)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


PHRASES = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}


def base_of(text):
    w, places = plain(text), []
    for label, phrase in PHRASES.items():
        p = phrase.split(" ")
        places += [(k, label) for k in range(len(w)) if w[k : k + len(p)] == p]
    at = [k for k, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_license_base_places(spark, rows):
    texts = [t for _, t, *_ in rows] + [
        "Under the MIT License. mit license, MIT  license!", "gnu general public license gnu general public license", "CC BY-NC 4.0, cc by",
        "smit license apache license", "Licensed under the Apache License, Version 2.0", "apachelicense", "APACHE LICENSE" * 50]
    df = frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])
    got = by_id(license_scan.scan(clashing(df)), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got == [(i, *base_of(t)) for i, t in enumerate(texts)]


def test_license_labels(spark):
    cases = {
        "Licensed under the Apache License, Version 2.0": ("apache,apache-2.0", 0.95),
        "This work is licensed under the GNU General Public License, version 3.": ("gpl,gpl-3.0", 0.95),
        "Licensed under CC BY-NC 4.0.": ("cc-by,cc-by-nc-4.0", 0.95),
        "SPDX-License-Identifier: MPL-2.0": ("mpl-2.0", 1.0),
        "nothing to see": ("", 0.0),
    }
    df = frame(spark, [(i, t, None, None, None) for i, t in enumerate(cases)])
    got = by_id(license_scan.scan(df), "doc_id", "labels", "score")
    assert [g[1:] for g in got] == list(cases.values())


def test_license_rules_are_many_and_ordered():
    made = license_scan.rules()
    assert len(made) > 300 and [r.priority for r in made] == sorted(r.priority for r in made)
    scanner = license_scan.Scanner(made)
    for label, spdx, *_ in license_scan.FAMILIES:
        found = scanner.detections(f"x spdx license identifier {spdx} y")
        assert label in {f[2].label for f in license_scan.resolve(found)}, label


def test_license_suppression():
    def rule(p, label="a"):
        return license_scan.Rule(label, "", "", p, 0.5)

    found = [(0, 5, rule(1)), (1, 3, rule(2, "b")), (4, 8, rule(2, "c")), (5, 7, rule(3, "d")), (4, 8, rule(2, "e")), (9, 9, rule(3, "f"))]
    assert [f[2].label for f in license_scan.resolve(found)] == ["a", "c", "f"]


def contaminated(rows, items, n=10):
    windows = defaultdict(set)
    for item, text in items:
        w = plain(text)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            windows[tuple(w[k : k + n])].add(item)
    out = []
    for i, t in rows:
        w, hit, ids = plain(t), set(), set()
        for g, of in windows.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    ids |= of
        out.append((i, len(w), len(hit), sorted(map(str, ids)), bool(hit)))
    return out


def test_decontamination(spark):
    rng = random.Random(4)
    items = [(k, t) for k, t in enumerate(passages(rng, 25, 4, 40))] + [(100, None), (101, ""), (102, "w1"), (103, "the only one"), (3, "twice the id of another item but with words of its own here")]
    items.append((104, items[5][1]))
    texts = []
    for t in passages(rng, 60, 5, 80):
        w = t.split(" ")
        if rng.random() < 0.6:
            piece = plain(rng.choice(items)[1])
            a = rng.randrange(len(piece) + 1)
            at = rng.randrange(len(w) + 1)
            w[at:at] = piece[a : a + rng.randrange(6, 20)]
        texts.append(", ".join(w) if rng.random() < 0.2 else " ".join(w).upper())
    rows = [(i, t) for i, t in enumerate([*texts, None, "", "w1", "the only one", *(plain(t) and t for _, t in items[:3])])] + [(None, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = contaminated(rows, items)
    got = by_id(decontaminate.contamination(clashing(df), clashing(bench)), "doc_id", "n_words", "n_hit", "item_ids", "contaminated")
    assert got == ordered(want) and sum(w[4] for w in want) > 10
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r["contaminated"] for r in decontaminate.contamination(df, none).collect())
    assert decontaminate.contamination(df.limit(0), bench).count() == 0


def test_proximity(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item_id long, text string")
    df = spark.createDataFrame([(1, "so alpha then beta here"), (2, "alpha " + "x " * 30 + "beta"), (3, "beta")], "doc_id long, text string")
    found = {r["doc_id"] for r in decontaminate.proximity_matches(df, bench, slop=3).collect()}
    assert found == {1}


def language_rows(n=160):
    rng, rows = random.Random(2), []
    stems = {"aa": ["the", "and", "with", "from", "house"], "bb": ["der", "und", "nicht", "schule", "ich"], "cc": ["que", "para", "los", "el", "mente"]}
    for i in range(n):
        lang = rng.choice(list(stems))
        rows.append((i, " ".join(rng.choice(stems[lang]) for _ in range(rng.randrange(3, 40))), lang if i % 5 else None, "s", 1))
    return rows + [(n + 1, None, None, None, None), (n + 2, "123 -- !", None, None, None), (n + 3, "", "aa", None, None), (n + 4, "x" * 5000, None, None, None)]


def test_language_held_out(spark):
    rows = language_rows()
    df = frame(spark, rows).withColumn("held_out", language_id.held_out(F.col("doc_id")))
    out = language_id.identify(df.select("doc_id", "held_out", "text"), df.filter("NOT held_out AND lang IS NOT NULL"))
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(rows)
    n = len(rows) - 4
    assert got[n + 1]["lang_pred"] == got[n + 2]["lang_pred"] == got[n + 3]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    judged = [(got[i]["lang_pred"], lang) for i, _, lang, *_ in rows if lang and got[i]["held_out"] and i < n]
    assert len(judged) > 15 and np.mean([a == b for a, b in judged]) > 0.95
    nothing = language_id.identify(df.select("doc_id", "text"), df.limit(0))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}


def test_forward_sums_all_segmentations():
    names = [b" a", b"a", b"b", b"ab", b" ab", b" ", b"ba"]
    vocabulary = language_id.Vocabulary(names)
    prob = np.array([[0.1, 0.2, 0.05, 0.15, 0.2, 0.1, 0.2]]).T
    p = {n: float(x) for n, x in zip(names, prob[:, 0])}

    def total(word):
        return 1.0 if not word else sum(p.get(word[:k], 1e-9 if k == 1 else 0.0) * total(word[k:]) for k in range(1, len(word) + 1))

    def corrected(word):  # a covered byte may also go unseen
        return 1.0 if not word else sum((p.get(word[:k], 0.0) + (1e-9 if k == 1 else 0.0)) * corrected(word[k:]) for k in range(1, len(word) + 1))

    for word in (b" ab", b" abab", b" aab", b" abcab"):
        got = language_id.forward(vocabulary, np.frombuffer(word, np.uint8)[None, :], prob)[0, 0]
        assert got == pytest.approx(np.log(corrected(word)), rel=1e-9)
        assert total(word) <= corrected(word) * (1 + 1e-12)
    counts = language_id.expected(vocabulary, np.frombuffer(b" ab", np.uint8)[None, :], np.array([2.0]), prob[:, 0])
    ways = {(" ab",): 0.2, (" a", "b"): 0.1 * 0.05, (" ", "ab"): 0.1 * 0.15, (" ", "a", "b"): 0.1 * 0.2 * 0.05}
    want = {n: 2 * sum(v for k, v in ways.items() if n.decode() in k) / sum(ways.values()) for n in names}
    assert counts == pytest.approx([want[n] for n in names], abs=1e-6)


def test_toxicity_chain(spark):
    rng, rows, labels = random.Random(6), [], []
    for i in range(300):
        words = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(5, 40))]
        toxic = i % 5 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["vile", "nasty"])
        rows.append((i, " ".join(words), "en", "s", 1))
        if i % 3:
            labels.append((i, int(rng.random() < 0.7), int(toxic)))
    rows += [(900, None, None, None, None), (901, "", None, None, None), (None, "vile vile", None, None, None)]
    labels += [(None, 1, 1), (5000, 1, 1), (3, None, None), (1, 1, None)]
    df = frame(spark, rows)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = toxicity.score_toxicity(clashing(df), table)
    assert set(clashing(df).columns) < set(out.columns) and out.count() == len(rows)
    got = {r["doc_id"]: r for r in out.collect()}
    truth = {i: i % 5 == 0 for i in range(300)}
    assert np.mean([got[i]["rejected"] == t for i, t in truth.items()]) > 0.97
    assert got[None]["rejected"] and not got[900]["rejected"] and not got[901]["rejected"]
    none = toxicity.score_toxicity(df, table.limit(0))
    assert none.filter("rejected").count() == 0 and none.count() == len(rows)
    clean = toxicity.score_toxicity(df, table.withColumn("toxic", F.lit(0)))
    assert clean.filter("rejected").count() == 0


def water(sizes, weights, most=3.0):
    """Targets by sharing again until none is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_, total = {}, set(names), float(sum(sizes.values()))
    while open_:
        factor = (total - sum(target.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if factor * weight[s] > most * sizes[s]]
        if not over:
            target |= {s: factor * weight[s] for s in open_}
            break
        target |= {s: most * sizes[s] for s in over}
        open_ -= set(over)
    return target


@pytest.mark.parametrize("block_rows", [20_000, 7])
def test_mixing(spark, docs, rows, block_rows):
    sizes = defaultdict(int)
    for _, t, _, source, _ in rows:
        sizes[source] += len(spaced(t))
    target = water(sizes, mixing.WEIGHTS)
    out = mixing.mix_sources(clashing(docs).withColumn("size", F.lit(1)), block_rows=block_rows)
    got = out.collect()
    assert sorted(map(str, (r["doc_id"] for r in got))) == sorted(str(r[0]) for r in rows)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s]
    again = by_id(mixing.mix_sources(docs.repartition(5), block_rows=block_rows), "doc_id", "size", "taken")
    assert again == ordered([(r["doc_id"], r["size"], r["taken"]) for r in got])


def test_mixing_targets_with_caps(spark):
    sizes = {"a": 10, "b": 1000, "c": 0, "d": 500, None: 3}
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(water(sizes, mixing.WEIGHTS))


def test_flight_keeps_totals():
    rng = np.random.default_rng(1)
    size, p = rng.integers(0, 500, 400).astype(float), rng.random(400)
    moved = mixing.flight(size, p, np.random.default_rng(2))
    assert ((moved > 0) & (moved < 1)).sum() <= 2
    assert moved.sum() == pytest.approx(p.sum()) and (moved * size).sum() == pytest.approx((p * size).sum())
    rate = np.mean([mixing.flight(size[:40], np.full(40, 0.3), np.random.default_rng(k)) for k in range(400)])
    assert rate == pytest.approx(0.3, abs=0.02)


def test_mixing_of_nothing(spark):
    assert mixing.mix_sources(frame(spark, [], 1)).count() == 0
    out = mixing.mix_sources(frame(spark, [(1, None, None, "a", None), (2, "", None, None, None)])).collect()
    assert [(r["taken"], r["target"]) for r in out] == [(0, 0.0)] * 2
