"""Small corpora with the awkward cases, and plain Python versions of the contracts."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import types as T

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
# Names that operators use within.
CLASHING = ("pos", "term", "key", "window", "n", "gone", "chunks", "lines", "place", "d1", "block", "features", "spans", "doc", "keep_id", "size")


def passages(rng, n, low=3, high=40):
    words = [f"w{rng.randrange(40)}" if rng.random() < 0.5 else f"r{rng.randrange(4000)}" for _ in range(2000)]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(low, high))) for _ in range(n)]


def corpus(seed=1, n=70):
    """(doc_id, text, lang, source, n_chars): shared lines and passages, exact and near copies, nulls, blanks, a long text."""
    rng = random.Random(seed)
    shared, own, texts = passages(rng, 6, 15, 90), passages(rng, 400), []
    for _ in range(n):
        lines = [rng.choice(shared) if rng.random() < 0.25 else rng.choice(own) for _ in range(rng.randrange(1, 12))]
        texts.append("\n".join(lines))
    for k in range(n // 4):  # exact and near copies
        base = texts[rng.randrange(n)]
        if k % 2:
            words = base.split(" ")
            words[rng.randrange(len(words))] = "edited"
            base = " ".join(words)
        texts.append(base)
    texts += [None, "", " ", "\n\n", "a", "ß", "A b C", "a B c", "tab\tand nbsp", "x\x00y z", " ".join(own), "same same same " * 300, texts[0], texts[0]]
    sources = ["b", "a", "c", None, "a", "a"]
    rows = [(i * 3, t, rng.choice(["en", "de", None]), sources[i % 6], None if t is None else len(t)) for i, t in enumerate(texts)]
    return rows + [(None, texts[1], "en", "a", 1), (6, texts[2], "en", "b", 1)]  # a null id, a row that stands twice


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def clashing(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in CLASHING})


def by_id(df, *columns):
    """Sorted rows of the columns; None sorts first."""
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    return sorted(rows, key=lambda r: tuple((v is not None, v) for v in r))


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, v) for v in r))


def spaced(text):
    return SPACED.findall(text or "")


def plain(text):
    return PLAIN.findall((text or "").translate(LOW))


def below(i):
    return -1 if i is None else i


__all__ = ["Counter", "SCHEMA", "below", "by_id", "clashing", "corpus", "defaultdict", "frame", "ordered", "passages", "plain", "spaced"]
