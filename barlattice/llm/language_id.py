"""Language identification by unigram pieces with all segmentations summed.

The pieces are a fixed public vocabulary (a parameter). Every language has a probability for each piece, fitted by
expectation maximisation: a word's expected piece counts come from the forward-backward sums over all of its
segmentations. A text's likelihood in a language is the product over its words of the forward sum, i.e. of the total
probability of all ways to cut the word into pieces; the prediction is the language of the largest likelihood.

Words are runs of letters, with a word-start mark, so no piece crosses words and the sum over a text's segmentations
is the product of the words' sums. Each slice of text scores its distinct words once, in numpy, for all languages.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlattice.llm.common import staged, table
from barlattice.llm.textbytes import Words, mixed, pieces

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLE_DOCS = 400  # documents a language that are learned from, about; whole texts
ROUNDS = 4
LONGEST_PIECE = 16  # bytes
UNKNOWN = 1e-9  # of a byte that no piece covers, in every language
SMOOTHING = 0.01
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SLOTS = 1 << 18
_P = np.uint64(0x9E3779B97F4A7C15)


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """Lower-case letter pieces of a sentencepiece model, in UTF-8, the word-start mark as a blank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)))
    plain = {n.replace("▁", " ") for n in names}
    kept = (n for n in plain if n == n.lower() and (n.strip().isalpha() or n == " ") and " " not in n[1:])
    return sorted(b for b in (n.encode() for n in kept) if len(b) <= LONGEST_PIECE)


class Vocabulary:
    """Byte strings to ids, many at a time: an open hash table of rolling hashes."""

    def __init__(self, names: list[bytes]):
        self.size = len(names)
        self.keys, self.ids = np.zeros(_SLOTS, np.uint64), np.full(_SLOTS, -1, np.int32)
        for i, name in enumerate(names):
            h = np.uint64(0)
            for b in name:
                h = np.multiply(h, _P) + np.uint64(b + 1)
            key = mixed(np.array([h], np.uint64))[0]
            at = int(key >> np.uint64(46))
            while self.ids[at] >= 0:
                at = (at + 1) % _SLOTS
            self.keys[at], self.ids[at] = key, i

    def find(self, hashes: np.ndarray) -> np.ndarray:
        key = mixed(hashes)
        at = (key >> np.uint64(46)).astype(np.int64)
        out = np.full(len(key), -1, np.int32)
        open_ = np.arange(len(key))
        while len(open_):
            slot = at[open_]
            ids = self.ids[slot]
            hit = (ids >= 0) & (self.keys[slot] == key[open_])
            out[open_[hit]] = ids[hit]
            open_ = open_[~hit & (ids >= 0)]
            at[open_] = (at[open_] + 1) % _SLOTS
        return out


def word_matrix(words: Words, which: np.ndarray):
    """(length, rows of which, matrix of bytes): the words grouped by length, each with the start mark before it."""
    size = (words.end - words.start)[which]
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        step = max(1, 4_000_000 // int(n + 1))
        for k in range(0, len(rows), step):
            part = rows[k : k + step]
            body = words.folded[words.start[which[part]][:, None] + np.arange(n)]
            yield part, np.concatenate([np.full((len(part), 1), 32, np.uint8), body], axis=1)


def cuts(vocabulary: Vocabulary, matrix: np.ndarray, end: int) -> list[tuple[int, np.ndarray]]:
    """(start, piece ids or -1) of the pieces that may end before byte `end`."""
    out, h, power = [], np.zeros(len(matrix), np.uint64), np.uint64(1)
    for start in range(end - 1, max(-1, end - 1 - LONGEST_PIECE), -1):
        h = h + power * (matrix[:, start].astype(np.uint64) + np.uint64(1))
        power = np.multiply(power, _P)
        out.append((start, vocabulary.find(h)))
    return out


def forward(vocabulary: Vocabulary, matrix: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """log of the summed probability of all segmentations: a row per word, a column per language. prob: pieces x languages."""
    n, langs = matrix.shape[1], prob.shape[1]
    table_ = np.concatenate([prob, np.zeros((1, langs))])  # id -1: no piece
    alpha = {0: np.ones((len(matrix), langs))}
    scale = np.zeros(len(matrix))
    for end in range(1, n + 1):
        total = alpha[end - 1] * UNKNOWN
        for start, ids in cuts(vocabulary, matrix, end):
            total += alpha[start] * table_[ids]
        alpha[end] = total
        alpha.pop(end - LONGEST_PIECE, None)
        if end % 8 == 0:
            top = np.maximum(total.max(axis=1), 1e-250)
            scale += np.log(top)
            for a in alpha.values():
                a /= top[:, None]
    return np.log(np.maximum(alpha[n], 1e-300)) + scale[:, None]


def expected(vocabulary: Vocabulary, matrix: np.ndarray, weight: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Expected piece counts of weighted words under one language's probabilities."""
    n, out = matrix.shape[1], np.zeros(vocabulary.size + 1)
    table_ = np.append(prob, 0.0)
    steps = [cuts(vocabulary, matrix, end) for end in range(1, n + 1)]
    alpha = np.zeros((n + 1, len(matrix)))
    alpha[0] = 1
    for end in range(1, n + 1):
        alpha[end] = alpha[end - 1] * UNKNOWN + sum(alpha[start] * table_[ids] for start, ids in steps[end - 1])
    beta = np.zeros((n + 1, len(matrix)))
    beta[n] = 1
    total = np.maximum(alpha[n], 1e-300)
    for end in range(n, 0, -1):
        beta[end - 1] += beta[end] * UNKNOWN
        for start, ids in steps[end - 1]:
            p = table_[ids]
            beta[start] += beta[end] * p
            out += np.bincount(ids % (vocabulary.size + 1), alpha[start] * p * beta[end] / total * weight, vocabulary.size + 1)
    return out[:-1]


def _letters(texts: pa.Array) -> Words:
    return Words(texts, lower=True, inside=_LETTER)


def fit(learn: DataFrame, names: list[bytes], sample_docs: int = SAMPLE_DOCS, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages and their piece probabilities (pieces x languages) from rows (doc_id, text, lang)."""
    spark = learn.sparkSession
    have = {r["lang"]: r["count"] for r in learn.filter("text IS NOT NULL").groupBy("lang").count().collect()}
    langs = sorted(have)
    if not langs:
        return [], np.zeros((len(names), 0))
    share = F.lit(0.0)
    for lang in langs:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, sample_docs / have[lang]))).otherwise(share)
    sample = learn.filter(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1_000_000)) < share * 1_000_000)

    def count(batches):
        for batch in pieces(batches):
            words = _letters(batch.column("text"))
            of = np.repeat(np.arange(batch.num_rows), words.counts)
            lang = batch.column("lang").take(pa.array(of))
            text = [words.folded[s:e].tobytes() for s, e in zip(words.start, words.end)]
            one = pa.table({"lang": lang, "word": pa.array(text, pa.binary())})
            both = one.group_by(["lang", "word"]).aggregate([([], "count_all")])
            yield from both.select(["lang", "word", "count_all"]).rename_columns(["lang", "word", "n"]).combine_chunks().to_batches()

    words = staged(
        sample.select("text", "lang").mapInArrow(count, "lang string, word binary, n long")
        .filter(F.length("word") <= 48).groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    vocabulary = Vocabulary(names)
    prob = np.full((len(names), len(langs)), 1.0 / len(names))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((vocabulary, prob))

        def estimate(batches, shared=shared):
            known, now = shared.value
            for batch in batches:
                for k, lang in enumerate(langs):
                    mine = batch.filter(pc.equal(batch.column("lang"), lang))
                    if not mine.num_rows:
                        continue
                    found, total = _letters(mine.column("word").cast(pa.string())), np.zeros(known.size)
                    weight = mine.column("n").to_numpy().astype(float)
                    weight = weight[np.searchsorted(found.first, np.arange(len(found.start)), "right") - 1]
                    for rows, matrix in word_matrix(found, np.arange(len(found.start))):
                        for low in range(0, len(rows), 2000):
                            total += expected(known, matrix[low : low + 2000], weight[rows[low : low + 2000]], now[:, k])
                    ids = np.flatnonzero(total)
                    yield pa.RecordBatch.from_pydict({"lang": pa.array(np.full(len(ids), k, np.int32)), "piece": pa.array(ids.astype(np.int32)), "n": pa.array(total[ids])})

        # one row for a piece and a language at most
        sums = words.mapInArrow(estimate, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
        counts = np.full_like(prob, SMOOTHING)
        counts[sums["piece"].to_numpy(), sums["lang"].to_numpy()] += sums["n"].to_numpy()
        prob = counts / counts.sum(axis=0)
    return langs, prob


def identify(docs: DataFrame, learn: DataFrame, vocabulary: str = VOCABULARY, sample_docs: int = SAMPLE_DOCS, rounds: int = ROUNDS) -> DataFrame:
    """One row per input row of docs (doc_id, text): doc_id, lang_pred, score (posterior at even priors).

    `und` with score 0 for null text, text without a letter, or if there was nothing to learn from. Equal likelihoods go
    to the first language in code point order. Ids may be null or repeat: rows are scored one by one. Rows of `learn`
    with null text or lang are left out by the caller's filter or ignored. Further columns of docs are kept beside them.
    """
    spark = docs.sparkSession
    names = read_vocabulary(vocabulary)
    langs, prob = fit(learn.filter("lang IS NOT NULL"), names, sample_docs, rounds)
    shared = spark.sparkContext.broadcast((Vocabulary(names), prob))
    kept = [f for f in docs.schema.fields if f.name != "text"]

    def score(batches):
        known, now = shared.value
        for batch in pieces(batches):
            texts = batch.column("text")
            words = _letters(texts)
            _, first, back = np.unique(words.hash, return_index=True, return_inverse=True)
            logs = np.zeros((len(first), len(langs)))
            for rows, matrix in word_matrix(words, first) if langs else ():
                logs[rows] = forward(known, matrix, now)
            by_word = np.concatenate([np.zeros((1, len(langs))), np.cumsum(logs[back], axis=0)])
            total = by_word[words.first[1:]] - by_word[words.first[:-1]]
            ascii_letter = np.concatenate([[0], np.cumsum(_LETTER[words.folded] & (words.folded < 128))])
            sure = ascii_letter[words.at[1:]] > ascii_letter[words.at[:-1]]
            lettered = [bool(a) or any(map(str.isalpha, t.as_py() or "")) for a, t in zip(sure, texts)]
            pred, value = [], []
            for k in range(batch.num_rows):
                if not langs or not lettered[k]:
                    pred.append("und")
                    value.append(0.0)
                    continue
                best = int(np.argmax(total[k]))
                pred.append(langs[best])
                value.append(float(1 / np.exp(total[k] - total[k][best]).sum()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in kept), pa.array(pred), pa.array(value)], names=[*(f.name for f in kept), "lang_pred", "score"])

    from pyspark.sql import types as T

    out = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(score, out)


def held_out(doc_id: Column) -> Column:
    """A quarter of the ids; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op8_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    return identify(docs.select("doc_id", "held_out", "text"), docs.filter("NOT held_out AND lang IS NOT NULL"))
