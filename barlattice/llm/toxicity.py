"""Toxicity by a classifier chain.

Categories are predicted one after the other by logistic regressions on word presence. Each later model also gets the
probabilities of the earlier categories, and is trained with out-of-fold ones: for every fold, an earlier model that has
not seen it. At prediction the earlier models are those fitted on all labelled rows. The decision threshold of the
last category is the one with the best F1 on its own out-of-fold probabilities.

Models are fitted by Spark on a bounded sample of labelled documents (whole texts); scoring is JVM-side and per row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlattice.llm.common import PLAIN_WORD, lowered, staged, table

LABELLED_ROWS = 12_000  # rows that are learned from, about
FOLDS = 3
TERMS = 400  # a category
MIN_DOCS = 3
REGULARISATION = 0.0003
ROUNDS = 40


def _words(text: Column) -> Column:
    return F.regexp_extract_all(lowered(text), F.lit(PLAIN_WORD), F.lit(0))


def _fold(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit("fold")), F.lit(FOLDS)).cast("int")


@dataclass
class Constant:
    """Stands in where labelled rows don't have both classes."""

    rate: float

    def probability(self, df: DataFrame, features: str, name: str) -> DataFrame:
        return df.withColumn(name, F.lit(float(self.rate)))


@dataclass
class Linear:
    model: object

    def probability(self, df: DataFrame, features: str, name: str) -> DataFrame:
        self.model.setFeaturesCol(features).setProbabilityCol("chain_probability").setRawPredictionCol("chain_raw").setPredictionCol("chain_prediction")
        return self.model.transform(df).withColumn(name, vector_to_array("chain_probability")[1]).drop("chain_probability", "chain_raw", "chain_prediction")


def _fit(rows: DataFrame, features: str, label: str):
    n, positive = rows.agg(F.count(F.lit(1)), F.sum(label)).first()
    if not n or not positive or positive == n:
        return Constant((positive or 0) / n if n else 0.0)
    regression = LogisticRegression(
        featuresCol=features, labelCol=label, regParam=REGULARISATION, maxIter=ROUNDS, tol=1e-4, standardization=False)
    return Linear(regression.fit(rows.withColumn(label, F.col(label).cast("double"))))


def _with_earlier(df: DataFrame, earlier: list[str], out: str) -> DataFrame:
    return VectorAssembler(inputCols=["chain_features", *earlier], outputCol=out).transform(df)


class Chain:
    """A fitted chain: categories in order, a model each, and the threshold of the last."""

    def __init__(self, categories: list[str], vectoriser, models: list, threshold: float):
        self.categories, self.vectoriser, self.models, self.threshold = categories, vectoriser, models, threshold

    def score(self, docs: DataFrame) -> DataFrame:
        """docs (doc_id, text and whatever the caller carries) with p_<category> of each category and `rejected`."""
        df = docs
        if self.vectoriser is not None:
            df = self.vectoriser.transform(df.withColumn("chain_words", _words(F.col("text")))).drop("chain_words")
        done: list[str] = []
        for k, (category, model) in enumerate(zip(self.categories, self.models)):
            name = f"p_{category}"
            if isinstance(model, Linear):
                df = _with_earlier(df, done, f"chain_input_{k}")
            df = model.probability(df, f"chain_input_{k}", name).drop(f"chain_input_{k}")
            done.append(name)
        return df.drop("chain_features").withColumn("rejected", F.col(done[-1]) >= self.threshold)


def best_threshold(scored: DataFrame, probability: str, label: str) -> float:
    """The probability with the best F1; above 1 (nothing is rejected) without a positive row."""
    cells = scored.groupBy(F.floor(F.col(probability) * 200).alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("hits"))
    rows = sorted(((r["cell"], r["n"], r["hits"] or 0) for r in cells.collect()), reverse=True)  # 201 at most
    total = sum(r[2] for r in rows)
    best, at, taken, hit = 0.0, 2.0, 0, 0
    for cell, n, hits in rows:
        taken, hit = taken + n, hit + hits
        f1 = 2 * hit / (taken + total) if total else 0.0
        if f1 > best:
            best, at = f1, cell / 200
    return at


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], labelled_rows: int = LABELLED_ROWS) -> Chain:
    """categories: name -> condition over labels, in the order of the chain. Labels without a document, of null ids or with a
    null condition are left out; of several labels of an id each counts."""
    spark, names = docs.sparkSession, list(categories)
    known = labels.select(F.col("doc_id"), *(c.cast("int").alias(f"is_{n}") for n, c in categories.items())).dropna()
    n = known.count()
    share = min(1.0, labelled_rows / n) if n else 0.0
    # Bounded by the parameter: a hash picks about labelled_rows, and twice that is never passed.
    picked = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < share * 1_000_000).limit(2 * labelled_rows)
    sample = staged(
        docs.select("doc_id", _words(F.col("text")).alias("chain_words")).join(F.broadcast(picked), "doc_id")
        .withColumn("fold", _fold()).coalesce(2 * spark.sparkContext.defaultParallelism), "toxic-sample")

    seen = sample.select(F.explode(F.array_distinct("chain_words")).alias("term"), *(f"is_{c}" for c in names))
    sums = [F.sum(f"is_{c}").alias(f"hits_{c}") for c in names]
    counts = staged(seen.groupBy("term").agg(F.count(F.lit(1)).alias("n"), *sums).filter(f"n >= {MIN_DOCS}"), "toxic-terms")
    totals = sample.agg(F.count(F.lit(1)).alias("n"), *sums).first()
    terms: set[str] = set()
    for c in names:
        rate = (totals[f"hits_{c}"] or 0) / totals["n"] if totals["n"] else 0.0
        if 0 < rate < 1:
            surprise = F.abs(F.col(f"hits_{c}") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate) + 0.5)
            terms |= {r["term"] for r in counts.orderBy(surprise.desc(), "term").limit(TERMS).select("term").collect()}
    if not terms:
        return Chain(names, None, [Constant((totals[f"hits_{c}"] or 0) / totals["n"] if totals["n"] else 0.0) for c in names], 2.0)
    vectoriser = CountVectorizerModel.from_vocabulary(sorted(terms), inputCol="chain_words", outputCol="chain_features", binary=True)
    rows = staged(vectoriser.transform(sample).select("doc_id", "fold", "chain_features", *(f"is_{c}" for c in names)), "toxic-features")

    models, done = [], []
    for k, c in enumerate(names):
        rows = _with_earlier(rows, done, f"chain_input_{k}")
        models.append(_fit(rows, f"chain_input_{k}", f"is_{c}"))
        parts = [_fit(rows.filter(F.col("fold") != f), f"chain_input_{k}", f"is_{c}").probability(rows.filter(F.col("fold") == f), f"chain_input_{k}", f"p_{c}") for f in range(FOLDS)]
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        rows = staged(out.drop(f"chain_input_{k}"), "toxic-out-of-fold")
        done.append(f"p_{c}")
    return Chain(names, vectoriser, models, best_threshold(rows, done[-1], f"is_{names[-1]}"))


def default_categories() -> dict[str, Column]:
    return {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}


def score_toxicity(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS) -> DataFrame:
    """docs with p_low_quality, p_toxic and rejected, one row per input row.

    Null or empty text has no words: its probabilities are those of the intercepts. Ids may be null or repeat; rows are
    scored one by one. Without labels of both classes a category's probability is its rate and nothing is rejected.
    Other columns of docs are kept, whatever their names. An empty table gives no rows.
    """
    chain = fit_chain(docs.select("doc_id", "text"), labels, default_categories(), labelled_rows)
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")).select("doc", F.col("doc.text").alias("text"))
    scored = chain.score(packed)
    return scored.select(*(F.col(f"doc.`{c}`").alias(c) for c in docs.columns), *(F.col(f"p_{c}").alias(f"p_{c}") for c in chain.categories), "rejected")


def op1_toxicity(spark, sf_dir):
    found = score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "p_low_quality", "p_toxic", F.col("rejected").alias("toxic"))
