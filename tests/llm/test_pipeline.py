"""Stages of the pipeline on a small corpus: decisions take effect, columns stay, and each stage reruns on its input."""

import importlib

import pytest
from helpers import SCHEMA, corpus, frame

corpus_pipeline = importlib.import_module("corpus_pipeline")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    rows = [r for r in corpus(8, 120)]
    rows += [(5000 + k, f"clean words number {k} and vile ones {k * 7} of a kind {k * k}", "en", "a", 1) for k in range(40)]
    item = "an item of the benchmark that has many words in it and some more of them"
    rows += [(7000, f"before {item} after", "en", "b", 1)]
    frame(spark, rows).write.parquet(f"{root}/documents.parquet")
    labels = [(r[0], 1, int("vile" in (r[1] or ""))) for r in rows if r[0] is not None and r[0] % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf_dir).cache()
        seen[name] = docs.collect()
        if name != "mixing":
            assert docs.columns == before.columns == [f.name for f in SCHEMA]
    assert not any("vile" in (r["text"] or "") for r in seen["toxicity"])
    assert {r["doc_id"] for r in seen["toxicity"]} >= {0, 3, 6, None}
    texts = [r["text"] for r in seen["jaccard_join"] if r["text"] and len(r["text"].split()) > 4]
    assert len(texts) == len(set(texts))
    assert 7000 in {r["doc_id"] for r in seen["jaccard_join"]} and 7000 not in {r["doc_id"] for r in seen["benchmark_decontamination"]}
    assert len(seen["benchmark_decontamination"]) == len(seen["jaccard_join"]) - 1
    assert all(r["mix_copies"] in (1, 2, 3) for r in seen["mixing"]) and seen["mixing"]
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(map(str, whole)) == sorted(map(str, seen["mixing"]))


def test_registered():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))
    assert set(entry.oracle_sql()) <= set(names)
