"""The stages against the operators' own verdicts, and what they do to odd tables."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from featloom.llm import blocks, exact, forest, quality


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        found.append(docs)
    return found


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_each_stage_takes_effect(spark, sf_dir, stages):
    docs, clean, single, apart, cut, packed = stages
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert all(d.columns == docs.columns for d in stages[:-1])
    assert ids(clean) == sorted(r["id"] for r in quality.judged(docs, labels).where("kept").collect())
    assert ids(single) == sorted(r["doc_id"] for r in exact.exact_duplicates(clean).where("kept").collect())
    assert ids(apart) == sorted(r["doc_id"] for r in forest.near_duplicates(single).where("kept").collect())
    left = {r["doc_id"]: r for r in blocks.remove_repeats(apart).collect()}
    assert all(r["text"] == left[r["doc_id"]]["left_text"] for r in cut.collect()) and ids(cut) == ids(apart)
    assert cut.where(F.col("n_chars") != F.length("text")).join(apart, ["doc_id", "n_chars"], "left_anti").count() == 0
    assert ids(packed.select("doc_id").distinct()) == ids(cut)


def test_clean_documents_stay(spark, sf_dir, stages):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    good = stages[0].join(labels.select("doc_id"), "doc_id")
    lost = good.join(stages[1].select("doc_id"), "doc_id", "left_anti")
    base = quality.judged(lost, labels).where("NOT base_failed").count()
    assert base == 0


def test_odd_table(spark, sf_dir):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "word " * 3, None, "s", 15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, sf_dir)
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count() == 2
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf_dir)
    assert empty.count() == 0


def test_registered():
    import __spark_entry__ as contract

    names = contract.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
