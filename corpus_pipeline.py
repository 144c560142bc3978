"""From raw documents to packed training sequences.

Each stage takes the documents that its predecessor kept, as they were read back from Parquet, and its
decisions take effect before the next one starts. Run as

    import corpus_pipeline
    packed = corpus_pipeline.run(spark, folder)        # reads documents.parquet and labels.parquet
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from featloom.llm.base import load
from featloom.llm.blocks import cut_repeats
from featloom.llm.exact import drop_duplicates
from featloom.llm.forest import drop_near_duplicates
from featloom.llm.packing import pack_table, pieces
from featloom.llm.quality import drop_rejected
from featloom.session import materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base rules or the rules learned from the labels reject."""
    return drop_rejected(docs, load(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text, the one with the smallest id stays."""
    return drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 or more, one stays."""
    return drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 13 words or more that a document with a smaller id holds too."""
    return cut_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and the sequences they lie in; the last stage."""
    return pieces(pack_table(docs))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("packing", packing),
]

# Learned rules, signatures and token ids are beyond SQL; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
