"""Registry of the queries of this package and the input shape its operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Space and the five ASCII controls that separate words, as a Java and RE2 character class.
BLANKS = r"[\x20\x09-\x0D]+"


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL where SQL can express it."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str) -> Column:
    """Column by exact name, whatever characters it holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id long, text string): the two columns an operator reads, a null text as the empty one.

    Every other column is dropped here, so no name of the input can clash with an operator's own.
    """
    return docs.select(named(doc_id).cast("long").alias("doc_id"), F.coalesce(named(text), F.lit("")).alias("text"))


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts; sizes chunks and buckets."""
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def parts(total: float, each: float) -> int:
    """How many parts of about ``each`` a total needs."""
    return max(1, -(-int(total) // int(each)))
