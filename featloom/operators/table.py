"""General table operators of the exploratory work: totals, counts, groups, strides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featloom.dataset import quoted


def group_totals(df: DataFrame, key: str, column: str) -> DataFrame:
    """Sum, count and mean of a column per group."""
    x = quoted(column)
    return df.groupBy(quoted(key)).agg(F.sum(x).alias("total"), F.count(x).alias("n"), F.avg(x).alias("mean"))


def overall_mean(totals: DataFrame) -> DataFrame:
    """Mean of all rows from the totals of the groups."""
    return totals.agg((F.sum("total") / F.sum("n")).alias("mean"))


def column_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Present values, sum and mean per column, as one row per column."""
    parts = [
        F.struct(F.lit(c).alias("column"), F.count(quoted(c)).alias("n"), F.sum(quoted(c).cast("double")).alias("total"),
                 F.avg(quoted(c).cast("double")).alias("mean"))
        for c in columns
    ]
    row = df.agg(F.array(*parts).alias("parts"))
    return row.select(F.explode("parts").alias("p")).select("p.column", "p.n", "p.total", "p.mean")


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct values per column; the exact form spreads (column, value) over the cluster first."""
    if approximate:
        row = df.agg(*[F.approx_count_distinct(quoted(c)).alias(c) for c in columns])
        return row.select(F.explode(F.create_map(*[v for c in columns for v in (F.lit(c), quoted(c))])).alias("column", "n"))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("v")) for c in columns]))
    pairs = df.select(cells.alias("s")).select("s.column", "s.v").filter(F.col("v").isNotNull()).distinct()
    return pairs.groupBy("column").agg(F.count(F.lit(1)).alias("n"))


def count_where(df: DataFrame, condition: Column, name: str = "n") -> DataFrame:
    return df.agg(F.count_if(condition).alias(name))


def strided_means(df: DataFrame, columns: Sequence[str], stride: int) -> DataFrame:
    """Mean of every ``stride``-th column; the other columns are not read."""
    return df.agg(*[F.avg(quoted(c)).alias(c) for c in columns[::stride]])


def extremes(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(quoted(column)).alias("lo"), F.max(quoted(column)).alias("hi"))


def fold_by(df: DataFrame, key: Column, value: Column, name: str = "top") -> DataFrame:
    """Largest value per computed key."""
    return df.groupBy(key.alias("key")).agg(F.max(value).alias(name))


def stacked(df: DataFrame, columns: Sequence[str], name: str = "stack") -> DataFrame:
    """The columns as one array column."""
    return df.withColumn(name, F.array(*[quoted(c).cast("double") for c in columns]))
