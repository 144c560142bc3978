"""Prediction metrics as aggregations."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featloom.dataset import quoted


def confusion(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per (group, actual, predicted)."""
    return df.groupBy(*by, quoted(label).alias("actual"), quoted(prediction).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def weighted_f1(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Support-weighted mean of the classes' F1 from confusion counts, per group."""
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(zero)
    sides = F.array(
        F.struct(F.col("actual").alias("cls"), F.col("n").alias("support"), zero.alias("guessed"), hit.alias("hits")),
        F.struct(F.col("predicted").alias("cls"), zero.alias("support"), F.col("n").alias("guessed"), zero.alias("hits")),
    )
    classes = (
        counts.select(*by, F.explode(sides).alias("s"))
        .groupBy(*by, "s.cls")
        .agg(F.sum("s.support").alias("support"), F.sum("s.guessed").alias("guessed"), F.sum("s.hits").alias("hits"))
    )
    f1 = 2.0 * F.col("hits") / (F.col("support") + F.col("guessed"))
    return classes.groupBy(*by).agg((F.sum(f1 * F.col("support")) / F.sum("support")).alias("f1"))


def relative_absolute_error(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """Sum of absolute errors over the sum of absolute deviations from the group's mean.

    ``by`` names columns such as the fold. The table of their means is broadcast only if the optimizer
    finds it small enough.
    """
    y, p = quoted(label), quoted(prediction)
    means = df.groupBy(*by).agg(F.avg(y).alias("__mean"))
    if by:
        joined = df.join(means, list(by))
    else:
        joined = df.withColumn("__mean", F.lit(means.collect()[0]["__mean"]))
    return joined.groupBy(*by).agg((F.sum(F.abs(y - p)) / F.sum(F.abs(y - F.col("__mean")))).alias("rae"))


def f1_of_matrix(matrix: np.ndarray) -> float:
    """Support-weighted F1 of a confusion matrix (rows actual, columns predicted)."""
    hits, support, guessed = np.diag(matrix), matrix.sum(axis=1), matrix.sum(axis=0)
    both = support + guessed
    f1 = np.where(both > 0, 2.0 * hits / np.where(both > 0, both, 1.0), 0.0)
    return float((f1 * support).sum() / support.sum())
