"""Univariate scores from the summary frame: ANOVA F for classes, correlation F for a target."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featloom.dataset import REGRESSION, Dataset
from featloom.operators.moments import moments_frame


def univariate_scores(ds: Dataset, exprs=None) -> DataFrame:
    """Columns feature, score: the F statistic of every feature against the label."""
    frame = moments_frame(ds, exprs, by_label=True)
    return correlation_scores(frame) if ds.task == REGRESSION else anova_scores(frame)


def anova_scores(frame: DataFrame) -> DataFrame:
    """One-way F from class sizes, means and squared deviations (a few rows per feature and class).

    Rows without a class take no part.
    """
    n = F.col("rows") - F.col("nulls")
    feature = Window.partitionBy("feature")
    present = frame.filter((n > 0) & F.col("cls").isNotNull()).withColumn("n", n)
    centred = present.withColumn("grand", F.sum(F.col("n") * F.col("mean")).over(feature) / F.sum("n").over(feature))
    parts = centred.groupBy("feature").agg(
        F.sum(F.col("n") * (F.col("mean") - F.col("grand")) * (F.col("mean") - F.col("grand"))).alias("between"),
        F.sum("m2").alias("within"),
        F.sum("n").alias("total"),
        F.count(F.lit(1)).alias("classes"),
    )
    between = F.col("between") / (F.col("classes") - 1)
    within = F.col("within") / (F.col("total") - F.col("classes"))
    defined = (F.col("classes") > 1) & (F.col("total") > F.col("classes"))
    return parts.select(
        "feature",
        F.when(
            defined & (F.col("within") > 0), between / within
        ).otherwise(F.when(defined & (F.col("between") > 0), F.lit(float("inf")))).alias("score"),
    )


def correlation_scores(frame: DataFrame) -> DataFrame:
    """r^2 / (1 - r^2) * (n - 2) of every feature with the target, over the rows that have both."""
    n = F.col("pairs")
    squared = F.col("cxy") * F.col("cxy") / (F.col("xm2") * F.col("ym2"))
    return frame.filter((F.col("xm2") > 0) & (F.col("ym2") > 0) & (n > 2)).select(
        "feature",
        F.when(squared < 1, squared / (F.lit(1.0) - squared) * (n - 2)).otherwise(F.lit(float("inf"))).alias("score"),
    )
