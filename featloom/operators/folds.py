"""Cross-validation folds as a column, without a single-task ordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from featloom.dataset import REGRESSION, Dataset
from featloom.operators.ordering import ROWS_PER_BUCKET, with_position

FOLD = "fold"


def with_folds(ds: Dataset, folds: int = 5, rows_per_bucket: int = ROWS_PER_BUCKET) -> Dataset:
    """Unshuffled folds: contiguous blocks by row id (regression), the same inside each class (classification).

    The first ``n mod folds`` blocks hold one row more than the others.
    """
    by = [] if ds.task == REGRESSION else [ds.label]
    placed = with_position(ds.df, ds.row_id, by, "__pos", "__size", rows_per_bucket)
    size = F.floor(F.col("__size") / folds).cast("long")
    larger = F.col("__size") % folds
    head = larger * (size + 1)
    fold = F.when(F.col("__pos") < head, F.floor(F.col("__pos") / (size + 1))).otherwise(
        larger + F.floor((F.col("__pos") - head) / F.greatest(size, F.lit(1)))
    )
    return ds.with_df(placed.withColumn(FOLD, fold.cast("int")).drop("__pos", "__size"))
