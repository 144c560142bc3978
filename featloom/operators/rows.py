"""Model inputs: the vector ``__x`` and label ``__y`` of a table as matrices per batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featloom.dataset import quoted


def arrays(df: DataFrame) -> DataFrame:
    """(y double, x array<double>) of a table with ``__x`` and ``__y``."""
    return df.select(F.col("__y").cast("double").alias("y"), vector_to_array("__x").alias("x"))


def inputs_of(column: pa.Array) -> np.ndarray:
    """Rows of an array column as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def width_of(rows: DataFrame) -> int:
    return rows.select(F.max(F.size("x"))).first()[0] or 0


def with_columns(df: DataFrame, added: dict[str, str], compute: Callable[[np.ndarray], list[np.ndarray]]) -> DataFrame:
    """The table, ``__x`` as an array, with columns computed from ``__x``: names and types, and a function of the matrix."""
    kept = [c for c in df.columns if c != "__x"]
    wide = df.select(*[quoted(c) for c in kept], vector_to_array("__x").alias("__x"))
    schema = wide.select("*", *[F.lit(None).cast(t).alias(n) for n, t in added.items()]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = compute(inputs_of(batch.column(len(kept))))
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(f) for f in found]], names=[*batch.schema.names, *added])

    return wide.mapInArrow(run, schema)
