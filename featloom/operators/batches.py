"""Append columns computed per Arrow batch from the feature columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from featloom.dataset import Dataset, Feature, as_double, quoted


def batch_matrix(batch: pa.RecordBatch, start: int, count: int) -> np.ndarray:
    """Rows x ``count`` doubles; missing values are NaN."""
    if count == 0:
        return np.zeros((batch.num_rows, 0))
    return np.column_stack(
        [batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(start, start + count)]
    )


def append_batches(
    df: DataFrame, inputs: Sequence[str], outputs: Sequence[str], compute: Callable[[np.ndarray], np.ndarray]
) -> DataFrame:
    """Add double columns ``outputs`` = ``compute(matrix of inputs)``; all other columns pass through."""
    wide = df.select(*[quoted(c) for c in df.columns], *[as_double(quoted(c)).alias(f"__in{i}") for i, c in enumerate(inputs)])
    schema = T.StructType([*df.schema.fields, *[T.StructField(o, T.DoubleType()) for o in outputs]])
    kept, wanted, count = len(df.columns), list(outputs), len(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            result = compute(batch_matrix(batch, kept, count))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:kept], *[pa.array(result[:, j], from_pandas=True) for j in range(len(wanted))]],
                names=[*batch.schema.names[:kept], *wanted],
            )

    return wide.mapInArrow(run, schema)


def append_vector(
    df: DataFrame, inputs: Sequence[str], output: str, compute: Callable[[np.ndarray], np.ndarray]
) -> DataFrame:
    """Add one ``array<double>`` column holding a row of ``compute(matrix of inputs)``."""
    wide = df.select(*[quoted(c) for c in df.columns], *[as_double(quoted(c)).alias(f"__in{i}") for i, c in enumerate(inputs)])
    schema = T.StructType([*df.schema.fields, T.StructField(output, T.ArrayType(T.DoubleType(), False))])
    kept, count = len(df.columns), len(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            result = np.ascontiguousarray(compute(batch_matrix(batch, kept, count)), dtype=float)
            offsets = np.arange(0, result.size + 1, result.shape[1], dtype=np.int32)
            rows = pa.ListArray.from_arrays(pa.array(offsets), pa.array(result.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], rows], names=[*batch.schema.names[:kept], output])

    return wide.mapInArrow(run, schema)


def append_features(ds: Dataset, outputs: Sequence[str], compute: Callable[[np.ndarray], np.ndarray]) -> Dataset:
    """Dataset with further features computed from all its features."""
    columns = [f"f_{len(ds.features) + i:06d}_{abs(hash_name(o)):x}" for i, o in enumerate(outputs)]
    added = tuple(Feature(o, c) for o, c in zip(outputs, columns))
    return Dataset(append_batches(ds.df, ds.columns, columns, compute), (*ds.features, *added), ds.label, ds.task, ds.row_id)


def hash_name(name: str) -> int:
    """Small number that depends on the name only."""
    value = 0
    for ch in name:
        value = (value * 131 + ord(ch)) % 1_000_003
    return value
