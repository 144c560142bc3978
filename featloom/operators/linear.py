"""Least squares from one pass of inner products."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from featloom.operators.gram import gram_matrices
from featloom.operators.rows import arrays, inputs_of, with_columns

# Directions whose share of the largest is smaller are left out of a solution.
RANK = 1e-10


@dataclass(frozen=True)
class LinearModel:
    intercept: float
    slopes: np.ndarray

    def transform(self, df: DataFrame) -> DataFrame:
        return with_columns(df, {"__p": "double"}, lambda x: [self.intercept + x @ self.slopes])


@dataclass(frozen=True)
class GramRegression:
    """Ordinary least squares; of equivalent solutions the shortest over standardised inputs."""

    def fit(self, df: DataFrame) -> LinearModel:
        rows = arrays(df)
        first = rows.first()
        if first is None:
            return LinearModel(0.0, np.zeros(0))
        # Sums around one row keep their digits where values are far from zero.
        shift = np.array([first["y"], *first["x"]])
        total = gram_matrices(rows, partial(_shifted_products, shift))[(0, 0)]
        n, sums = total[0, 0], total[0, 1:]
        covariance = total[1:, 1:] / n - np.outer(sums, sums) / n**2
        means = shift + sums / n
        scale = np.sqrt(np.maximum(np.diag(covariance)[1:], 0.0))
        used = scale > 1e-12 * np.maximum(1.0, np.abs(means[1:]))
        slopes = np.zeros(len(scale))
        if used.any():
            own = scale[used]
            matrix = covariance[1:, 1:][np.ix_(used, used)] / np.outer(own, own)
            slopes[used] = np.linalg.lstsq(matrix, covariance[1:, 0][used] / own, rcond=RANK)[0] / own
        return LinearModel(float(means[0] - means[1:] @ slopes), slopes)


def _shifted_products(shift: np.ndarray, batch: pa.RecordBatch):
    rows = np.column_stack([batch.column(0).to_numpy(zero_copy_only=False), inputs_of(batch.column(1))]) - shift
    design = np.column_stack([np.ones(len(rows)), rows])
    yield (0, 0), design.T @ design
