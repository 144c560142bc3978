"""Gaussian processes over inducing points.

The rows enter by sums only: for every candidate kernel, the products of the whitened kernel columns of a
bounded set of inducing points with each other and with the targets. Columns are whitened before they are
summed, so the rounding of a sum over many rows is not blown up by nearly dependent points. One pass gives
the sums for all candidates; the marginal likelihood, which the same sums determine, chooses the kernel and the noise.
With all rows as inducing points the answer is that of the exact process. Several targets (classes) share
the sums. A prediction comes with its variance.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featloom.operators.gram import gram_matrices
from featloom.operators.rows import arrays, inputs_of, width_of, with_columns
from featloom.session import materialise

INDUCING = 256
# Fixed candidates: length scales in standard deviations times the root of the width, shapes, noise shares.
SCALES = (0.25, 0.5, 1.0, 2.0, 4.0)
SHAPES = (0.5, 1.0, 4.0)
NOISES = (1e-4, 1e-3, 1e-2, 3e-2, 0.1, 0.3, 1.0)
JITTER = 1e-10
# Rows of a task in the pass over all kernels.
TASK_ROWS = 1 << 14
DOT, RATIONAL, RBF = "dot", "rational", "rbf"


@dataclass(frozen=True)
class Kernel:
    """``dot`` is 1 + x·z; ``rational`` is the square of a rational quadratic; ``rbf`` decays with the squared distance."""

    kind: str
    scale: float = 1.0
    shape: float = 1.0

    def __call__(self, x: np.ndarray, z: np.ndarray) -> np.ndarray:
        if self.kind == DOT:
            return 1.0 + x @ z.T
        squared = np.maximum((x * x).sum(1)[:, None] + (z * z).sum(1)[None, :] - 2.0 * x @ z.T, 0.0) / self.scale**2
        if self.kind == RBF:
            return np.exp(-0.5 * squared)
        return (1.0 + squared / (2.0 * self.shape)) ** (-2.0 * self.shape)

    def own(self, x: np.ndarray) -> np.ndarray:
        return 1.0 + (x * x).sum(axis=1) if self.kind == DOT else np.ones(len(x))


def candidates(kind: str, width: int) -> list[Kernel]:
    root = float(np.sqrt(max(width, 1)))
    if kind == DOT:
        return [Kernel(DOT)]
    if kind == RBF:
        return [Kernel(RBF, s * root) for s in SCALES]
    return [Kernel(RATIONAL, s * root, a) for s, a in product(SCALES, SHAPES)]


@dataclass(frozen=True)
class ProcessModel:
    """Posterior of the chosen kernel; targets are columns of ``weights``."""

    kernel: Kernel
    noise: float
    likelihood: float
    points: np.ndarray
    means: np.ndarray
    scales: np.ndarray
    weights: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    inverse: np.ndarray
    classes: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.means) / self.scales
        return self.kernel(z, self.points) @ self.weights * self.spread + self.centre

    def variance(self, x: np.ndarray) -> np.ndarray:
        """Of the function, in units of the first target."""
        z = (x - self.means) / self.scales
        columns = self.kernel(z, self.points)
        found = self.kernel.own(z) - ((columns @ self.inverse) * columns).sum(axis=1)
        return np.maximum(found, 0.0) * float(self.spread[0]) ** 2

    def predict(self, x: np.ndarray) -> np.ndarray:
        found = self.scores(x)
        if not self.classes:
            return found[:, 0]
        return (found[:, 0] > 0).astype(float) if found.shape[1] == 1 else found.argmax(axis=1).astype(float)

    def transform(self, df: DataFrame) -> DataFrame:
        return with_columns(df, {"__p": "double", "__variance": "double"}, lambda x: [self.predict(x), self.variance(x)])


@dataclass(frozen=True)
class InducingProcess:
    """``classes`` 0 fits values; 2 one target of -1 and 1; more a target per class, the largest of which wins."""

    kind: str
    classes: int = 0
    inducing: int = INDUCING
    kernels: Sequence[Kernel] | None = None
    noises: Sequence[float] = NOISES

    def fit(self, df: DataFrame) -> ProcessModel:
        rows = materialise(arrays(df), "process-rows")
        width = width_of(rows)
        moments = gram_matrices(rows, partial(_moments, self.classes))[(0, 0)]
        n = moments[0, 0]
        mean = moments[1] / max(n, 1.0)
        deviation = np.sqrt(np.maximum(moments[2] / max(n, 1.0) - mean**2, 0.0))
        deviation = np.where(deviation > 1e-12 * np.maximum(1.0, np.abs(mean)), deviation, 1.0)
        means, scales, centre, spread = mean[:width], deviation[:width], mean[width:], deviation[width:]
        # A bounded set of rows, the same however the table is dealt.
        order = F.xxhash64(F.lit(29), "x", "y")
        chosen = rows.select("x").orderBy(order, "x").limit(self.inducing).toPandas()["x"]
        points = np.array(chosen.tolist(), dtype=float).reshape(len(chosen), width)
        points = np.unique((points - means) / scales, axis=0)
        kernels = list(self.kernels or candidates(self.kind, width))
        whites = [whitening(kernel, points) for kernel in kernels]
        # A row takes far more work than its bytes tell, so small files are dealt to many tasks.
        dealt = rows.repartition(max(1, -(-int(n) // TASK_ROWS)))
        sums = gram_matrices(dealt, partial(_kernel_sums, kernels, whites, points, means, scales, centre, spread, self.classes))
        best = None
        for i, kernel in enumerate(kernels):
            for noise, found in zip(self.noises, _posteriors(whites[i], sums[(i, 0)], n, self.noises)):
                if best is None or found[0] > best[0][0]:
                    best = (found, kernel, noise)
        (likelihood, weights, inverse), kernel, noise = best
        return ProcessModel(kernel, noise, likelihood, points, means, scales, weights, centre, spread, inverse, self.classes)


def _targets(y: np.ndarray, classes: int) -> np.ndarray:
    if not classes:
        return y[:, None]
    if classes <= 2:
        return np.where(y > 0, 1.0, -1.0)[:, None]
    return np.where(y.astype(int)[:, None] == np.arange(classes), 1.0, -1.0)


def _moments(classes: int, batch: pa.RecordBatch):
    y, x = batch.column(0).to_numpy(zero_copy_only=False), inputs_of(batch.column(1))
    both = np.column_stack([x, _targets(y, classes)])
    yield (0, 0), np.stack([np.full(both.shape[1], float(len(y))), both.sum(axis=0), (both * both).sum(axis=0)])


def whitening(kernel: Kernel, points: np.ndarray) -> np.ndarray:
    """Map of kernel columns to whitened inducing values: the prior of their coefficients is the identity."""
    prior = kernel(points, points)
    values, vectors = np.linalg.eigh((prior + prior.T) / 2)
    kept = values > JITTER * max(values.max(initial=0.0), 1e-300)
    return vectors[:, kept] / np.sqrt(values[kept])


def _kernel_sums(kernels, whites, points, means, scales, centre, spread, classes, batch: pa.RecordBatch) -> Iterator:
    """Per kernel, of its whitened columns W, [W'W, W't] and, in a last row, the targets' squares and the kernel's diagonal."""
    y, x = batch.column(0).to_numpy(zero_copy_only=False), inputs_of(batch.column(1))
    z, t = (x - means) / scales, (_targets(y, classes) - centre) / spread
    for i, (kernel, white) in enumerate(zip(kernels, whites)):
        columns = kernel(z, points) @ white
        m = columns.shape[1]
        out = np.zeros((m + 1, m + t.shape[1]))
        out[:m, :m], out[:m, m:] = columns.T @ columns, columns.T @ t
        out[m, m:] = (t * t).sum(axis=0)
        out[m, 0] = kernel.own(z).sum()
        yield (i, 0), out


def _posteriors(white: np.ndarray, sums: np.ndarray, n: float, noises: Sequence[float]) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
    """Per noise the marginal likelihood of the sums, weights of the mean, and the matrix that the variance subtracts."""
    m = white.shape[1]
    squares, cross, own = sums[:m, :m], sums[:m, m:], sums[m, m:]
    values, vectors = np.linalg.eigh((squares + squares.T) / 2)
    # Products of columns with each other; below zero they are rounding.
    values = np.maximum(values, 0.0)
    left_out = max(float(sums[m, 0]) - float(np.trace(squares)), 0.0)
    turned, mapped, targets = vectors.T @ cross, white @ vectors, len(own)
    for noise in noises:
        precision = 1.0 + values / noise
        right = turned / noise / np.sqrt(precision)[:, None]
        likelihood = -0.5 * (
            targets * (n * np.log(2 * np.pi * noise) + np.log(precision).sum() + left_out / noise) + own.sum() / noise - (right * right).sum()
        )
        weights = mapped @ (right / np.sqrt(precision)[:, None])
        yield float(likelihood), weights, (mapped * (1.0 - 1.0 / precision)) @ mapped.T
