"""A small network trained by data-parallel steps.

Rows lie in batches, batches in shards of at most ``SHARD_BATCHES``. An epoch is one job: every shard makes an
Adam move per batch, one after the other, from the weights and moments all shards start with; what they
end with is averaged by their rows. So a table of one shard is trained as on a single machine, and the number
of jobs does not grow with the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from featloom.dataset import CLASSIFICATION, Dataset, as_double, quoted
from featloom.operators.batches import append_features
from featloom.operators.gram import gram_matrices
from featloom.operators.moments import stats_of
from featloom.session import materialise

HIDDEN = 32
EPOCHS = 100
BATCH_ROWS = 4096
# Batches that follow one another before the shards are averaged.
SHARD_BATCHES = 16
# Fixed values of the optimiser.
RATE, DECAY, SQUARE_DECAY, FLOOR = 1e-3, 0.9, 0.999, 1e-8

Layers = list[tuple[np.ndarray, np.ndarray]]


def initial_layers(sizes: list[int], seed: int) -> Layers:
    """Uniform within one over the root of a layer's inputs."""
    rng = np.random.default_rng(seed)
    found = []
    for inputs, outputs in zip(sizes, sizes[1:]):
        bound = 1.0 / np.sqrt(max(inputs, 1))
        found.append((rng.uniform(-bound, bound, (inputs, outputs)), rng.uniform(-bound, bound, outputs)))
    return found


def forward(layers: Layers, z: np.ndarray) -> list[np.ndarray]:
    """Inputs and activations of every layer; the last one is linear."""
    found = [z]
    for i, (weight, bias) in enumerate(layers):
        z = z @ weight + bias
        z = np.maximum(z, 0.0) if i + 1 < len(layers) else z
        found.append(z)
    return found


def gradients(layers: Layers, z: np.ndarray, y: np.ndarray, classes: int) -> tuple[float, np.ndarray]:
    """Summed loss of the rows, and its gradient as one vector: cross entropy, or the absolute error."""
    activations = forward(layers, z)
    out = activations[-1]
    if classes:
        shifted = np.exp(out - out.max(axis=1, keepdims=True))
        p = shifted / shifted.sum(axis=1, keepdims=True)
        hit = y.astype(int)
        loss = float(-np.log(np.maximum(p[np.arange(len(y)), hit], 1e-300)).sum())
        delta = p - (hit[:, None] == np.arange(classes))
    else:
        loss, delta = float(np.abs(out[:, 0] - y).sum()), np.sign(out - y[:, None])
    parts: list[np.ndarray] = []
    for i in range(len(layers) - 1, -1, -1):
        parts.append(np.concatenate([(activations[i].T @ delta).ravel(), delta.sum(axis=0)]))
        if i:
            delta = (delta @ layers[i][0].T) * (activations[i] > 0)
    return loss, np.concatenate(parts[::-1])


def flat(layers: Layers) -> np.ndarray:
    return np.concatenate([np.concatenate([w.ravel(), b]) for w, b in layers])


def unflat(values: np.ndarray, sizes: list[int]) -> Layers:
    layers, at = [], 0
    for inputs, outputs in zip(sizes, sizes[1:]):
        weight = values[at : at + inputs * outputs].reshape(inputs, outputs)
        at += inputs * outputs
        layers.append((weight, values[at : at + outputs]))
        at += outputs
    return layers


@dataclass
class Adam:
    """Moments of the gradient and the moves they give."""

    size: int
    rate: float = RATE

    def __post_init__(self):
        self.first, self.second, self.steps = np.zeros(self.size), np.zeros(self.size), 0

    def move(self, values: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        self.steps += 1
        self.first = DECAY * self.first + (1 - DECAY) * gradient
        self.second = SQUARE_DECAY * self.second + (1 - SQUARE_DECAY) * gradient * gradient
        first, second = self.first / (1 - DECAY**self.steps), self.second / (1 - SQUARE_DECAY**self.steps)
        return values - self.rate * first / (np.sqrt(second) + FLOOR)


@dataclass(frozen=True)
class NetworkEmbedding:
    """Last hidden layer of a network with two hidden layers: ``mlp_pred_<i>_<inputs>``.

    Classes are fitted by cross entropy, values by their absolute error. ``losses`` are the mean losses of
    the steps.
    """

    means: np.ndarray
    scales: np.ndarray
    layers: tuple
    classes: int
    losses: tuple[float, ...] = ()

    @classmethod
    def fit(
        cls, ds: Dataset, hidden: int = HIDDEN, epochs: int = EPOCHS, batch_rows: int = BATCH_ROWS, rate: float = RATE, seed: int = 0
    ) -> NetworkEmbedding:
        stats = stats_of(ds)
        means = np.array([stats[n].mean for n in ds.names])
        scales = np.array([stats[n].std or 1.0 for n in ds.names])
        classes = 0
        if ds.task == CLASSIFICATION:
            classes = int(ds.df.agg(F.max(quoted(ds.label))).first()[0] or 0) + 1
        rows, total = _in_shards(ds, batch_rows)
        sizes = [len(ds.names), hidden, hidden, classes or 1]
        values = flat(initial_layers(sizes, seed))
        adam, losses = Adam(len(values), rate), []
        for _ in range(epochs):
            found = gram_matrices(rows, partial(_epoch_sums, values, adam, sizes, means, scales, classes, total)).get((0, 0))
            if found is None:
                break
            values, adam.first, adam.second = found[0, : 3 * len(values)].reshape(3, -1)
            seen, lost = found[0, 3 * len(values) :].reshape(2, -1)
            adam.steps += int((seen > 0).sum())
            losses += (lost[seen > 0] / seen[seen > 0]).tolist()
        return cls(means, scales, tuple(unflat(values, sizes)), classes, tuple(losses))

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return forward(list(self.layers), (x - self.means) / self.scales)[-2]

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = forward(list(self.layers), (x - self.means) / self.scales)[-1]
        return out.argmax(axis=1).astype(float) if self.classes else out[:, 0]

    def transform(self, ds: Dataset) -> Dataset:
        width = self.layers[-2][1].shape[0]
        plain = replace(self, losses=())
        return append_features(ds, [f"mlp_pred_{i}_{len(ds.names)}" for i in range(width)], plain.hidden)


def _in_shards(ds: Dataset, batch_rows: int):
    """Stored shards (shard, sizes of its batches, their rows), batches by a hash of the rows' content, and the number of rows."""
    table = ds.df.select(as_double(quoted(ds.label)).alias("y"), *[v.alias(f"x{i}") for i, v in enumerate(ds.values().values())])
    table = table.where(F.col("y").isNotNull())
    total = table.count()
    batches = max(1, -(-total // batch_rows))
    shards = -(-batches // SHARD_BATCHES)
    keyed = table.withColumn("batch", F.pmod(F.xxhash64(F.lit(31), *table.columns), F.lit(batches)).cast("int"))
    dealt = keyed.withColumn("shard", F.col("batch") % shards).repartition(shards, "shard")
    width = len(table.columns)

    def pack(rows: pa.Table) -> pa.Table:
        own = np.column_stack([rows[c].to_numpy().astype(float) for c in rows.column_names[:width]])
        step = rows["batch"].to_numpy() // shards
        order = np.lexsort((*own.T, step))
        sizes = np.bincount(step, minlength=SHARD_BATCHES).astype(np.int64)
        return pa.table({"shard": rows["shard"][:1], "sizes": pa.array([sizes.tobytes()], pa.binary()), "rows": pa.array([own[order].tobytes()], pa.binary())})

    return materialise(dealt.groupBy("shard").applyInArrow(pack, "shard int, sizes binary, rows binary"), "network-rows"), total


def _epoch_sums(values, adam: Adam, sizes: list[int], means, scales, classes: int, total: int, batch: pa.RecordBatch) -> Iterator:
    """Per shard its share of the weights and moments after its steps, then the rows and losses of the steps."""
    for counts, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
        own, moved, at = values, _copied(adam), 0
        rows = np.frombuffer(raw).reshape(-1, len(means) + 1)
        counts = np.frombuffer(counts, np.int64)
        lost = np.zeros(len(counts))
        for i, count in enumerate(counts.tolist()):
            if count:
                part = rows[at : at + count]
                lost[i], gradient = gradients(unflat(own, sizes), (part[:, 1:] - means) / scales, part[:, 0], classes)
                own = moved.move(own, gradient / count)
                at += count
        share = len(rows) / total
        yield (0, 0), np.concatenate([own * share, moved.first * share, moved.second * share, counts, lost])[None, :]


def _copied(adam: Adam) -> Adam:
    """A copy that moves on its own."""
    found = Adam(adam.size, adam.rate)
    found.first, found.second, found.steps = adam.first, adam.second, adam.steps
    return found
