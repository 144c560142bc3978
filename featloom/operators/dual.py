"""Support vector machines by dual coordinate ascent in blocks.

Rows lie in blocks, each with its dual variables. A round runs some epochs of coordinate ascent inside every
block against the weights all blocks share, and adds up what the blocks would move them by; the local
steps are damped by the number of blocks, so that the sum of all moves cannot overshoot. The gap between
the primal and the dual value bounds the distance to the optimum and ends the rounds. The rows are stored once,
in a table bucketed by block; a round writes the dual variables alone and meets the rows without a shuffle.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featloom.operators.gram import merged_tree, task_slot
from featloom.operators.rows import arrays, inputs_of, with_columns
from featloom.session import materialise, work_dir

ROUNDS = 30
# Passes over a block inside a round.
EPOCHS = 5
GAP = 1e-2
STRENGTH = 1e-3
TUBE = 0.1
BLOCK_ROWS = 8192
# Buckets of the table of blocks; beyond, a bucket holds several blocks.
TABLE_BUCKETS = 10_000
PACKED = "block int, x binary, y binary"
STEPPED = "block int, alpha binary, sums binary"
STEPPED_KINDS = pa.schema([("block", pa.int32()), ("alpha", pa.binary()), ("sums", pa.binary())])


@dataclass(frozen=True)
class DualModel:
    """Weights over the inputs and a constant one, a column per margin; ``gap`` is the relative duality gap."""

    weights: np.ndarray
    classes: int
    centre: float
    spread: float
    gap: float
    rounds: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        found = np.column_stack([x, np.ones(len(x))]) @ self.weights
        if not self.classes:
            return found[:, 0] * self.spread + self.centre
        return (found[:, 0] > 0).astype(float) if found.shape[1] == 1 else found.argmax(axis=1).astype(float)

    def transform(self, df: DataFrame) -> DataFrame:
        return with_columns(df, {"__p": "double"}, lambda x: [self.predict(x)])


@dataclass(frozen=True)
class DualAscent:
    """``classes`` 0 fits values inside a tube of ``tube`` deviations; else hinge loss, one margin for two classes.

    ``strength`` is the weight of half the squared norm beside the mean loss.
    """

    classes: int = 0
    strength: float = STRENGTH
    tube: float = TUBE
    rounds: int = ROUNDS
    gap: float = GAP
    epochs: int = EPOCHS

    def fit(self, df: DataFrame) -> DualModel:
        rows = materialise(arrays(df), "dual-rows")
        total = rows.agg(F.count("y").alias("n"), F.avg("y").alias("mean"), F.stddev_pop("y").alias("std")).first()
        n = total["n"]
        if not n:
            return DualModel(np.zeros((1, 1)), self.classes, 0.0, 1.0, 0.0, 0)
        centre, spread = (0.0, 1.0) if self.classes else (total["mean"], total["std"] or 1.0)
        margins = self.classes if self.classes > 2 else 1
        blocks = -(-n // BLOCK_ROWS)
        table, stepped = self.dealt(rows, blocks, centre, spread), None
        width = len(rows.first()["x"]) + 1
        weights, best, rounds = np.zeros((width, margins)), np.inf, 0
        for rounds in range(1, self.rounds + 1):
            stepped = bucketed(self.stepped(table, stepped, weights, n, blocks), blocks, "dual")
            sums = np.frombuffer(merged_tree(stepped.select(F.lit(0).alias("all"), F.col("block").alias("slot"), F.col("sums").alias("payload")), ["all"], _added).collect()[0]["payload"])
            moved, loss, dual = sums[: width * margins].reshape(width, margins), sums[-2], sums[-1]
            primal = self.strength / 2 * float((weights**2).sum()) + loss / n
            lower = dual / n - self.strength / 2 * float((weights**2).sum())
            best = (primal - lower) / max(abs(primal), 1e-12)
            if best <= self.gap:
                break
            weights = weights + moved / (self.strength * n)
        return DualModel(weights, self.classes, centre, spread, float(best), rounds)

    def dealt(self, rows: DataFrame, blocks: int, centre: float, spread: float) -> DataFrame:
        """The rows in blocks, in an order that follows from them inside one."""
        classes = self.classes

        def pack(table: pa.Table) -> pa.Table:
            y = table["y"].to_numpy()
            x = np.column_stack([inputs_of(table["x"].combine_chunks()), np.ones(len(y))])
            order = np.lexsort((*x.T, y))
            target = ((y - centre) / spread)[:, None] if not classes else signs(y, classes)
            columns = [x[order], target[order]]
            return pa.table({"block": table["block"][:1].cast(pa.int32()), **{k: pa.array([c.tobytes()], pa.binary()) for k, c in zip(("x", "y"), columns)}})

        placed = rows.withColumn("block", F.pmod(F.xxhash64("x", "y", F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))
        spread_out = placed.repartition(min(blocks, TABLE_BUCKETS), "block")
        return bucketed(spread_out.groupBy("block").applyInArrow(pack, PACKED), blocks, "dual_rows")

    def stepped(self, table: DataFrame, before: DataFrame | None, weights: np.ndarray, n: int, blocks: int) -> DataFrame:
        """The dual variables of every block after its epochs, its move of the weights, and its loss and dual value before them.

        ``before`` is the round before; without one all dual variables are zero.
        """

        def step(block: int, x: bytes, y: bytes, alpha: bytes | None) -> pa.Table:
            x = np.frombuffer(x).reshape(-1, len(weights))
            y = np.frombuffer(y).reshape(len(x), -1)
            alpha = np.zeros_like(y) if alpha is None else np.frombuffer(alpha).reshape(y.shape)
            loss, dual = self.values(x @ weights, y, alpha)
            alpha, moved = self.epoch(x, y, alpha.copy(), weights, n, blocks)
            sums = np.concatenate([moved.ravel(), [loss, dual]])
            columns = [pa.array([block], pa.int32()), *[pa.array([r], pa.binary()) for r in (alpha.tobytes(), sums.tobytes())]]
            return pa.Table.from_arrays(columns, schema=STEPPED_KINDS)

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    yield from step(*row, None).to_batches()

        def meet(own: pa.Table, last: pa.Table) -> pa.Table:
            (row,), (alpha,) = (own.select(["block", "x", "y"]).to_pylist(), last["alpha"].to_pylist())
            return step(row["block"], row["x"], row["y"], alpha)

        if before is None:
            return table.mapInArrow(first, STEPPED)
        kept = before.select("block", "alpha")
        return table.groupBy("block").cogroup(kept.groupBy("block")).applyInArrow(meet, STEPPED)

    def values(self, margin: np.ndarray, y: np.ndarray, alpha: np.ndarray) -> tuple[float, float]:
        """Summed loss, and summed dual terms, of rows."""
        if self.classes:
            return float(np.maximum(0.0, 1.0 - y * margin).sum()), float((alpha * y).sum())
        return float(np.maximum(0.0, np.abs(margin - y) - self.tube).sum()), float((alpha * y - self.tube * np.abs(alpha)).sum())

    def epoch(self, x, y, alpha, weights, n: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
        """Passes of coordinate steps; ``alpha`` are signed, so the weights are the mean of alpha times x over the strength."""
        moved = np.zeros_like(weights)
        norms = (x * x).sum(axis=1) * blocks / (self.strength * n)
        own = weights.copy()
        step = blocks / (self.strength * n)
        if y.shape[1] == 1:
            self._one_margin(x, y[:, 0].tolist(), alpha[:, 0], own[:, 0], moved[:, 0], norms.tolist(), step)
            return alpha, moved
        for i in list(range(len(x))) * self.epochs:
            if norms[i] <= 0:
                continue
            margin = x[i] @ own
            if self.classes:
                new = y[i] * np.clip(alpha[i] * y[i] + (1.0 - y[i] * margin) / norms[i], 0.0, 1.0)
            else:
                pulled = alpha[i] + (y[i] - margin) / norms[i]
                new = np.clip(np.sign(pulled) * np.maximum(np.abs(pulled) - self.tube / norms[i], 0.0), -1.0, 1.0)
            delta = new - alpha[i]
            if delta.any():
                alpha[i] = new
                change = np.outer(x[i], delta)
                own += step * change
                moved += change
        return alpha, moved

    def _one_margin(self, x, y, alpha, own, moved, norms, step: float) -> None:
        """The same passes for a single margin, in numbers instead of arrays of one."""
        at = alpha.tolist()
        for i in list(range(len(x))) * self.epochs:
            if norms[i] <= 0:
                continue
            margin = float(x[i] @ own)
            if self.classes:
                new = y[i] * min(max(at[i] * y[i] + (1.0 - y[i] * margin) / norms[i], 0.0), 1.0)
            else:
                pulled = at[i] + (y[i] - margin) / norms[i]
                size = min(max(abs(pulled) - self.tube / norms[i], 0.0), 1.0)
                new = size if pulled > 0 else -size
            delta = new - at[i]
            if delta:
                at[i] = new
                change = x[i] * delta
                own += step * change
                moved += change
        alpha[:] = at


def bucketed(rows: DataFrame, blocks: int, label: str) -> DataFrame:
    """Stored rows by block, so that two such tables meet without a shuffle."""
    spark = rows.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    writer = rows.write.option("path", f"{work_dir(spark)}/featloom/{name}")
    writer.bucketBy(min(blocks, TABLE_BUCKETS), "block").saveAsTable(name)
    return spark.table(name)


def signs(y: np.ndarray, classes: int) -> np.ndarray:
    if classes <= 2:
        return np.where(y > 0, 1.0, -1.0)[:, None]
    return np.where(y.astype(int)[:, None] == np.arange(classes), 1.0, -1.0)


def _added(left: bytes, right: bytes) -> bytes:
    return (np.frombuffer(left) + np.frombuffer(right)).tobytes()
