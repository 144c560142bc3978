"""Sums of small matrices over all rows, merged in a tree.

Every task adds its batches up and emits one row per key. The rows of a key are then merged, on a
cluster with many cores in two levels, the first ``FAN_IN`` groups wide; each merge streams over its
rows, so neither a task nor the driver holds more than a few matrices per key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Groups of the first level, and cores from which there is one.
FAN_IN = 64

_SCHEMA = "block int, fold int, rows int, cols int, slot int, payload binary"
_NAMES = ["block", "fold", "rows", "cols", "slot", "payload"]

Key = tuple[int, int]
BlockFunction = Callable[[pa.RecordBatch], Iterable[tuple[Key, np.ndarray]]]


def task_slot() -> int:
    """Number of the running task, which spreads the first level of a merge."""
    context = TaskContext.get()
    return context.partitionId() if context is not None else 0


def merged_tree(partial: DataFrame, keys: Sequence[str], combine: Callable[..., bytes], keyed: bool = False) -> DataFrame:
    """One row per key of the (keys, slot int, payload binary) rows, payloads combined two by two.

    ``keyed`` gives ``combine`` the key as a dictionary before the two payloads.
    """
    schema = partial.select(*keys, "payload").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first, own = None, None, ()
        for batch in batches:
            if first is None and batch.num_rows:
                first = batch.slice(0, 1)
                own = ({k: first.column(k)[0].as_py() for k in keys},) if keyed else ()
            for payload in batch.column("payload"):
                raw = payload.as_py()
                total = raw if total is None else combine(*own, total, raw)
        if first is not None:
            yield pa.RecordBatch.from_arrays([*[first.column(k) for k in keys], pa.array([total], pa.binary())], names=[*keys, "payload"])

    if partial.sparkSession.sparkContext.defaultParallelism > FAN_IN:
        narrow = partial.select(*keys, "payload", F.pmod("slot", F.lit(FAN_IN)).alias("slot"))
        partial = narrow.groupBy(*keys, "slot").applyInArrow(run, schema)
    return partial.select(*keys, "payload").groupBy(*keys).applyInArrow(run, schema)


def gram_matrices(table: DataFrame, blocks: BlockFunction) -> dict[Key, np.ndarray]:
    """Sum over all batches of the matrices ``blocks`` gives for each key."""
    partial = table.mapInArrow(_add_batches(blocks), _SCHEMA)
    merged = merged_tree(partial, ["block", "fold", "rows", "cols"], _add)
    return {(r["block"], r["fold"]): np.frombuffer(r["payload"]).reshape(r["rows"], r["cols"]) for r in merged.collect()}


def _add(left: bytes, right: bytes) -> bytes:
    return (np.frombuffer(left) + np.frombuffer(right)).tobytes()


def _add_batches(blocks: BlockFunction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            if batch.num_rows:
                for key, matrix in blocks(batch):
                    if key in total:
                        total[key] += matrix
                    else:
                        total[key] = np.array(matrix, dtype=float)
        slot = task_slot()
        for (block, fold), matrix in total.items():
            row = [block, fold, *matrix.shape, slot]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([v], pa.int32()) for v in row], pa.array([np.ascontiguousarray(matrix).tobytes()], pa.binary())], names=_NAMES
            )

    return run
