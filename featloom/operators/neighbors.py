"""Exact k nearest neighbours of every row among the fitted rows.

A fitted table of checked size travels to the executors and every batch is compared with it.
A larger one is cut into a tree of cells. Two passes of bounds tell which cells a query must see: its
nearest cell gives k rows, the farthest of which bounds its k-th neighbour from above; then it visits the
cells whose boxes the ball of that radius touches. Queries and rows meet in blocks of bounded size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featloom.dataset import CLASSIFICATION, Dataset, Feature, as_double, quoted
from featloom.operators.batches import append_batches
from featloom.operators.cells import Cells, grow, in_chunks, matrix, nearest_box, touched, visits
from featloom.operators.encoding import class_values
from featloom.session import materialise

NEIGHBOURS = 5
MAX_BROADCAST_CELLS = 8_000_000
BLOCK_ROWS = 4096
_QUERY_CHUNK = 512
_TRAIN_TILE = 1024
# Pairs of a query and a row whose distance is computed exactly at a time.
_EXACT_PAIRS = 1 << 17
# Cells, and blocks of a cell's visitors, where balls touch most cells.
FEW_CELLS = 16
MOST_ROWS = 1 << 16


def nearest(query: np.ndarray, train: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and distances of the ``k`` nearest rows of ``train``; equal distances by smaller id."""
    k = min(k, len(train))
    found = np.zeros((len(query), k), dtype=np.int64)
    distance = np.zeros((len(query), k))
    norms = (train * train).sum(axis=1)
    # One product gives the squared distances but for the query's own part.
    right = np.column_stack([-2.0 * train, norms])
    for at in range(0, len(query), _QUERY_CHUNK):
        part = query[at:at + _QUERY_CHUNK]
        # The rough distances only preselect: everything within rounding of the k-th is recomputed.
        room = 1e-9 * ((part * part).sum(axis=1) + norms.max() + 1e-300)
        rows, cols = _preselected(np.column_stack([part, np.ones(len(part))]), right, room, k)
        stops = np.cumsum(np.bincount(rows, minlength=len(part)))
        if np.any(np.diff(stops, prepend=0) < k):
            raise ValueError("neighbours need complete, finite features")
        first = 0
        while first < len(part):
            begin = stops[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(stops, begin + _EXACT_PAIRS, side="right")))
            own, near = rows[begin:stops[last - 1]], cols[begin:stops[last - 1]]
            exact = np.sqrt(((train[near] - part[own]) ** 2).sum(axis=1))
            order = np.lexsort((ids[near], exact, own))
            starts = np.concatenate([[begin], stops[first:last - 1]]) - begin
            best = order[starts[:, None] + np.arange(k)]
            found[at + first:at + last], distance[at + first:at + last] = near[best], exact[best]
            first = last
    return found, distance


def _preselected(left: np.ndarray, right: np.ndarray, room: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of all products up to the k-th smallest of their row and ``room``, ordered by row.

    Products are made in tiles that stay in the processor's cache, and only those that can still count are kept.
    """
    least = np.full((len(left), k), np.inf)
    kept = []
    for start in range(0, len(right), _TRAIN_TILE):
        rough = left @ right[start:start + _TRAIN_TILE].T
        if not start and rough.shape[1] >= k:
            least = np.partition(rough, k - 1, axis=1)[:, :k]
            least.sort(axis=1)
        rows, cols = np.nonzero(rough <= (least[:, -1] + room)[:, None])
        values = rough[rows, cols]
        kept.append((rows, cols + start, values))
        if (start or rough.shape[1] < k) and len(rows):
            number, place = np.unique(rows, return_inverse=True)
            begins = np.searchsorted(rows, number)
            width = np.diff(begins, append=len(rows)).max()
            wider = np.full((len(number), k + width), np.inf)
            wider[:, :k] = least[number]
            wider[place, k + np.arange(len(rows)) - begins[place]] = values
            least[number] = np.sort(np.partition(wider, k - 1, axis=1)[:, :k], axis=1)
    rows, cols, values = (np.concatenate(c) for c in zip(*kept))
    close = np.flatnonzero(values <= (least[:, -1] + room)[rows])
    close = close[np.argsort(rows[close], kind="stable")]
    return rows[close], cols[close]


@dataclass(frozen=True)
class NearestNeighbours:
    """``nn_<class>`` counts (classification) or ``nn_target`` mean (regression) over ``k`` neighbours."""

    train: Dataset
    classes: tuple
    k: int = NEIGHBOURS
    max_cells: int = MAX_BROADCAST_CELLS

    @classmethod
    def fit(cls, ds: Dataset, k: int = NEIGHBOURS, max_cells: int = MAX_BROADCAST_CELLS) -> NearestNeighbours:
        if ds.row_id is None:
            raise ValueError("neighbours need a row id to order equal distances")
        classes = tuple(class_values(ds.df, ds.label)) if ds.task == CLASSIFICATION else ()
        return cls(ds, classes, k, max_cells)

    @property
    def outputs(self) -> list[str]:
        return [f"nn_{i}" for i in range(len(self.classes))] if self.classes else ["nn_target"]

    def transform(self, ds: Dataset) -> Dataset:
        columns = [f"__{o}" for o in self.outputs]
        rows = self.train.df.count()
        if rows * (len(ds.names) + 2) <= self.max_cells:
            df = self._broadcast(ds, columns)
        else:
            df = self._by_cells(ds, columns, rows)
        added = tuple(Feature(o, c) for o, c in zip(self.outputs, columns))
        return Dataset(df, (*ds.features, *added), ds.label, ds.task, ds.row_id)

    def _table(self, names) -> DataFrame:
        label = quoted(self.train.label)
        target = as_double(label)
        if self.classes:
            target = F.array_position(F.array(*[F.lit(c) for c in self.classes]), label).cast("double") - 1
        return self.train.df.select(
            quoted(self.train.row_id).cast("long").alias("tid"),
            target.alias("y"),
            *[self.train.value(n).alias(f"x{i}") for i, n in enumerate(names)],
        )

    def _broadcast(self, ds: Dataset, columns) -> DataFrame:
        fitted = self._table(ds.names).toPandas().to_numpy(dtype=float)
        shared = ds.spark.sparkContext.broadcast(fitted)
        k, outcome = self.k, _outcome_of(len(self.classes))

        def compute(x: np.ndarray) -> np.ndarray:
            table = shared.value
            found, _ = nearest(x, table[:, 2:], table[:, 0], k)
            return outcome(table[:, 1][found])

        return append_batches(ds.df, ds.columns, columns, compute)

    def _by_cells(self, ds: Dataset, columns, rows: int) -> DataFrame:
        train, k = self._table(ds.names), self.k
        xs = [f"x{i}" for i in range(len(ds.names))]
        # Of equal rows only the k with the smallest ids can be among the nearest; the limit is
        # applied before the shuffle, so copies of one row cost no more than k rows per task.
        copy = F.row_number().over(Window.partitionBy(*xs).orderBy("tid"))
        block = block_rows(rows, len(xs))
        cells = grow(train.withColumn("copy", copy).filter(F.col("copy") <= k).drop("copy"), xs, "tid", block if block > BLOCK_ROWS else None)
        query = ds.df.select(quoted(ds.row_id).cast("long").alias("qid"), *[ds.value(n).alias(x) for n, x in zip(ds.names, xs)])
        home = materialise(met(visits(query, cells, "qid", nearest_box), cells, k, block), "home-cells")
        away = visits(home.select("qid", *xs, "bound", F.col("cell").alias("home")), cells, "qid", touched).where("cell <> home")
        others = met(away.drop("home", "bound"), cells, k, block)
        # At most k rows per block, then per query.
        merged = home.select("qid", "near").unionByName(others.select("qid", "near")).groupBy("qid").agg(
            F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near")
        )
        targets = F.transform("near", lambda s: s["y"])
        if self.classes:
            values = [_share_of(targets, i) for i in range(len(self.classes))]
        else:
            values = [F.aggregate(targets, F.lit(0.0), lambda a, y: a + y) / F.size(targets)]
        outcome = merged.select("qid", *[v.alias(c) for v, c in zip(values, columns)])
        return ds.df.join(outcome, quoted(ds.row_id).cast("long") == F.col("qid"), "left").drop("qid")


def block_rows(rows: int, width: int) -> int:
    """Rows of a cell and of a block of its visitors.

    With fewer cells than a box has corners not every side is cut, and most balls touch most cells. What moves is then
    rows times blocks; with a fixed number of blocks it grows as the rows do, until a block is as large as a task bears.
    """
    if width < 40 and rows >= BLOCK_ROWS << width:
        return BLOCK_ROWS
    return max(BLOCK_ROWS, min(MOST_ROWS, MAX_BROADCAST_CELLS // (width + 3), -(-rows // FEW_CELLS)))


def met(visiting: DataFrame, cells: Cells, k: int, block: int = BLOCK_ROWS) -> DataFrame:
    """Every visit with its ``k`` nearest rows of the cell, ``near``, and the distance of the k-th, ``bound``.

    The visitors of a cell are dealt into blocks; a cell goes to each of its blocks.
    """
    xs = cells.xs
    sizes = visiting.groupBy("cell").count().select("cell", F.ceil(F.col("count") / block).alias("chunks"))
    left, chunks = in_chunks(visiting, sizes, "cell", "qid")
    right = cells.rows.join(chunks, "cell").select(F.col("cell").alias("of"), F.col("chunk").alias("of_chunk"), "tid", "y", *xs)
    numbers = ", ".join(f"{x} double" for x in xs)
    schema = f"qid long, {numbers}, cell long, bound double, near array<struct<distance: double, tid: long, y: double>>"
    item = pa.struct([("distance", pa.float64()), ("tid", pa.int64()), ("y", pa.float64())])
    kinds = pa.schema([("qid", pa.int64()), *((x, pa.float64()) for x in xs), ("cell", pa.int64()), ("bound", pa.float64()), ("near", pa.list_(item))])

    def run(own: pa.Table, rows: pa.Table) -> pa.Table:
        if not own.num_rows or not rows.num_rows:
            return kinds.empty_table()
        ids, y = rows["tid"].to_numpy(), rows["y"].to_numpy()
        found, distance = nearest(matrix(own, xs), matrix(rows, xs), ids, k)
        width = found.shape[1]
        bound = distance[:, -1] if width == k else np.full(len(found), np.inf)
        flat = found.ravel()
        items = pa.StructArray.from_arrays([pa.array(distance.ravel()), pa.array(ids[flat]), pa.array(y[flat], from_pandas=True)], fields=list(item))
        near = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width, dtype=np.int32)), items)
        columns = [*(own[c].combine_chunks() for c in ("qid", *xs, "cell")), pa.array(bound), near]
        return pa.Table.from_arrays(columns, schema=kinds)

    return left.groupBy("cell", "chunk").cogroup(right.groupBy("of", "of_chunk")).applyInArrow(run, schema)


def _outcome_of(classes: int):
    def outcome(y: np.ndarray) -> np.ndarray:
        if not classes:
            return y.mean(axis=1, keepdims=True)
        return np.stack([(y == i).sum(axis=1) for i in range(classes)], axis=1).astype(float)

    return outcome


def _share_of(targets, code: int):
    return F.size(F.filter(targets, lambda y: y == F.lit(float(code)))).cast("double")
