"""Second-order gradient boosting on histograms.

Features are cut into bins once, and rows with the same bins and label become one row with a weight, so that
what the rounds read is bounded by the cells there are. Cells that fit into ``CELL_BYTES`` go through all rounds in
one task. Of more cells a round grows one tree per class, all together and level by level: a
pass adds up the gradients and second derivatives of the loss per class, node, feature and bin, the sums
are merged in a tree of tasks, and the merged blocks give their best split each, so that histograms never
reach the driver. Margins are brought up to date in the stored table every few rounds and from the
latest trees in between.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featloom.dataset import Dataset
from featloom.operators.batches import batch_matrix
from featloom.operators.fitted import few_values
from featloom.operators.gram import merged_tree, task_slot
from featloom.operators.quantiles import exact_quantiles
from featloom.session import materialise

# Defaults of the method.
ROUNDS = 100
DEPTH = 6
RATE = 0.3
PENALTY = 1.0
LEAST_WEIGHT = 1.0
BINS = 256
# A split must gain more than rounding.
LEAST_GAIN = 1e-6
# Bytes of sums that a task holds in a pass, and of a merged row.
PASS_BYTES = 64 << 20
ROW_BYTES = 4 << 20
# Rounds after which margins are stored anew.
STORED_EVERY = 8
# Bytes up to which the cells of a table are fitted by one task.
CELL_BYTES = 384 << 20
# Margins of a fitted model between its thresholds up to which rows look their prediction up.
LATTICE_CELLS = 1 << 22
LEAF = -1


@dataclass
class Tree:
    """Nodes in rows: feature (``LEAF`` for a leaf), last bin that goes left, threshold, children, weight."""

    feature: list[int] = field(default_factory=list)
    last: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    weight: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, weight: float) -> int:
        for column, value in zip((self.feature, self.last, self.threshold, self.left, self.right, self.weight, self.gain), (LEAF, 0, 0.0, 0, 0, weight, 0.0)):
            column.append(value)
        return len(self.feature) - 1

    def split(self, node: int, feature: int, last: int, threshold: float, gain: float, left: float, right: float) -> tuple[int, int]:
        self.feature[node], self.last[node], self.threshold[node], self.gain[node] = feature, last, threshold, gain
        self.left[node], self.right[node] = self.add(left), self.add(right)
        return self.left[node], self.right[node]

    def nodes(self, x: np.ndarray, binned: bool) -> np.ndarray:
        """The leaf of every row, of bins or of values."""
        feature, left, right = (np.array(c, dtype=np.int64) for c in (self.feature, self.left, self.right))
        limit = np.array(self.last if binned else self.threshold)
        at = np.zeros(len(x), np.int64)
        while (open_ := np.flatnonzero(feature[at] != LEAF)).size:
            own = at[open_]
            value = x[open_, feature[own]]
            low = value <= limit[own] if binned else value < limit[own]
            at[open_] = np.where(low, left[own], right[own])
        return at

    def values(self, x: np.ndarray, binned: bool = False) -> np.ndarray:
        return np.array(self.weight)[self.nodes(x, binned)]


def derivatives(margin: np.ndarray, y: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss per row and margin: squared error, logistic, or softmax."""
    return _derivatives(margin, targets(y, classes), classes)


def targets(y: np.ndarray, classes: int) -> np.ndarray:
    """What each margin of a row aims at: its label, or whether it is the label's class."""
    return y.astype(int)[:, None] == np.arange(classes) if classes > 2 else y[:, None]


def _derivatives(margin: np.ndarray, target: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    if not classes:
        return margin - target, np.ones_like(margin)
    if classes <= 2:
        p = 1.0 / (1.0 + np.exp(-margin))
        return p - target, np.maximum(p * (1.0 - p), 1e-16)
    p = np.exp(margin - margin.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    return p - target, np.maximum(2.0 * p * (1.0 - p), 1e-16)


def best_split(sums: np.ndarray, penalty: float, least_weight: float) -> tuple[float, int, int, float, float, float, float]:
    """(gain, feature, last bin, left G, left H, G, H) of a node's (2, features, bins) sums; ties to the first."""
    left = np.cumsum(sums, axis=2)
    g, h = left[0, 0, -1], left[1, 0, -1]
    gl, hl = left[0, :, :-1], left[1, :, :-1]
    gr, hr = g - gl, h - hl
    gain = gl**2 / (hl + penalty) + gr**2 / (hr + penalty) - g**2 / (h + penalty)
    gain = np.where((hl >= least_weight) & (hr >= least_weight), gain, -np.inf)
    feature, last = np.unravel_index(int(gain.argmax()), gain.shape)
    return float(gain[feature, last]), int(feature), int(last), float(gl[feature, last]), float(hl[feature, last]), float(g), float(h)


@dataclass(frozen=True)
class BoostedTrees:
    """Fitted trees; ``transform`` adds the class or the value as ``__p`` from the vector ``__x``."""

    base: float
    classes: int
    rounds: tuple[tuple[Tree, ...], ...]

    def margins(self, x: np.ndarray) -> np.ndarray:
        width = self.classes if self.classes > 2 else 1
        found = np.full((len(x), width), self.base)
        for trees in self.rounds:
            for k, tree in enumerate(trees):
                found[:, k] += tree.values(x)
        return found

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.chosen(self.margins(x))

    def chosen(self, found: np.ndarray) -> np.ndarray:
        """Value or class of every row of margins."""
        if not self.classes:
            return found[:, 0]
        return (found[:, 0] > 0).astype(float) if self.classes <= 2 else found.argmax(axis=1).astype(float)

    def lattice(self) -> tuple[list[np.ndarray], np.ndarray] | None:
        """Thresholds in use per feature, and the prediction of every cell between them; None where cells are too many."""
        cuts: dict[int, set[float]] = {}
        for tree in (t for trees in self.rounds for t in trees):
            for feature, threshold in zip(tree.feature, tree.threshold):
                if feature != LEAF:
                    cuts.setdefault(feature, set()).add(threshold)
        own = [np.array(sorted(cuts.get(i, ()))) for i in range(1 + max(cuts, default=-1))]
        shape, margins = [len(c) + 1 for c in own], self.classes if self.classes > 2 else 1
        if math.prod(shape) * margins > LATTICE_CELLS:
            return None
        found = np.full((margins, *shape), self.base)
        for trees in self.rounds:
            for margin, tree in zip(found, trees):
                open_ = [(0, [(0, n) for n in shape])]
                while open_:
                    node, box = open_.pop()
                    feature = tree.feature[node]
                    if feature == LEAF:
                        margin[tuple(slice(*side) for side in box)] += tree.weight[node]
                        continue
                    low, high = box[feature]
                    cut = min(max(int(np.searchsorted(own[feature], tree.threshold[node])) + 1, low), high)
                    for child, side in ((tree.left[node], (low, cut)), (tree.right[node], (cut, high))):
                        if side[0] < side[1]:
                            open_.append((child, [*box[:feature], side, *box[feature + 1 :]]))
        return own, self.chosen(found.reshape(margins, -1).T)

    def transform(self, df: DataFrame) -> DataFrame:
        kept = [c for c in df.columns if c != "__x"]
        wide = df.select(*[F.col("`" + c.replace("`", "``") + "`") for c in kept], vector_to_array("__x").alias("__x"))
        schema = wide.withColumn("__p", F.lit(0.0)).schema
        lattice = self.lattice()
        predict = self.predict if lattice is None else lambda x: _looked_up(*lattice, x)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = batch.column(len(kept)).flatten().to_numpy().reshape(batch.num_rows, -1)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(predict(x))], names=[*batch.schema.names, "__p"])

        return wide.mapInArrow(run, schema)


@dataclass(frozen=True)
class CellBoosting:
    """The rounds over cells that are all in memory."""

    classes: int = 0
    rounds: int = ROUNDS
    depth: int = DEPTH
    rate: float = RATE
    penalty: float = PENALTY
    least_weight: float = LEAST_WEIGHT
    bins: int = BINS

    def cells_of(self, held: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bins by feature, weight and mean target of every cell, in the order of the bins."""
        kind = np.dtype(np.uint8 if self.bins <= 256 else np.uint16)
        y, weight = (held.column(i).to_numpy() for i in range(2))
        raw = np.frombuffer(b"".join(v for c in held.column(2).chunks for v in c.to_pylist()), kind).reshape(len(y), -1)
        if not raw.shape[1]:
            raw = np.zeros((len(y), 1), kind)
        bins, cell = np.unique(raw, axis=0, return_inverse=True)
        cell = cell.ravel()
        total = np.bincount(cell, weight)
        target = np.column_stack([np.bincount(cell, weight * t) for t in targets(y, self.classes).T]) / total[:, None]
        return np.ascontiguousarray(bins.T), total, target

    def rounds_of(self, bins: np.ndarray, weight: np.ndarray, target: np.ndarray, edges: list[np.ndarray], base: float, margins: int):
        margin = np.full((len(weight), margins), base)
        done: list[tuple[Tree, ...]] = []
        for _ in range(self.rounds if edges else 0):
            g, h = (np.ascontiguousarray((d * weight[:, None]).T) for d in _derivatives(margin, target, self.classes))
            grown = [self.tree_of(bins, g[k], h[k], edges) for k in range(margins)]
            if not any(len(t.feature) > 1 or t.weight[0] for t, _ in grown):
                break
            for k, (tree, leaf) in enumerate(grown):
                margin[:, k] += np.array(tree.weight)[leaf]
            done.append(tuple(t for t, _ in grown))
        return tuple(done)

    def tree_of(self, bins: np.ndarray, g: np.ndarray, h: np.ndarray, edges: list[np.ndarray]) -> tuple[Tree, np.ndarray]:
        """A tree, and the leaf of every cell."""
        tree, leaf = Tree(), np.zeros(len(g), np.int64)
        open_ = [tree.add(0.0)]
        for level in range(self.depth):
            # Cells of closed nodes are added up behind the open ones.
            place = np.full(len(tree.feature), len(open_))
            place[open_] = np.arange(len(open_))
            first, size = place[leaf] * self.bins, (len(open_) + 1) * self.bins
            sums = np.empty((2, len(open_), len(bins), self.bins))
            for i, own in enumerate(bins):
                at = first + own
                for total, values in zip(sums, (g, h)):
                    total[:, i] = np.bincount(at, values, size).reshape(-1, self.bins)[:-1]
            grown: list[int] = []
            for number, node in enumerate(open_):
                gain, feature, last, *sides = best_split(sums[:, number], self.penalty, self.least_weight)
                grown += self.divided(tree, level, node, gain, feature, last, *sides, edges)
            if not grown:
                break
            feature, last, left, right = (np.array(c) for c in (tree.feature, tree.last, tree.left, tree.right))
            moved = np.flatnonzero(feature[leaf] != LEAF)
            own = leaf[moved]
            leaf[moved] = np.where(bins[feature[own], moved] <= last[own], left[own], right[own])
            open_ = grown
        return tree, leaf

    def divided(self, tree: Tree, level: int, node: int, gain: float, feature: int, last: int, gl: float, hl: float, g: float, h: float, edges) -> tuple[int, ...]:
        """Children of a node that its best split is worth."""
        if not level:
            tree.weight[0] = self.weight(g, h)
        if not gain > LEAST_GAIN:
            return ()
        return tree.split(node, feature, last, float(edges[feature][last]), gain, self.weight(gl, hl), self.weight(g - gl, h - hl))

    def weight(self, g: float, h: float) -> float:
        return -self.rate * g / (h + self.penalty)


class HistogramBoosting(CellBoosting):
    """``classes`` 0 fits values, 2 a logistic margin, more a softmax over as many margins."""

    def fit(self, df: DataFrame) -> BoostedTrees:
        """From the vector ``__x`` and the label ``__y``."""
        # The table may hold predictions of another model, so it is computed once.
        arrays = materialise(df.select(F.col("__y").cast("double").alias("__y"), vector_to_array("__x").alias("__a")), "boosting-rows")
        width = arrays.select(F.max(F.size("__a"))).first()[0] or 0
        names = [f"f{i}" for i in range(width)]
        wide = arrays.select("__y", *[F.col("__a")[i].alias(n) for i, n in enumerate(names)])
        ds = Dataset.of(wide, names)
        edges = self.edges(ds)
        base = 0.0
        if not self.classes:
            base = wide.agg(F.avg("__y")).first()[0] or 0.0
        margins = self.classes if self.classes > 2 else 1
        rows = self.binned(wide, names, edges, base, margins)
        cells = rows.count()
        if cells and self.cell_bytes(cells, width, margins) <= CELL_BYTES:
            return BoostedTrees(base, self.classes, self.grown_at_once(rows, edges, base, margins))
        done: list[tuple[Tree, ...]] = []
        pending: list[tuple[Tree, ...]] = []
        for _ in range(self.rounds):
            trees = self.grow(rows, pending, edges, margins)
            if not any(len(t.feature) > 1 or t.weight[0] for t in trees):
                break
            done.append(trees)
            pending.append(trees)
            if len(pending) == STORED_EVERY:
                rows, pending = self.updated(rows, pending, margins), []
        return BoostedTrees(base, self.classes, tuple(done))

    def edges(self, ds: Dataset) -> list[np.ndarray]:
        """Lower bounds of the bins above the first: all values but the least where they are few, else quantiles."""
        few = few_values(ds, self.bins)
        many = [n for n, v in zip(ds.names, few) if v is None]
        marks = exact_quantiles(ds.keep(many), np.arange(1, self.bins) / self.bins) if many else {}
        return [np.unique(marks[n]) if v is None else np.array(v[1:]) for n, v in zip(ds.names, few)]

    def binned(self, wide: DataFrame, names: Sequence[str], edges: list[np.ndarray], base: float, margins: int) -> DataFrame:
        """Columns y, weight, bins, margin: a row for the rows of equal bins and label; of values ``y`` is the mean."""
        kind = np.dtype(np.uint8 if self.bins <= 256 else np.uint16)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch_matrix(batch, 1, len(names))
                own = np.column_stack([np.searchsorted(e, x[:, i], "right") for i, e in enumerate(edges)]) if names else np.zeros((len(x), 0))
                yield pa.RecordBatch.from_arrays([batch.column(0), _cells(own.astype(kind))], names=["y", "bins"])

        cells = wide.mapInArrow(run, "y double, bins binary")
        weight, start = F.count(F.lit(1)).cast("double").alias("weight"), F.lit(np.full(margins, base).tobytes()).alias("margin")
        if self.classes:
            found = cells.groupBy("y", "bins").agg(weight)
        else:
            found = cells.groupBy("bins").agg(F.avg("y").alias("y"), weight)
        return materialise(found.select("y", "weight", "bins", start), "bins")

    def cell_bytes(self, rows: int, width: int, margins: int) -> int:
        """Bytes that cells take in memory at most, with the sums of a level."""
        return rows * (4 * width + 64 + 56 * margins) + 2 * 8 * self.bins * width * 2 ** (self.depth - 1)

    def grown_at_once(self, rows: DataFrame, edges: list[np.ndarray], base: float, margins: int) -> tuple[tuple[Tree, ...], ...]:
        """All rounds in one task; the driver gets the trees."""
        boosted = CellBoosting(**vars(self))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells = boosted.cells_of(pa.Table.from_batches([b for b in batches if b.num_rows]))
            found = [[vars(tree) for tree in trees] for trees in boosted.rounds_of(*cells, edges, base, margins)]
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], names=["payload"])

        found = rows.select("y", "weight", "bins").coalesce(1).mapInArrow(run, "payload binary").collect()[0]["payload"]
        return tuple(tuple(Tree(**tree) for tree in trees) for trees in pickle.loads(found))

    def updated(self, rows: DataFrame, pending: list[tuple[Tree, ...]], margins: int) -> DataFrame:
        read = self.reader(pending, margins)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    *_, margin = read(batch)
                    yield pa.RecordBatch.from_arrays([*batch.columns[:3], _cells(margin)], names=["y", "weight", "bins", "margin"])

        return materialise(rows.mapInArrow(run, rows.schema), "margins")

    def reader(self, pending: list[tuple[Tree, ...]], margins: int):
        kind = np.dtype(np.uint8 if self.bins <= 256 else np.uint16)

        def read(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
            n = batch.num_rows
            y, weight = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            bins = np.frombuffer(b"".join(batch.column(2).to_pylist()), kind).reshape(n, -1).astype(np.int64)
            margin = np.frombuffer(b"".join(batch.column(3).to_pylist())).reshape(n, margins).copy()
            for trees in pending:
                for k, tree in enumerate(trees):
                    margin[:, k] += tree.values(bins, binned=True)
            return y, weight, bins, margin

        return read

    def grow(self, rows: DataFrame, pending: list[tuple[Tree, ...]], edges: list[np.ndarray], margins: int) -> tuple[Tree, ...]:
        """One tree per margin; ``open_`` are (margin, node) that may still be split."""
        trees = tuple(Tree() for _ in range(margins))
        for tree in trees:
            tree.add(0.0)
        open_ = [(k, 0) for k in range(margins)]
        for level in range(self.depth):
            found = self.splits(rows, pending, trees, open_, len(edges), margins)
            grown = []
            for k, node in open_:
                if (k, node) not in found:
                    continue
                grown += [(k, child) for child in self.divided(trees[k], level, node, *found[(k, node)], edges)]
            open_ = grown
            if not open_:
                break
        return trees

    def splits(self, rows, pending, trees, open_, width: int, margins: int) -> dict:
        """Best split of every open node: passes over parts of the nodes and features whose sums fit a task."""
        node_bytes = 2 * 8 * self.bins
        side = max(1, min(width, ROW_BYTES // node_bytes))
        parts = [(number, first) for number in range(len(open_)) for first in range(0, width, side)]
        room = max(1, PASS_BYTES // (node_bytes * side))
        found: dict = {}
        for at in range(0, len(parts), room):
            for row in self.sums(rows, pending, trees, open_, parts[at : at + room], side, width, margins).collect():
                key = open_[row["node"]]
                best = tuple(row[c] for c in ("gain", "feature", "last", "gl", "hl", "g", "h"))
                # Higher gain first, then the smaller feature.
                if key not in found or (best[0], -best[1]) > (found[key][0], -found[key][1]):
                    found[key] = best
        return found

    def sums(self, rows, pending, trees, open_, parts, side: int, width: int, margins: int) -> DataFrame:
        read, bins, classes, penalty, least = self.reader(pending, margins), self.bins, self.classes, self.penalty, self.least_weight
        wanted: dict[int, list[int]] = {}
        for number, first in parts:
            wanted.setdefault(number, []).append(first)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {part: np.zeros((2, min(side, width - part[1]), bins)) for part in parts}
            seen = False
            for batch in batches:
                if not batch.num_rows:
                    continue
                seen = True
                y, weight, own, margin = read(batch)
                g, h = (d * weight[:, None] for d in derivatives(margin, y, classes))
                leaves = {k: trees[k].nodes(own, binned=True) for k in {open_[n][0] for n in wanted}}
                for number, firsts in wanted.items():
                    k, node = open_[number]
                    at = np.flatnonzero(leaves[k] == node)
                    if not len(at):
                        continue
                    for first in firsts:
                        cells = total[(number, first)]
                        count = cells.shape[1]
                        flat = (own[at, first : first + count] + np.arange(count) * bins).ravel()
                        for i, values in enumerate((g, h)):
                            cells[i] += np.bincount(flat, np.repeat(values[at, k], count), count * bins).reshape(count, bins)
            slot = task_slot()
            for (number, first), cells in total.items() if seen else ():
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array([v], pa.int32()) for v in (number, first, slot)], pa.array([cells.tobytes()], pa.binary())],
                    names=["node", "first", "slot", "payload"],
                )

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ["node", "gain", "feature", "last", "gl", "hl", "g", "h"]
            for batch in batches:
                for node, first, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    cells = np.frombuffer(payload).reshape(2, -1, bins)
                    gain, feature, *rest = best_split(cells, penalty, least)
                    values = [node, gain, feature + first, *rest]
                    kinds = [pa.int32(), pa.float64(), pa.int32(), pa.int32(), *[pa.float64()] * 4]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=names)

        merged = merged_tree(rows.mapInArrow(run, "node int, first int, slot int, payload binary"), ["node", "first"], _added)
        return merged.mapInArrow(best, "node int, gain double, feature int, last int, gl double, hl double, g double, h double")


def _looked_up(cuts: Sequence[np.ndarray], found: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), np.int64)
    for i, own in enumerate(cuts):
        at = at * (len(own) + 1) + np.searchsorted(own, x[:, i], "right")
    return found[at]


def _added(left: bytes, right: bytes) -> bytes:
    return (np.frombuffer(left) + np.frombuffer(right)).tobytes()


def _cells(matrix: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values of one length."""
    raw = np.ascontiguousarray(matrix)
    each = raw.dtype.itemsize * (raw.shape[1] if raw.ndim > 1 else 1)
    offsets = np.arange(len(raw) + 1, dtype=np.int32) * each
    return pa.BinaryArray.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw.tobytes())])
