"""Exact quantiles of many columns by refined brackets.

A pass counts the values of every column between the edges known so far and keeps, inside open brackets,
the values themselves as (value, count) pairs. Where there are more of them than a column has room for,
they are thinned evenly and become the edges of the next pass, which opens the brackets that should
hold the wanted positions; where they are all there, the positions are read off. The counts are
exact, so a bracket that was guessed wrong is opened a pass later. A column with few values needs one
pass, one with many two or a few, and what is shuffled depends on the columns and the room, not on the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from featloom.dataset import Dataset
from featloom.operators.batches import batch_matrix
from featloom.operators.gram import merged_tree, task_slot

# Pairs that a task keeps over all columns, and of a column at most and at least.
ROOM = 1 << 21
MOST = 1 << 16
LEAST = 1 << 10
# Pairs of an open bracket that are kept at least.
SHARE = 8
PACKED = "col int, slot int, payload binary"


@dataclass
class Between:
    """Rows below, inside and above open brackets of a column.

    ``counts`` are the rows of each bracket; ``values`` and ``weights`` those of the open ones in order,
    ``exact`` tells for each bracket whether they are all there.
    """

    counts: np.ndarray
    exact: np.ndarray
    values: np.ndarray
    weights: np.ndarray

    def packed(self) -> bytes:
        parts = [self.counts.astype("<i8"), self.exact.astype("<i8"), self.values.astype("<f8"), self.weights.astype("<i8")]
        return np.array([len(p) for p in parts], "<i8").tobytes() + b"".join(p.tobytes() for p in parts)

    @classmethod
    def read(cls, raw: bytes) -> Between:
        sizes = np.frombuffer(raw, "<i8", 4)
        at, parts = 32, []
        for size, kind in zip(sizes.tolist(), ("<i8", "<i8", "<f8", "<i8")):
            parts.append(np.frombuffer(raw, kind, size, at))
            at += 8 * size
        return cls(parts[0], parts[1].astype(bool), parts[2], parts[3])


@dataclass(frozen=True)
class Brackets:
    """Edges of a column and which of the brackets between them are open; a value on an edge lies above it."""

    edges: np.ndarray
    open_: np.ndarray
    room: int

    def of(self, values: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, values, "right")

    def summary(self, values: np.ndarray) -> Between:
        values = np.sort(values[~np.isnan(values)]) + 0.0
        bracket = self.of(values)
        counts = np.bincount(bracket, minlength=len(self.edges) + 1)
        inside, weights = np.unique(values[self.open_[bracket]], return_counts=True)
        return self.thinned(Between(counts, self.open_.copy(), inside, weights))

    def merged(self, a: Between, b: Between) -> Between:
        values = np.concatenate([a.values, b.values])
        inside, at = np.unique(values, return_inverse=True)
        weights = np.bincount(at, np.concatenate([a.weights, b.weights]), len(inside)).astype(np.int64)
        return self.thinned(Between(a.counts + b.counts, a.exact & b.exact, inside, weights))

    def thinned(self, found: Between) -> Between:
        """No more pairs than there is room for: every bracket with more than its share keeps evenly spaced ones."""
        if len(found.values) <= self.room:
            return found
        share = max(SHARE, self.room // max(1, int(self.open_.sum())))
        bracket = self.of(found.values)
        heads = np.flatnonzero(np.diff(bracket, prepend=-1))
        sizes = np.diff(heads, append=len(bracket))
        keep = np.ones(len(bracket), bool)
        for head, size in zip(heads[sizes > share].tolist(), sizes[sizes > share].tolist()):
            chosen = np.unique(np.linspace(0, size - 1, share).astype(int))
            keep[head : head + size] = False
            keep[head + chosen] = True
            found.exact[bracket[head]] = False
        # The weight of what goes falls to the pair kept before it.
        weights = np.add.reduceat(found.weights, np.flatnonzero(keep)) if keep.any() else found.weights[:0]
        return Between(found.counts, found.exact, found.values[keep], weights)


def exact_quantiles(ds: Dataset, probabilities: Sequence[float], room: int = ROOM) -> dict[str, np.ndarray]:
    """Linearly interpolated quantiles per feature, missing values left out; NaN where a feature has none."""
    names = ds.names
    wanted = {i: None for i in range(len(names))}
    per_column = min(MOST, max(LEAST, room // max(1, len(names))))
    state = {i: Brackets(np.zeros(0), np.ones(1, bool), per_column) for i in wanted}
    found: dict[str, np.ndarray] = {}
    while state:
        sums = _counted(ds, state)
        after = {}
        for i, brackets in state.items():
            between = sums.get(i)
            total = 0 if between is None else int(between.counts.sum())
            if not total:
                found[names[i]] = np.full(len(probabilities), np.nan)
                continue
            exact = _positions(probabilities, total - 1)
            low, high = np.floor(exact).astype(np.int64), np.ceil(exact).astype(np.int64)
            needed = np.unique(np.concatenate([low, high]))
            above = np.cumsum(between.counts)
            bracket = np.searchsorted(above, needed, "right")
            if between.exact[bracket].all():
                at = dict(zip(needed.tolist(), _values_at(needed, bracket, above, between, brackets).tolist()))
                left, right = (np.array([at[p] for p in side.tolist()]) for side in (low, high))
                share = exact - low
                found[names[i]] = np.where(share > 0, left + (right - left) * share, left)
                continue
            after[i] = _refined(brackets, between, needed, bracket, above)
        state = after
    return {n: found[n] for n in names}


def _refined(brackets: Brackets, between: Between, needed: np.ndarray, bracket: np.ndarray, above: np.ndarray) -> Brackets:
    """Brackets of the next pass: those with a wanted position, cut at their thinned values where they have some."""
    own = brackets.of(between.values)
    holds = np.zeros(len(between.counts), bool)
    holds[bracket] = True
    cut = between.values[holds[own]]
    edges = np.unique(np.concatenate([brackets.edges, cut]))
    opened = Brackets(edges, np.zeros(len(edges) + 1, bool), brackets.room)
    below = np.concatenate([[0], above])[:-1]
    for one in np.unique(bracket).tolist():
        mine = needed[bracket == one]
        inside = own == one
        values = between.values[inside]
        if not len(values):
            opened.open_[opened.of(brackets.edges[one - 1 : one])[0] if one else 0] = True
            continue
        # Kept weights say about where a position lies; its neighbours are opened too.
        guess = np.searchsorted(below[one] + np.cumsum(between.weights[inside]), mine, "right")
        first = int(opened.of(values[:1])[0])
        near = np.unique(np.concatenate([guess - 1, guess, guess + 1]))
        opened.open_[np.clip(first + near, 0, len(edges))] = True
    return opened


def _values_at(needed, bracket, above, between: Between, brackets: Brackets) -> np.ndarray:
    """The value at each needed position, from the complete pairs of its bracket."""
    own = brackets.of(between.values)
    below = np.concatenate([[0], above])[:-1]
    inside = np.cumsum(between.weights) - between.weights
    first = np.searchsorted(own, np.arange(len(below)))
    start = below[own] + inside - inside[np.minimum(first[own], len(inside) - 1)]
    return between.values[np.searchsorted(start, needed, "right") - 1]


def _counted(ds: Dataset, state: dict[int, Brackets]) -> dict[int, Between]:
    columns = sorted(state)
    table = ds.df.select(*[ds.value(ds.names[i]).alias(f"v{i}") for i in columns])
    shared = [state[i] for i in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, Between] = {}
        for batch in batches:
            x = batch_matrix(batch, 0, len(columns))
            for k, brackets in enumerate(shared):
                own = brackets.summary(x[:, k])
                sums[k] = brackets.merged(sums[k], own) if k in sums else own
        slot = task_slot()
        for k, own in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()), pa.array([slot], pa.int32()), pa.array([own.packed()], pa.binary())], names=["col", "slot", "payload"]
            )

    def combine(key: dict, left: bytes, right: bytes) -> bytes:
        return shared[key["col"]].merged(Between.read(left), Between.read(right)).packed()

    merged = merged_tree(table.mapInArrow(run, PACKED), ["col"], combine, keyed=True)
    return {columns[r["col"]]: Between.read(r["payload"]) for r in merged.collect()}


def _positions(probabilities: Sequence[float], top: int) -> np.ndarray:
    """Fractional positions 0..top; those within rounding of a whole position are that position."""
    exact = np.asarray(probabilities, dtype=float) * top
    whole = np.rint(exact)
    return np.where(np.abs(exact - whole) <= 1e-9 + 4e-16 * top, whole, exact)
