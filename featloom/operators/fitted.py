"""Operators fitted on the whole table and applied to any table with the same features."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import partial, reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featloom.dataset import Dataset, as_double, quoted
from featloom.functions.scalar import UNARY
from featloom.functions.summary import FeatureStats
from featloom.operators.batches import append_features, batch_matrix
from featloom.operators.gram import gram_matrices, merged_tree, task_slot
from featloom.operators.moments import stats_of
from featloom.operators.ordering import lookup
from featloom.operators.quantiles import exact_quantiles
from featloom.operators.seeding import blocks, fewer_tasks, first_centres, nearest_centre, packed
from featloom.session import materialise

CLUSTERS = 16
QUANTILES = 1000
# Steps of k-means at most, and the move of a centre below which it rests.
CLUSTER_ROUNDS = 20
CLUSTER_MOVE = 1e-4
# Steps of one-dimensional clustering at most, and the share of a variance below which its moves end it.
ROUNDS = 300
TOLERANCE = 1e-4
SPARSE_SHARE = 0.3
MANY_COLUMNS = 10


def assembled(df: DataFrame, columns: Sequence[str], out: str = "__x") -> DataFrame:
    doubles = [as_double(quoted(c)).alias(f"__v{i}") for i, c in enumerate(columns)]
    wide = df.select("*", *doubles)
    names = [f"__v{i}" for i in range(len(columns))]
    return VectorAssembler(inputCols=names, outputCol=out, handleInvalid="error").transform(wide).drop(*names)


@dataclass(frozen=True)
class PreClean:
    """Columns with less than ``SPARSE_SHARE`` missing (infinity counts), means for the rest."""

    kept: tuple[str, ...]
    means: Mapping[str, float]

    @classmethod
    def fit(cls, ds: Dataset, share: float = SPARSE_SHARE) -> PreClean:
        stats = stats_of(_finite(ds))
        kept = tuple(n for n in ds.names if stats[n].rows and stats[n].nulls / stats[n].rows < share)
        return cls(kept, {n: stats[n].mean for n in kept})

    def transform(self, ds: Dataset) -> Dataset:
        kept = _finite(ds.keep(self.kept))
        filled = {f.column: F.coalesce(quoted(f.column), F.lit(self.means[f.name])) for f in kept.features}
        return kept.with_df(kept.df.withColumns(filled)) if filled else kept


def _finite(ds: Dataset) -> Dataset:
    plain = {f.column: F.when(F.abs(ds.value(f.name)) != float("inf"), ds.value(f.name)) for f in ds.features}
    return ds.with_df(ds.df.withColumns(plain)) if plain else ds


@dataclass(frozen=True)
class Standardise:
    """Zero mean and unit population deviation, both of the fitted table."""

    stats: Mapping[str, FeatureStats]

    @classmethod
    def fit(cls, ds: Dataset) -> Standardise:
        return cls(stats_of(ds))

    def transform(self, ds: Dataset) -> Dataset:
        op = UNARY["zscore"]
        return ds.derived({n: op.column(v, op.fit(self.stats[n])) for n, v in ds.values().items()})


@dataclass(frozen=True)
class Clustering:
    """k-means label over a set of features."""

    centres: np.ndarray
    inputs: tuple[str, ...]
    name: str

    @classmethod
    def fit(cls, ds: Dataset, k: int = CLUSTERS, seed: int = 0, name: str = "clustering_whole", inputs: Sequence[str] | None = None) -> Clustering:
        return cls.fit_many(ds, [(name, ds.names if inputs is None else inputs)], k, seed)[0]

    @classmethod
    def fit_many(cls, ds: Dataset, plan: Sequence[tuple[str, Sequence[str]]], k: int = CLUSTERS, seed: int = 0) -> list[Clustering]:
        """One clustering per (name, inputs): rows are dealt once, and a pass moves the centres of all."""
        used = [n for n in ds.names if any(n in inputs for _, inputs in plan)]
        rows = packed(ds.spread().df.select(*[as_double(quoted(ds.by_name[n])).alias(f"c{i}") for i, n in enumerate(used)])).persist()
        try:
            at = [[used.index(n) for n in inputs] for _, inputs in plan]
            wide = fewer_tasks(rows, len(used))
            moved = _settled(wide, at, first_centres(rows, wide, at, k, seed))
        finally:
            rows.unpersist()
        return [cls(centres, tuple(inputs), name) for (name, inputs), centres in zip(plan, moved)]

    def transform(self, ds: Dataset) -> Dataset:
        return labelled(ds, [self])


def labelled(ds: Dataset, parts: Sequence[Clustering]) -> Dataset:
    """Append the label of every clustering: rows go to Python once for all."""
    used = [n for n in ds.names if any(n in p.inputs for p in parts)]
    plan = [([used.index(n) for n in p.inputs], p.centres) for p in parts]

    @F.pandas_udf(", ".join(f"l{i} double" for i in range(len(parts))))
    def labels(*columns: pd.Series) -> pd.DataFrame:
        x = np.array([c.to_numpy(dtype=float) for c in columns])
        if np.isnan(x).any():
            raise ValueError("a row to be labelled has a missing value")
        return pd.DataFrame({f"l{i}": nearest_centre(x[at].T, centres).astype(float) for i, (at, centres) in enumerate(plan)})

    found = replace(ds, df=ds.df.withColumn("__labels", labels(*[as_double(ds.value(n)) for n in used])))
    return found.derived({**found.values(), **{p.name: F.col("__labels")[f"l{i}"] for i, p in enumerate(parts)}})


def _settled(rows: DataFrame, at: Sequence[Sequence[int]], starts: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Steps of all clusterings together, each until no centre moves by more than ``CLUSTER_MOVE``."""
    centres: dict[int, np.ndarray] = dict(enumerate(starts))
    moving = list(centres)
    for _ in range(CLUSTER_ROUNDS):
        sums = gram_matrices(rows, partial(_cluster_sums, {i: (at[i], centres[i]) for i in moving}))
        left = []
        for i in moving:
            own = sums.get((i, 0))
            if own is None:
                continue
            held = own[:, -1:] > 0
            after = np.where(held, own[:, :-1] / np.where(held, own[:, -1:], 1.0), centres[i])
            if (((after - centres[i]) ** 2).sum(axis=1) > CLUSTER_MOVE**2).any():
                left.append(i)
            centres[i] = after
        moving = left
        if not moving:
            break
    return [centres[i] for i in range(len(starts))]


def _cluster_sums(clusterings: Mapping[int, tuple[Sequence[int], np.ndarray]], batch: pa.RecordBatch):
    """Sums and number of the rows of every centre."""
    for x in blocks(batch):
        for i, (at, centres) in clusterings.items():
            label, k = nearest_centre(x[at].T, centres), len(centres)
            sums = [np.bincount(label, x[j], k) for j in at]
            yield (i, 0), np.column_stack([*sums, np.bincount(label, minlength=k)])


@dataclass(frozen=True)
class Binning:
    """Each feature's bin: nearest of at most ``CLUSTERS`` centres, numbered upwards.

    A column with no more values than centres has its values as centres. The others are clustered
    together: centres start at evenly spaced quantiles (fewer where one value fills several shares), and
    every step moves all centres of all columns to the means of their rows in one pass, until the
    moves of a column fall below ``TOLERANCE`` of its variance or ``rounds`` are through.
    """

    centres: Mapping[str, tuple[float, ...]]
    clean: PreClean

    @classmethod
    def fit(cls, ds: Dataset, k: int = CLUSTERS, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> Binning:
        clean = PreClean.fit(ds)
        table = clean.transform(ds)
        if not table.names:
            return cls({}, clean)
        centres = {n: v for n, v in zip(table.names, few_values(table, k)) if v is not None}
        many = [n for n in table.names if n not in centres]
        if many:
            wide = table.keep(many)
            spread = wide.with_df(materialise(wide.df.select(*[quoted(c) for c in wide.columns]), "bins"))
            centres |= _line_means(spread, k, rounds, tolerance)
        return cls({n: centres[n] for n in table.names}, clean)

    def transform(self, ds: Dataset) -> Dataset:
        table = self.clean.transform(ds)
        base = table.values()
        bins = {f"binning_{n}": _bin_of(base[n], self.centres[n]) for n in table.names}
        return table.derived({**base, **bins})


def few_values(ds: Dataset, limit: int) -> list[tuple[float, ...] | None]:
    """Per feature its values in order, None where there are more than ``limit``: one pass for all."""
    table = ds.df.select(*[v.alias(f"v{i}") for i, v in enumerate(ds.values().values())])
    count = len(ds.names)

    def kept(values: np.ndarray) -> bytes:
        return np.unique(values[~np.isnan(values)] + 0.0)[: limit + 1].astype("<f8").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b""] * count
        for batch in batches:
            x = batch_matrix(batch, 0, count)
            found = [kept(np.concatenate([np.frombuffer(f), x[:, i]])) for i, f in enumerate(found)]
        slots = [task_slot()] * count
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(count), pa.int32()), pa.array(slots, pa.int32()), pa.array(found, pa.binary())], names=["col", "slot", "payload"]
        )

    def combine(left: bytes, right: bytes) -> bytes:
        return kept(np.concatenate([np.frombuffer(left), np.frombuffer(right)]))

    merged = merged_tree(table.mapInArrow(run, "col int, slot int, payload binary"), ["col"], combine)
    values = {r["col"]: np.frombuffer(r["payload"]) for r in merged.collect()}
    own = [values.get(i, np.zeros(0)) for i in range(count)]
    return [tuple(v.tolist()) if len(v) <= limit else None for v in own]


def _line_means(ds: Dataset, k: int, rounds: int, tolerance: float) -> dict[str, tuple[float, ...]]:
    """One-dimensional k-means of every feature; a pass gives (column, centre, rows, sum) of all."""
    starts = exact_quantiles(ds, (np.arange(k) + 0.5) / k)
    centres = [np.unique(starts[n]) for n in ds.names]
    variance = [s.std**2 for s in stats_of(ds).values()]
    table = ds.df.select(*[v.alias(f"v{i}") for i, v in enumerate(ds.values().values())])
    moving = np.ones(len(centres), bool)
    for _ in range(rounds):
        at = [c if m else None for c, m in zip(centres, moving)]
        sums = gram_matrices(table, partial(_centre_sums, at, k))[(0, 0)]
        for i in np.flatnonzero(moving):
            own = sums[2 * i : 2 * i + 2, : len(centres[i])]
            moved = centres[i] + np.divide(own[1], own[0], out=np.zeros(len(own[0])), where=own[0] > 0)
            shift = float(((moved - centres[i]) ** 2).sum())
            centres[i] = moved
            # Moves by rounding are none.
            moving[i] = shift > max(tolerance, 1e-20) * variance[i]
        if not moving.any():
            break
    return {n: tuple(c.tolist()) for n, c in zip(ds.names, centres)}


def _centre_sums(centres: list[np.ndarray | None], k: int, batch: pa.RecordBatch):
    """Rows, and sums of the distances from their centre, per centre of each column that still moves."""
    x = batch_matrix(batch, 0, len(centres))
    sums = np.zeros((2 * len(centres), k))
    for i, own in enumerate(centres):
        if own is not None:
            at = np.searchsorted((own[1:] + own[:-1]) / 2, x[:, i], "left")
            sums[2 * i, : len(own)] = np.bincount(at, minlength=len(own))
            sums[2 * i + 1, : len(own)] = np.bincount(at, x[:, i] - own[at], len(own))
    yield (0, 0), sums


def _bin_of(x: Column, centres: Sequence[float]) -> Column:
    passed = [(x > F.lit((a + b) / 2)).cast("double") for a, b in zip(centres, centres[1:])]
    return reduce(lambda a, b: a + b, passed, F.lit(0.0))


@dataclass(frozen=True)
class TermFrequency:
    """Number of fitted rows that hold the same value; 0 for values never seen."""

    counts: Mapping[str, DataFrame]

    @classmethod
    def fit(cls, ds: Dataset) -> TermFrequency:
        found = {}
        for name in ds.names:
            value = ds.value(name)
            counted = ds.df.filter(value.isNotNull()).groupBy(value.alias("key")).agg(F.count(F.lit(1)).alias("n"))
            found[name] = materialise(counted.select("key", F.col("n").alias("value"), "n"), "terms")
        return cls(found)

    def transform(self, ds: Dataset) -> Dataset:
        df = ds.df.select("*", *[ds.value(n).alias(f"__t{i}") for i, n in enumerate(ds.names)])
        for i, name in enumerate(ds.names):
            df = lookup(df, f"__t{i}", self.counts[name], f"__k{i}", F.lit(0).cast("long"))
        added = {f"ktermfreq_{n}": F.col(f"__k{i}") for i, n in enumerate(ds.names)}
        return ds.with_df(df).derived({**ds.values(), **added})


@dataclass(frozen=True)
class QuantileMap:
    """Map to [0, 1] by the fitted empirical quantiles, ties at the middle of their range."""

    quantiles: Mapping[str, np.ndarray]
    clean: PreClean

    @classmethod
    def fit(cls, ds: Dataset, quantiles: int = QUANTILES) -> QuantileMap:
        clean = PreClean.fit(ds)
        table = clean.transform(ds)
        steps = min(quantiles, max(2, table.df.count()))
        return cls(exact_quantiles(table, np.linspace(0.0, 1.0, steps)), clean)

    def transform(self, ds: Dataset) -> Dataset:
        table = self.clean.transform(ds)
        marks = [self.quantiles[n] for n in table.names]

        def compute(x: np.ndarray) -> np.ndarray:
            out = np.empty_like(x)
            for j, q in enumerate(marks):
                share = np.linspace(0.0, 1.0, len(q))
                up = np.interp(x[:, j], q, share)
                down = np.interp(-x[:, j], -q[::-1], -share[::-1])
                out[:, j] = 0.5 * (up - down)
            return out

        return append_features(table, [f"quanTransform{n}" for n in table.names], compute)


@dataclass(frozen=True)
class NominalExpansion:
    """Products of distinct features up to degree 3 (10 features or fewer) or 2, and the constant 1."""

    clean: PreClean

    @classmethod
    def fit(cls, ds: Dataset) -> NominalExpansion:
        return cls(PreClean.fit(ds))

    def transform(self, ds: Dataset) -> Dataset:
        table = self.clean.transform(ds).as_plain()
        base = table.values()
        degree = 3 if len(base) <= MANY_COLUMNS else 2
        columns = {"1": F.lit(1.0)}
        for size in range(1, degree + 1):
            for names in combinations(base, size):
                columns[" ".join(names)] = reduce(lambda a, b: a * b, [base[n] for n in names])
        return table.derived(columns)


def block_plan(columns: int, blocks: int = 4) -> list[tuple[int, int]]:
    """Column ranges: each block, each pair and each triple of neighbouring blocks."""
    width = 1 if columns < blocks else columns // blocks
    starts = list(range(0, columns, width))
    plan = []
    for span in (1, 2, 3):
        ends = [*starts[span:], columns]
        plan += [(i, j) for i, j in zip(starts, ends) if i < j and len(starts) >= span]
    return plan


@dataclass(frozen=True)
class SpatialAggregate:
    """k-means labels over column blocks and over the whole table."""

    parts: tuple[Clustering, ...]

    @classmethod
    def fit(cls, ds: Dataset, k: int = CLUSTERS, seed: int = 0) -> SpatialAggregate:
        names = ds.names
        plan = [(f"spatialAgg_step_{i}_{j}", names[i:j]) for i, j in dict.fromkeys(block_plan(len(names)))]
        plan.append(("spatialAgg_whole", names))
        return cls(tuple(Clustering.fit_many(ds, plan, k, seed)))

    def transform(self, ds: Dataset) -> Dataset:
        return labelled(ds, self.parts)
