"""One pass of sufficient statistics over any number of features.

The result has one row per (feature, class). It serves the operator gates, the validity
rule, the cleaning rules, the scalers and the univariate scores, so a table is scanned once
for all of them.

Few features are aggregated by Catalyst. Many features (candidates of a generation) are
evaluated per Arrow batch from the columns they derive from, a block at a time; every task emits
one packed row per block and class, so what is shuffled depends on the number of features and tasks
only, and a class that holds most of the rows costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featloom.dataset import REGRESSION, Dataset, as_double, quoted
from featloom.functions.summary import NEAR_ZERO, FeatureStats
from featloom.operators.expr import Expr, Ref, refs, to_array, to_column
from featloom.operators.gram import merged_tree, task_slot

# Above this number of features the per-batch form is used.
NARROW_LIMIT = 6
# Features of a block that is made of expressions.
BLOCK = 64

PACKED = "block int, cls double, slot int, payload binary"
# Rows of a block's matrix of sums; a column per feature.
FIELDS = ("rows", "nulls", "zeros", "near_zeros", "n", "mean", "m2", "lo", "hi", "pairs", "xmean", "ymean", "xm2", "ym2", "cxy")
AT = {name: i for i, name in enumerate(FIELDS)}


@dataclass(frozen=True)
class ExprBlock:
    """Features that are evaluated together."""

    exprs: tuple[Expr, ...]

    @property
    def size(self) -> int:
        return len(self.exprs)

    def refs(self) -> set[str]:
        return set().union(*(refs(e) for e in self.exprs))

    def parts(self, values: Mapping[str, np.ndarray]) -> Iterator[tuple[slice, np.ndarray]]:
        """(features, their values as rows) for the rows of a batch."""
        yield slice(0, self.size), np.stack([to_array(e, values) for e in self.exprs])


def base_exprs(ds: Dataset) -> list[Expr]:
    return [Ref(name) for name in ds.names]


def moments_frame(ds: Dataset, exprs: Sequence[Expr] | None = None, by_label: bool = False) -> DataFrame:
    """Columns feature, cls, rows, nulls, zeros, near_zeros, mean, m2, lo, hi, pairs, xm2, ym2, cxy.

    ``cls`` is the class code when ``by_label`` is set on a classification table, else NULL.
    ``pairs``, ``xm2``, ``ym2`` and ``cxy`` (count, squared deviations and co-moment over the rows
    where both the feature and the label are present) are filled for a regression table.
    """
    exprs = base_exprs(ds) if exprs is None else list(exprs)
    if not exprs:
        raise ValueError("no features to summarise")
    if len(exprs) <= NARROW_LIMIT:
        return _narrow(ds, exprs, by_label)
    return _wide(ds, exprs, by_label)


def _class_column(ds: Dataset, by_label: bool) -> Column:
    if by_label and ds.task != REGRESSION:
        return quoted(ds.label).cast("double")
    return F.lit(None).cast("double")


def _with_target(ds: Dataset) -> bool:
    return ds.task == REGRESSION and ds.label is not None


def _narrow(ds: Dataset, exprs: Sequence[Expr], by_label: bool) -> DataFrame:
    ds = ds.as_plain()
    values = ds.values()
    selected = [_class_column(ds, by_label).alias("cls")]
    if _with_target(ds):
        selected.append(as_double(quoted(ds.label)).alias("y"))
    selected += [F.nullif(to_column(e, values), F.lit(float("nan"))).alias(f"x{i}") for i, e in enumerate(exprs)]
    table = ds.df.select(*selected)
    summaries = []
    for i, expr in enumerate(exprs):
        x = F.col(f"x{i}")
        n = F.count(x)
        pairs, own, target, cross = F.lit(0).cast("long"), *[F.lit(None).cast("double")] * 3
        if _with_target(ds):
            y = F.when(x.isNotNull(), F.col("y"))
            pairs = F.count(y)
            own = F.var_pop(F.when(F.col("y").isNotNull(), x)) * pairs
            target = F.var_pop(y) * pairs
            cross = F.covar_pop(x, F.col("y")) * pairs
        summaries.append(
            F.struct(
                F.lit(expr.name).alias("feature"),
                F.count(F.lit(1)).alias("rows"),
                (F.count(F.lit(1)) - n).alias("nulls"),
                F.count_if(x == 0).alias("zeros"),
                F.count_if(F.abs(x) < NEAR_ZERO).alias("near_zeros"),
                F.avg(x).alias("mean"),
                (F.var_pop(x) * n).alias("m2"),
                F.min(x).alias("lo"),
                F.max(x).alias("hi"),
                pairs.alias("pairs"),
                own.alias("xm2"),
                target.alias("ym2"),
                cross.alias("cxy"),
            ).alias(f"s{i}")
        )
    grouped = table.groupBy("cls").agg(*summaries)
    stacked = grouped.select("cls", F.explode(F.array(*[F.col(f"s{i}") for i in range(len(exprs))])).alias("s"))
    return stacked.select("s.feature", "cls", *[f"s.{c}" for c in _MEASURES])


_MEASURES = ["rows", "nulls", "zeros", "near_zeros", "mean", "m2", "lo", "hi", "pairs", "xm2", "ym2", "cxy"]


def _wide(ds: Dataset, exprs: Sequence[Expr], by_label: bool) -> DataFrame:
    blocks = [ExprBlock(tuple(exprs[i : i + BLOCK])) for i in range(0, len(exprs), BLOCK)]
    names = {i: [e.name for e in b.exprs] for i, b in enumerate(blocks)}
    schema = "feature string, cls double, " + ", ".join(f"{m} {'bigint' if m in _COUNTS else 'double'}" for m in _MEASURES)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, cls, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
                sums = unpacked(payload)
                empty, unpaired = sums[AT["n"]] == 0, sums[AT["pairs"]] == 0
                gone = {m: empty for m in ("mean", "m2")} | {m: unpaired for m in ("xm2", "ym2", "cxy")}
                columns = [
                    pa.array(sums[AT[m]].astype(np.int64)) if m in _COUNTS else pa.array(sums[AT[m]], mask=gone.get(m), from_pandas=True)
                    for m in _MEASURES
                ]
                names_ = names[block]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names_, pa.string()), pa.array([cls] * len(names_), pa.float64()), *columns], names=["feature", "cls", *_MEASURES]
                )

    return block_sums(ds, blocks, by_label).mapInArrow(opened, schema)


_COUNTS = {"rows", "nulls", "zeros", "near_zeros", "pairs"}


def block_sums(ds: Dataset, blocks: Sequence, by_label: bool) -> DataFrame:
    """(block, cls, payload): the sums of every block and class over all rows; blocks by their place."""
    needed = sorted(set().union(*(b.refs() for b in blocks)))
    target = as_double(quoted(ds.label)) if _with_target(ds) else F.lit(None).cast("double")
    table = ds.df.select(
        _class_column(ds, by_label).alias("cls"),
        target.alias("y"),
        *[ds.value(name).alias(f"b{i}") for i, name in enumerate(needed)],
    )
    return merged_tree(table.mapInArrow(_batch_sums(list(blocks), needed), PACKED), ["block", "cls"], merged)


def unpacked(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload).reshape(len(FIELDS), -1)


def merged(left: bytes, right: bytes) -> bytes:
    return add_sums(unpacked(left), unpacked(right)).tobytes()


def add_sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of two sets of rows put together around their common mean, so nothing cancels however large the values are."""
    out = a + b
    for name, choose in (("lo", np.fmin), ("hi", np.fmax)):
        out[AT[name]] = choose(a[AT[name]], b[AT[name]])
    for count, means, squares in (("n", ("mean",), (("m2", 0, 0),)), ("pairs", ("xmean", "ymean"), (("xm2", 0, 0), ("ym2", 1, 1), ("cxy", 0, 1)))):
        total = out[AT[count]]
        share = np.divide(b[AT[count]], total, out=np.zeros_like(total), where=total > 0)
        # A side without rows has nothing to say about the mean.
        both = (a[AT[count]] > 0) & (b[AT[count]] > 0)
        away = [np.where(both, b[AT[m]] - a[AT[m]], 0.0) for m in means]
        for m, d in zip(means, away):
            out[AT[m]] = np.where(a[AT[count]] > 0, a[AT[m]] + d * share, b[AT[m]])
        for m, i, j in squares:
            out[AT[m]] += away[i] * away[j] * a[AT[count]] * share
    return out


def _group_means(values: np.ndarray, present: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.add.reduceat(present, starts, axis=1, dtype=np.int64).astype(float)
    total = np.add.reduceat(np.where(present, values, 0.0), starts, axis=1)
    return n, np.divide(total, n, out=np.zeros_like(total), where=n > 0)


def _sums_of(x: np.ndarray, y: np.ndarray | None, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(field, feature, class) sums of feature rows whose values are in class order."""
    missing = np.isnan(x)
    some = bool(missing.any())
    present = ~missing
    found = np.zeros((len(FIELDS), len(x), len(starts)))
    n, mean = _group_means(x, present, starts) if some else (np.broadcast_to(sizes.astype(float), (len(x), len(sizes))), np.add.reduceat(x, starts, axis=1) / sizes)
    away = x - np.repeat(mean, sizes, axis=1)
    if some:
        away[missing] = 0.0
        found[AT["nulls"]] = sizes - n
    found[AT["rows"]], found[AT["n"]], found[AT["mean"]] = sizes, n, mean
    found[AT["m2"]] = np.add.reduceat(away * away, starts, axis=1)
    near = np.abs(x) < NEAR_ZERO
    if near.any():
        found[AT["zeros"]] = np.add.reduceat(x == 0, starts, axis=1, dtype=np.int64)
        found[AT["near_zeros"]] = np.add.reduceat(near, starts, axis=1, dtype=np.int64)
    found[AT["lo"]], found[AT["hi"]] = np.fmin.reduceat(x, starts, axis=1), np.fmax.reduceat(x, starts, axis=1)
    if y is not None:
        both = present & ~np.isnan(y)
        pairs, xmean = _group_means(x, both, starts)
        _, ymean = _group_means(np.broadcast_to(y, x.shape), both, starts)
        dx = np.where(both, x - np.repeat(xmean, sizes, axis=1), 0.0)
        dy = np.where(both, y - np.repeat(ymean, sizes, axis=1), 0.0)
        for name, part in (("pairs", pairs), ("xmean", xmean), ("ymean", ymean)):
            found[AT[name]] = part
        for name, part in (("xm2", dx * dx), ("ym2", dy * dy), ("cxy", dx * dy)):
            found[AT[name]] = np.add.reduceat(part, starts, axis=1)
    return found


def _empty_sums(size: int) -> np.ndarray:
    found = np.zeros((len(FIELDS), size))
    found[[AT["lo"], AT["hi"]]] = np.nan
    return found


def _batch_sums(blocks: list, needed: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            cls = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
            # Without classes, or with one in the batch, rows stay as they are.
            order = slice(None) if np.isnan(cls).all() or (cls == cls[0]).all() else np.argsort(cls, kind="stable")
            cls = cls[order]
            change = np.flatnonzero(cls[1:] != cls[:-1]) + 1
            if np.isnan(cls).any():
                change = change[~np.isnan(cls[change - 1])]
            starts = np.concatenate([[0], change])
            sizes = np.diff(np.concatenate([starts, [len(cls)]]))
            keys = [None if np.isnan(c) else float(c) for c in cls[starts]]
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(float)[order]
            y = None if np.isnan(y).all() else y
            values = {
                name: batch.column(i + 2).to_numpy(zero_copy_only=False).astype(float)[order]
                for i, name in enumerate(needed)
            }
            with np.errstate(all="ignore"):
                for number, block in enumerate(blocks):
                    for at, x in block.parts(values):
                        found = _sums_of(x, y, starts, sizes)
                        for g, key in enumerate(keys):
                            own = sums.setdefault((number, key), _empty_sums(block.size))
                            own[:, at] = add_sums(own[:, at], found[:, :, g])
        slot = task_slot()
        for (number, key), own in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int32()), pa.array([key], pa.float64()), pa.array([slot], pa.int32()), pa.array([own.tobytes()], pa.binary())],
                names=["block", "cls", "slot", "payload"],
            )

    return run


def collect_stats(frame: DataFrame) -> dict[str, FeatureStats]:
    """Statistics per feature over all classes; one row per feature and class reaches the driver."""
    merged: dict[str, FeatureStats] = {}
    for row in frame.collect():
        part = FeatureStats(
            rows=row["rows"],
            nulls=row["nulls"],
            zeros=row["zeros"],
            near_zeros=row["near_zeros"],
            mean=_number(row["mean"]),
            m2=_number(row["m2"]),
            lo=_number(row["lo"]),
            hi=_number(row["hi"]),
        )
        known = merged.get(row["feature"])
        merged[row["feature"]] = part if known is None else _merge(known, part)
    return merged


def _number(value) -> float:
    return float("nan") if value is None else float(value)


def _merge(a: FeatureStats, b: FeatureStats) -> FeatureStats:
    na, nb = a.rows - a.nulls, b.rows - b.nulls
    if na == 0 or nb == 0:
        values = b if na == 0 else a
        mean, m2 = values.mean, values.m2
    else:
        delta = b.mean - a.mean
        mean = a.mean + delta * nb / (na + nb)
        m2 = a.m2 + b.m2 + delta * delta * na * nb / (na + nb)
    return FeatureStats(
        rows=a.rows + b.rows,
        nulls=a.nulls + b.nulls,
        zeros=a.zeros + b.zeros,
        near_zeros=a.near_zeros + b.near_zeros,
        mean=mean,
        m2=m2,
        lo=float(np.fmin(a.lo, b.lo)),
        hi=float(np.fmax(a.hi, b.hi)),
    )


def stats_of(ds: Dataset, exprs: Sequence[Expr] | None = None) -> dict[str, FeatureStats]:
    return collect_stats(moments_frame(ds, exprs))
