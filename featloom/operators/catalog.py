"""The catalog of candidate features: judged in blocks, kept as a table.

Candidates are never listed one by one. Parent columns are cut into blocks, and a block of candidates
is an operator with one block of columns (unary) or two (binary). Blocks are summarised in passes of
bounded size, each of which reads only the columns its blocks derive from; a task holds the sums of one
pass. A finished block gives a row per usable candidate, with its statistics and its univariate score,
and these rows are a stored table. The best of every operator are chosen there, so that the driver sees
the survivors only.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featloom.dataset import REGRESSION, Dataset, quoted
from featloom.functions.scalar import BINARY, RBF, RBF_SUFFIX, unary_op
from featloom.functions.summary import FLOAT32_MAX, NEAR_ZERO_SHARE, FeatureStats
from featloom.operators.cleaning import PRESENT_SHARE, ZERO_SHARE
from featloom.operators.expr import Binary, Expr, RandomCosine, Ref, Unary
from featloom.operators.moments import AT, FIELDS, add_sums, base_exprs, block_sums, collect_stats, moments_frame, unpacked
from featloom.operators.unary import fourier_weights
from featloom.session import materialise, run_parallel

# Columns on a side of a block at most, and bytes of sums that a task holds in a pass.
SIDE = 64
PASS_BYTES = 64 << 20
SUM_BYTES = 8 * len(FIELDS)
# Jobs at a time.
WIDTH = 3
CANDIDATES = (
    "operator string, part int, first int, second int, feature string, "
    "rows bigint, nulls bigint, zeros bigint, near_zeros bigint, mean double, m2 double, lo double, hi double, score double"
)
_COLUMNS = [field.split()[0] for field in CANDIDATES.split(", ")]


@dataclass(frozen=True)
class UnaryBlock:
    """``op`` on some columns, with the parameters each was given; ``first`` are their places."""

    operator: str
    inputs: tuple[str, ...]
    params: tuple[tuple, ...]
    first: tuple[int, ...]

    @property
    def size(self) -> int:
        return len(self.inputs)

    def refs(self) -> set[str]:
        return set(self.inputs)

    def parts(self, values: Mapping[str, np.ndarray]) -> Iterator[tuple[slice, np.ndarray]]:
        op = unary_op(self.operator)
        yield slice(0, self.size), np.stack([op.array(values[n], p) for n, p in zip(self.inputs, self.params)])

    def rows(self) -> Iterator[tuple[int, int, int, str]]:
        suffix = unary_op(self.operator).suffix
        for name, place in zip(self.inputs, self.first):
            yield 0, place, 0, f"{name}_{suffix}"


@lru_cache(maxsize=2)
def _square_weights(d: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    return fourier_weights(d, d, seed=seed)


@dataclass(frozen=True)
class CosineBlock:
    """Random Fourier features first..last-1 of all inputs: one matrix product a batch."""

    inputs: tuple[str, ...]
    seed: int
    begin: int
    end: int
    operator: str = RBF

    @property
    def size(self) -> int:
        return self.end - self.begin

    def refs(self) -> set[str]:
        return set(self.inputs)

    def parts(self, values: Mapping[str, np.ndarray]) -> Iterator[tuple[slice, np.ndarray]]:
        d = len(self.inputs)
        weights, bias = _square_weights(d, self.seed)
        total = np.repeat(bias[self.begin : self.end, None], len(values[self.inputs[0]]), axis=1)
        for i, name in enumerate(self.inputs):
            total += values[name] * weights[i, self.begin : self.end, None]
        yield slice(0, self.size), np.sqrt(2.0 / d) * np.cos(total)

    def rows(self) -> Iterator[tuple[int, int, int, str]]:
        for j in range(self.begin, self.end):
            yield 0, j, 0, f"{self.inputs[j]}_{RBF_SUFFIX}"


@dataclass(frozen=True)
class PairBlock:
    """``op`` on all pairs of two blocks of columns; ``part`` 0 is inside the current generation, 1 with the earlier one.

    Inside the generation a pair has its columns in order (``with_self`` adds a column with itself).
    """

    operator: str
    lefts: tuple[str, ...]
    rights: tuple[str, ...]
    first: int
    second: tuple[int, ...]
    part: int
    with_self: bool = False

    def begins(self, i: int) -> int:
        """The first right column that the i-th left one meets."""
        if self.part:
            return 0
        least = self.first + i + (not self.with_self)
        return next((k for k, place in enumerate(self.second) if place >= least), len(self.second))

    @property
    def size(self) -> int:
        return sum(len(self.rights) - self.begins(i) for i in range(len(self.lefts)))

    def refs(self) -> set[str]:
        return {*self.lefts, *self.rights}

    def parts(self, values: Mapping[str, np.ndarray]) -> Iterator[tuple[slice, np.ndarray]]:
        right = np.stack([values[n] for n in self.rights])
        op, at = BINARY[self.operator].array, 0
        for i, name in enumerate(self.lefts):
            own = right[self.begins(i) :]
            if len(own):
                yield slice(at, at + len(own)), op(np.broadcast_to(values[name], own.shape), own)
                at += len(own)

    def rows(self) -> Iterator[tuple[int, int, int, str]]:
        symbol = BINARY[self.operator].symbol
        for i, left in enumerate(self.lefts):
            for k in range(self.begins(i), len(self.rights)):
                yield self.part, self.first + i, self.second[k], f"({left}{symbol}{self.rights[k]})"


Block = UnaryBlock | CosineBlock | PairBlock


@dataclass(frozen=True)
class OperatorSet:
    """How candidates are formed.

    The older library pairs columns with themselves too, keeps right operands without a non-zero value,
    and gates logarithm, reciprocal and sigmoid by other conditions: ``unary`` names the variants.
    """

    with_self: bool = False
    skip_zero: bool = True
    unary: Mapping[str, str] | None = None

    def unary_name(self, op: str) -> str:
        return (self.unary or {}).get(op, op)


DEFAULT_SET = OperatorSet()
OLDER_SET = OperatorSet(True, False, {"ln": "ln_positive", "reciprocal": "reciprocal_each", "sigmoid": "sigmoid_any"})


def side_of(classes: int) -> int:
    """Columns on a side of a block, so that the sums of all its classes fit a pass."""
    return max(1, min(SIDE, math.isqrt(PASS_BYTES // (SUM_BYTES * max(1, classes)))))


def cut(items: Sequence, size: int) -> Iterator[tuple[int, Sequence]]:
    for i in range(0, len(items), size):
        yield i, items[i : i + size]


def blocks_of(
    operators: Sequence[str],
    current: Sequence[str],
    previous: Sequence[str],
    stats: Mapping[str, FeatureStats],
    seed: int = 0,
    rules: OperatorSet = DEFAULT_SET,
    side: int = SIDE,
) -> Iterator[Block]:
    """The blocks of all candidates of the operators; a few names each, their count grows with (columns / side)^2."""
    for op in operators:
        if op == RBF:
            yield from (CosineBlock(tuple(current), seed, i, i + len(own)) for i, own in cut(current, side))
        elif op in BINARY:
            sides = [(0, list(enumerate(current))), (1, list(enumerate(previous)))]
            for part, rights in sides:
                fit = [(k, n) for k, n in rights if _fits_right(op, stats[n], rules)]
                for i, lefts in cut(current, side):
                    for _, own in cut(fit, side):
                        block = PairBlock(op, tuple(lefts), tuple(n for _, n in own), i, tuple(k for k, _ in own), part, rules.with_self)
                        if block.size:
                            yield block
        else:
            spec = unary_op(rules.unary_name(op))
            open_ = [(i, n) for i, n in enumerate(current) if stats[n].rows > stats[n].nulls and spec.gate(stats[n])]
            for _, own in cut(open_, side):
                yield UnaryBlock(spec.name, tuple(n for _, n in own), tuple(spec.fit(stats[n]) for _, n in own), tuple(i for i, _ in own))


def _fits_right(op: str, right: FeatureStats, rules: OperatorSet) -> bool:
    """A divisor that holds a zero can only give an invalid quotient."""
    return not (rules.skip_zero and right.all_zero) and not (op == "div" and right.zeros > 0)


def is_checked(operator: str) -> bool:
    """Operators whose children must pass the validity rule."""
    return operator in BINARY or (operator != RBF and unary_op(operator).checked)


def passes(blocks: Iterable[Block], classes: int) -> Iterator[list[Block]]:
    """Blocks in parts whose sums fit a task."""
    part, held = [], 0
    for block in blocks:
        cost = SUM_BYTES * block.size * max(1, classes)
        if part and held + cost > PASS_BYTES:
            yield part
            part, held = [], 0
        part.append(block)
        held += cost
    if part:
        yield part


def judged(classes: Sequence[np.ndarray], labelled: Sequence[np.ndarray], task: str, checked: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which candidates of a block are usable, their scores, and their sums over all classes, from the sums per class.

    A usable candidate has a finite value in every row, more than one value, and is not mostly zero; a
    checked one is valid as well.
    """
    whole = reduce(add_sums, classes)
    rows, nulls, lo, hi = (whole[AT[k]] for k in ("rows", "nulls", "lo", "hi"))
    usable = (nulls == 0) & np.isfinite(lo) & np.isfinite(hi) & (lo < hi) & (rows - nulls >= PRESENT_SHARE * rows) & (whole[AT["zeros"]] < ZERO_SHARE * rows)
    if checked:
        usable &= (hi <= FLOAT32_MAX) & (lo >= -FLOAT32_MAX) & (whole[AT["near_zeros"]] <= NEAR_ZERO_SHARE * rows)
    if task == REGRESSION:
        n, squares = whole[AT["pairs"]], whole[AT["xm2"]] * whole[AT["ym2"]]
        squared = np.divide(whole[AT["cxy"]] ** 2, squares, out=np.full_like(n, np.nan), where=squares > 0)
        score = np.where(squared < 1, squared / np.where(squared < 1, 1 - squared, 1.0) * (n - 2), np.inf)
        return usable, np.where((squares > 0) & (n > 2), score, np.nan), whole
    if not labelled:
        return usable, np.full(len(rows), np.nan), whole
    n = np.stack([c[AT["n"]] for c in labelled])
    mean, m2 = (np.stack([c[AT[k]] for c in labelled]) for k in ("mean", "m2"))
    total = n.sum(axis=0)
    kinds = (n > 0).sum(axis=0)
    grand = (n * mean).sum(axis=0) / np.maximum(total, 1)
    between, within = (n * (mean - grand) ** 2).sum(axis=0), m2.sum(axis=0)
    defined = (kinds > 1) & (total > kinds)
    with np.errstate(all="ignore"):
        ratio = (between / (kinds - 1)) / (within / (total - kinds))
    return usable, np.where(defined & (within > 0), ratio, np.where(defined & (between > 0), np.inf, np.nan)), whole


def candidates(
    ds: Dataset, operators: Sequence[str], previous: Sequence[str] = (), seed: int = 0, rules: OperatorSet = DEFAULT_SET
) -> DataFrame:
    """The stored table of usable candidates: operator, part, first, second, feature, statistics and score.

    ``part``, ``first`` and ``second`` are the candidate's place among those of its operator: pairs inside
    the current generation, then pairs with the earlier one, in column order.
    """
    stats = collect_stats(moments_frame(ds, base_exprs(ds)))
    old = set(previous)
    current, history = [n for n in ds.names if n not in old], [n for n in ds.names if n in old]
    classes = 1
    if ds.label is not None and ds.task != REGRESSION:
        classes = ds.df.agg(F.count_distinct(quoted(ds.label))).first()[0] + 1
    parts = list(passes(blocks_of(operators, current, history, stats, seed, rules, side_of(classes)), classes))
    if not parts:
        return ds.spark.createDataFrame([], CANDIDATES)
    found = run_parallel(ds.spark, [lambda p=p: materialise(_pass(ds, p), "candidates") for p in parts], WIDTH)
    return reduce(DataFrame.unionByName, found)


def _pass(ds: Dataset, blocks: list[Block]) -> DataFrame:
    task, labelled = ds.task, ds.label is not None

    def finish(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block = blocks[key[0].as_py()]
        sums = [(cls, unpacked(raw)) for cls, raw in zip(table["cls"].to_pylist(), table["payload"].to_pylist())]
        usable, score, whole = judged([s for _, s in sums], [s for c, s in sums if c is not None] if labelled else [], task, is_checked(block.operator))
        kept = np.flatnonzero(usable)
        places = list(block.rows())
        part, first, second, names = zip(*(places[i] for i in kept)) if len(kept) else ((), (), (), ())
        numbers = [whole[AT[k]][kept] for k in ("rows", "nulls", "zeros", "near_zeros", "mean", "m2", "lo", "hi")]
        columns = [
            pa.array([block.operator] * len(kept), pa.string()),
            *[pa.array(c, pa.int32()) for c in (part, first, second)],
            pa.array(names, pa.string()),
            *[pa.array(c.astype(np.int64)) for c in numbers[:4]],
            *[pa.array(c) for c in numbers[4:]],
            pa.array(score[kept], pa.float64(), from_pandas=True),
        ]
        return pa.Table.from_arrays(columns, names=_COLUMNS)

    sums = block_sums(ds, blocks, by_label=labelled and task != REGRESSION)
    return sums.groupBy("block").applyInArrow(finish, CANDIDATES)


def best_candidates(found: DataFrame, known: Sequence[str], limit: int | None) -> DataFrame:
    """Candidates with new names; of every operator the ``limit`` best by score, undefined scores last."""
    taken = found.sparkSession.createDataFrame([(n,) for n in known], "feature string")
    new = found.join(taken, "feature", "left_anti")
    if limit is None:
        return new
    order = Window.partitionBy("operator").orderBy(F.desc_nulls_last("score"), "part", "first", "second")
    return new.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).drop("place")


def surviving(
    ds: Dataset, operators: Sequence[str], previous: Sequence[str] = (), seed: int = 0, limit: int | None = None, rules: OperatorSet = DEFAULT_SET
) -> tuple[dict[str, list[Expr]], dict[str, FeatureStats]]:
    """Expressions and statistics of the survivors per operator, in the operators' order.

    No more than ``limit`` an operator reach the driver. A name that two operators give stays with the first.
    """
    rows = best_candidates(candidates(ds, operators, previous, seed, rules), ds.names, limit).collect()
    stats = collect_stats(moments_frame(ds, base_exprs(ds)))
    old = set(previous)
    current, history = [n for n in ds.names if n not in old], [n for n in ds.names if n in old]
    by_operator: dict[str, list] = {}
    for row in rows:
        by_operator.setdefault(row["operator"], []).append(row)
    tribes: dict[str, list[Expr]] = {}
    found: dict[str, FeatureStats] = {}
    cosines = _cosines(current, seed) if RBF in by_operator else None
    for op in operators:
        own = sorted(by_operator.get(rules.unary_name(op), ()), key=lambda r: (r["part"], r["first"], r["second"]))
        for row in own:
            if row["feature"] in found:
                continue
            if op == RBF:
                expr = cosines(row["first"])
            elif op in BINARY:
                expr = Binary(op, Ref(current[row["first"]]), Ref((history if row["part"] else current)[row["second"]]))
            else:
                name, spec = current[row["first"]], unary_op(rules.unary_name(op))
                expr = Unary(spec.name, Ref(name), spec.fit(stats[name]))
            found[row["feature"]] = FeatureStats(**{k: row[k] for k in ("rows", "nulls", "zeros", "near_zeros", "mean", "m2", "lo", "hi")})
            tribes.setdefault(op, []).append(expr)
    return tribes, found


def _cosines(current: Sequence[str], seed: int):
    d = len(current)
    weights, bias = fourier_weights(d, d, seed=seed)
    inputs, scale = tuple(Ref(n) for n in current), math.sqrt(2.0 / d)
    return lambda j: RandomCosine(current[j], inputs, tuple(float(w) for w in weights[:, j]), float(bias[j]), scale)
