"""Feature expressions: a tree whose printed form is the feature's name."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from featloom.functions.scalar import BINARY, OPTIONAL_UNARY, RBF, RBF_SUFFIX, UNARY, unary_op


@dataclass(frozen=True)
class Ref:
    """A column of the table the expression is evaluated on."""

    name: str


@dataclass(frozen=True)
class Unary:
    """``op`` on ``child``; ``params`` are the statistics frozen when it was fitted."""

    op: str
    child: Expr
    params: tuple = ()

    @property
    def name(self) -> str:
        return f"{self.child.name}_{unary_op(self.op).suffix}"


@dataclass(frozen=True)
class Binary:
    op: str
    left: Expr
    right: Expr

    @property
    def name(self) -> str:
        return f"({self.left.name}{BINARY[self.op].symbol}{self.right.name})"


@dataclass(frozen=True)
class RandomCosine:
    """One random Fourier feature over several inputs, named after one of them."""

    named: str
    inputs: tuple[Expr, ...]
    weights: tuple[float, ...]
    bias: float
    scale: float

    @property
    def name(self) -> str:
        return f"{self.named}_{RBF_SUFFIX}"


Expr = Ref | Unary | Binary | RandomCosine


def refs(expr: Expr) -> set[str]:
    if isinstance(expr, Ref):
        return {expr.name}
    if isinstance(expr, Unary):
        return refs(expr.child)
    if isinstance(expr, Binary):
        return refs(expr.left) | refs(expr.right)
    return set().union(*(refs(e) for e in expr.inputs))


def operator_count(expr: Expr) -> int:
    """Number of operator applications on the longest path."""
    if isinstance(expr, Ref):
        return 0
    if isinstance(expr, Unary):
        return 1 + operator_count(expr.child)
    if isinstance(expr, Binary):
        return 1 + max(operator_count(expr.left), operator_count(expr.right))
    return 1 + max(operator_count(e) for e in expr.inputs)


def to_column(expr: Expr, values: Mapping[str, Column]) -> Column:
    if isinstance(expr, Ref):
        return values[expr.name]
    if isinstance(expr, Unary):
        return unary_op(expr.op).column(to_column(expr.child, values), expr.params)
    if isinstance(expr, Binary):
        return BINARY[expr.op].column(to_column(expr.left, values), to_column(expr.right, values))
    total = F.lit(expr.bias)
    for child, weight in zip(expr.inputs, expr.weights):
        total = total + to_column(child, values) * F.lit(weight)
    return F.lit(expr.scale) * F.cos(total)


def to_array(expr: Expr, values: Mapping[str, np.ndarray]) -> np.ndarray:
    if isinstance(expr, Ref):
        return values[expr.name]
    if isinstance(expr, Unary):
        return unary_op(expr.op).array(to_array(expr.child, values), expr.params)
    if isinstance(expr, Binary):
        return BINARY[expr.op].array(to_array(expr.left, values), to_array(expr.right, values))
    total = expr.bias
    for child, weight in zip(expr.inputs, expr.weights):
        total = total + to_array(child, values) * weight
    return expr.scale * np.cos(total)


def canonical_key(expr: Expr) -> str:
    """Equal for expressions that are equal by commutativity or a double sign change."""
    if isinstance(expr, Unary):
        if expr.op == "negative" and isinstance(expr.child, Unary) and expr.child.op == "negative":
            return canonical_key(expr.child.child)
        return f"{expr.op}[{canonical_key(expr.child)}]"
    if isinstance(expr, Binary):
        sides = [canonical_key(expr.left), canonical_key(expr.right)]
        if BINARY[expr.op].commutative:
            sides.sort()
        return f"{expr.op}[{sides[0]},{sides[1]}]"
    return expr.name


def distinct_exprs(exprs: Iterable[Expr]) -> list[Expr]:
    """First of every set of equal expressions, order kept."""
    seen: dict[str, Expr] = {}
    for expr in exprs:
        seen.setdefault(canonical_key(expr), expr)
    return list(seen.values())


def read_name(name: str, bases: Iterable[str]) -> Expr:
    """Expression tree of a printed name, given the base column names."""
    known = sorted(bases, key=len, reverse=True)
    suffixes = {op.suffix: op.name for op in [*OPTIONAL_UNARY.values(), *UNARY.values()]} | {RBF_SUFFIX: RBF}
    symbols = {op.symbol: op.name for op in BINARY.values()}

    def heads(at: int) -> Iterator[tuple[Expr, int]]:
        for base in known:
            if name.startswith(base, at):
                yield Ref(base), at + len(base)
        if name.startswith("(", at):
            for left, mid in readings(at + 1):
                if name[mid:mid + 1] in symbols:
                    for right, end in readings(mid + 1):
                        if name.startswith(")", end):
                            yield Binary(symbols[name[mid]], left, right), end + 1

    def readings(at: int) -> Iterator[tuple[Expr, int]]:
        for head, end in heads(at):
            yield from tails(head, end)

    def tails(head: Expr, at: int) -> Iterator[tuple[Expr, int]]:
        for suffix, op in suffixes.items():
            if name.startswith("_" + suffix, at):
                longer = RandomCosine(head.name, (head,), (), 0.0, 0.0) if op == RBF else Unary(op, head)
                yield from tails(longer, at + 1 + len(suffix))
        yield head, at

    for expr, end in readings(0):
        if end == len(name):
            return expr
    raise ValueError(f"not a feature name over the given columns: {name!r}")
