"""Candidate generation: operators applied to fitted statistics, invalid children removed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from featloom.dataset import Dataset
from featloom.functions.scalar import BINARY, RBF, unary_op
from featloom.functions.summary import FeatureStats
from featloom.operators.binary import fit_binary
from featloom.operators.expr import Expr, to_column
from featloom.operators.moments import base_exprs, collect_stats, moments_frame
from featloom.operators.unary import fit_unary


def fit_operator(
    op: str,
    current: Sequence[Expr],
    stats: Mapping[str, FeatureStats],
    previous: Sequence[Expr] = (),
    seed: int = 0,
) -> list[Expr]:
    """Unchecked children of one registered operator."""
    if op in BINARY:
        return fit_binary(op, current, stats, previous)
    return fit_unary(op, current, stats, seed=seed)


def is_checked(op: str) -> bool:
    """Operators whose children must pass the validity rule."""
    return op in BINARY or (op != RBF and unary_op(op).checked)


def children(
    ds: Dataset, op: str, previous: Sequence[str] = (), seed: int = 0
) -> tuple[list[Expr], dict[str, FeatureStats]]:
    """Valid children of ``op`` over the dataset's features, with their statistics."""
    exprs = base_exprs(ds)
    stats = collect_stats(moments_frame(ds, exprs))
    history = [e for e in exprs if e.name in set(previous)]
    current = [e for e in exprs if e.name not in set(previous)]
    made = fit_operator(op, current, stats, history, seed)
    if not made:
        return [], {}
    child_stats = collect_stats(moments_frame(ds, made))
    if is_checked(op):
        made = [e for e in made if child_stats[e.name].valid]
    return made, {e.name: child_stats[e.name] for e in made}


def append(ds: Dataset, exprs: Sequence[Expr], keep_base: bool = True) -> Dataset:
    """Dataset with the derived features as columns; a projection, no join."""
    values = ds.values()
    columns = dict(values) if keep_base else {}
    columns.update({e.name: to_column(e, values) for e in exprs})
    return ds.derived(columns)
