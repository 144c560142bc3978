"""Unary feature operators: gate on the statistics, freeze parameters, name the child."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np

from featloom.functions.scalar import RBF, unary_op
from featloom.functions.summary import FeatureStats
from featloom.operators.expr import Expr, RandomCosine, Unary


def fit_unary(op: str, inputs: Sequence[Expr], stats: Mapping[str, FeatureStats], seed: int = 0) -> list[Expr]:
    """Children of ``op`` over the inputs whose statistics pass its gate."""
    if op == RBF:
        return random_cosines(inputs, seed=seed)
    spec = unary_op(op)
    return [
        Unary(op, expr, spec.fit(stats[expr.name]))
        for expr in inputs
        if stats[expr.name].rows > stats[expr.name].nulls and spec.gate(stats[expr.name])
    ]


def random_cosines(inputs: Sequence[Expr], gamma: float = 1.0, seed: int = 0) -> list[Expr]:
    """As many random Fourier features of the RBF kernel as there are inputs."""
    d = len(inputs)
    weights, bias = fourier_weights(d, d, gamma, seed)
    scale = float(np.sqrt(2.0 / d)) if d else 0.0
    return [
        RandomCosine(expr.name, tuple(inputs), tuple(float(w) for w in weights[:, j]), float(bias[j]), scale)
        for j, expr in enumerate(inputs)
    ]


def fourier_weights(inputs: int, outputs: int, gamma: float = 1.0, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Projection and phase of ``outputs`` random Fourier features of exp(-gamma |x-y|^2)."""
    rng = np.random.default_rng(seed)
    return rng.normal(0.0, np.sqrt(2.0 * gamma), (inputs, outputs)), rng.uniform(0.0, 2.0 * np.pi, outputs)
