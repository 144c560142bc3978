"""The unary and binary feature operators: one Catalyst form and one numpy form each.

The Catalyst form materialises a chosen feature. The numpy form evaluates thousands of
candidates per Arrow batch from the few columns they derive from, so that candidates are
judged without ever becoming table columns. Both read NULL (NaN) as missing.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from featloom.functions.summary import FeatureStats

# Fixed values of the operator definitions.
EXP_BELOW = 1.0
LN_ABOVE = 1e-9
SIGMOID_ABOVE = -1.0


def _always(stats: FeatureStats) -> bool:
    return True


def _no_params(stats: FeatureStats) -> tuple:
    return ()


@dataclass(frozen=True)
class UnaryOp:
    name: str
    suffix: str
    column: Callable[[Column, tuple], Column]
    array: Callable[[np.ndarray, tuple], np.ndarray]
    gate: Callable[[FeatureStats], bool] = _always
    fit: Callable[[FeatureStats], tuple] = _no_params
    checked: bool = False


@dataclass(frozen=True)
class BinaryOp:
    name: str
    symbol: str
    column: Callable[[Column, Column], Column]
    array: Callable[[np.ndarray, np.ndarray], np.ndarray]
    commutative: bool = False


def _ln_array(x, _):
    positive = x > 0
    return np.where(positive, np.log(np.where(positive, x, 1.0)), np.nan)


def _sqrt_array(x, _):
    defined = x >= 0
    return np.where(defined, np.sqrt(np.where(defined, x, 0.0)), np.nan)


def _recip_column(x, params):
    return x if params[0] else F.when(x != 0, F.lit(1.0) / x)


def _recip_array(x, params):
    return x if params[0] else _divide(np.ones_like(x), x)


def _recip_each_column(x, _):
    return F.when(x != 0, F.lit(1.0) / x).otherwise(x)


def _recip_each_array(x, _):
    return np.where(x != 0, _divide(np.ones_like(x), x), x)


def _divide(a, b):
    usable = b != 0
    return np.where(usable, a / np.where(usable, b, 1.0), np.nan)


def _scaled_column(x, params):
    shift, width = params
    return (x - F.lit(shift)) / F.lit(width)


def _scaled_array(x, params):
    shift, width = params
    return (x - shift) / width


def _fit_minmax(stats):
    return (stats.lo, (stats.hi - stats.lo) or 1.0)


def _fit_zscore(stats):
    return (stats.mean, stats.std or 1.0)


_UNARY = [
    UnaryOp("abs", "abs", lambda x, p: F.abs(x), lambda x, p: np.abs(x), gate=lambda s: s.lo < 0),
    UnaryOp("adde", "adde", lambda x, p: x + F.lit(math.e), lambda x, p: x + math.e),
    UnaryOp("cos", "cos", lambda x, p: F.cos(x), lambda x, p: np.cos(x)),
    UnaryOp("degree", "degree", lambda x, p: F.degrees(x), lambda x, p: np.degrees(x)),
    UnaryOp("exp", "exp", lambda x, p: F.exp(x), lambda x, p: np.exp(x),
            gate=lambda s: s.nulls == 0 and s.hi < EXP_BELOW),
    UnaryOp("ln", "ln", lambda x, p: F.ln(x), _ln_array, gate=lambda s: s.nulls == 0 and s.lo > LN_ABOVE),
    UnaryOp("negative", "negative", lambda x, p: -x, lambda x, p: -x),
    UnaryOp("radian", "radian", lambda x, p: F.radians(x), lambda x, p: np.radians(x)),
    UnaryOp("reciprocal", "recip", _recip_column, _recip_array, fit=lambda s: (s.zeros > 0,)),
    UnaryOp("sin", "sin", lambda x, p: F.sin(x), lambda x, p: np.sin(x)),
    UnaryOp("sigmoid", "sigmoid", lambda x, p: F.lit(1.0) / (F.lit(1.0) + F.exp(-x)),
            lambda x, p: 1.0 / (1.0 + np.exp(-x)), gate=lambda s: s.nulls == 0 and s.lo > SIGMOID_ABOVE),
    UnaryOp("square", "square", lambda x, p: x * x, lambda x, p: x * x, checked=True),
    UnaryOp("tanh", "tanh", lambda x, p: F.tanh(x), lambda x, p: np.tanh(x)),
    UnaryOp("relu", "relu", lambda x, p: F.when(x <= 0, F.lit(0.0)).otherwise(x),
            lambda x, p: np.where(x <= 0, 0.0, x)),
    UnaryOp("mmnorm", "mmnorm", _scaled_column, _scaled_array, fit=_fit_minmax),
    UnaryOp("zscore", "zscore", _scaled_column, _scaled_array, fit=_fit_zscore),
]

RBF = "kernelapproxrbf"
RBF_SUFFIX = "rbfFeature"

# Off by default, or variants with the gates of the older operator set.
_OPTIONAL = [
    UnaryOp("sqrt", "sqrt", lambda x, p: F.when(x >= 0, F.sqrt(x)), _sqrt_array),
    UnaryOp("ln_positive", "ln", lambda x, p: F.ln(x), _ln_array, gate=lambda s: s.nulls == 0 and s.lo > 0),
    UnaryOp("reciprocal_each", "recip", _recip_each_column, _recip_each_array),
    UnaryOp("sigmoid_any", "sigmoid", lambda x, p: F.lit(1.0) / (F.lit(1.0) + F.exp(-x)),
            lambda x, p: 1.0 / (1.0 + np.exp(-x))),
]

UNARY: dict[str, UnaryOp] = {op.name: op for op in _UNARY}
OPTIONAL_UNARY: dict[str, UnaryOp] = {op.name: op for op in _OPTIONAL}

BINARY: dict[str, BinaryOp] = {
    op.name: op
    for op in [
        BinaryOp("div", "/", lambda a, b: F.when(b != 0, a / b), _divide),
        BinaryOp("minus", "-", lambda a, b: a - b, lambda a, b: a - b),
        BinaryOp("add", "+", lambda a, b: a + b, lambda a, b: a + b, commutative=True),
        BinaryOp("product", "*", lambda a, b: a * b, lambda a, b: a * b, commutative=True),
    ]
}

# Operator names in registry order: 17 unary, 4 binary.
OPERATOR_NAMES: list[str] = [*UNARY, RBF, *BINARY]


def unary_op(name: str) -> UnaryOp:
    return UNARY.get(name) or OPTIONAL_UNARY[name]
