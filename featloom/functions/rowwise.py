"""Statistics across the columns of one row, as plain column arithmetic."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def complete(columns: Sequence[Column]) -> Column:
    """True when no value of the row is missing."""
    return reduce(lambda a, b: a & b, [c.isNotNull() for c in columns])


def ordered_row(columns: Sequence[Column]) -> Column:
    return F.sort_array(F.array(*columns))


def row_percentile(columns: Sequence[Column], share: float, ordered: Column | None = None) -> Column:
    """Linearly interpolated percentile; missing as soon as one value is missing.

    ``ordered`` is the sorted row when it already is a column.
    """
    at = share * (len(columns) - 1)
    below, part = math.floor(at), at - math.floor(at)
    ordered = ordered_row(columns) if ordered is None else ordered
    value = F.element_at(ordered, below + 1)
    if part:
        value = value + F.lit(part) * (F.element_at(ordered, below + 2) - value)
    return F.when(complete(columns), value)


def _present(columns: Sequence[Column]) -> Column:
    return _total([c.isNotNull().cast("int") for c in columns])


def row_mean(columns: Sequence[Column]) -> Column:
    n = _present(columns)
    return F.when(n > 0, _total([F.coalesce(c, F.lit(0.0)) for c in columns]) / n)


def row_std(columns: Sequence[Column], sample: bool = False, mean: Column | None = None) -> Column:
    """Standard deviation of the present values (population unless ``sample``).

    ``mean`` is the row mean when it already is a column; it occurs once per value here.
    """
    n, mean = _present(columns), row_mean(columns) if mean is None else mean
    squares = _total([F.coalesce((c - mean) * (c - mean), F.lit(0.0)) for c in columns])
    divisor = n - 1 if sample else n
    return F.when(divisor > 0, F.sqrt(squares / divisor))


def row_max(columns: Sequence[Column]) -> Column:
    return F.greatest(*columns) if len(columns) > 1 else columns[0]


def row_min(columns: Sequence[Column]) -> Column:
    return F.least(*columns) if len(columns) > 1 else columns[0]
