"""Operators across the columns of each row. Every result is a projection of the same table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from featloom.dataset import Dataset
from featloom.functions import rowwise as R

WINDOW = 5

# Shares of the percentile aggregates.
PERCENTILES = {"p25": 0.25, "p50": 0.50, "p75": 0.75}

# Aggregates of the row in chain order, with the suffix of their names.
ROW_AGGREGATES = {"p25": "_25%", "p50": "_50%", "p75": "_75%", "std": "_std", "max": "_max", "min": "_min"}


def _aggregate(name: str, inputs: Sequence[Column]) -> Column:
    if name in PERCENTILES:
        return R.row_percentile(inputs, PERCENTILES[name], F.col("__sorted"))
    if name == "std":
        return R.row_std(inputs, mean=F.col("__mean"))
    return R.row_max(inputs) if name == "max" else R.row_min(inputs)


def row_aggregate(ds: Dataset, name: str) -> Dataset:
    """Append one aggregate over all features of the row."""
    return time_aggregate(ds, [name])


def time_aggregate(ds: Dataset, names: Sequence[str] = tuple(ROW_AGGREGATES), chained: bool = False) -> Dataset:
    """Append row aggregates. ``chained`` lets each see the ones before it as further inputs."""
    if chained:
        for name in names:
            ds = time_aggregate(ds, [name])
        return ds
    ds = ds.as_plain()
    base = ds.values()
    inputs = list(base.values())
    # Sorted row and mean are columns of their own below the projection that repeats them.
    shared = {}
    if "std" in names:
        shared["__mean"] = R.row_mean(inputs)
    if any(n in PERCENTILES for n in names):
        shared["__sorted"] = R.ordered_row(inputs)
    table = replace(ds, df=ds.df.withColumns(shared)) if shared else ds
    added = {"-".join(base) + ROW_AGGREGATES[n]: _aggregate(n, inputs) for n in names}
    return table.derived({**base, **added})


def column_differences(ds: Dataset) -> Dataset:
    """Append ``diff_<c>``: each column minus the one before it; the first is missing."""
    ds = ds.as_plain()
    base = ds.values()
    names = list(base)
    added = {f"diff_{names[0]}": F.lit(None).cast("double")}
    for before, name in zip(names, names[1:]):
        added[f"diff_{name}"] = base[name] - base[before]
    return ds.derived({**base, **added})


def rolling_columns(ds: Dataset, window: int = WINDOW) -> Dataset:
    """Append sample std, max, min and mean over each column and the ``window - 1`` before it."""
    ds = ds.as_plain()
    base = ds.values()
    names = list(base)
    full = range(window - 1, len(names))
    inputs = {i: [base[n] for n in names[i + 1 - window:i + 1]] for i in full}
    means = {f"__mean{i}": F.when(R.complete(inputs[i]), R.row_mean(inputs[i])) for i in full}
    table = replace(ds, df=ds.df.withColumns(means)) if means else ds
    added: dict[str, Column] = {}
    for aggregate in ("std", "max", "min", "mean"):
        for i, name in enumerate(names):
            value = F.lit(None).cast("double")
            if i in inputs:
                mean = F.col(f"__mean{i}")
                value = {
                    "std": lambda c, m: F.when(m.isNotNull(), R.row_std(c, sample=True, mean=m)),
                    "max": lambda c, m: F.when(m.isNotNull(), R.row_max(c)),
                    "min": lambda c, m: F.when(m.isNotNull(), R.row_min(c)),
                    "mean": lambda c, m: m,
                }[aggregate](inputs[i], mean)
            added[f"tempWinAgg_{aggregate}_{name}"] = value
    return table.derived({**base, **added})
