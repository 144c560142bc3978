"""Cleaning rules on the feature columns, all decided from one summary pass."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featloom.dataset import Dataset, quoted
from featloom.functions.summary import NEAR_ZERO_SHARE, FeatureStats
from featloom.operators.moments import stats_of

# Fixed values of the cleaning rules.
PRESENT_SHARE = 0.5
ZERO_SHARE = 0.8


@dataclass(frozen=True)
class CleanRules:
    """``older`` judges columns by nearly-zero values (above .8 drops) instead of exact zeros."""

    present_share: float = PRESENT_SHARE
    zero_share: float = ZERO_SHARE
    older: bool = False


def float_value(column: Column) -> Column:
    """Single-precision value; NaN and both infinities become NULL."""
    x = column.cast("float").cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def as_floats(ds: Dataset) -> Dataset:
    """All features as single-precision values without infinities."""
    others = [quoted(c) for c in ds.df.columns if c not in set(ds.columns)]
    return ds.with_df(ds.df.select(*others, *[float_value(quoted(c)).alias(c) for c in ds.columns]))


def mostly_null(stats: FeatureStats, rules: CleanRules = CleanRules()) -> bool:
    return stats.rows - stats.nulls < rules.present_share * stats.rows


def constant(stats: FeatureStats) -> bool:
    return stats.nulls in (0, stats.rows) and not stats.lo < stats.hi


def mostly_zero(stats: FeatureStats, rules: CleanRules = CleanRules()) -> bool:
    if rules.older:
        return stats.near_zeros > NEAR_ZERO_SHARE * stats.rows
    return stats.zeros >= rules.zero_share * stats.rows


def kept_features(stats: Mapping[str, FeatureStats], names, rules: CleanRules = CleanRules()) -> list[str]:
    return [
        n for n in names if not (mostly_null(stats[n], rules) or constant(stats[n]) or mostly_zero(stats[n], rules))
    ]


def fill_means(ds: Dataset, stats: Mapping[str, FeatureStats]) -> Dataset:
    """Missing values by the column mean, 0 where no value exists."""
    filled = {}
    for f in ds.features:
        s = stats[f.name]
        if s.nulls:
            mean = s.mean if s.nulls < s.rows else 0.0
            filled[f.column] = F.coalesce(quoted(f.column), F.lit(mean))
    return ds.with_df(ds.df.withColumns(filled)) if filled else ds


def clean(ds: Dataset, rules: CleanRules = CleanRules()) -> Dataset:
    """Floats, column rules, mean imputation, complete rows. The label is never judged or filled."""
    table = as_floats(ds)
    stats = stats_of(table)
    kept = fill_means(table.keep(kept_features(stats, table.names, rules)), stats)
    needed = [*kept.columns, *([kept.label] if kept.label else [])]
    complete = kept.df.select(*[quoted(c) for c in dict.fromkeys([*kept.roles(), *kept.columns])])
    condition = F.lit(True)
    for c in needed:
        if c == kept.label or c not in set(kept.columns):
            condition = condition & quoted(c).isNotNull()
    return replace(kept, df=complete.filter(condition))


def quality_report(ds: Dataset) -> DataFrame:
    """One row: rows, columns, cells that are +infinity, cells that are missing."""
    infinite = sum((F.count_if(quoted(c).cast("double") == float("inf")) for c in ds.columns), F.lit(0))
    x = [quoted(c).cast("double") for c in ds.columns]
    missing = sum((F.count_if(v.isNull() | F.isnan(v)) for v in x), F.lit(0))
    return ds.df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(ds.columns)).cast("long").alias("n_columns"),
        infinite.cast("long").alias("n_inf"),
        missing.cast("long").alias("n_missing"),
    )
