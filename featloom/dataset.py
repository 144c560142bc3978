"""The labelled table every operator works on."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CLASSIFICATION = "C"
REGRESSION = "R"
SPREAD_ROWS = 50_000
NUMERIC = (T.DoubleType, T.FloatType, T.DecimalType, T.LongType, T.IntegerType, T.ShortType, T.ByteType)
# Read as the text they are written as.
TEXTUAL = (T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
_PLAIN = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")


def quoted(column: str) -> Column:
    """Column by exact name, whatever characters it holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def numeric_columns(df: DataFrame) -> list[str]:
    return [field.name for field in df.schema.fields if isinstance(field.dataType, NUMERIC)]


def string_columns(df: DataFrame) -> list[str]:
    return [field.name for field in df.schema.fields if isinstance(field.dataType, T.StringType)]


def readable(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Booleans, dates and times among ``columns`` as text; a type without a rule is an error, never left out."""
    wanted, texts = set(columns), {}
    for field in df.schema.fields:
        if field.name not in wanted or isinstance(field.dataType, (*NUMERIC, T.StringType)):
            continue
        if not isinstance(field.dataType, TEXTUAL):
            raise ValueError(f"column {field.name!r} has type {field.dataType.simpleString()}, which has no encoding")
        texts[field.name] = quoted(field.name).cast("string")
    return df.withColumns(texts) if texts else df


@dataclass(frozen=True)
class Feature:
    """A column together with the derivation it is known by."""

    name: str
    column: str


@dataclass(frozen=True)
class Dataset:
    """DataFrame with roles: features, label (by name, never by position), unique row id."""

    df: DataFrame
    features: tuple[Feature, ...]
    label: str | None = None
    task: str = CLASSIFICATION
    row_id: str | None = None
    plain: bool = False

    @classmethod
    def of(
        cls,
        df: DataFrame,
        features: Iterable[str] | None = None,
        label: str | None = None,
        task: str = CLASSIFICATION,
        row_id: str | None = None,
    ) -> Dataset:
        if task not in (CLASSIFICATION, REGRESSION):
            raise ValueError(f"task must be C or R, not {task!r}")
        names = [c for c in numeric_columns(df) if c not in (label, row_id)] if features is None else list(features)
        if label in names:
            raise ValueError(f"label {label!r} cannot be a feature")
        missing = [c for c in [*names, label, row_id] if c is not None and c not in df.columns]
        if missing:
            raise ValueError(f"no such columns: {missing}")
        return cls(df, tuple(Feature(c, c) for c in names), label, task, row_id)

    @property
    def spark(self):
        return self.df.sparkSession

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.features]

    @property
    def columns(self) -> list[str]:
        return [f.column for f in self.features]

    @property
    def by_name(self) -> dict[str, str]:
        return {f.name: f.column for f in self.features}

    def value(self, name: str) -> Column:
        """The feature as a double, NaN read as NULL."""
        column = quoted(self.by_name[name])
        return column if self.plain else as_double(column)

    def values(self) -> dict[str, Column]:
        return {f.name: self.value(f.name) for f in self.features}

    def as_plain(self) -> Dataset:
        """Features as doubles without NaN in a projection of their own.

        Expressions that use a feature many times then repeat a column, not its conversion.
        """
        if self.plain:
            return self
        return replace(self, df=self.df.withColumns({f.column: as_double(quoted(f.column)) for f in self.features}), plain=True)

    def spread(self) -> Dataset:
        """Deal the rows to tasks by their content alone, in an order that follows from it too.

        Seeded fits draw per partition. Here partitions and their order depend on the rows, not on
        files, cores or earlier plans, so a model is the same on every cluster.
        """
        parts = max(1, -(-self.df.count() // SPREAD_ROWS))
        keys = [self.row_id] if self.row_id else self.df.columns
        dealt = self.df.withColumn("__dealt", F.xxhash64(*[quoted(c) for c in keys]))
        order = ["__dealt", *([quoted(self.row_id)] if self.row_id else [])]
        return replace(self, df=dealt.repartition(parts, "__dealt").sortWithinPartitions(*order).drop("__dealt"))

    @contextmanager
    def dealt(self) -> Iterator[Dataset]:
        """The roles and features of :meth:`spread`, kept on the executors' disks while the block runs.

        A fit reads its rows in several jobs; these neither derive, shuffle nor order them again.
        """
        spread = self.spread()
        df = spread.df.select(*[quoted(c) for c in dict.fromkeys([*self.roles(), *self.columns])]).persist(StorageLevel.DISK_ONLY)
        try:
            yield replace(spread, df=df)
        finally:
            df.unpersist()

    def keep(self, names: Sequence[str]) -> Dataset:
        """Only these features, in the table's own order."""
        wanted = set(names)
        return replace(self, features=tuple(f for f in self.features if f.name in wanted))

    def roles(self) -> list[str]:
        return [c for c in (self.row_id, self.label) if c is not None]

    def with_df(self, df: DataFrame) -> Dataset:
        return replace(self, df=df, plain=False)

    def derived(self, columns: Mapping[str, Column], start: int = 0) -> Dataset:
        """New dataset of the given named columns plus the role columns."""
        features, selected = [], [quoted(c) for c in self.roles()]
        for i, (name, column) in enumerate(columns.items()):
            physical = name if _PLAIN.match(name) and name not in self.roles() else f"f_{start + i:06d}"
            features.append(Feature(name, physical))
            selected.append(column.alias(physical))
        return replace(self, df=self.df.select(*selected), features=tuple(features), plain=False)


def as_double(column: Column) -> Column:
    return F.nullif(column.cast("double"), F.lit(float("nan")))


def safe_columns(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Rename columns whose names are not plain identifiers; returns display name -> column."""
    mapping = {c: c if _PLAIN.match(c) else f"c_{i:06d}" for i, c in enumerate(df.columns)}
    return df.toDF(*[mapping[c] for c in df.columns]), mapping
