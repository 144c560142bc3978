"""Reading and writing tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featloom.dataset import Dataset, quoted, safe_columns

_PRIMITIVE = {int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bool: T.BooleanType()}


def read_csv(
    spark: SparkSession, path: str, sep: str = ",", header: bool = True, schema: T.StructType | str | None = None
) -> DataFrame:
    """CSV scan. Without a schema the types are inferred, which costs one more scan."""
    reader = spark.read.option("sep", sep).option("header", header).option("nanValue", "NaN")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def read_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """Parquet for ``*.parquet`` and folders, CSV for everything else."""
    return read_csv(spark, path, **options) if path.endswith((".csv", ".data", ".txt", ".tsv")) else spark.read.parquet(path)


def from_sequence(spark: SparkSession, items: Iterable, partitions: int | None = None, name: str = "value") -> DataFrame:
    """A driver-side sequence as a one-column table."""
    values = list(items)
    kind = _PRIMITIVE.get(type(values[0]), T.StringType()) if values else T.LongType()
    df = spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField(name, kind)]))
    return df.repartition(partitions) if partitions else df


def random_normal(
    spark: SparkSession, rows: int, columns: int, mean: float = 0.0, std: float = 1.0, seed: int = 0, partitions: int | None = None
) -> DataFrame:
    """``rows`` x ``columns`` normal values next to the row number ``id``."""
    base = spark.range(0, rows, 1, partitions) if partitions else spark.range(rows)
    return base.select("id", *[(F.randn(seed + i) * std + mean).alias(f"v{i}") for i in range(columns)])


def _named(ds: Dataset) -> DataFrame:
    """Features under their display names, the label last."""
    label = [quoted(ds.label)] if ds.label else []
    return ds.df.select(*[quoted(f.column).alias(f.name) for f in ds.features], *label)


def _storable(ds: Dataset) -> DataFrame:
    """Features in single precision; every other column (roles, folds) as it is."""
    features = set(ds.columns)
    return ds.df.select(*[quoted(c).cast("float").alias(c) if c in features else quoted(c) for c in ds.df.columns])


def write_generation(ds: Dataset, folder: str, generation: int) -> Dataset:
    """Store a generation as ``<folder>/gen=<i>`` and return the stored table."""
    return _write(ds, f"{folder.rstrip('/')}/gen={generation}")


def write_total(ds: Dataset, folder: str) -> Dataset:
    """Store all candidates as ``<folder>/total`` and return the stored table."""
    return _write(ds, f"{folder.rstrip('/')}/total")


def _write(ds: Dataset, path: str) -> Dataset:
    stored = _storable(ds)
    stored.write.mode("overwrite").parquet(path)
    # Names are not columns: they are kept next to the data, one row per feature.
    catalog = [(i, f.name, f.column) for i, f in enumerate(ds.features)]
    ds.spark.createDataFrame(catalog, "pos int, name string, column string").coalesce(1).write.mode("overwrite").parquet(
        f"{path}.features"
    )
    return ds.with_df(ds.spark.read.schema(stored.schema).parquet(path))


def read_stored(spark: SparkSession, path: str, label: str | None, task: str = "C", row_id: str | None = None) -> Dataset:
    """Read back a table written by :func:`write_generation` or :func:`write_total`."""
    rows = spark.read.parquet(f"{path}.features").orderBy("pos").collect()
    ds = Dataset.of(spark.read.parquet(path), [r["column"] for r in rows], label, task, row_id)
    names = {r["column"]: r["name"] for r in rows}
    return Dataset(ds.df, tuple(type(f)(names[f.column], f.column) for f in ds.features), label, task, row_id)


def write_final(ds: Dataset, path: str) -> None:
    """Selected features as CSV with their display names in the header."""
    _named(Dataset(ds.df, ds.features)).write.mode("overwrite").option("header", True).csv(path)


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Unique increasing id in scan order. Store the table before relying on it in several jobs."""
    return df.withColumn(name, F.monotonically_increasing_id())


def display_dataset(
    df: DataFrame, label: str | None, task: str, row_id: str | None, features: Sequence[str] | None = None
) -> Dataset:
    """Dataset over columns with arbitrary names; physical names become plain identifiers."""
    renamed, mapping = safe_columns(df)
    back = {v: k for k, v in mapping.items()}
    wanted = None if features is None else [mapping[c] for c in features]
    ds = Dataset.of(renamed, wanted, mapping.get(label), task, mapping.get(row_id))
    return Dataset(ds.df, tuple(type(f)(back[f.column], f.column) for f in ds.features), ds.label, task, ds.row_id)
