"""From a raw table to a clean, encoded, bounded dataset."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from featloom.dataset import CLASSIFICATION, Dataset, quoted, readable, string_columns
from featloom.operators.cleaning import CleanRules, clean
from featloom.operators.encoding import (
    chained_imputation,
    drop_empty_columns,
    drop_null_columns,
    encode_features,
    encode_label,
)
from featloom.operators.sampling import balance, subsample
from featloom.session import materialise
from featloom.sources.tables import display_dataset, read_table, with_row_id

ROW_ID = "row_id"


@dataclass(frozen=True)
class LoadOptions:
    """``order='older'`` cleans and balances before it encodes. ``row_limit`` samples so many rows; None keeps all."""

    sep: str = ","
    header: bool = True
    order: str = "current"
    drop_half_null: bool = True
    row_limit: int | None = None
    seed: int = 1


def preprocess(
    df: DataFrame, label: str | None = None, task: str = CLASSIFICATION, drop_half_null: bool = True, row_id: str | None = None
) -> Dataset:
    """Encode the target and the features, drop sparse columns, impute. Last column is the default label."""
    label = label or df.columns[-1]
    columns = [c for c in df.columns if c not in (label, row_id)]
    df = readable(df, columns)
    if task == CLASSIFICATION:
        df, _ = encode_label(df, label)
    if drop_half_null:
        columns = drop_null_columns(df, columns)
    encoded, features = encode_features(df, columns)
    roles = [c for c in (row_id, label) if c]
    if encoded is not df:
        encoded = materialise(encoded.select(*[quoted(c) for c in [*roles, *features]]), "encoded")
    features = drop_empty_columns(encoded, features)
    imputed = chained_imputation(encoded, features)
    return display_dataset(imputed.select(*[quoted(c) for c in [*roles, *features]]), label, task, row_id, features)


def load_frame(
    df: DataFrame, label: str | None = None, task: str = CLASSIFICATION, row_id: str | None = None, options: LoadOptions = LoadOptions()
) -> Dataset:
    """Loading steps on a table already read."""
    label = label or df.columns[-1]
    if row_id is None:
        row_id = ROW_ID
        # The id follows the scan; storing it pins it for every later job.
        df = materialise(with_row_id(df, row_id), "input")
    if options.order == "older":
        return _load_older(df, label, task, row_id, options)
    ds = clean(preprocess(df, label, task, options.drop_half_null, row_id))
    return _limited(ds, options)


def _load_older(df, label, task, row_id, options) -> Dataset:
    """Cleaning comes first, then balancing and sampling, then the encoding of text columns."""
    df = readable(df, [c for c in df.columns if c not in (label, row_id)])
    if task == CLASSIFICATION:
        df, _ = encode_label(df, label)
    others = string_columns(df.drop(label, row_id))
    ds = clean(display_dataset(df, label, task, row_id), CleanRules(older=True))
    if others:
        # Text columns are not cleaned; they wait beside the numbers for their encoding.
        texts = df.select(quoted(row_id), *[quoted(c) for c in others])
        ds = ds.with_df(ds.df.join(texts, row_id))
    if task == CLASSIFICATION:
        balanced = balance(ds, options.seed)
        renumbered = with_row_id(balanced.df.drop("copy", row_id), row_id)
        ds = balanced.with_df(materialise(renumbered, "balanced"))
    ds = _limited(ds, options)
    if not others:
        return ds
    roles, columns = ds.roles(), [*ds.columns, *others]
    encoded, features = encode_features(ds.df.select(*[quoted(c) for c in [*roles, *columns]]), columns)
    encoded = materialise(encoded.select(*[quoted(c) for c in [*roles, *features]]), "encoded")
    imputed = chained_imputation(encoded, drop_empty_columns(encoded, features))
    named = {f.column: f.name for f in ds.features}
    made = display_dataset(imputed, ds.label, task, ds.row_id)
    return replace(made, features=tuple(replace(f, name=named.get(f.name, f.name)) for f in made.features))


def _limited(ds: Dataset, options: LoadOptions) -> Dataset:
    return ds if options.row_limit is None else subsample(ds, options.row_limit, options.seed)


def load_data(
    spark: SparkSession,
    path: str,
    label: str | None = None,
    task: str = CLASSIFICATION,
    row_id: str | None = None,
    options: LoadOptions = LoadOptions(),
) -> Dataset:
    """CSV or Parquet file to a dataset ready for generation."""
    if path.endswith(".parquet"):
        df = read_table(spark, path)
    else:
        df = read_table(spark, path, sep=options.sep, header=options.header)
    return load_frame(df, label, task, row_id, options)
