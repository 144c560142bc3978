"""Encodings of raw columns: targets, categories, counts; and chained-equation imputation."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featloom.dataset import as_double, numeric_columns, quoted, string_columns
from featloom.operators.gram import gram_matrices
from featloom.operators.ordering import lookup, sorted_codes
from featloom.session import materialise

# Fixed values of the encoding rules.
NULL_SHARE_LIMIT = 0.5
ONE_HOT_BELOW = 8
NULL_TEXT = "nan"
NULL_CODE_TEXT = "NULL"

INLINE_LIMIT = 64


def null_counts(df: DataFrame, columns: Sequence[str]) -> tuple[int, dict[str, int]]:
    """Row count and NULL-or-NaN count per column, in one pass."""
    nan = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}

    def missing(c):
        return quoted(c).isNull() | F.isnan(quoted(c)) if c in nan else quoted(c).isNull()

    row = df.agg(
        F.count(F.lit(1)).alias("__rows"), *[F.count_if(missing(c)).alias(f"n{i}") for i, c in enumerate(columns)]
    ).collect()[0]
    return row["__rows"], {c: row[f"n{i}"] for i, c in enumerate(columns)}


def drop_null_columns(df: DataFrame, columns: Sequence[str], share: float = NULL_SHARE_LIMIT) -> list[str]:
    """Columns whose missing share is below ``share``; exactly ``share`` is dropped."""
    rows, counts = null_counts(df, columns)
    return [c for c in columns if rows and counts[c] / rows < share]


def drop_empty_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns with at least one value."""
    rows, counts = null_counts(df, columns)
    return [c for c in columns if counts[c] < rows]


def class_values(df: DataFrame, label: str) -> list:
    """Distinct label values in ascending order, for models that hold something per class anyway."""
    return sorted(r[0] for r in df.select(quoted(label)).filter(quoted(label).isNotNull()).distinct().collect())


def encode_label(df: DataFrame, label: str, out: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Replace the label by 0..k-1 in the order of the sorted class values; also returns (value, code).

    A few classes are told apart inside the plan, more of them by a dictionary that is joined.
    """
    keys = df.select(quoted(label).alias("key")).filter("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    few = keys.limit(INLINE_LIMIT + 1).collect()
    if len(few) <= INLINE_LIMIT:
        values = sorted(r["key"] for r in few)
        code = _case(label, values) if values else F.lit(None).cast("double")
        kind = df.schema[label].dataType.simpleString()
        codes = df.sparkSession.createDataFrame([(v, float(i)) for i, v in enumerate(values)], f"value {kind}, code double")
        return df.withColumn(out or label, code), codes
    keys = materialise(keys, "classes")
    coded = keys.join(sorted_codes(keys, "key"), "key").select("key", F.col("code").cast("double").alias("value"), "n")
    coded = materialise(coded, "classes")
    codes = coded.select(F.col("key").alias("value"), F.col("value").alias("code"))
    if out is None:
        order = df.columns
        keyed = df.withColumn("__label", quoted(label)).drop(label)
        return lookup(keyed, "__label", coded, label).select(*[quoted(c) for c in order]), codes
    return lookup(df, label, coded, out), codes


def _case(label: str, values: Sequence):
    code = F.when(quoted(label) == F.lit(values[0]), F.lit(0.0))
    for i, value in enumerate(values[1:], 1):
        code = code.when(quoted(label) == F.lit(value), F.lit(float(i)))
    return code


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per distinct text of every column: columns col (position), key, n. Missing has a NULL key."""
    cells = F.explode(
        F.array(*[F.struct(F.lit(i).alias("col"), quoted(c).cast("string").alias("key")) for i, c in enumerate(columns)])
    )
    return df.select(cells.alias("cell")).groupBy("cell.col", "cell.key").agg(F.count(F.lit(1)).alias("n"))


def dictionary_sizes(counts: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Number of distinct values per column, missing counting as one."""
    sizes = {r["col"]: r["entries"] for r in counts.groupBy("col").agg(F.count(F.lit(1)).alias("entries")).collect()}
    return {c: sizes.get(i, 0) for i, c in enumerate(columns)}


def small_dictionaries(
    counts: DataFrame, columns: Sequence[str], sizes: Mapping[str, int], limit: int = INLINE_LIMIT
) -> dict[str, dict]:
    """Value -> rows of the columns with at most ``limit`` values; nothing larger reaches the driver."""
    small = [i for i, c in enumerate(columns) if sizes[c] <= limit]
    found: dict[str, dict] = {columns[i]: {} for i in small}
    if small:
        for row in counts.filter(F.col("col").isin(small)).collect():
            found[columns[row["col"]]][row["key"]] = row["n"]
    return found


def _inline(text: Column, table: Mapping[str, float], default: Column) -> Column:
    """Look a text up in a dictionary of at most ``INLINE_LIMIT`` entries held in the plan."""
    if not table:
        return default
    entries = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), v if isinstance(v, Column) else F.lit(v))])
    return F.coalesce(F.element_at(entries, text), default)


def count_encode(df: DataFrame, columns: Sequence[str], suffix: str = "_kterm", counts: DataFrame | None = None) -> DataFrame:
    """Add ``<c>_kterm``, the number of rows that share the value; 0 for missing."""
    if not columns:
        return df
    counts = materialise(value_counts(df, columns), "counts") if counts is None else counts
    sizes = dictionary_sizes(counts, columns)
    small = small_dictionaries(counts, columns, sizes)
    zero = F.lit(0).cast("long")
    added = {}
    for c, table in small.items():
        present = {k: F.lit(n).cast("long") for k, n in table.items() if k is not None}
        added[c + suffix] = _inline(quoted(c).cast("string"), present, zero)
    for i, c in enumerate(columns):
        if c not in small:
            dictionary = counts.filter((F.col("col") == i) & F.col("key").isNotNull())
            df = lookup(df, c, dictionary.select("key", F.col("n").alias("value"), "n"), c + suffix, zero)
    return df.withColumns(added) if added else df


def few_valued(small: Mapping[str, Mapping], below: int = ONE_HOT_BELOW) -> dict[str, list[str]]:
    """Sorted distinct texts (missing reads ``nan``) of the columns with fewer than ``below`` values."""
    return {
        c: sorted({NULL_TEXT if k is None else k for k in table}) for c, table in small.items() if 0 < len(table) < below
    }


def one_hot(df: DataFrame, categories: Mapping[str, Sequence[str]]) -> tuple[DataFrame, list[str]]:
    """Indicator columns ``<c>_<value>`` without the first sorted value."""
    added = {}
    for c, values in categories.items():
        text = F.coalesce(quoted(c).cast("string"), F.lit(NULL_TEXT))
        for value in values[1:]:
            added[f"{c}_{value}"] = (text == F.lit(value)).cast("double")
    return df.withColumns(added) if added else df, list(added)


def label_encode(df: DataFrame, columns: Sequence[str], counts: DataFrame | None = None) -> DataFrame:
    """Replace texts by their sorted position; missing reads as the text ``NULL``."""
    if not columns:
        return df
    counts = materialise(value_counts(df, columns), "counts") if counts is None else counts
    sizes = dictionary_sizes(counts, columns)
    small = small_dictionaries(counts, columns, sizes)
    order = df.columns
    replaced = {}
    for c, table in small.items():
        texts = sorted({NULL_CODE_TEXT if k is None else k for k in table})
        codes = {t: float(i) for i, t in enumerate(texts)}
        replaced[c] = _inline(_code_text(c), codes, F.lit(None).cast("double"))
    for i, c in enumerate(columns):
        if c in small:
            continue
        named = counts.filter(F.col("col") == i).select(F.coalesce("key", F.lit(NULL_CODE_TEXT)).alias("key"), "n")
        named = named.groupBy("key").agg(F.sum("n").alias("n"))
        coded = named.join(sorted_codes(named, "key"), "key").select("key", F.col("code").cast("double").alias("value"), "n")
        texted = df.withColumn("__text", _code_text(c)).drop(c)
        df = lookup(texted, "__text", coded, c).drop("__text")
    if replaced:
        df = df.withColumns(replaced)
    return df.select(*[quoted(c) for c in order])


def _code_text(column: str) -> Column:
    return F.coalesce(quoted(column).cast("string"), F.lit(NULL_CODE_TEXT))


def encode_features(df: DataFrame, columns: Sequence[str], below: int = ONE_HOT_BELOW) -> tuple[DataFrame, list[str]]:
    """Numeric columns, count encodings, indicators and label codes; returns (table, features).

    One pass counts the values of all text columns; every encoding is decided from it.
    """
    texts = [c for c in string_columns(df) if c in set(columns)]
    numbers = [c for c in numeric_columns(df) if c in set(columns)]
    if not texts:
        return df, numbers
    counts = materialise(value_counts(df, texts), "counts")
    narrow = few_valued(small_dictionaries(counts, texts, dictionary_sizes(counts, texts)), below)
    wide = [c for c in texts if c not in narrow]
    df = count_encode(df, texts, counts=counts)
    df, indicators = one_hot(df, narrow)
    if wide:
        df = label_encode(df, wide)
    features = [*numbers, *[c + "_kterm" for c in texts], *indicators, *wide]
    return df, features


def chained_imputation(
    df: DataFrame, columns: Sequence[str], max_rounds: int = 10, tolerance: float = 1e-3, ridge: float = 0.0
) -> DataFrame:
    """Fill missing values by linear regression on all other columns, repeated.

    Every round predicts each incomplete column from the last round's table. All its regressions
    come from one pass: a matrix of inner products per incomplete column over the rows where
    that column is present. Rounds end when the largest change of a fitted mean is small.
    """
    rows, counts = null_counts(df, columns)
    incomplete = [i for i, c in enumerate(columns) if 0 < counts[c] < rows]
    if not incomplete:
        return df
    row = df.agg(
        *[F.avg(as_double(quoted(c))).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(as_double(quoted(c))).alias(f"s{i}") for i, c in enumerate(columns)],
    ).collect()[0]
    means = np.array([row[f"m{i}"] if row[f"m{i}"] is not None else 0.0 for i in range(len(columns))])
    scales = np.array([row[f"s{i}"] or 1.0 for i in range(len(columns))])
    inputs = df.select(*[as_double(quoted(c)).alias(f"v{i}") for i, c in enumerate(columns)])
    rounds: list[np.ndarray] = []
    for _ in range(max_rounds):
        step = _imputation_round(inputs, means, scales, rounds, incomplete, ridge)
        previous = rounds[-1] if rounds else np.zeros_like(step)
        rounds.append(step)
        if np.abs(step - previous).max() < tolerance:
            break
    fields = [f for f in df.schema.fields if f.name not in set(columns)]
    kept = [f.name for f in fields]
    typed = df.select(*[quoted(c) for c in kept], *[as_double(quoted(c)).alias(c) for c in columns])
    filled = typed.mapInArrow(_fill_batches(len(kept), means, scales, rounds, incomplete), typed.schema)
    return filled.select(*[quoted(c) for c in df.columns])


def _imputed(x: np.ndarray, means, scales, rounds, incomplete) -> tuple[np.ndarray, np.ndarray]:
    """Standardised values after the given rounds, and the mask of missing ones."""
    z = (x - means) / scales
    missing = np.isnan(z)
    z = np.where(missing, 0.0, z)
    for step in rounds:
        guess = np.column_stack([np.ones(len(z)), z]) @ step
        nxt = z.copy()
        for k, i in enumerate(incomplete):
            nxt[missing[:, i], i] = guess[missing[:, i], k]
        z = nxt
    return z, missing


def _imputation_round(inputs, means, scales, rounds, incomplete, ridge) -> np.ndarray:
    frozen = list(rounds)

    def blocks(batch: pa.RecordBatch):
        x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(batch.num_columns)])
        z, missing = _imputed(x, means, scales, frozen, incomplete)
        design = np.column_stack([np.ones(len(z)), z])
        for k, i in enumerate(incomplete):
            present = design[~missing[:, i]]
            yield (k, 0), present.T @ present

    grams = gram_matrices(inputs, blocks)
    d = len(means) + 1
    step = np.zeros((d, len(incomplete)))
    for k, i in enumerate(incomplete):
        gram = grams[(k, 0)]
        others = [j for j in range(d) if j != i + 1]
        system = gram[np.ix_(others, others)] + ridge * gram[0, 0] * np.eye(len(others))
        step[others, k] = np.linalg.lstsq(system, gram[others, i + 1], rcond=None)[0]
    return step


def _fill_batches(offset: int, means, scales, rounds, incomplete):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                yield batch
                continue
            total = batch.num_columns
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(offset, total)])
            z, missing = _imputed(x, means, scales, rounds, incomplete)
            filled = np.where(missing, z * scales + means, x)
            arrays = [batch.column(i) for i in range(offset)]
            arrays += [pa.array(filled[:, i]) for i in range(total - offset)]
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return run
