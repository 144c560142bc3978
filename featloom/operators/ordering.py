"""Positions, running values and code dictionaries without a single-task sort.

A window over the whole table puts all rows into one task. Here the order column is cut at
approximate quantiles into buckets; every window is per bucket, and only one small row per
(group, bucket) is carried from bucket to bucket. The cut points are literals in the plan, so
a recomputed task sees the same buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featloom.dataset import quoted
from featloom.session import materialise

ROWS_PER_BUCKET = 2_000_000
# Buckets whose cut points are literals of the plan.
MAX_BUCKETS = 4096
SMALL_DICTIONARY = 100_000
HOT_KEYS = 1000

_BUCKET = "__bucket"


def with_bucket(df: DataFrame, order: str, rows_per_bucket: int = ROWS_PER_BUCKET, rows: int | None = None) -> DataFrame:
    """Add ``__bucket``, non-decreasing in the numeric column ``order``."""
    rows = df.count() if rows is None else rows
    buckets = -(-rows // rows_per_bucket)
    if buckets > MAX_BUCKETS:
        # Too many cut points for the driver and the plan: ranges, fixed by writing them.
        ranged = df.repartitionByRange(buckets, quoted(order)).withColumn(_BUCKET, F.spark_partition_id())
        return materialise(ranged, "ranges")
    if buckets <= 1:
        return df.withColumn(_BUCKET, F.lit(0))
    points = df.select(quoted(order).cast("double").alias("o")).approxQuantile(
        "o", [i / buckets for i in range(1, buckets)], 1.0 / (4 * buckets)
    )
    inner = sorted(set(points))
    if not inner:
        return df.withColumn(_BUCKET, F.lit(0))
    splits = [float("-inf"), *inner, float("inf")]
    keyed = df.withColumn("__order", quoted(order).cast("double"))
    bucketed = Bucketizer(splits=splits, inputCol="__order", outputCol="__cut").transform(keyed)
    return bucketed.withColumn(_BUCKET, F.col("__cut").cast("int")).drop("__order", "__cut")


def with_position(
    df: DataFrame,
    order: str,
    by: Sequence[str] = (),
    position: str = "position",
    group_rows: str | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    rows: int | None = None,
    weight: str | None = None,
) -> DataFrame:
    """0-based position of every row by ``order`` inside its ``by`` group, exact.

    ``order`` must be unique inside a group. ``group_rows`` names an extra column with the
    group's size. A group may hold any share of the rows: it is spread over the buckets.
    With ``weight`` a row counts as that many rows and the position is that of its first.
    """
    bucketed = with_bucket(df, order, rows_per_bucket, rows)
    keys = list(by)
    amount = F.lit(1).cast("long") if weight is None else quoted(weight).cast("long")
    sizes = bucketed.groupBy(*keys, _BUCKET).agg(F.sum(amount).alias("__n"))
    # One row per (group, bucket).
    carried = Window.partitionBy(*keys).orderBy(_BUCKET)
    offsets = sizes.select(
        *[quoted(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.col(_BUCKET).alias("__b"),
        (F.sum("__n").over(carried) - F.col("__n")).alias("__before"),
        F.sum("__n").over(Window.partitionBy(*keys)).alias("__group"),
    )
    condition = F.col(_BUCKET) == F.col("__b")
    for i, k in enumerate(keys):
        condition = condition & quoted(k).eqNullSafe(F.col(f"__k{i}"))
    local = Window.partitionBy(*[quoted(k) for k in keys], F.col(_BUCKET)).orderBy(quoted(order))
    before = F.row_number().over(local) - 1 if weight is None else F.sum(amount).over(local) - amount
    joined = bucketed.withColumn("__local", before).join(offsets, condition, "inner")
    result = joined.withColumn(position, F.col("__local") + F.col("__before"))
    if group_rows is not None:
        result = result.withColumn(group_rows, F.col("__group"))
    return result.drop("__local", "__before", "__group", "__b", _BUCKET, *[f"__k{i}" for i in range(len(keys))])


def forward_fill(
    df: DataFrame, columns: Sequence[str], order: str, rows_per_bucket: int = ROWS_PER_BUCKET, rows: int | None = None
) -> DataFrame:
    """Replace missing values by the last present one in ``order``; leading ones stay missing."""
    bucketed = with_bucket(df, order, rows_per_bucket, rows)
    running = Window.partitionBy(_BUCKET).orderBy(quoted(order)).rowsBetween(Window.unboundedPreceding, 0)
    last = bucketed.groupBy(_BUCKET).agg(
        *[
            F.max_by(quoted(c), F.when(quoted(c).isNotNull(), quoted(order))).alias(f"__last{i}")
            for i, c in enumerate(columns)
        ]
    )
    # One row per bucket: the value that enters the bucket from the ones before it.
    earlier = Window.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    entering = last.select(
        F.col(_BUCKET).alias("__b"),
        *[F.last(f"__last{i}", ignorenulls=True).over(earlier).alias(f"__in{i}") for i in range(len(columns))],
    )
    filled = bucketed.select(
        "*", *[F.last(quoted(c), ignorenulls=True).over(running).alias(f"__run{i}") for i, c in enumerate(columns)]
    )
    position = {c: i for i, c in enumerate(columns)}
    joined = filled.join(entering, F.col(_BUCKET) == F.col("__b"), "inner")
    return joined.select(
        *[
            F.coalesce(F.col(f"__run{position[c]}"), F.col(f"__in{position[c]}")).alias(c) if c in position else quoted(c)
            for c in df.columns
        ]
    )


def sorted_codes(values: DataFrame, value: str, code: str = "code", small: int = SMALL_DICTIONARY) -> DataFrame:
    """0-based position of every distinct value in ascending order: columns value, code.

    A dictionary of at most ``small`` entries is numbered in one task. A larger one is range
    partitioned, written to the shared folder (which fixes the partitions) and numbered per
    partition with carried counts.
    """
    distinct = values.select(quoted(value).alias(value)).filter(quoted(value).isNotNull()).distinct()
    entries = distinct.count()
    if entries <= small:
        return distinct.select(value, (F.row_number().over(Window.orderBy(value)) - 1).cast("long").alias(code))
    parts = max(2, -(-entries // small))
    ranged = distinct.repartitionByRange(parts, value).withColumn("__part", F.spark_partition_id())
    fixed = materialise(ranged, "codes")
    sizes = fixed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select(
        F.col("__part").alias("__p"),
        (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"),
    )
    local = Window.partitionBy("__part").orderBy(value)
    return (
        fixed.withColumn("__local", F.row_number().over(local) - 1)
        .join(offsets, F.col("__part") == F.col("__p"))
        .select(value, (F.col("__local") + F.col("__before")).cast("long").alias(code))
    )


def lookup(df: DataFrame, key: str, dictionary: DataFrame, out: str, default: Column | None = None) -> DataFrame:
    """Left join of ``dictionary`` (columns key, value, n) with hot keys apart.

    ``n`` is the number of rows that carry the key. Keys with at least a ``HOT_KEYS``-th of all
    rows, of which there can be no more than ``HOT_KEYS``, are broadcast; rows they resolve are
    spread by a salt, and the remaining keys are joined by shuffle (or broadcast by the
    optimizer when their size allows it).
    """
    total = dictionary.agg(F.sum("n").alias("total"))
    threshold = (total.collect()[0]["total"] or 0) / HOT_KEYS
    hot = dictionary.filter((F.col("n") >= threshold) & (F.col("n") > 0)).select(
        F.col("key").alias("__hk"), F.col("value").alias("__hv"), F.lit(True).alias("__hot")
    )
    cold = dictionary.filter((F.col("n") < threshold) | (F.col("n") <= 0)).select(
        F.col("key").alias("__ck"), F.col("value").alias("__cv"), F.lit(0).alias("__cs")
    )
    first = df.join(F.broadcast(hot), quoted(key) == F.col("__hk"), "left")
    open_key = F.when(F.col("__hot").isNull(), quoted(key))
    salted = first.withColumn("__open", open_key).withColumn(
        "__salt", F.when(F.col("__open").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(4096)).cast("int")).otherwise(0)
    )
    joined = salted.join(cold, (F.col("__open") == F.col("__ck")) & (F.col("__salt") == F.col("__cs")), "left")
    value = F.coalesce(F.col("__hv"), F.col("__cv"), *([] if default is None else [default]))
    return joined.select(*[quoted(c) for c in df.columns], value.alias(out))


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """Dictionary value -> number of rows, counted map-side first."""
    counted = df.filter(quoted(column).isNotNull()).groupBy(quoted(column).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("key", F.col("n").alias("value"), "n")
