"""Row sampling, class balancing, splits and random grouping. All by hash of the row id."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featloom.dataset import Dataset, quoted
from featloom.operators.ordering import ROWS_PER_BUCKET, with_position
from featloom.session import materialise

ROW_LIMIT = 100_000
BALANCED_BELOW = 0.1

_HASH_MIN, _HASH_MAX = -(2**63), 2**63 - 1


def row_hash(row_id: str, seed: int) -> Column:
    """Uniform 64-bit value per row, the same in every run."""
    return F.xxhash64(F.lit(seed), quoted(row_id))


def subsample(ds: Dataset, limit: int = ROW_LIMIT, seed: int = 1) -> Dataset:
    """Exactly ``limit`` rows (all when there are fewer): those with the smallest hash.

    A threshold on the hash first cuts the table down to a little more than ``limit`` rows,
    so the final ordering never sees more than that, whatever the size of the table.
    """
    if ds.row_id is None:
        raise ValueError("sampling needs a row id")
    rows = ds.df.count()
    if rows <= limit:
        return ds
    h = row_hash(ds.row_id, seed)
    share = (limit + 6.0 * math.sqrt(limit) + 50.0) / rows
    while True:
        if share >= 1.0:
            near = ds.df
            break
        near = ds.df.filter(h <= F.lit(_HASH_MIN + int(share * (_HASH_MAX - _HASH_MIN))))
        if near.count() >= limit:
            break
        share *= 2.0
    return ds.with_df(near.orderBy(h, quoted(ds.row_id)).limit(limit))


def class_sizes(ds: Dataset) -> dict:
    return {r[0]: r[1] for r in ds.df.groupBy(quoted(ds.label)).count().collect()}


def is_balanced(sizes: Sequence[int]) -> bool:
    mean = sum(sizes) / len(sizes)
    std = math.sqrt(sum((s - mean) ** 2 for s in sizes) / len(sizes))
    return std / mean < BALANCED_BELOW


def balance(ds: Dataset, seed: int = 0, rows_per_bucket: int = ROWS_PER_BUCKET) -> Dataset:
    """Every class at the size of the largest: all its rows plus draws with replacement.

    Each draw is a hashed position inside its class; positions and rows meet in an equi-join on
    (class, position), which no single class can overload. ``copy`` is 0 for an original row.
    """
    sizes = {k: v for k, v in class_sizes(ds).items() if k is not None}
    if len(sizes) < 2 or is_balanced(list(sizes.values())):
        return ds.with_df(ds.df.withColumn("copy", F.lit(0).cast("long")))
    largest = max(sizes.values())
    classes = sorted(sizes)
    spark = ds.spark
    draws = None
    for c in classes:
        missing = largest - sizes[c]
        if missing == 0:
            continue
        part = spark.range(missing).select(
            F.lit(c).alias("__class"),
            F.pmod(F.xxhash64(F.lit(seed), F.lit(str(c)), F.col("id")), F.lit(sizes[c])).alias("__pos"),
        )
        draws = part if draws is None else draws.unionByName(part)
    times = draws.groupBy("__class", "__pos").agg(F.count(F.lit(1)).alias("__times"))
    placed = with_position(ds.df, ds.row_id, [ds.label], "__at", rows_per_bucket=rows_per_bucket)
    drawn = placed.join(times, (quoted(ds.label) == F.col("__class")) & (F.col("__at") == F.col("__pos")), "left")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("__times"), F.lit(0)).cast("long")))
    return ds.with_df(drawn.select(*[quoted(c) for c in ds.df.columns], copies.alias("copy")))


def holdout(ds: Dataset, test_share: float = 0.25, seed: int = 0) -> tuple[Dataset, Dataset]:
    """(train, test) by hash of the row id; the same rows in every run and on every retry."""
    u = F.pmod(row_hash(ds.row_id, seed), F.lit(1_000_000)) / F.lit(1_000_000.0)
    return ds.with_df(ds.df.filter(u >= test_share)), ds.with_df(ds.df.filter(u < test_share))


def random_groups(items: Sequence, n: int, seed: int = 0) -> list[list]:
    """Shuffle and deal into ``n`` groups of nearly equal size; singletons when there are fewer items."""
    shuffled = list(items)
    random.Random(seed).shuffle(shuffled)
    if len(shuffled) > n:
        return [shuffled[i::n] for i in range(n)]
    return [[item] for item in shuffled]


_AT = "__at"


def placed_rows(ds: Dataset, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """The stored roles and features with the position of every row, for several calls of :func:`donors`."""
    placed = with_position(ds.df, ds.row_id, position=_AT, rows_per_bucket=rows_per_bucket)
    return materialise(placed.select(_AT, *[quoted(c) for c in dict.fromkeys([*ds.roles(), *ds.columns])]), "placed")


def donors(
    ds: Dataset,
    columns: Sequence[str],
    prefix: str,
    seed: int = 0,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    placed: DataFrame | None = None,
) -> Dataset:
    """Give every row the ``columns`` of another row, as ``<prefix><column>``.

    A permutation of the row positions by a multiplicative step pairs the rows, so permuted
    columns come from one equi-join on the position instead of a global shuffle sort. ``placed`` are the
    rows with their positions, where :func:`placed_rows` has stored them.
    """
    rows = ds.df.count() if placed is None else placed.count()
    if rows == 0:
        raise ValueError("no rows to permute")
    rng = random.Random(seed)
    step = rng.randrange(1, rows) if rows > 1 else 1
    while math.gcd(step, rows) != 1:
        step = rng.randrange(1, rows)
    offset = rng.randrange(rows)
    if placed is None:
        placed = with_position(ds.df, ds.row_id, position=_AT, rows_per_bucket=rows_per_bucket, rows=rows)
    moved = (F.col(_AT).cast("decimal(38,0)") * F.lit(step) + F.lit(offset)) % F.lit(rows)
    given = placed.select(moved.cast("long").alias("__to"), *[quoted(c).alias(prefix + c) for c in columns])
    return replace(ds, df=placed.join(given, F.col(_AT) == F.col("__to")).drop(_AT, "__to"))
