"""Registry of queries and the shapes they share with their SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featloom.dataset import Dataset, quoted
from featloom.operators.encoding import encode_label
from featloom.operators.moments import moments_frame

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL where SQL can express it."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def single(column: Column) -> Column:
    """Reported value: single precision, with sums that cancel to rounding noise read as 0."""
    return (F.round(column, 12) + F.lit(0.0)).cast("float").cast("double")


def single_sql(expression: str) -> str:
    return f"CAST(CAST(round({expression}, 12) + 0.0 AS FLOAT) AS DOUBLE)"


# Five numeric columns of lineitem; ``net`` takes both signs.
LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "net"]
LINE_SQL = (
    "base AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_discount - l_tax AS net, "
    "CAST(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS DOUBLE) AS y, l_returnflag FROM lineitem)"
)


def line_items(spark: SparkSession, sf_dir: str, features: Sequence[str] = LINE_FEATURES) -> Dataset:
    df = load(spark, sf_dir, "lineitem").withColumn("net", F.col("l_discount") - F.col("l_tax"))
    return Dataset.of(df, features)


def labelled_line_items(spark: SparkSession, sf_dir: str, features: Sequence[str] = LINE_FEATURES) -> Dataset:
    """``l_returnflag`` as class code ``y``."""
    df = load(spark, sf_dir, "lineitem").withColumn("net", F.col("l_discount") - F.col("l_tax"))
    coded, _ = encode_label(df, "l_returnflag", "y")
    return Dataset.of(coded, features, "y")


def priced_line_items(spark: SparkSession, sf_dir: str) -> Dataset:
    """Regression on ``l_extendedprice``."""
    df = load(spark, sf_dir, "lineitem").withColumn("net", F.col("l_discount") - F.col("l_tax"))
    return Dataset.of(df, ["l_quantity", "l_discount", "l_tax", "net"], "l_extendedprice", "R")


def summary(ds: Dataset, exprs=None) -> DataFrame:
    """feature, n, mean, std, lo, hi of the given expressions."""
    frame = moments_frame(ds, exprs)
    n = F.col("rows") - F.col("nulls")
    return frame.select(
        "feature",
        n.alias("n"),
        single(F.col("mean")).alias("mean"),
        single(F.sqrt(F.greatest(F.col("m2"), F.lit(0.0)) / n)).alias("std"),
        single(F.col("lo")).alias("lo"),
        single(F.col("hi")).alias("hi"),
    )


def empty_summary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "feature string, n bigint, mean double, std double, lo double, hi double")


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def summary_sql(source: str, items: Sequence[tuple[str, str, str | None]], frm: str = "base") -> str:
    """The same summary of SQL expressions: items are (feature, expression, HAVING condition or None)."""
    parts = []
    for feature, expression, having in items:
        part = (
            f"SELECT {text(feature)} AS feature, count(x) AS n, {single_sql('avg(x)')} AS mean, "
            f"{single_sql('stddev_pop(x)')} AS std, {single_sql('min(x)')} AS lo, {single_sql('max(x)')} AS hi "
            f"FROM (SELECT *, CAST({expression} AS DOUBLE) AS x FROM {frm}) t"
        )
        parts.append(part + (f" HAVING {having}" if having else ""))
    return f"WITH {source} " + " UNION ALL ".join(parts)


def by_flag(df: DataFrame, columns: dict[str, Column], key: str) -> DataFrame:
    """Row count and mean of every column per key."""
    means = [single(F.avg(c)).alias(name) for name, c in columns.items()]
    return df.groupBy(quoted(key)).agg(F.count(F.lit(1)).alias("n"), *means)


def by_flag_sql(source: str, columns: dict[str, str], key: str, frm: str = "base") -> str:
    means = ", ".join(f"{single_sql(f'avg({e})')} AS {n}" for n, e in columns.items())
    return f"WITH {source} SELECT {key}, count(*) AS n, {means} FROM {frm} GROUP BY {key}"


def least_squares_sql(name: str, source: str, y: str, xs: Sequence[str], keys: Sequence[str] = (), weight: str = "TRUE") -> tuple[str, str]:
    """CTEs that fit ``y`` on ``xs`` per key, and the prediction from columns of the last one (alias ``name``) and the ``xs``.

    Every regressor is freed from those before it, so each coefficient is a slope of one variable.
    """
    by = ", ".join(keys)
    group, lead = (f" GROUP BY {by}", f"{by}, ") if keys else ("", "")
    join = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys) or "TRUE"
    ctes, previous = [], None
    free = []
    for i, x in enumerate(xs):
        table = f"{name}_{i}" if i + 1 < len(xs) else name
        own = f"s.{x} - p.m{i}" if i else None
        if i:
            own += "".join(f" - p.b{i}_{j} * ({z})" for j, z in enumerate(free))
            free.append(own)
        else:
            free.append(f"s.{x}" if previous else "")
        if not i:
            means = ", ".join([f"avg({y}) AS my", *[f"avg({c}) AS m{k}" for k, c in enumerate(xs)]])
            slopes = ", ".join([f"coalesce(regr_slope({y}, {x}), 0) AS c0", *[f"coalesce(regr_slope({c}, {x}), 0) AS b{k}_0" for k, c in enumerate(xs) if k]])
            ctes.append(f"{table} AS (SELECT {lead}{means}, {slopes} FROM {source} WHERE {weight}{group})")
            free[0] = f"s.{x} - p.m0"
        else:
            slopes = ", ".join([f"coalesce(regr_slope(s.{y}, {own}), 0) AS c{i}", *[f"coalesce(regr_slope(s.{c}, {own}), 0) AS b{k}_{i}" for k, c in enumerate(xs) if k > i]])
            inner = f"SELECT {', '.join(f's.{k}' for k in keys) + ', ' if keys else ''}{slopes} FROM {source} s JOIN {previous} p ON {join('s', 'p')} WHERE {weight}{' GROUP BY ' + ', '.join(f's.{k}' for k in keys) if keys else ''}"
            ctes.append(f"{table} AS (SELECT q.*, {', '.join(['t.c' + str(i), *[f't.b{k}_{i}' for k in range(i + 1, len(xs))]])} FROM {previous} q JOIN ({inner}) t ON {join('q', 't')})")
        previous = table
    terms = [f"{name}.c{i} * ({z.replace('p.', name + '.').replace('s.', 'r.')})" for i, z in enumerate(free)]
    return ", ".join(ctes), f"{name}.my + " + " + ".join(terms)
