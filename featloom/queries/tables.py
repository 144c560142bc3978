"""Queries over sources, sinks and the general table operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from featloom.dataset import Dataset
from featloom.operators import table as T
from featloom.operators.generate import append, fit_operator
from featloom.operators.moments import base_exprs, stats_of
from featloom.queries.base import (
    LINE_FEATURES,
    LINE_SQL,
    line_items,
    load,
    query,
    single,
    single_sql,
    summary,
    summary_sql,
)
from featloom.session import work_dir
from featloom.sources import tables as S

_NUMBERS = ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "group_totals",
    f"SELECT l_returnflag, {single_sql('sum(l_extendedprice)')} AS total, count(l_extendedprice) AS n, "
    f"{single_sql('avg(l_extendedprice)')} AS mean FROM lineitem GROUP BY l_returnflag",
)
def group_totals(spark, sf_dir):
    found = T.group_totals(load(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice")
    return found.select("l_returnflag", single(F.col("total")).alias("total"), "n", single(F.col("mean")).alias("mean"))


@query("group_overall_mean", f"SELECT {single_sql('sum(l_extendedprice) / count(l_extendedprice)')} AS mean FROM lineitem")
def overall(spark, sf_dir):
    totals = T.group_totals(load(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice")
    return T.overall_mean(totals).select(single(F.col("mean")).alias("mean"))


@query(
    "column_counts",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS n, {single_sql(f'sum({c})')} AS total, {single_sql(f'avg({c})')} AS mean FROM lineitem"
        for c in _NUMBERS
    ),
)
def column_counts(spark, sf_dir):
    found = T.column_counts(load(spark, sf_dir, "lineitem"), _NUMBERS)
    return found.select("column", "n", single(F.col("total")).alias("total"), single(F.col("mean")).alias("mean"))


_DISTINCT = ["l_orderkey", "l_partkey", "l_quantity", "l_shipdate", "l_returnflag"]


@query(
    "distinct_counts",
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n FROM lineitem" for c in _DISTINCT),
)
def distinct_counts(spark, sf_dir):
    return T.distinct_counts(load(spark, sf_dir, "lineitem"), _DISTINCT)


@query("conditional_count", "SELECT count_if(l_discount = 0)::BIGINT AS n FROM lineitem")
def conditional_count(spark, sf_dir):
    return T.count_where(load(spark, sf_dir, "lineitem"), F.col("l_discount") == 0)


@query("filtered_rows", "SELECT count(*) AS n FROM lineitem WHERE l_quantity >= 25")
def filtered_rows(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").filter(F.col("l_quantity") >= 25).agg(F.count(F.lit(1)).alias("n"))


@query("projection_by_name", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def by_name(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("projection_by_position", "SELECT o_orderstatus, o_totalprice FROM orders")
def by_position(spark, sf_dir):
    df = load(spark, sf_dir, "orders")
    return df.select(*df.columns[2:4])


@query("head_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def head(spark, sf_dir):
    ordered = load(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return ordered.select("o_orderkey", "o_totalprice").limit(10)


@query("map_and_filter", "SELECT event_id, event_id * event_id AS squared FROM events WHERE event_id % 2 = 0")
def map_filter(spark, sf_dir):
    df = load(spark, sf_dir, "events").filter(F.col("event_id") % 2 == 0)
    return df.select("event_id", (F.col("event_id") * F.col("event_id")).alias("squared"))


@query(
    "group_by_function",
    "SELECT length(p_name) AS key, count(*) AS n, min(p_name) AS first_name, max(p_name) AS last_name FROM part GROUP BY 1",
)
def group_by_function(spark, sf_dir):
    return load(spark, sf_dir, "part").groupBy(F.length("p_name").cast("long").alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.min("p_name").alias("first_name"), F.max("p_name").alias("last_name"))


@query("fold_by_key", "SELECT o_custkey % 2 AS key, max(o_totalprice) AS top FROM orders GROUP BY 1")
def fold_by_key(spark, sf_dir):
    return T.fold_by(load(spark, sf_dir, "orders"), F.col("o_custkey") % 2, F.col("o_totalprice"))


@query(
    "strided_means",
    "SELECT " + ", ".join(f"{single_sql(f'avg(embedding[{i + 1}]::DOUBLE)')} AS v{i}" for i in range(0, 64, 16)) + " FROM embeddings",
)
def strided(spark, sf_dir):
    df = load(spark, sf_dir, "embeddings")
    wide = df.select(*[F.col("embedding")[i].cast("double").alias(f"v{i}") for i in range(64)])
    means = T.strided_means(wide, wide.columns, 16)
    return means.select(*[single(F.col(c)).alias(c) for c in means.columns])


@query("minimum_and_maximum", "SELECT min(value) AS lo, max(value) AS hi FROM events")
def min_max(spark, sf_dir):
    return T.extremes(load(spark, sf_dir, "events"), "value")


@query(
    "stacked_columns",
    f"SELECT l_returnflag, {single_sql('avg(l_quantity + l_discount + l_tax)')} AS mean_sum FROM lineitem GROUP BY 1",
)
def stacked(spark, sf_dir):
    """Columns stacked into one array, reduced per row, then per group."""
    df = T.stacked(load(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"])
    total = F.aggregate("stack", F.lit(0.0), lambda a, x: a + x)
    return df.groupBy("l_returnflag").agg(single(F.avg(total)).alias("mean_sum"))


@query("generation_store", summary_sql(LINE_SQL, [
    (f"{c}_sin", f"CAST(CAST(sin({c}) AS FLOAT) AS DOUBLE)", None) for c in LINE_FEATURES]))
def generation_store(spark, sf_dir):
    """Write a generation in single precision, read it back with its feature names."""
    ds = line_items(spark, sf_dir)
    made = append(ds, fit_operator("sin", base_exprs(ds), stats_of(ds)), keep_base=False)
    folder = f"{work_dir(spark)}/featloom/query-{uuid.uuid4().hex}"
    S.write_generation(made, folder, 1)
    return summary(S.read_stored(spark, f"{folder}/gen=1", None))


@query("final_store", "SELECT count(*) AS n, " + single_sql("avg(l_quantity * l_tax)") + " AS mean FROM lineitem")
def final_store(spark, sf_dir):
    """Selected features as CSV with their names in the header, scanned again."""
    ds = line_items(spark, sf_dir, ["l_quantity", "l_tax"])
    made = append(ds, fit_operator("product", base_exprs(ds), stats_of(ds)), keep_base=False)
    path = f"{work_dir(spark)}/featloom/query-{uuid.uuid4().hex}/final"
    S.write_final(made, path)
    again = S.read_csv(spark, path, schema="product double")
    return again.agg(F.count(F.lit(1)).alias("n"), single(F.avg("product")).alias("mean"))
