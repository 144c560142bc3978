"""Queries over encoding, imputation, cleaning and sampling."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from featloom.dataset import Dataset, numeric_columns, quoted
from featloom.operators import cleaning, encoding, sampling
from featloom.operators.folds import FOLD, with_folds
from featloom.plans.load import LoadOptions, load_data, load_frame, preprocess
from featloom.queries.base import least_squares_sql, load, query, single, single_sql, summary, summary_sql
from featloom.session import work_dir


@query(
    "label_codes",
    "SELECT o_orderstatus, CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS DOUBLE) AS code, n "
    "FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) t",
)
def label_codes(spark, sf_dir):
    df, _ = encoding.encode_label(load(spark, sf_dir, "orders"), "o_orderstatus", "code")
    return df.groupBy("o_orderstatus", "code").agg(F.count(F.lit(1)).alias("n"))


@query(
    "label_codes_many",
    "SELECT o_custkey, CAST(dense_rank() OVER (ORDER BY o_custkey) - 1 AS DOUBLE) AS code, n "
    "FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) t",
)
def label_codes_many(spark, sf_dir):
    """A label with as many classes as there are customers: coded by a dictionary join."""
    df, _ = encoding.encode_label(load(spark, sf_dir, "orders"), "o_custkey", "code")
    return df.groupBy("o_custkey", "code").agg(F.count(F.lit(1)).alias("n"))


_SPARSE = {
    "half": "CASE WHEN p_retailprice < 950 THEN p_size END",
    "some": "CASE WHEN p_size > 10 THEN p_size END",
    "none": "CASE WHEN p_size > 1000 THEN p_size END",
    "brand": "nullif(p_brand, 'Brand#2')",
}


@query(
    "null_shares",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(*) - count({e}) AS missing, (count(*) - count({e})) / count(*) < 0.5 AS kept, "
        f"count({e}) > 0 AS has_values FROM part"
        for c, e in _SPARSE.items()
    ),
)
def null_shares(spark, sf_dir):
    """Missing values per column, and which columns the half-null and the all-null rule keep."""
    part = load(spark, sf_dir, "part")
    df = part.select(*[F.expr(e).alias(c) for c, e in _SPARSE.items()])
    _, counts = encoding.null_counts(df, df.columns)
    kept, filled = encoding.drop_null_columns(df, df.columns), encoding.drop_empty_columns(df, df.columns)
    rows = [(c, counts[c], c in kept, c in filled) for c in df.columns]
    return spark.createDataFrame(rows, "feature string, missing bigint, kept boolean, has_values boolean")


@query(
    "count_encoding",
    "WITH b AS (SELECT p_partkey, nullif(p_brand, 'Brand#2') AS brand, p_name FROM part) "
    "SELECT p_partkey, CASE WHEN brand IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY brand) END AS brand_kterm, "
    "count(*) OVER (PARTITION BY p_name) AS p_name_kterm FROM b",
)
def count_encoding(spark, sf_dir):
    df = load(spark, sf_dir, "part").select("p_partkey", F.nullif("p_brand", F.lit("Brand#2")).alias("brand"), "p_name")
    made = encoding.count_encode(df, ["brand", "p_name"])
    return made.select("p_partkey", "brand_kterm", "p_name_kterm")


@query(
    "count_encoding_many_values",
    "SELECT freq, count(*) AS n FROM (SELECT count(*) OVER (PARTITION BY props) AS freq FROM events) t GROUP BY freq",
)
def count_encoding_many(spark, sf_dir):
    """A dictionary that does not fit into the plan is joined, hot keys apart."""
    made = encoding.count_encode(load(spark, sf_dir, "events").select("props"), ["props"])
    return made.groupBy(F.col("props_kterm").alias("freq")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "numeric_projection",
    f"SELECT count(*) AS n, {single_sql('avg(p_partkey)')} AS p_partkey, {single_sql('avg(p_size)')} AS p_size, "
    f"{single_sql('avg(p_retailprice)')} AS p_retailprice FROM part",
)
def numeric_projection(spark, sf_dir):
    df = load(spark, sf_dir, "part")
    return df.agg(F.count(F.lit(1)).alias("n"), *[single(F.avg(c)).alias(c) for c in numeric_columns(df)])


_PRIORITIES = ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "one_hot",
    "WITH v AS (SELECT DISTINCT o_orderpriority AS p FROM orders), f AS (SELECT p FROM v WHERE p > (SELECT min(p) FROM v)) "
    "SELECT o_orderstatus, 'o_orderpriority_' || p AS indicator, count_if(o_orderpriority = p)::BIGINT AS ones, count(*) AS n "
    "FROM orders, f GROUP BY o_orderstatus, p",
)
def one_hot(spark, sf_dir):
    """Indicators of a column with fewer than 8 values; the first sorted value has none."""
    df = load(spark, sf_dir, "orders")
    counts = encoding.value_counts(df, ["o_orderpriority"])
    sizes = encoding.dictionary_sizes(counts, ["o_orderpriority"])
    narrow = encoding.few_valued(encoding.small_dictionaries(counts, ["o_orderpriority"], sizes))
    made, added = encoding.one_hot(df, narrow)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("indicator"), F.col(f"`{c}`").alias("v")) for c in added]))
    return made.select("o_orderstatus", cells.alias("s")).groupBy("o_orderstatus", "s.indicator").agg(
        F.sum("s.v").cast("long").alias("ones"), F.count(F.lit(1)).alias("n"))


@query(
    "label_encoding",
    "SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY coalesce(nullif(p_name, 'red widget'), 'NULL')) - 1 AS DOUBLE) AS name FROM part",
)
def label_encoding(spark, sf_dir):
    df = load(spark, sf_dir, "part").select("p_partkey", F.nullif("p_name", F.lit("red widget")).alias("name"))
    return encoding.label_encode(df, ["name"])


@query(
    "label_encoding_many_values",
    "SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_name) - 1 AS DOUBLE) AS c_name FROM customer",
)
def label_encoding_many(spark, sf_dir):
    return encoding.label_encode(load(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_name"])


def _assembled_sql() -> str:
    source = (
        "base AS (SELECT o_custkey::DOUBLE AS o_custkey, o_totalprice, o_orderpriority, "
        "count(*) OVER (PARTITION BY o_orderpriority) AS kterm FROM orders)"
    )
    items = [("o_custkey", "o_custkey", None), ("o_totalprice", "o_totalprice", None), ("o_orderpriority_kterm", "kterm", None)]
    items += [(f"o_orderpriority_{p}", f"CASE WHEN o_orderpriority = '{p}' THEN 1 ELSE 0 END", None) for p in _PRIORITIES]
    return summary_sql(source, items)


@query("preprocess", _assembled_sql())
def assembled(spark, sf_dir):
    """Raw table to numeric features: numbers, count encodings, indicators."""
    df = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    return summary(preprocess(df, "o_orderstatus", "C", row_id="o_orderkey"))


@query(
    "chained_imputation",
    "WITH b AS (SELECT p_partkey, CASE WHEN p_size > 5 THEN p_retailprice END AS price, p_size::DOUBLE AS size FROM part) "
    "SELECT p_partkey, " + single_sql(
        "coalesce(price, (SELECT regr_slope(price, size) FROM b) * size + (SELECT regr_intercept(price, size) FROM b))"
    ) + " AS price FROM b",
)
def imputation(spark, sf_dir):
    """One incomplete column: its missing values follow from the regression on the other."""
    df = load(spark, sf_dir, "part").select(
        "p_partkey", F.when(F.col("p_size") > 5, F.col("p_retailprice")).alias("price"), F.col("p_size").cast("double").alias("size"))
    return encoding.chained_imputation(df, ["price", "size"]).select("p_partkey", single(F.col("price")).alias("price"))


_GAPS = {
    "a": "CASE WHEN l_quantity > 10 THEN l_extendedprice END",
    "b": "CASE WHEN l_discount > 0.01 THEN l_quantity END",
    "c": "CASE WHEN l_tax > 0 THEN l_discount END",
    "l_tax": "l_tax",
}


def _two_rounds_sql() -> str:
    """Gaps start at the means; twice, each column is regressed on the others where it is known and filled from the round before."""
    names = list(_GAPS)
    raw = ", ".join(f"CAST({e} AS DOUBLE) AS {c}_raw" for c, e in _GAPS.items())
    start = ", ".join(f"coalesce({c}_raw, avg({c}_raw) OVER ()) AS {c}" for c in names)
    ctes, source = [f"raw AS (SELECT {raw} FROM lineitem)", f"t0 AS (SELECT *, {start} FROM raw)"], "t0"
    for turn in (1, 2):
        columns, tables = [], []
        for c in names[:3]:
            fits, predicted = least_squares_sql(f"m{turn}{c}", f"(SELECT * FROM {source} WHERE {c}_raw IS NOT NULL)", c, [o for o in names if o != c])
            ctes.append(fits)
            tables.append(f"m{turn}{c}")
            columns.append(f"coalesce(r.{c}_raw, {predicted}) AS {c}")
        ctes.append(f"t{turn} AS (SELECT r.a_raw, r.b_raw, r.c_raw, {', '.join(columns)}, r.l_tax FROM {source} r, {', '.join(tables)})")
        source = f"t{turn}"
    return ", ".join(ctes)


@query("chained_imputation_rounds", summary_sql(_two_rounds_sql(), [(c, c, None) for c in _GAPS], "t2"))
def imputation_rounds(spark, sf_dir):
    """Several incomplete columns: two rounds of regressions."""
    li = load(spark, sf_dir, "lineitem")
    df = li.select(*[F.expr(e).alias(c) for c, e in _GAPS.items()])
    return summary(Dataset.of(encoding.chained_imputation(df, df.columns, max_rounds=2)))


_DIRTY = {
    "number": "nullif(l_linenumber, 3)",
    "infinite": "CASE WHEN l_discount = 0 THEN {inf} ELSE l_discount END",
    "nan": "CASE WHEN l_tax = 0 THEN {nan} ELSE l_tax END",
    "fixed": "1.0",
    "zeros": "CASE WHEN l_quantity > 45 THEN 1.0 ELSE 0.0 END",
    "mostly_null": "CASE WHEN l_quantity > 30 THEN l_quantity END",
    "l_quantity": "l_quantity",
}


def _dirty(spark, sf_dir, label=None):
    li = load(spark, sf_dir, "lineitem")
    columns = [F.expr(e.format(inf="double('Infinity')", nan="double('NaN')")).cast("double").alias(c) for c, e in _DIRTY.items()]
    return Dataset.of(li.select(*columns, "l_returnflag"), list(_DIRTY), label)


def _dirty_sql() -> str:
    raw = ", ".join(f"CAST({e.format(inf=chr(39) + 'infinity' + chr(39) + '::DOUBLE', nan=chr(39) + 'nan' + chr(39) + '::DOUBLE')} AS DOUBLE) AS {c}"
                    for c, e in _DIRTY.items())
    floats = ", ".join(f"CASE WHEN isinf({c}) OR isnan({c}) THEN NULL ELSE CAST(CAST({c} AS FLOAT) AS DOUBLE) END AS {c}" for c in _DIRTY)
    filled = ", ".join(f"coalesce({c}, (SELECT avg({c}) FROM fl)) AS {c}" for c in _DIRTY)
    return f"raw AS (SELECT {raw} FROM lineitem), fl AS (SELECT {floats} FROM raw), base AS (SELECT {filled} FROM fl)"


_KEEP = (
    "(SELECT count({c}) >= 0.5 * count(*) AND (min({c}) < max({c}) OR count({c}) < count(*)) AND count_if({c} = 0) < 0.8 * count(*) FROM fl)"
)


@query("clean", summary_sql(_dirty_sql(), [(c, c, _KEEP.format(c=c)) for c in _DIRTY]))
def clean(spark, sf_dir):
    """Single precision, infinities and sparse, constant, mostly-zero columns out, means in."""
    return summary(cleaning.clean(_dirty(spark, sf_dir, "l_returnflag")))


_KEEP_OLDER = _KEEP.replace("count_if({c} = 0) < 0.8", "count_if(abs({c}) < 0.0001) <= 0.8")


@query("clean_older_rule", summary_sql(_dirty_sql(), [(c, c, _KEEP_OLDER.format(c=c)) for c in _DIRTY]))
def clean_older(spark, sf_dir):
    return summary(cleaning.clean(_dirty(spark, sf_dir, "l_returnflag"), cleaning.CleanRules(older=True)))


@query(
    "quality_report",
    "WITH " + _dirty_sql() + " SELECT count(*) AS n_rows, 7::BIGINT AS n_columns, "
    "(" + " + ".join(f"count_if({c} = 'infinity'::DOUBLE)" for c in _DIRTY) + ")::BIGINT AS n_inf, "
    "(" + " + ".join(f"count_if({c} IS NULL OR isnan({c}))" for c in _DIRTY) + ")::BIGINT AS n_missing FROM raw",
)
def quality(spark, sf_dir):
    return cleaning.quality_report(_dirty(spark, sf_dir))


def _loaded_sql() -> str:
    source = (
        "base AS (SELECT o_custkey, o_totalprice, o_orderpriority, "
        "count(*) OVER (PARTITION BY o_orderpriority) AS kterm FROM orders)"
    )
    items = [("o_custkey", "o_custkey"), ("o_totalprice", "o_totalprice"), ("o_orderpriority_kterm", "kterm")]
    items += [(f"o_orderpriority_{p}", f"CASE WHEN o_orderpriority = '{p}' THEN 1 ELSE 0 END") for p in _PRIORITIES]
    kept = "count_if(x = 0) < 0.8 * count(*) AND min(x) < max(x)"
    return summary_sql(source, [(n, f"CAST({e} AS FLOAT)", kept) for n, e in items])


@query("load_frame", _loaded_sql())
def loaded(spark, sf_dir):
    """All loading steps with their defaults: encode, impute, clean; every row is kept."""
    df = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    ds = load_frame(df, "o_orderstatus", "C", "o_orderkey")
    return summary(ds)


def _csv_orders(spark, sf_dir) -> str:
    """The orders as a folder of CSV files, written from the given table; the label comes last."""
    path = f"{work_dir(spark)}/featloom/orders-{uuid.uuid4().hex}.csv"
    columns = ["o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus"]
    load(spark, sf_dir, "orders").select(*columns).write.option("header", True).csv(path)
    return path


@query("load_csv", _loaded_sql())
def loaded_csv(spark, sf_dir):
    """CSV scan with inferred types, then all loading steps."""
    return summary(load_data(spark, _csv_orders(spark, sf_dir)))


@query(
    "load_csv_older",
    "WITH s AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) "
    "SELECT CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS DOUBLE) AS o_orderstatus, "
    "CASE WHEN (SELECT stddev_pop(n) / avg(n) FROM s) < 0.1 THEN n ELSE (SELECT max(n) FROM s) END AS n, "
    "(SELECT count(DISTINCT o_orderpriority) + 2 FROM orders) AS features, 0::BIGINT AS wrong FROM s",
)
def loaded_csv_older(spark, sf_dir):
    """The older order: classes that differ brought to the size of the largest, then text columns encoded.

    ``wrong`` counts rows whose indicators and count encoding do not agree with each other.
    """
    ds = load_data(spark, _csv_orders(spark, sf_dir), options=LoadOptions(order="older"))
    indicators = [ds.value(n) for n in ds.names if n.startswith("o_orderpriority_") and n != "o_orderpriority_kterm"]
    kterm = ds.value("o_orderpriority_kterm")
    coded = sum((F.when(c == 1, F.lit(i + 1)) .otherwise(0) for i, c in enumerate(indicators)), F.lit(0))
    pairs = ds.df.select(quoted(ds.label).alias("o_orderstatus"), coded.alias("value"), kterm.alias("kterm"))
    sizes = pairs.groupBy("value").agg(F.count(F.lit(1)).alias("size"))
    judged = pairs.join(sizes, "value")
    return judged.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"),
        F.lit(len(ds.names)).cast("long").alias("features"),
        F.count_if(F.col("kterm") != F.col("size")).alias("wrong"),
    )


def _mixed_sql() -> str:
    source = (
        "raw AS (SELECT CAST(o_totalprice AS DECIMAL(14,2)) AS price, CAST(o_custkey % 100 AS SMALLINT) AS small, "
        "o_totalprice > 150000 AS high, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders), "
        "base AS (SELECT *, count(*) OVER (PARTITION BY high) AS high_kterm, count(*) OVER (PARTITION BY day) AS day_kterm, "
        "dense_rank() OVER (ORDER BY day) - 1 AS day_code FROM raw)"
    )
    items = [("price", "price"), ("small", "small"), ("high_kterm", "high_kterm"), ("day_kterm", "day_kterm"),
             ("high_true", "CASE WHEN high THEN 1 ELSE 0 END"), ("day", "day_code")]
    kept = "count_if(x = 0) < 0.8 * count(*) AND min(x) < max(x)"
    return summary_sql(source, [(n, f"CAST(CAST({e} AS DOUBLE) AS FLOAT)", kept) for n, e in items])


@query("load_mixed_types", _mixed_sql())
def loaded_mixed(spark, sf_dir):
    """Fixed-point, short, boolean and date columns all reach the loaded table."""
    df = load(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.col("o_totalprice").cast("decimal(14,2)").alias("price"),
        (F.col("o_custkey") % 100).cast("short").alias("small"),
        (F.col("o_totalprice") > 150000).alias("high"),
        F.to_date("o_orderdate").alias("day"),
        "o_orderstatus",
    )
    return summary(load_frame(df, "o_orderstatus", "C", "o_orderkey"))


@query(
    "subsample",
    "SELECT least(count(*), 10000)::BIGINT AS n, least(count(*), 10000)::BIGINT AS ids, 0::BIGINT AS unknown FROM orders",
)
def subsample(spark, sf_dir):
    """Exactly 10 000 rows (or all), none twice, none invented."""
    orders = load(spark, sf_dir, "orders")
    taken = sampling.subsample(Dataset.of(orders, ["o_totalprice"], row_id="o_orderkey"), limit=10_000).df
    known = orders.select(F.col("o_orderkey").alias("k"), F.lit(1).alias("known"))
    joined = taken.join(known, F.col("o_orderkey") == F.col("k"), "left")
    return joined.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderkey").alias("ids"), F.count_if(F.col("known").isNull()).alias("unknown"))


@query(
    "balance_classes",
    "WITH b AS (SELECT CASE WHEN value > 150 THEN 'high' WHEN value > 20 THEN 'middle' ELSE 'low' END AS class, event_id FROM events), "
    "s AS (SELECT class, count(*) AS originals FROM b GROUP BY class) "
    "SELECT class, (SELECT max(originals) FROM s) AS n, originals FROM s",
)
def balance(spark, sf_dir):
    """Every class at the size of the largest, every original row kept."""
    level = F.when(F.col("value") > 150, "high").when(F.col("value") > 20, "middle").otherwise("low")
    events = load(spark, sf_dir, "events").select("event_id", "value", level.alias("class"))
    made = sampling.balance(Dataset.of(events, ["value"], "class", row_id="event_id")).df
    return made.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("originals"))


@query("holdout_split")
def holdout(spark, sf_dir):
    ds = Dataset.of(load(spark, sf_dir, "orders"), ["o_totalprice"], row_id="o_orderkey")
    train, test = sampling.holdout(ds, seed=3)
    sides = train.df.select(F.lit("train").alias("side")).unionByName(test.df.select(F.lit("test").alias("side")))
    return sides.groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query(
    "folds_stratified",
    "SELECT o_orderkey, (ntile(5) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1)::INTEGER AS fold FROM orders",
)
def folds_stratified(spark, sf_dir):
    ds = with_folds(Dataset.of(load(spark, sf_dir, "orders"), ["o_totalprice"], "o_orderstatus", "C", "o_orderkey"))
    return ds.df.select("o_orderkey", FOLD)


@query("folds_contiguous", "SELECT event_id, (ntile(5) OVER (ORDER BY event_id) - 1)::INTEGER AS fold FROM events")
def folds_contiguous(spark, sf_dir):
    ds = with_folds(Dataset.of(load(spark, sf_dir, "events"), [], "value", "R", "event_id"))
    return ds.df.select("event_id", FOLD)
