"""Queries over the row-wise and table-fitted operators."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from featloom.dataset import Dataset
from featloom.operators import fitted, rowwise
from featloom.operators.quantiles import exact_quantiles
from featloom.queries.base import by_flag, by_flag_sql, load, query, single, single_sql, summary, summary_sql

WIDE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SERIES = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "gross"]
_SERIES_SQL = (
    "base AS (SELECT l_returnflag, l_linenumber::DOUBLE AS l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, "
    "l_extendedprice * (1 - l_discount) AS gross FROM lineitem)"
)


def _lines(spark, sf_dir, features=WIDE) -> Dataset:
    df = load(spark, sf_dir, "lineitem").withColumn("gross", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return Dataset.of(df, features, "l_returnflag")


_SORTED = "list_sort([l_quantity, l_extendedprice, l_discount, l_tax])"


def _share(q: float) -> str:
    at = q * 3
    i, part = int(at), at - int(at)
    return f"{_SORTED}[{i + 1}] + {part} * ({_SORTED}[{i + 2}] - {_SORTED}[{i + 1}])"


_MEAN = "((l_quantity + l_extendedprice + l_discount + l_tax) / 4)"
ROW_SQL = {
    "p25": _share(0.25),
    "p50": _share(0.5),
    "p75": _share(0.75),
    "std": "sqrt((" + " + ".join(f"({c} - {_MEAN}) ** 2" for c in WIDE) + ") / 4)",
    "max": "greatest(l_quantity, l_extendedprice, l_discount, l_tax)",
    "min": "least(l_quantity, l_extendedprice, l_discount, l_tax)",
}


def _row_query(name):
    def run(spark, sf_dir):
        ds = rowwise.row_aggregate(_lines(spark, sf_dir), name)
        return by_flag(ds.df, {name: ds.value(ds.names[-1])}, "l_returnflag")

    return run


for _name, _sql in ROW_SQL.items():
    query(f"row_{_name}", by_flag_sql(_SERIES_SQL, {_name: _sql}, "l_returnflag"))(_row_query(_name))


@query("row_timeagg", by_flag_sql(_SERIES_SQL, {f"agg_{n}": s for n, s in ROW_SQL.items()}, "l_returnflag"))
def all_row_aggregates(spark, sf_dir):
    ds = rowwise.time_aggregate(_lines(spark, sf_dir))
    made = ds.names[len(WIDE):]
    return by_flag(ds.df, {f"agg_{n}": ds.value(m) for n, m in zip(rowwise.ROW_AGGREGATES, made)}, "l_returnflag")


def _chained_sql() -> str:
    base = "base AS (SELECT l_returnflag, [l_quantity, l_extendedprice, l_discount, l_tax] AS v0 FROM lineitem)"
    steps = []
    for i, q in enumerate((0.25, 0.5, 0.75)):
        steps.append(f"s{i + 1} AS (SELECT *, list_append(v{i}, quantile_of_{i}) AS v{i + 1} FROM (SELECT *, "
                     + _interpolated(f"v{i}", 4 + i, q) + f" AS quantile_of_{i} FROM {'base' if i == 0 else f's{i}'}) t)")
    steps.append("s4 AS (SELECT *, list_append(v3, sd) AS v4 FROM (SELECT *, list_stddev_pop(v3) AS sd FROM s3) t)")
    steps.append("s5 AS (SELECT *, list_append(v4, mx) AS v5 FROM (SELECT *, list_max(v4) AS mx FROM s4) t)")
    columns = {"c25": "quantile_of_0", "c50": "quantile_of_1", "c75": "quantile_of_2", "cstd": "sd", "cmax": "mx", "cmin": "list_min(v5)"}
    return by_flag_sql(", ".join([base, *steps]), columns, "l_returnflag", "s5")


def _interpolated(v: str, n: int, q: float) -> str:
    at = q * (n - 1)
    i, part = int(at), at - int(at)
    low = f"list_sort({v})[{i + 1}]"
    return low if part == 0 else f"{low} + {part} * (list_sort({v})[{i + 2}] - {low})"


@query("row_timeagg_chained", _chained_sql())
def chained_row_aggregates(spark, sf_dir):
    """Every aggregate sees the ones before it as further columns."""
    ds = rowwise.time_aggregate(_lines(spark, sf_dir), chained=True)
    made = ds.names[len(WIDE):]
    names = ["c25", "c50", "c75", "cstd", "cmax", "cmin"]
    return by_flag(ds.df, {n: ds.value(m) for n, m in zip(names, made)}, "l_returnflag")


_DIFFS = {f"diff_{b}": f"{b} - {a}" for a, b in zip(SERIES, SERIES[1:])}


@query("row_diff", by_flag_sql(_SERIES_SQL, {"diff_l_linenumber": "NULL::DOUBLE", **_DIFFS}, "l_returnflag"))
def differences(spark, sf_dir):
    ds = rowwise.column_differences(_lines(spark, sf_dir, SERIES))
    return by_flag(ds.df, {n: ds.value(n) for n in ds.names[len(SERIES):]}, "l_returnflag")


def _rolling_sql() -> str:
    columns = {}
    for i in (4, 5):
        window = "[" + ", ".join(SERIES[i - 4:i + 1]) + "]"
        for short, fn in {"std": "list_stddev_samp", "max": "list_max", "min": "list_min", "mean": "list_avg"}.items():
            columns[f"{short}_{SERIES[i]}"] = f"{fn}({window})"
    return by_flag_sql(_SERIES_SQL, columns, "l_returnflag")


@query("row_rolling_window", _rolling_sql())
def rolling(spark, sf_dir):
    ds = rowwise.rolling_columns(_lines(spark, sf_dir, SERIES))
    columns = {}
    for i in (4, 5):
        for short in ("std", "max", "min", "mean"):
            columns[f"{short}_{SERIES[i]}"] = ds.value(f"tempWinAgg_{short}_{SERIES[i]}")
    return by_flag(ds.df, columns, "l_returnflag")


def _part(spark, sf_dir) -> Dataset:
    return Dataset.of(load(spark, sf_dir, "part"), ["p_size", "p_retailprice"], row_id="p_partkey")


@query(
    "term_frequency",
    "SELECT p_partkey, count(*) OVER (PARTITION BY p_size) AS freq_size, "
    "count(*) OVER (PARTITION BY p_retailprice) AS freq_price FROM part",
)
def term_frequency(spark, sf_dir):
    ds = _part(spark, sf_dir)
    made = fitted.TermFrequency.fit(ds).transform(ds)
    return made.df.select("p_partkey", *[
        F.col(made.by_name[f"ktermfreq_{c}"]).alias(a) for c, a in (("p_size", "freq_size"), ("p_retailprice", "freq_price"))])


@query(
    "term_frequency_unseen",
    "WITH train AS (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'), "
    "f AS (SELECT o_custkey AS k, count(*) AS n FROM train GROUP BY 1) "
    "SELECT coalesce(n, 0) AS freq, count(*) AS orders FROM orders LEFT JOIN f ON o_custkey = k "
    "WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1",
)
def term_frequency_unseen(spark, sf_dir):
    """Frequencies fitted on the older orders, applied to the newer ones; unseen customers get 0."""
    orders = load(spark, sf_dir, "orders")
    cut = F.to_timestamp(F.lit("1998-01-01"))
    train = Dataset.of(orders.filter(F.col("o_orderdate") < cut), ["o_custkey"])
    test = Dataset.of(orders.filter(F.col("o_orderdate") >= cut), ["o_custkey"])
    made = fitted.TermFrequency.fit(train).transform(test)
    return made.df.groupBy(F.col(made.by_name["ktermfreq_o_custkey"]).alias("freq")).agg(F.count(F.lit(1)).alias("orders"))


def _quantile_sql() -> str:
    columns = ("p_size", "p_retailprice")
    points = " UNION ALL ".join(f"SELECT p_partkey, '{c}' AS feature, {c}::DOUBLE AS x FROM part" for c in columns)
    marks = (
        "SELECT p.feature, i, lo.x + (hi.x - lo.x) * (pos - floor(pos)) AS v FROM "
        "(SELECT feature, i, i * (n - 1) / q AS pos FROM (SELECT feature, n, q, unnest(range(q + 1)) AS i FROM sizes) u) p "
        "JOIN ranked lo ON lo.feature = p.feature AND lo.k = floor(pos) JOIN ranked hi ON hi.feature = p.feature AND hi.k = ceil(pos)"
    )
    between = "(a + (x - va) / (vb - va)) / q"
    return (
        f"WITH points AS ({points}), ranked AS (SELECT feature, x, row_number() OVER (PARTITION BY feature ORDER BY x) - 1 AS k FROM points), "
        "sizes AS (SELECT feature, count(*) AS n, least(1000, count(*)) - 1 AS q FROM points GROUP BY feature), "
        f"marks AS ({marks}), near AS (SELECT p_partkey, p.feature, x, "
        "max(CASE WHEN v <= x THEN i END) AS a, min(CASE WHEN v >= x THEN i END) AS b, "
        "max(CASE WHEN v <= x THEN v END) AS va, min(CASE WHEN v >= x THEN v END) AS vb "
        "FROM points p JOIN marks m ON p.feature = m.feature GROUP BY p_partkey, p.feature, x) "
        "SELECT p_partkey, feature, "
        + single_sql(
            f"0.5 * (CASE WHEN va = x THEN a / q ELSE {between} END + CASE WHEN vb = x THEN b / q ELSE {between} END)"
        )
        + " AS q FROM near JOIN sizes USING (feature)"
    )


@query("quantile_map", _quantile_sql())
def quantile_map(spark, sf_dir):
    """Uniform quantile transform of two columns, row by row."""
    ds = _part(spark, sf_dir)
    made = fitted.QuantileMap.fit(ds).transform(ds)
    pairs = F.array(*[
        F.struct(F.lit(c).alias("feature"), single(F.col(made.by_name[f"quanTransform{c}"])).alias("q")) for c in ds.names])
    return made.df.select("p_partkey", F.explode(pairs).alias("s")).select("p_partkey", "s.feature", "s.q")


def _quantile_points_sql() -> str:
    shares = "[0.0, 0.001, 0.05, 0.25, 0.5, 0.75, 0.95, 0.999, 1.0]"
    parts = [
        f"SELECT '{c}' AS feature, unnest({shares}) AS share, {single_sql(f'unnest((SELECT quantile_cont({c}::DOUBLE, {shares}) FROM lineitem))')} AS value"
        for c in ("l_quantity", "l_extendedprice")
    ]
    return "SELECT feature, share::DOUBLE AS share, value FROM (" + " UNION ALL ".join(parts) + ") t"


@query("exact_quantiles", _quantile_points_sql())
def quantile_points(spark, sf_dir):
    shares = [0.0, 0.001, 0.05, 0.25, 0.5, 0.75, 0.95, 0.999, 1.0]
    found = exact_quantiles(_lines(spark, sf_dir, ["l_quantity", "l_extendedprice"]), shares)
    rows = [(n, p, float(v)) for n, values in found.items() for p, v in zip(shares, values)]
    frame = spark.createDataFrame(rows, "feature string, share double, value double")
    return frame.withColumn("value", single(F.col("value")))


_BINS = ["l_linenumber", "l_discount", "l_tax"]


@query(
    "binning",
    "WITH b AS (SELECT l_returnflag, " + ", ".join(f"dense_rank() OVER (ORDER BY {c}) - 1 AS {c}_bin" for c in _BINS)
    + " FROM lineitem) SELECT l_returnflag, count(*) AS n, " + ", ".join(f"sum({c}_bin)::BIGINT AS {c}_bins" for c in _BINS)
    + " FROM b GROUP BY l_returnflag",
)
def binning(spark, sf_dir):
    """Columns with at most 16 values get one bin per value."""
    ds = _lines(spark, sf_dir, _BINS)
    made = fitted.Binning.fit(ds).transform(ds)
    return made.df.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(made.value(f"binning_{c}")).cast("long").alias(f"{c}_bins") for c in _BINS])


_STEPS = 8


def _line_means_sql() -> str:
    """One-dimensional k-means from evenly spaced quantiles, a few steps, and the bins they end in."""
    starts = "list_value(" + ", ".join(str((i + 0.5) / 16) for i in range(16)) + ")"
    parts = [
        "v AS (SELECT CAST(l_extendedprice AS DOUBLE) AS x FROM lineitem)",
        f"c0 AS (SELECT list_sort(list_distinct(quantile_cont(x, {starts}))) AS c FROM v)",
    ]
    place = "len(list_filter(range(1, len(c)), lambda i: (c[i] + c[i + 1]) / 2 < x)) + 1"
    for i in range(_STEPS):
        parts.append(f"m{i} AS (SELECT {place} AS j, avg(x) AS m FROM v, c{i} GROUP BY 1)")
        parts.append(f"c{i + 1} AS (SELECT list(m ORDER BY j) AS c FROM m{i})")
    return (
        "WITH " + ", ".join(parts) + f" SELECT ({place} - 1)::INTEGER AS bin, count(*) AS n, min(x) AS lo, max(x) AS hi FROM v, c{_STEPS} GROUP BY 1"
    )


@query("binning_continuous", _line_means_sql())
def binning_continuous(spark, sf_dir):
    """Bins of a column with many values after a fixed number of steps."""
    ds = _lines(spark, sf_dir, ["l_quantity", "l_extendedprice"])
    made = fitted.Binning.fit(ds, rounds=_STEPS, tolerance=0.0).transform(ds)
    return made.df.groupBy(made.value("binning_l_extendedprice").cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))


@query("binning_until_still")
def binning_until_still(spark, sf_dir):
    """The same with the defaults: until the centres hardly move."""
    ds = _lines(spark, sf_dir, ["l_quantity", "l_extendedprice", "l_discount"])
    made = fitted.Binning.fit(ds).transform(ds)
    return made.df.groupBy(made.value("binning_l_extendedprice").cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))


@query("clustering")
def clustering(spark, sf_dir):
    ds = _lines(spark, sf_dir)
    made = fitted.Clustering.fit(ds).transform(ds)
    return made.df.groupBy(made.value("clustering_whole").cast("int").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))


@query("spatial_aggregate")
def spatial(spark, sf_dir):
    ds = _lines(spark, sf_dir)
    made = fitted.SpatialAggregate.fit(ds, k=8).transform(ds)
    labels = [n for n in made.names if n.startswith("spatialAgg")]
    # Rows with the same labels are counted before they become a row per label.
    alike = made.df.groupBy(*[made.value(n).alias(n) for n in labels]).agg(F.count(F.lit(1)).alias("rows"))
    sizes = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("cluster")) for n in labels]))
    return alike.select(sizes.alias("s"), "rows").groupBy("s.feature", "s.cluster").agg(F.sum("rows").alias("n"))


def _expansion_sql() -> str:
    items = [("1", "1.0", None)]
    for size in (1, 2, 3):
        items += [(" ".join(c), " * ".join(c), None) for c in combinations(WIDE, size)]
    return summary_sql(_SERIES_SQL, items)


@query("nominal_expansion", _expansion_sql())
def expansion(spark, sf_dir):
    ds = _lines(spark, sf_dir)
    return summary(fitted.NominalExpansion.fit(ds).transform(ds))


_HOLES_SQL = (
    "raw AS (SELECT nullif(l_linenumber, 3)::DOUBLE AS few, CASE WHEN l_quantity > 30 THEN l_quantity END AS many, "
    "CASE WHEN l_discount = 0 THEN 'infinity'::DOUBLE ELSE l_discount END AS inf, l_tax FROM lineitem), "
    "fin AS (SELECT few, many, CASE WHEN isinf(inf) THEN NULL ELSE inf END AS inf, l_tax FROM raw), "
    "base AS (SELECT coalesce(few, (SELECT avg(few) FROM fin)) AS few, coalesce(many, (SELECT avg(many) FROM fin)) AS many, "
    "coalesce(inf, (SELECT avg(inf) FROM fin)) AS inf, l_tax FROM fin)"
)


@query(
    "pre_clean",
    summary_sql(
        _HOLES_SQL,
        [(c, c, f"(SELECT count(*) - count({c}) FROM fin) < 0.3 * (SELECT count(*) FROM fin)") for c in ("few", "many", "inf", "l_tax")],
    ),
)
def pre_clean(spark, sf_dir):
    """Infinity as missing, sparse columns dropped, means filled in."""
    li = load(spark, sf_dir, "lineitem")
    df = li.select(
        F.nullif("l_linenumber", F.lit(3)).cast("double").alias("few"),
        F.when(F.col("l_quantity") > 30, F.col("l_quantity")).alias("many"),
        F.when(F.col("l_discount") == 0, float("inf")).otherwise(F.col("l_discount")).alias("inf"),
        "l_tax",
    )
    ds = Dataset.of(df)
    return summary(fitted.PreClean.fit(ds).transform(ds))


@query(
    "standardise_with_train",
    summary_sql(
        "tr AS (SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01'), "
        "base AS (SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01')",
        [(c, f"({c} - (SELECT avg({c}) FROM tr)) / (SELECT stddev_pop({c}) FROM tr)", None) for c in WIDE],
    ),
)
def standardise(spark, sf_dir):
    """Scaler fitted on the older rows, applied to the newer ones."""
    li = load(spark, sf_dir, "lineitem")
    cut = F.to_timestamp(F.lit("1999-01-01"))
    train, test = Dataset.of(li.filter(F.col("l_shipdate") < cut), WIDE), Dataset.of(li.filter(F.col("l_shipdate") >= cut), WIDE)
    return summary(fitted.Standardise.fit(train).transform(test))
