"""Queries over metrics, fitness, model-derived features and selection."""

from __future__ import annotations

from functools import partial

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from featloom.dataset import Dataset
from featloom.functions import metrics
from featloom.operators import supervised as M
from featloom.operators.encoding import encode_label
from featloom.operators.expr import Ref
from featloom.operators.folds import FOLD, with_folds
from featloom.operators.generate import append, children
from featloom.operators.neighbors import NearestNeighbours
from featloom.operators.ordering import forward_fill
from featloom.operators.process import NOISES
from featloom.plans import search as H
from featloom.plans import selection as K
from featloom.plans.fitness import (
    ForestScorer,
    HoldoutScorer,
    LinearScorer,
    baseline_scores,
    permutation_importance,
    score_compare,
)
from featloom.queries.base import (
    LINE_FEATURES,
    LINE_SQL,
    least_squares_sql,
    line_items,
    load,
    query,
    single,
    single_sql,
)
from featloom.session import materialise

_DIMENSIONS = 64


def _orders(spark, sf_dir, task="C") -> Dataset:
    """Orders with three numeric features; the status as class or the price as target."""
    df = load(spark, sf_dir, "orders").withColumn("day", F.dayofyear("o_orderdate").cast("double"))
    df = df.withColumn("priority", F.substring("o_orderpriority", 1, 1).cast("double"))
    if task == "R":
        return Dataset.of(df, ["o_custkey", "day", "priority"], "o_totalprice", "R", "o_orderkey")
    df, _ = encode_label(df, "o_orderstatus", "status")
    return Dataset.of(df, ["o_totalprice", "day", "priority"], "status", "C", "o_orderkey")


def _parts(spark, sf_dir) -> Dataset:
    """Part prices; the size and the key as features."""
    df = load(spark, sf_dir, "part").withColumn("id", F.col("p_partkey"))
    return Dataset.of(df, ["p_partkey", "p_size"], "p_retailprice", "R", "id")


def _part_brands(spark, sf_dir) -> Dataset:
    df = load(spark, sf_dir, "part").withColumn("id", F.col("p_partkey"))
    df = df.withColumn("cheap", (F.col("p_retailprice") < 950).cast("double"))
    return Dataset.of(df, ["p_partkey", "p_size"], "cheap", "C", "id")


def _vectors(spark, sf_dir) -> Dataset:
    df = load(spark, sf_dir, "embeddings")
    wide = df.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(_DIMENSIONS)])
    return Dataset.of(wide, [f"e{i}" for i in range(_DIMENSIONS)], "label", "C", "vec_id")


def _folded(ds: Dataset) -> Dataset:
    ds = with_folds(ds)
    return ds.with_df(materialise(ds.df, "folds"))


# Metrics over a fixed predictor: the quantity decides the class, a constant factor the price.
_PREDICTED_SQL = (
    "base AS (SELECT l_linestatus, l_extendedprice AS y, l_quantity * 1500 AS p, l_returnflag AS actual, "
    "CASE WHEN l_quantity < 20 THEN 'A' WHEN l_quantity < 35 THEN 'N' ELSE 'R' END AS predicted FROM lineitem)"
)


def _predicted(spark, sf_dir):
    guess = F.when(F.col("l_quantity") < 20, "A").when(F.col("l_quantity") < 35, "N").otherwise("R")
    return load(spark, sf_dir, "lineitem").select(
        "l_linestatus", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"),
        F.col("l_returnflag").alias("actual"), guess.alias("predicted"))


@query(
    "relative_absolute_error",
    f"WITH {_PREDICTED_SQL}, m AS (SELECT l_linestatus AS s, avg(y) AS mean FROM base GROUP BY 1) "
    f"SELECT l_linestatus, {single_sql('sum(abs(y - p)) / sum(abs(y - mean))')} AS rae FROM base JOIN m ON s = l_linestatus GROUP BY 1",
)
def rae(spark, sf_dir):
    found = metrics.relative_absolute_error(_predicted(spark, sf_dir), "y", "p", ["l_linestatus"])
    return found.select("l_linestatus", single(F.col("rae")).alias("rae"))


_F1_PARTS = (
    "cells AS (SELECT l_linestatus AS s, actual, predicted, count(*) AS n FROM base GROUP BY 1, 2, 3), "
    "k AS (SELECT DISTINCT s, actual AS cls FROM cells UNION SELECT DISTINCT s, predicted FROM cells), "
    "parts AS (SELECT k.s, k.cls, sum(CASE WHEN actual = cls AND predicted = cls THEN n ELSE 0 END) AS hits, "
    "sum(CASE WHEN actual = cls THEN n ELSE 0 END) AS support, sum(CASE WHEN predicted = cls THEN n ELSE 0 END) AS guessed "
    "FROM k JOIN cells ON k.s = cells.s GROUP BY k.s, k.cls)"
)
_F1_SQL = _F1_PARTS + (
    f" SELECT s AS l_linestatus, {single_sql('sum(2.0::DOUBLE * hits / (support + guessed) * support) / sum(support)')} AS f1 FROM parts GROUP BY s"
)


@query("weighted_f1", f"WITH {_PREDICTED_SQL}, {_F1_SQL}")
def f1(spark, sf_dir):
    counts = metrics.confusion(_predicted(spark, sf_dir), "actual", "predicted", ["l_linestatus"])
    found = metrics.weighted_f1(counts, ["l_linestatus"])
    return found.select("l_linestatus", single(F.col("f1")).alias("f1"))


@query("confusion", f"WITH {_PREDICTED_SQL} SELECT actual, predicted, count(*) AS n FROM base GROUP BY 1, 2")
def confusion(spark, sf_dir):
    return metrics.confusion(_predicted(spark, sf_dir), "actual", "predicted")


def _linear_sql() -> str:
    return (
        "WITH b AS (SELECT p_retailprice AS y, p_size::DOUBLE AS x, ntile(5) OVER (ORDER BY p_partkey) AS fold FROM part), "
        "f AS (SELECT DISTINCT fold AS f FROM b), "
        "m AS (SELECT f, regr_slope(y, x) AS a, regr_intercept(y, x) AS c FROM f JOIN b ON fold <> f GROUP BY f), "
        "t AS (SELECT fold AS tf, avg(y) AS mean FROM b GROUP BY 1), "
        "r AS (SELECT fold, sum(abs(y - (a * x + c))) / sum(abs(y - mean)) AS rae FROM b JOIN m ON fold = f JOIN t ON fold = tf GROUP BY fold) "
        f"SELECT {single_sql('1 - avg(rae)')} AS fitness, {single_sql('stddev_pop(rae)')} AS std FROM r"
    )


@query("fitness_linear_regression", _linear_sql())
def linear_fitness(spark, sf_dir):
    """Five-fold 1 - relative absolute error of a linear model: two passes, no fit per fold."""
    ds = _folded(_parts(spark, sf_dir))
    fitness, std = LinearScorer(ridge=0.0).score(ds, [Ref("p_size")])
    frame = spark.createDataFrame([(fitness, std)], "fitness double, std double")
    return frame.select(single(F.col("fitness")).alias("fitness"), single(F.col("std")).alias("std"))


def _linear_class_sql() -> str:
    label = "CASE WHEN p_retailprice < 950 THEN 1 ELSE 0 END"
    return (
        f"WITH b AS (SELECT {label} AS y, p_partkey::DOUBLE AS x, "
        f"ntile(5) OVER (PARTITION BY {label} ORDER BY p_partkey) AS fold FROM part), f AS (SELECT DISTINCT fold AS f FROM b), "
        "m AS (SELECT f, regr_slope(y, x) AS a, regr_intercept(y, x) AS c FROM f JOIN b ON fold <> f GROUP BY f), "
        "base AS (SELECT fold AS l_linestatus, y AS actual, CASE WHEN a * x + c > 0.5 THEN 1 ELSE 0 END AS predicted "
        "FROM b JOIN m ON fold = f), "
        + _F1_PARTS
        + ", folds AS (SELECT s, sum(2.0::DOUBLE * hits / (support + guessed) * support) / sum(support) AS f1 FROM parts GROUP BY s) "
        f"SELECT {single_sql('avg(f1)')} AS fitness, {single_sql('stddev_pop(f1)')} AS std FROM folds"
    )


@query("fitness_linear_classification", _linear_class_sql())
def linear_class_fitness(spark, sf_dir):
    """Five-fold weighted F1 of a linear model on class indicators."""
    ds = _folded(_part_brands(spark, sf_dir))
    fitness, std = LinearScorer(ridge=0.0).score(ds, [Ref("p_partkey")])
    frame = spark.createDataFrame([(fitness, std)], "fitness double, std double")
    return frame.select(single(F.col("fitness")).alias("fitness"), single(F.col("std")).alias("std"))


_ORDER_FOLDS = (
    "SELECT o_totalprice, dayofyear(o_orderdate)::DOUBLE AS day, substring(o_orderpriority, 1, 1)::DOUBLE AS priority, "
    "dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS y, ntile(5) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS fold FROM orders"
)
_BRAND = "CASE WHEN p_retailprice < 950 THEN 1 ELSE 0 END"
_BRAND_FOLDS = (
    f"SELECT p_partkey::DOUBLE AS p_partkey, p_size::DOUBLE AS p_size, {_BRAND} AS y, ntile(5) OVER (PARTITION BY {_BRAND} ORDER BY p_partkey) AS fold FROM part"
)
_PRICE_FOLDS = "SELECT p_partkey::DOUBLE AS p_partkey, p_size::DOUBLE AS p_size, p_retailprice AS y, ntile(5) OVER (ORDER BY p_partkey) AS fold FROM part"


def _class_fitness_sql(rows: str, xs) -> str:
    """Cross-validated weighted F1 of least squares on class indicators, the largest wins."""
    fits, predicted = least_squares_sql("m", "src", "t", xs, ["f", "c"])
    return (
        f"WITH b AS ({rows}), every AS (SELECT DISTINCT y AS c FROM b), "
        "src AS (SELECT b.*, f, c, (y = c)::INTEGER::DOUBLE AS t FROM b, every, (SELECT DISTINCT fold AS f FROM b) WHERE fold <> f), "
        f"{fits}, numbered AS (SELECT row_number() OVER () AS id, * FROM b), "
        f"base AS (SELECT any_value(r.fold) AS l_linestatus, any_value(r.y) AS actual, arg_max(m.c, {predicted}) AS predicted "
        "FROM numbered r JOIN m ON m.f = r.fold GROUP BY r.id), " + _F1_PARTS
        + ", folds AS (SELECT s, sum(2.0::DOUBLE * hits / (support + guessed) * support) / sum(support) AS f1 FROM parts GROUP BY s) "
        f"SELECT {single_sql('round(avg(f1), 8)')} AS fitness, {single_sql('round(stddev_pop(f1), 8)')} AS std FROM folds"
    )


def _value_fitness_sql(rows: str, xs) -> str:
    """Cross-validated 1 - relative absolute error of least squares."""
    fits, predicted = least_squares_sql("m", "src", "y", xs, ["f"])
    return (
        f"WITH b AS ({rows}), src AS (SELECT b.*, f FROM b, (SELECT DISTINCT fold AS f FROM b) WHERE fold <> f), {fits}, "
        "t AS (SELECT fold AS tf, avg(y) AS mean FROM b GROUP BY 1), "
        f"e AS (SELECT r.fold, sum(abs(r.y - ({predicted}))) / sum(abs(r.y - mean)) AS rae FROM b r JOIN m ON m.f = r.fold JOIN t ON tf = r.fold GROUP BY 1) "
        f"SELECT {single_sql('round(1 - avg(rae), 8)')} AS fitness, {single_sql('round(stddev_pop(rae), 8)')} AS std FROM e"
    )


_SETS = [["o_totalprice"], ["day", "priority"], ["o_totalprice", "day", "priority"]]


def _scores(frame):
    return frame.withColumns({c: single(F.round(c, 8)) for c in ("fitness", "std")})


@query("fitness_of_many_sets", " UNION ALL ".join(f"SELECT '{'+'.join(g)}' AS features, * FROM ({_class_fitness_sql(_ORDER_FOLDS, g)})" for g in _SETS))
def many_sets(spark, sf_dir):
    """Weighted F1 of many feature sets at once."""
    ds = _folded(_orders(spark, sf_dir))
    scores = LinearScorer(ridge=0.0).score_many(ds, [[Ref(n) for n in g] for g in _SETS])
    rows = [("+".join(g), f, s) for g, (f, s) in zip(_SETS, scores)]
    return _scores(spark.createDataFrame(rows, "features string, fitness double, std double"))


@query("fitness_forest_classification")
def forest_fitness(spark, sf_dir):
    ds = _folded(_part_brands(spark, sf_dir))
    return spark.createDataFrame([ForestScorer(trees=20, depth=5).score(ds)], "fitness double, std double")


@query("fitness_forest_regression")
def forest_regression(spark, sf_dir):
    ds = _folded(_parts(spark, sf_dir))
    return spark.createDataFrame([ForestScorer(trees=20, depth=8).score(ds)], "fitness double, std double")


@query("fitness_holdout")
def holdout_fitness(spark, sf_dir):
    """Mean of three 75/25 splits for both tasks."""
    scorer = HoldoutScorer(trees=20, depth=5)
    rows = [(t, *scorer.score(d)) for t, d in (("C", _part_brands(spark, sf_dir)), ("R", _parts(spark, sf_dir)))]
    return spark.createDataFrame(rows, "task string, fitness double, std double")


@query("fitness_of_subset", _class_fitness_sql(_BRAND_FOLDS, ["p_size"]))
def subset_fitness(spark, sf_dir):
    ds = _folded(_part_brands(spark, sf_dir))
    return _scores(spark.createDataFrame([LinearScorer(ridge=0.0).score(ds.keep(["p_size"]))], "fitness double, std double"))


@query(
    "baseline_scores",
    f"SELECT 'brands' AS dataset, 2 AS features, * FROM ({_class_fitness_sql(_BRAND_FOLDS, ['p_partkey', 'p_size'])}) UNION ALL "
    f"SELECT 'prices' AS dataset, 2 AS features, * FROM ({_value_fitness_sql(_PRICE_FOLDS, ['p_partkey', 'p_size'])})",
)
def baselines(spark, sf_dir):
    """Both tasks scored as loaded."""
    datasets = {"brands": _folded(_part_brands(spark, sf_dir)), "prices": _folded(_parts(spark, sf_dir))}
    return _scores(baseline_scores(datasets, LinearScorer(ridge=0.0)))


@query(
    "score_compare",
    "SELECT fitness AS initial, std AS initial_std, fitness AS current, std AS current_std, 0.0::DOUBLE AS increase "
    f"FROM ({_value_fitness_sql(_PRICE_FOLDS, ['p_partkey', 'p_size'])})",
)
def compare(spark, sf_dir):
    """Fitness of the base features, of the derived ones, and the relative increase: none, as a sum of features adds nothing to a linear score."""
    ds = _folded(_parts(spark, sf_dir))
    made, _ = children(ds, "add")
    found = score_compare(ds, _folded(append(ds, made)), LinearScorer(ridge=0.0))
    rounded = {c: single(F.round(c, 8)) for c in ("initial", "initial_std", "current", "current_std")}
    return found.withColumns({**rounded, "increase": F.round("increase", 6) + F.lit(0.0)})


@query("permutation_importance")
def importance(spark, sf_dir):
    return permutation_importance(_parts(spark, sf_dir), ForestScorer(trees=20, depth=8), repeats=2)


@query("permutation_selected")
def permutation_selected(spark, sf_dir):
    kept = K.permutation_selected(_orders(spark, sf_dir), repeats=1)
    return spark.createDataFrame([(n,) for n in kept.names], "feature string")


@query(
    "forward_fill",
    "WITH b AS (SELECT event_id, CASE WHEN event_type = 'click' THEN value END AS click, "
    "CASE WHEN event_type = 'error' THEN value END AS error FROM events) "
    "SELECT event_id, last_value(click IGNORE NULLS) OVER w AS click, last_value(error IGNORE NULLS) OVER w AS error "
    "FROM b WINDOW w AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
)
def filled(spark, sf_dir):
    df = load(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_type") == "click", F.col("value")).alias("click"),
        F.when(F.col("event_type") == "error", F.col("value")).alias("error"),
    )
    return forward_fill(df, ["click", "error"], "event_id")


@query(
    "linear_prediction",
    "WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS c FROM lineitem) "
    f"SELECT l_returnflag, count(*) AS n, {single_sql('avg(a * l_quantity + c)')} AS linear_pred, 0.0::DOUBLE AS linear_pred_diff "
    "FROM lineitem, m GROUP BY l_returnflag",
)
def linear(spark, sf_dir):
    """Prediction of a linear model, and the linear model of its residual (zero up to rounding)."""
    ds = Dataset.of(load(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice", "R")
    made = M.linear_regression().fit(ds).transform(ds)
    diff = F.round(F.avg(made.value("linear_pred_diff")), 4) + F.lit(0.0)
    return made.df.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), single(F.avg(made.value("linear_pred"))).alias("linear_pred"), diff.alias("linear_pred_diff"))


@query(
    "leaky_info",
    "WITH b AS (SELECT l_returnflag, l_quantity AS q, l_extendedprice AS e FROM lineitem), "
    "m AS (SELECT regr_slope(q, e) AS a1, regr_intercept(q, e) AS c1, regr_slope(e, q) AS a2, regr_intercept(e, q) AS c2 FROM b) "
    f"SELECT l_returnflag, {single_sql('avg(abs(a1 * e + c1 - q))')} AS quantity_leaky, {single_sql('avg(abs(a2 * q + c2 - e))')} AS price_leaky "
    "FROM b, m GROUP BY l_returnflag",
)
def leaky(spark, sf_dir):
    ds = Dataset.of(load(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"], "l_discount", "R")
    made = M.LeakyInfo.fit(ds).transform(Dataset.of(ds.df, ds.names, "l_returnflag"))
    return made.df.groupBy("l_returnflag").agg(
        single(F.avg(F.abs(made.value("l_quantity_leaky")))).alias("quantity_leaky"),
        single(F.avg(F.abs(made.value("l_extendedprice_leaky")))).alias("price_leaky"))


_DISTANCE = "list_distance(CAST(q.embedding AS DOUBLE[]), CAST(t.embedding AS DOUBLE[]))"
_NEAR_SQL = (
    "WITH d AS (SELECT q.vec_id AS vec_id, t.label AS label, row_number() OVER (PARTITION BY q.vec_id ORDER BY "
    f"{_DISTANCE}, t.vec_id) AS r FROM embeddings q, embeddings t) "
)


@query(
    "neighbour_classes",
    _NEAR_SQL + "SELECT vec_id, " + ", ".join(f"count_if(label = {i})::DOUBLE AS nn_{i}" for i in range(10))
    + " FROM d WHERE r <= 5 GROUP BY vec_id",
)
def neighbour_classes(spark, sf_dir):
    """Neighbours per class among the five nearest rows."""
    ds = _vectors(spark, sf_dir)
    made = NearestNeighbours.fit(ds).transform(ds)
    return made.df.select("vec_id", *[made.value(f"nn_{i}").alias(f"nn_{i}") for i in range(10)])


@query("neighbour_target", _NEAR_SQL + f"SELECT vec_id, {single_sql('avg(label)')} AS nn_target FROM d WHERE r <= 5 GROUP BY vec_id")
def neighbour_target(spark, sf_dir):
    """Mean label of the five nearest rows, found cell by cell instead of by broadcast."""
    base = _vectors(spark, sf_dir)
    ds = Dataset.of(base.df, base.names, "label", "R", "vec_id")
    made = NearestNeighbours.fit(ds, max_cells=0).transform(ds)
    return made.df.select("vec_id", single(made.value("nn_target")).alias("nn_target"))


def _stacked(make, dataset):
    def run(spark, sf_dir):
        ds = dataset(spark, sf_dir)
        made = make().fit(ds).transform(ds)
        added = [n for n in made.names if n not in set(ds.names)]
        cells = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), made.value(n).alias("v")) for n in added]))
        return made.df.select(cells.alias("s")).groupBy("s.feature").agg(
            F.count("s.v").alias("n"), F.avg("s.v").alias("mean"), F.stddev_pop("s.v").alias("std"))

    return run


for _name, _make, _data in [
    ("svr_prediction", M.support_vector_regression, _parts),
    ("svc_prediction", M.support_vector_classification, _part_brands),
    ("dot_product_regression", partial(M.dot_product_process, "R"), _parts),
    ("dot_product_classification", partial(M.dot_product_process, "C"), _part_brands),
    ("rational_quadratic_regression", partial(M.rational_quadratic_process, "R"), _parts),
    ("rational_quadratic_classification", partial(M.rational_quadratic_process, "C"), _part_brands),
    ("rbf_regression", partial(M.rbf_process, "R"), _parts),
    ("rbf_classification", partial(M.rbf_process, "C"), _part_brands),
    ("forest_classification", partial(M.random_forest, "C", trees=20), _orders),
    ("forest_regression", partial(M.random_forest, "R", trees=20), _parts),
    ("boosting_classification", partial(M.gradient_boosting, "C"), _orders),
    ("boosting_regression", partial(M.gradient_boosting, "R"), _parts),
]:
    query(_name)(_stacked(_make, _data))


def _fitted(kind, dataset):
    def run(spark, sf_dir):
        return _stacked(lambda: kind, dataset)(spark, sf_dir)

    return run


_STUMP_FEATURES = ["l_linenumber", "l_quantity", "l_discount", "l_tax"]


def _stumps_sql() -> str:
    """Every threshold of every feature: gains in closed form, the best per class."""
    cells = " UNION ALL ".join(f"SELECT {i} AS f, CAST({c} AS DOUBLE) AS x, y FROM b" for i, c in enumerate(_STUMP_FEATURES))
    gain = "gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1)"
    return (
        "WITH b AS (SELECT *, dense_rank() OVER (ORDER BY l_returnflag) - 1 AS y FROM lineitem), "
        "k AS (SELECT DISTINCT y AS k FROM b), p AS (SELECT 1.0::DOUBLE / count(*) AS p FROM k), "
        f"cells AS ({cells}), n AS (SELECT f, x, k, sum(p - (y = k)::INTEGER) AS g, count(*) * 2 * max(p) * (1 - max(p)) AS h FROM cells, k, p GROUP BY 1, 2, 3), "
        "s AS (SELECT f, k, x AS threshold, sum(g) OVER w - g AS gl, sum(h) OVER w - h AS hl, sum(g) OVER (PARTITION BY f, k) AS g, "
        "sum(h) OVER (PARTITION BY f, k) AS h FROM n WINDOW w AS (PARTITION BY f, k ORDER BY x)), "
        f"r AS (SELECT *, {gain} AS gain FROM s WHERE hl >= 1 AND h - hl >= 1), "
        "best AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(gain, 6) DESC, f, threshold) AS place FROM r) "
        f"SELECT k::INTEGER AS class, f::INTEGER AS feature, threshold, {single_sql('gain')} AS gain, "
        f"{single_sql('-0.3 * gl / (hl + 1)')} AS left_weight, {single_sql('-0.3 * (g - gl) / (h - hl + 1)')} AS right_weight FROM best WHERE place = 1"
    )


@query("boosting_stumps", _stumps_sql())
def stumps(spark, sf_dir):
    """One round of trees of depth one, a tree per class."""
    coded, _ = encode_label(load(spark, sf_dir, "lineitem"), "l_returnflag", "y")
    ds = Dataset.of(coded, _STUMP_FEATURES, "y")
    model = M._fit_model(M.HistogramBoosting(3, rounds=1, depth=1), M._inputs(ds, None), F.col("y").cast("double"))
    rows = [(k, t.feature[0], t.threshold[0], t.gain[0], t.weight[1], t.weight[2]) for k, t in enumerate(model.rounds[0])]
    frame = spark.createDataFrame(rows, "class int, feature int, threshold double, gain double, left_weight double, right_weight double")
    return frame.withColumns({c: single(F.col(c)) for c in ("gain", "left_weight", "right_weight")})


def _dot_process_sql() -> str:
    """Two standardised features and a constant: the posterior of three weights, the noise by the marginal likelihood."""
    noises = ", ".join(f"({v})" for v in NOISES)
    return (
        "WITH b AS (SELECT p_brand, p_partkey::DOUBLE AS a, p_size::DOUBLE AS s, p_retailprice AS y FROM part), "
        "g AS (SELECT count(*)::DOUBLE AS n, avg(a) AS ma, stddev_pop(a) AS sa, avg(s) AS ms, stddev_pop(s) AS ss, avg(y) AS my, stddev_pop(y) AS sy, "
        "corr(a, s) AS r, corr(a, y) AS ra, corr(s, y) AS rs FROM b), "
        f"v AS (SELECT CAST(column0 AS DOUBLE) AS v FROM (VALUES {noises}) AS given(column0)), "
        "d AS (SELECT *, 1 + n / v AS p, n * r / v AS o FROM g, v), e AS (SELECT *, p * p - o * o AS det, n * ra / v AS ba, n * rs / v AS bs FROM d), "
        "w AS (SELECT *, (p * ba - o * bs) / det AS wa, (p * bs - o * ba) / det AS ws FROM e), "
        "l AS (SELECT *, -0.5 * (n * ln(2 * pi() * v) + ln(p * det) + n / v - (ba * wa + bs * ws)) AS likelihood FROM w), "
        "best AS (SELECT * FROM l ORDER BY likelihood DESC LIMIT 1), "
        "z AS (SELECT p_brand, (a - ma) / sa AS za, (s - ms) / ss AS zs, best.* FROM b, best) "
        f"SELECT p_brand, count(*) AS n, {single_sql('avg(my + sy * (wa * za + ws * zs))')} AS mean, "
        f"{single_sql('avg(sy * sy * (1 / p + (p * za * za + p * zs * zs - 2 * o * za * zs) / det))')} AS variance FROM z GROUP BY p_brand"
    )


@query("dot_product_process", _dot_process_sql())
def dot_process(spark, sf_dir):
    """Posterior mean and variance per brand."""
    ds = _parts(spark, sf_dir)
    model = M._fit_model(M.InducingProcess(M.DOT), M._inputs(ds, None), F.col("p_retailprice"))
    found = model.transform(M._inputs(ds, None))
    return found.groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("n"), single(F.avg("__p")).alias("mean"), single(F.avg("__variance")).alias("variance"))


query("tree_features_classification")(_fitted(M.TreeFeatures, _orders))
query("tree_features_regression")(_fitted(M.TreeFeatures, _parts))
query("network_embedding")(_fitted(M.NetworkEmbedding, _part_brands))


def _anova_wide_sql(keep: int) -> str:
    cells = " UNION ALL ".join(f"SELECT 'e{i}' AS feature, {i} AS pos, label AS y, embedding[{i + 1}]::DOUBLE AS x FROM embeddings" for i in range(_DIMENSIONS))
    return (
        f"WITH long AS ({cells}), g AS (SELECT feature, pos, y, count(*) AS n, avg(x) AS m, var_pop(x) * count(*) AS ss FROM long GROUP BY 1, 2, 3), "
        "t AS (SELECT feature, sum(n) AS nn, sum(n * m) / sum(n) AS gm, count(*) AS k, sum(ss) AS w FROM g GROUP BY 1), "
        "f AS (SELECT g.feature, g.pos, (sum(n * (m - gm) * (m - gm)) / (max(k) - 1)) / (max(w) / (max(nn) - max(k))) AS score "
        "FROM g JOIN t ON g.feature = t.feature GROUP BY 1, 2) "
        f"SELECT feature, pos::INTEGER AS pos FROM f ORDER BY score DESC, pos LIMIT {keep}"
    )


def _positions(spark, kept: Dataset, base: Dataset):
    at = {n: i for i, n in enumerate(base.names)}
    return spark.createDataFrame([(n, at[n]) for n in kept.names], "feature string, pos int")


@query("best_features", _anova_wide_sql(10))
def best(spark, sf_dir):
    ds = _vectors(spark, sf_dir)
    return _positions(spark, K.best_features(ds, 10), ds)


@query("preselect_wide", _anova_wide_sql(20))
def preselect(spark, sf_dir):
    """A table above the column limit starts from its best columns."""
    ds = _vectors(spark, sf_dir)
    return _positions(spark, K.preselect_wide(ds, above=50, keep=20), ds)


@query("constrain_columns", _anova_wide_sql(40))
def constrain(spark, sf_dir):
    ds = _vectors(spark, sf_dir)
    return _positions(spark, K.constrain(ds, 40), ds)


_CORRELATED = {"l_quantity": "l_quantity", "gross": "l_extendedprice * (1 - l_discount)", "l_extendedprice": "l_extendedprice",
               "taxed": "l_extendedprice * (1 + l_tax)", "double_quantity": "l_quantity * 2 + 1", "l_discount": "l_discount"}


def _correlated_sql() -> str:
    columns = ", ".join(f"{e} AS {c}" for c, e in _CORRELATED.items())
    names = list(_CORRELATED)
    parts = []
    for j, b in enumerate(names):
        strong = " OR ".join(f"abs(corr({a}, {b})) > 0.98" for a in names[:j]) or "FALSE"
        parts.append(f"SELECT '{b}' AS feature FROM b HAVING NOT ({strong})")
    return f"WITH b AS (SELECT {columns} FROM lineitem) " + " UNION ALL ".join(parts)


@query("drop_correlated", _correlated_sql())
def uncorrelated(spark, sf_dir):
    df = load(spark, sf_dir, "lineitem").select(*[F.expr(e).alias(c) for c, e in _CORRELATED.items()])
    return spark.createDataFrame([(n,) for n in K.drop_correlated(Dataset.of(df)).names], "feature string")


@query(
    "correlation_matrix",
    f"WITH {LINE_SQL} " + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {single_sql(f'round(corr({a}, {b}), 9)')} AS r FROM base"
        for i, a in enumerate(LINE_FEATURES) for b in LINE_FEATURES[i + 1:]
    ),
)
def correlation_matrix(spark, sf_dir):
    names, matrix = K.correlations(line_items(spark, sf_dir))
    rows = [(a, names[j], float(matrix[i, j])) for i, a in enumerate(names) for j in range(i + 1, len(names))]
    return spark.createDataFrame(rows, "a string, b string, r double").withColumn("r", single(F.round("r", 9)))


@query("important_features")
def important(spark, sf_dir):
    kept = K.important_features(_vectors(spark, sf_dir), trees=20, depth=5)
    return spark.createDataFrame([(n,) for n in kept.names], "feature string")


@query("top_important")
def top(spark, sf_dir):
    kept = K.top_important(_vectors(spark, sf_dir), 10, trees=20)
    return spark.createDataFrame([(n,) for n in kept.names], "feature string")


@query("shrink")
def shrunk(spark, sf_dir):
    """Importance selection repeated until at most 8 features are left."""
    select = partial(K.important_features, trees=10, depth=4)
    rows = [(i, len(s.names)) for i, s in enumerate(K.shrink_steps(_vectors(spark, sf_dir), select))]
    return spark.createDataFrame(rows, "step int, features int")


@query("shadow_selection")
def shadow(spark, sf_dir):
    found = K.shadow_selection(_part_brands(spark, sf_dir), rounds=8, trees=10)
    rows = [(n, s) for s in ("accepted", "rejected", "undecided") for n in getattr(found, s)]
    return spark.createDataFrame(rows, "feature string, decision string")


@query("forest_search")
def search(spark, sf_dir):
    ds = _folded(_part_brands(spark, sf_dir))
    return K.forest_search(ds, {"trees": [5, 10], "depth": [3, 5], "min_leaf": [1, 20]}, samples=3)


@query("halving_search")
def halved(spark, sf_dir):
    """Eight settings; the folds a setting was fitted for are counted."""
    ds = _folded(_part_brands(spark, sf_dir))
    return H.halving_search(ds, {"trees": [5, 10], "depth": [3, 5], "min_leaf": [1, 20]})


_BIN_SHARES = ", ".join(f"{i}::DOUBLE / 16" for i in range(1, 16))
_BINNED_SQL = f"""
WITH c AS (SELECT 0 AS feature, p_size::DOUBLE AS v FROM part UNION ALL SELECT 1, p_retailprice::DOUBLE FROM part
), q AS (SELECT feature, unnest(list_distinct(quantile_cont(v, [{_BIN_SHARES}]))) AS cut FROM c GROUP BY feature)
SELECT feature, bin, count(*) AS n
FROM (SELECT feature, (SELECT count(*) FROM q WHERE q.feature = c.feature AND q.cut <= c.v) AS bin FROM c) GROUP BY feature, bin
"""


@query("binned_columns", _BINNED_SQL)
def binned_columns(spark, sf_dir):
    """Rows per bin of the table that the search of settings reads."""
    ds = _part_brands(spark, sf_dir)
    ds = _folded(Dataset.of(ds.df, ["p_size", "p_retailprice"], "cheap", "C", "id"))
    codes = F.posexplode(vector_to_array("x")).alias("feature", "bin")
    return H.binned(ds, 16).select(codes).groupBy("feature", F.col("bin").cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
