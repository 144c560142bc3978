"""A forest of classes reads as many rows as there are cells of its bins."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from featloom import Dataset
from featloom.operators import cell_forest
from featloom.operators.forest import ForestArrays
from featloom.plans import fitness


def _table(spark, copies=1):
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(size=600), rng.integers(1, 6, 600), rng.integers(0, 3, 600)])
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] > 3)
    rows = [(i, *map(float, r), float(c)) for i, (r, c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y double")
    wide = df.crossJoin(spark.range(copies).withColumnRenamed("id", "copy")).withColumn("id", F.col("id") * copies + F.col("copy"))
    return Dataset.of(wide.drop("copy"), list("abc"), "y", "C", "id"), x, y


def test_rows_that_are_fitted_do_not_grow_with_the_table(spark, monkeypatch):
    fitted, fit = [], RandomForestClassifier._fit
    monkeypatch.setattr(RandomForestClassifier, "_fit", lambda self, df: fitted.append(df.count()) or fit(self, df))
    monkeypatch.setattr(cell_forest, "ROWS_FROM", 1)
    scorer = fitness.ForestScorer(trees=4, depth=5)
    found = fitness.permutation_importance(_table(spark, 20)[0], scorer, repeats=1)
    values = {r["feature"]: r["importance"] for r in found.collect()}
    assert values["a"] > values["b"] > 0.05 > abs(values["c"])
    # 9000 rows in the larger part; 600 different ones at most.
    assert len(fitted) == 4 and max(fitted) <= 600


def test_cells_and_rows_give_like_forests(spark):
    ds, x, y = _table(spark, 5)
    estimator = fitness.ForestScorer(trees=20, depth=6).estimator("C")
    own = cell_forest.forest_of_cells(ds, estimator, rows_from=1)
    rows = ForestArrays.of(spark, estimator.fit(fitness.vectors(ds, [fitness.Ref(n) for n in ds.names])))
    a, b = (f.votes(x) / len(f.trees) for f in (own, rows))
    assert len(own.trees) == 20 and own.classes == 3 and np.abs(a - b).mean() < 0.05
    assert (own.predicted(a) == y).mean() > 0.95
    again = cell_forest.forest_of_cells(ds.with_df(ds.df.repartition(7)), estimator, rows_from=1)
    assert np.array_equal(own.votes(x), again.votes(x))


def test_weights_of_a_cell_add_up_the_draws_of_its_rows(spark):
    rows = spark.range(9000).select((F.col("id") % 2).cast("double").alias("y"), (F.col("id") % 3).cast("double").alias("v0"))
    cells = cell_forest.weighted_cells(rows, [np.array([0.0, 1.0])], 30, 1).toPandas()
    drawn = cells[[f"w{t}" for t in range(30)]].to_numpy()
    assert len(cells) == 6 and abs(drawn.mean() - 1500) < 15 and 25 < drawn.std() < 55


def test_what_cells_do_not_bound_is_left_to_rows(spark):
    ds, *_ = _table(spark)
    assert cell_forest.forest_of_cells(ds, fitness.ForestScorer(trees=2).estimator("C")) is None
    assert cell_forest.forest_of_cells(ds, fitness.ForestScorer(trees=2, min_leaf=3).estimator("C"), rows_from=1) is None
    gap = ds.with_df(ds.df.withColumn("b", F.when(F.col("id") != 7, F.col("b"))))
    with pytest.raises(ValueError, match="missing"):
        cell_forest.forest_of_cells(gap, fitness.ForestScorer(trees=2).estimator("C"), rows_from=1)
