import ast

import numpy as np
import pytest
from pyspark.sql import functions as F

from featloom import Dataset
from featloom.operators.folds import FOLD
from featloom.plans import search
from featloom.plans.fitness import ForestScorer, summarise
from featloom.session import materialise


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (300, 2))
    target = (x[:, 0] * x[:, 1] > 0).astype(float)
    rows = [
        (i, float(a), None if i % 10 == 0 else float(round(b)), None, float(t), i % 5)
        for i, ((a, b), t) in enumerate(zip(x, target))
    ]
    df = spark.createDataFrame(rows, f"id long, a double, b double, none double, k double, {FOLD} int").repartition(3)
    return Dataset.of(materialise(df, "search"), ["a", "b", "none"], "k", "C", "id")


def test_rungs_shrink_while_folds_grow():
    assert search.rungs(8, 5, 2) == [(8, 1), (4, 2), (2, 3), (1, 5)]
    assert search.rungs(1, 5, 2) == [(1, 5)]
    assert search.rungs(10, 3, 3) == [(10, 1), (4, 1), (2, 3)]


def test_bins_are_the_number_of_cuts_not_above(table):
    rows = table.df.select("a", "b", "none").toPandas()
    cuts = search.cut_points(table, 8)
    assert cuts["none"] == [] and cuts["b"] == sorted(set(cuts["b"]))
    assert np.allclose(cuts["a"], np.quantile(rows["a"], np.arange(1, 8) / 8))
    found = np.array([r["x"].toArray() for r in search.binned(table, 8).collect()])
    for j, name in enumerate(["a", "b", "none"]):
        splits = cuts[name] or [0.0]
        known = rows[name].dropna().astype(float)
        want = [*np.searchsorted(splits, known, "right"), *[len(splits) + 1] * (len(rows) - len(known))]
        assert sorted(found[:, j]) == sorted(map(float, want))


def test_the_winner_is_that_of_the_full_grid(table):
    grid = {"trees": [1, 12], "depth": [1, 5]}
    rows = search.halving_search(table, grid, bins=16).collect()
    bins, full = search.binned(table, 16), {}
    for trees in grid["trees"]:
        for depth in grid["depth"]:
            forest = ForestScorer(trees=trees, depth=depth)
            full[(trees, depth)] = summarise([forest._fold_score(bins, "C", f) for f in range(5)], "C")
    best = max(full, key=lambda s: full[s][0])
    assert ast.literal_eval(rows[0]["setting"]) == dict(zip(grid, best))
    assert (rows[0]["fitness"], rows[0]["std"]) == pytest.approx(full[best])
    assert [r["place"] for r in rows] == [1, 2, 3, 4] and [r["fits"] for r in rows] == [5, 3, 2, 2]


def test_no_settings(table):
    assert search.halving_search(table, {}).count() == 0
    with pytest.raises(ValueError):
        search.halving_search(table, {"trees": [1]}, keep=1)
