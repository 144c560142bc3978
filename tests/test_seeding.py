"""Starting centres of many clusterings against those of Spark."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.sql import functions as F

from featloom import Dataset
from featloom.operators import fitted, seeding


@pytest.mark.parametrize("seed", [0, 7, -3, 2**40 + 1])
def test_draws_are_those_of_spark(spark, seed):
    wanted = [r[0] for r in spark.range(0, 3000, 1, 1).select(F.rand(seed)).collect()]
    draws = seeding.Draws(seed)
    assert np.concatenate([draws.doubles(n) for n in (1, 0, 6, 2048, 945)]).tolist() == wanted


def test_java_random(spark):
    wanted, own = spark._jvm.java.util.Random(0), seeding.JavaRandom(0)
    for bound in (1, 2, 7, 64, 1000, 2**30 + 3):
        assert [wanted.nextDouble(), wanted.nextInt(bound)] == [own.next_double(), own.next_int(bound)]


def test_nearest_centre_takes_the_first_of_equal_ones():
    x = np.array([[0.0], [1.0], [2.0], [9.0]])
    label, away = seeding.nearest(x, np.array([[2.0], [0.0], [0.0], [8.0]]))
    assert label.tolist() == [1, 0, 0, 3] and away.tolist() == [0.0, 1.0, 0.0, 1.0]
    many = np.arange(300.0)[:, None]
    assert seeding.nearest_centre(many, many).tolist() == list(range(300))


@pytest.mark.parametrize("k", [3, 8])
def test_first_centres_are_those_of_spark_over_many_partitions(spark, monkeypatch, k):
    monkeypatch.setattr(seeding, "BLOCK_ROWS", 100)
    rng = np.random.default_rng(k)
    x = np.column_stack([rng.integers(1, 51, 3000), rng.normal(50, 9, 3000).round(1), rng.integers(0, 11, 3000) / 100, np.ones(3000)])
    rows = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double").repartition(7).persist()
    plan = [[0], [1], [2], [3], [0, 2], [0, 1, 2, 3]]
    blocks = seeding.packed(rows).persist()
    passes, own = [], seeding.gram_matrices
    monkeypatch.setattr(seeding, "gram_matrices", lambda *a: passes.append(1) or own(*a))
    found = seeding.first_centres(blocks, seeding.fewer_tasks(blocks, 4), plan, k, 0)
    # Costs of two steps and the weights of the candidates, for all clusterings together.
    assert len(passes) == 3
    for at, centres in zip(plan, found):
        data = fitted.assembled(rows, ["abcd"[i] for i in at]).select("__x").persist()
        assert np.allclose(KMeans(k=k, seed=0, maxIter=0, featuresCol="__x").fit(data).clusterCenters(), centres, rtol=1e-9)


def test_labels_of_all_blocks_take_one_call_of_python(spark):
    rows = [(float(i % 5), float(i % 7), float(i % 3)) for i in range(60)]
    ds = Dataset.of(spark.createDataFrame(rows, "a double, b double, c double"))
    fit = fitted.SpatialAggregate.fit(ds, k=2)
    made = fit.transform(ds)
    assert made.df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [") == 1
    assert len(made.names) == 3 + len(fit.parts)
    for part in fit.parts:
        own = [r[0] for r in made.df.select(made.value(part.name)).collect()]
        x = np.array(rows)[:, ["abc".index(n) for n in part.inputs]]
        assert own == seeding.nearest_centre(x, part.centres).tolist()


def test_gaps_and_empty_tables_cannot_be_clustered(spark):
    ds = Dataset.of(spark.createDataFrame([(1.0, 2.0), (None, 3.0), (float("nan"), 1.0)], "a double, b double"))
    for bad in (ds, ds.with_df(ds.df.limit(0))):
        with pytest.raises(Exception, match="missing value|no rows"):
            fitted.Clustering.fit(bad, k=2)
