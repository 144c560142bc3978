import numpy as np
import pytest

from pyspark.ml.clustering import KMeans

from featloom import Dataset
from featloom.operators import fitted, rowwise
from featloom.operators.quantiles import exact_quantiles


@pytest.fixture(scope="module")
def one_row(spark):
    return Dataset.of(spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, 10.0)], "a double, b double, c double, d double, e double"))


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), float(a), float(b), float(i % 5)) for i, (a, b) in enumerate(zip(rng.normal(0, 1, 600), rng.exponential(2, 600)))]
    return Dataset.of(spark.createDataFrame(rows, "id long, a double, b double, c double").repartition(4), ["a", "b", "c"], row_id="id")


def values(ds, names=None):
    return list(ds.df.select(*[ds.value(n).alias(f"v{i}") for i, n in enumerate(names or ds.names)]).collect()[0])


def test_row_aggregates(one_row):
    made = rowwise.time_aggregate(one_row)
    assert made.names[5:] == [f"a-b-c-d-e{s}" for s in ("_25%", "_50%", "_75%", "_std", "_max", "_min")]
    assert values(made)[5:] == pytest.approx([2, 3, 4, 3.162278, 10, 1])


def test_chained_row_aggregates(one_row):
    row = [1.0, 2.0, 3.0, 4.0, 10.0]
    for fn in (lambda v: np.percentile(v, 25), lambda v: np.percentile(v, 50), lambda v: np.percentile(v, 75), np.std, max, min):
        row.append(float(fn(row)))
    assert values(rowwise.time_aggregate(one_row, chained=True)) == pytest.approx(row)


def test_missing_values_in_a_row(spark):
    ds = Dataset.of(spark.createDataFrame([(1.0, None, 4.0)], "a double, b double, c double"))
    made = values(rowwise.time_aggregate(ds))[3:]
    assert made[:3] == [None, None, None] and made[3:] == [1.5, 4.0, 1.0]


def test_differences_and_rolling(one_row):
    assert values(rowwise.column_differences(one_row))[5:] == [None, 1, 1, 1, 6]
    made = rowwise.rolling_columns(one_row)
    found = dict(zip(made.names, values(made)))
    want = {"mean": 4, "max": 10, "min": 1, "std": 3.535534}
    assert all(found[f"tempWinAgg_{k}_e"] == pytest.approx(v) and found[f"tempWinAgg_{k}_d"] is None for k, v in want.items())


def test_exact_quantiles_over_passes(table):
    shares = np.linspace(0, 1, 37)
    found = exact_quantiles(table, shares, room=20)
    pdf = table.df.toPandas()
    for n in table.names:
        assert np.allclose(found[n], np.percentile(pdf[n], shares * 100))


def test_quantile_map(table):
    made = fitted.QuantileMap.fit(table).transform(table)
    got = made.df.select("a", made.value("quanTransforma").alias("q")).toPandas().sort_values("a")["q"].to_numpy()
    assert (np.diff(got) > 0).all() and got[0] == 0.0 and got[-1] == 1.0
    assert np.allclose(got, np.linspace(0, 1, 600), atol=1e-6)


def test_binning(table):
    made = fitted.Binning.fit(table).transform(table)
    few = made.df.select("c", made.value("binning_c").alias("k")).distinct().toPandas()
    assert (few["c"] == few["k"]).all() and len(few) == 5
    many = made.df.select("a", made.value("binning_a").alias("k")).toPandas().sort_values("a")["k"]
    assert many.is_monotonic_increasing and many.nunique() == 16


def test_term_frequency(spark):
    train = Dataset.of(spark.createDataFrame([(1.0,), (1.0,), (2.0,)], "x double"))
    test = Dataset.of(spark.createDataFrame([(1.0,), (9.0,)], "x double"))
    made = fitted.TermFrequency.fit(train).transform(test)
    assert [r[0] for r in made.df.select(made.by_name["ktermfreq_x"]).collect()] == [2, 0]


def test_pre_clean(spark):
    rows = [(float("inf"), None, 1.0), (2.0, None, 2.0), (4.0, 1.0, 3.0), (6.0, 1.0, 4.0)]
    ds = Dataset.of(spark.createDataFrame(rows, "a double, b double, c double"))
    clean = fitted.PreClean.fit(ds)
    assert clean.kept == ("a", "c")
    out = clean.transform(ds)
    assert [r["a"] for r in out.df.collect()] == [4.0, 2.0, 4.0, 6.0]


def test_expansion(spark):
    ds = Dataset.of(spark.createDataFrame([(2.0, 3.0, 5.0)], "a double, b double, c double"))
    made = fitted.NominalExpansion.fit(ds).transform(ds)
    assert made.names == ["1", "a", "b", "c", "a b", "a c", "b c", "a b c"]
    assert values(made) == [1, 2, 3, 5, 6, 10, 15, 30]


def test_standardise_uses_the_fitted_table(spark):
    train = Dataset.of(spark.createDataFrame([(0.0,), (2.0,)], "x double"))
    test = Dataset.of(spark.createDataFrame([(5.0,)], "x double"))
    assert values(fitted.Standardise.fit(train).transform(test)) == [4.0]


def test_clusters(table):
    made = fitted.Clustering.fit(table, k=4).transform(table)
    assert made.df.select(made.value("clustering_whole")).distinct().count() == 4
    blocks = fitted.SpatialAggregate.fit(table, k=3).transform(table)
    assert [n for n in blocks.names if n.startswith("spatial")][-1] == "spatialAgg_whole"


def test_clusterings_share_the_dealt_rows_and_are_those_of_spark(spark, monkeypatch):
    """The table is dealt once for all blocks; centres are those of Spark's k-means."""
    rng = np.random.default_rng(3)
    middle = rng.integers(0, 4, (400, 1)) * 10.0
    rows = [tuple(map(float, r)) for r in middle + rng.normal(0, 1, (400, 4))]
    ds = Dataset.of(spark.createDataFrame(rows, "a double, b double, c double, d double"))
    calls, dealt = [], Dataset.spread
    monkeypatch.setattr(Dataset, "spread", lambda self: (calls.append(1), dealt(self))[1])
    found = fitted.SpatialAggregate.fit(ds, k=4)
    assert len(calls) == 1 and len(found.parts) > 1
    for part in found.parts:
        data = fitted.assembled(dealt(ds).df, part.inputs).select("__x").persist()
        model = KMeans(k=4, seed=0, featuresCol="__x").fit(data)
        assert np.allclose(part.centres, model.clusterCenters())
        made = part.transform(ds)
        own = [r[0] for r in made.df.select(made.value(part.name).cast("int")).collect()]
        assert own == [model.predict(r["__x"]) for r in fitted.assembled(ds.df, part.inputs).collect()]


def test_block_plan():
    assert fitted.block_plan(8) == [(0, 2), (2, 4), (4, 6), (6, 8), (0, 4), (2, 6), (4, 8), (0, 6), (2, 8)]
    assert fitted.block_plan(1) == [(0, 1)]
    assert all(0 <= i < j <= 11 for i, j in fitted.block_plan(11))
