"""The library's own solvers against plain numpy on small tables."""

import datetime

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from featloom import Dataset
from featloom.operators import boosting, cells, dual, forest, linear, process
from featloom.operators.fitted import Binning, assembled, few_values
from featloom.plans.fitness import vectors
from featloom.operators.moments import base_exprs
from featloom.queries import models  # noqa: F401
from featloom.queries.base import QUERIES


def table(spark, x, y, parts=4):
    rows = [(*map(float, r), float(t)) for r, t in zip(x, y)]
    names = [f"x{i}" for i in range(x.shape[1])]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in [*names, "y"])).repartition(parts)
    return assembled(df, names).select("__x", F.col("y").alias("__y"))


def plain_tree(x, g, h, depth, rate=0.3):
    """Leaf weight of every row of the exact greedy tree."""
    out = np.full(len(x), -rate * g.sum() / (h.sum() + 1.0))
    best = (boosting.LEAST_GAIN, None, None)
    for f in range(x.shape[1]) if depth else ():
        for t in np.unique(x[:, f])[1:]:
            low = x[:, f] < t
            hl, hr = h[low].sum(), h[~low].sum()
            gain = g[low].sum() ** 2 / (hl + 1) + g[~low].sum() ** 2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1)
            if hl >= 1 and hr >= 1 and gain > best[0] + 1e-9:
                best = (gain, f, t)
    if best[1] is not None:
        low = x[:, best[1]] < best[2]
        for side in (low, ~low):
            out[side] = plain_tree(x[side], g[side], h[side], depth - 1, rate)
    return out


@pytest.mark.parametrize("classes", [0, 2, 3])
def test_boosting_is_exact_on_few_values(spark, monkeypatch, classes):
    monkeypatch.setattr(boosting, "PASS_BYTES", 30_000)
    monkeypatch.setattr(boosting, "ROW_BYTES", 5_000)
    monkeypatch.setattr(boosting, "STORED_EVERY", 2)
    rng = np.random.default_rng(classes)
    x = np.round(rng.normal(0, 4, (300, 3)))
    raw = x[:, 0] - 0.5 * x[:, 1] + rng.normal(0, 1, 300)
    y = raw if not classes else np.digitize(raw, [0.0, 3.0][: classes - 1]).astype(float)
    model = boosting.HistogramBoosting(classes, rounds=3, depth=3).fit(table(spark, x, y))
    margin = np.full((300, classes if classes > 2 else 1), y.mean() if not classes else 0.0)
    for _ in range(3):
        g, h = boosting.derivatives(margin, y, classes)
        margin = margin + np.column_stack([plain_tree(x, g[:, k], h[:, k], 3) for k in range(margin.shape[1])])
    assert np.allclose(model.margins(x), margin, atol=1e-6)
    shown = model.transform(table(spark, x, y)).select("__p").toPandas()["__p"]
    assert len(shown) == 300 and set(shown) <= set(model.predict(x))


def test_boosting_of_many_values_and_of_nothing(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (1500, 2))
    y = np.sin(2 * x[:, 0]) + x[:, 1] ** 2
    model = boosting.HistogramBoosting(rounds=12, bins=32).fit(table(spark, x, y))
    assert np.corrcoef(model.predict(x), y)[0, 1] > 0.97
    flat = boosting.HistogramBoosting(rounds=5).fit(table(spark, x[:50], np.ones(50)))
    assert np.allclose(flat.predict(x), 1.0) and not flat.rounds


def test_gram_regression(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (200, 4)) * [1, 1e-3, 1e4, 1] + [0, 5, 1e8, 2]
    x[:, 3] = 7.0
    y = 3 + x[:, 0] - 200 * x[:, 1] + 1e-4 * x[:, 2] + 0.01 * rng.normal(0, 1, 200)
    model = linear.GramRegression().fit(table(spark, x, y))
    design = np.column_stack([np.ones(200), x[:, :3] - x[:, :3].mean(0)])
    want = design @ np.linalg.lstsq(design, y, rcond=None)[0]
    assert np.allclose(model.intercept + x @ model.slopes, want, atol=1e-6) and model.slopes[3] == 0.0
    twice = linear.GramRegression().fit(table(spark, x[:, [0, 0]], x[:, 0]))
    assert np.allclose(twice.slopes, [0.5, 0.5])


def exact_process(kernel, z, t, noise, at):
    """Mean, variance and marginal likelihood of the full process."""
    own = kernel(z, z) + noise * np.eye(len(z))
    cross = kernel(at, z)
    mean = cross @ np.linalg.solve(own, t)
    variance = kernel.own(at) - (cross * np.linalg.solve(own, cross.T).T).sum(1)
    _, logdet = np.linalg.slogdet(own)
    return mean, variance, -0.5 * (t @ np.linalg.solve(own, t) + logdet + len(t) * np.log(2 * np.pi))


@pytest.mark.parametrize("kind", [process.DOT, process.RATIONAL, process.RBF])
def test_process_with_all_rows_is_exact(spark, kind):
    rng = np.random.default_rng(2)
    x = rng.uniform(-2, 2, (200, 2)) * [1, 30] + [4, 0]
    y = 5 + np.sin(2 * x[:, 0]) + 0.02 * x[:, 1] + 0.1 * rng.normal(0, 1, 200)
    z, t = (x - x.mean(0)) / x.std(0), (y - y.mean()) / y.std()
    model = process.InducingProcess(kind).fit(table(spark, x, y))
    every = [(exact_process(k, z, t, s, z)[2], k, s) for k in process.candidates(kind, 2) for s in process.NOISES]
    best = max(every, key=lambda e: e[0])
    assert (model.kernel, model.noise) == best[1:] and model.likelihood == pytest.approx(best[0], rel=1e-3)
    at = rng.uniform(-2, 2, (50, 2)) * [1, 30] + [4, 0]
    mean, variance, _ = exact_process(model.kernel, z, t, model.noise, (at - x.mean(0)) / x.std(0))
    assert np.allclose(model.predict(at), mean * y.std() + y.mean(), atol=1e-3)
    assert np.allclose(model.variance(at), variance * y.var(), atol=1e-3)


def test_process_with_fewer_points(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(-2, 2, (900, 1))
    y = np.sin(2 * x[:, 0]) + 0.1 * rng.normal(0, 1, 900)
    model = process.InducingProcess(process.RBF, inducing=30).fit(table(spark, x, y))
    assert len(model.points) == 30 and np.abs(model.predict(x) - np.sin(2 * x[:, 0])).mean() < 0.05
    assert model.variance(np.array([[50.0]]))[0] > 10 * model.variance(np.array([[0.0]]))[0]
    classes = process.InducingProcess(process.RBF, 3).fit(table(spark, x, np.digitize(x[:, 0], [-1, 1])))
    assert (classes.predict(x) == np.digitize(x[:, 0], [-1, 1])).mean() > 0.95


@pytest.mark.parametrize("kind", [process.RATIONAL, process.RBF])
def test_process_of_many_rows_and_nearly_dependent_points(spark, kind):
    """Many rows, points so close that kernel columns are almost multiples of each other."""
    rng = np.random.default_rng(9)
    x = rng.uniform(0, 1, (40_000, 1))
    y = 100 * x[:, 0] + np.sin(6 * x[:, 0])
    model = process.InducingProcess(kind, inducing=64, noises=(1e-4,)).fit(table(spark, x, y))
    assert np.isfinite(model.likelihood) and np.abs(model.predict(x[:500]) - y[:500]).max() < 0.2
    assert (model.variance(x[:500]) < 1e-3 * y.var()).all()


def best_hinge(x, y, strength, steps=60_000):
    """Primal value of the support vector machine by a long subgradient descent."""
    w, best = np.zeros(x.shape[1]), np.inf
    for i in range(1, steps):
        open_ = y * (x @ w) < 1
        w -= (strength * w - (x * y[:, None])[open_].sum(0) / len(x)) / (strength * i)
        best = min(best, strength / 2 * w @ w + np.maximum(0, 1 - y * (x @ w)).mean())
    return best


def rounds_of(spec, parts, rounds):
    """The rounds of dual ascent over (x, y) blocks without Spark: weights and the relative gap before the last one."""
    n = sum(len(x) for x, _ in parts)
    alphas = [np.zeros_like(y) for _, y in parts]
    weights = np.zeros((parts[0][0].shape[1], parts[0][1].shape[1]))
    for _ in range(rounds):
        both = [spec.values(x @ weights, y, a) for (x, y), a in zip(parts, alphas)]
        norm = spec.strength / 2 * (weights**2).sum()
        primal, lower = norm + sum(v for v, _ in both) / n, sum(d for _, d in both) / n - norm
        stepped = [spec.epoch(x, y, a, weights, n, len(parts)) for (x, y), a in zip(parts, alphas)]
        alphas = [a for a, _ in stepped]
        weights = weights + sum(m for _, m in stepped) / (spec.strength * n)
    return weights, (primal - lower) / abs(primal)


def test_dual_ascent_closes_the_gap():
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.normal(0, 1, (240, 2)), np.ones(240)])
    y = np.where(x[:, 0] + 0.5 * x[:, 1] + 0.5 * rng.normal(0, 1, 240) > 0, 1.0, -1.0)
    spec = dual.DualAscent(2, strength=0.05)
    weights, gap = rounds_of(spec, [(x[i::4], y[i::4, None]) for i in range(4)], 40)
    primal = 0.05 / 2 * (weights**2).sum() + np.maximum(0, 1 - y * (x @ weights[:, 0])).mean()
    assert gap <= 1e-3 and primal <= best_hinge(x, y, 0.05, 20_000) * 1.002


def test_tube_of_one_feature():
    """Without noise all rows but the steepest lie inside the tube: the slope is known."""
    x = np.column_stack([np.linspace(-1, 1, 101), np.ones(101)])
    weights, gap = rounds_of(dual.DualAscent(strength=1e-3, tube=0.1), [(x[i::2], 3 * x[i::2, :1]) for i in range(2)], 150)
    assert gap < 2e-2 and weights[0, 0] == pytest.approx(2.9, rel=0.02) and abs(weights[1, 0]) < 0.02


def test_dual_rounds_on_spark_are_the_same(spark, monkeypatch):
    monkeypatch.setattr(dual, "BLOCK_ROWS", 60)
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (200, 2))
    y = (x[:, 0] > 0.3 * rng.normal(0, 1, 200)).astype(float)
    model = dual.DualAscent(2, strength=0.05, rounds=4, gap=0.0).fit(table(spark, x, y))
    assert model.rounds == 4 and 0 < model.gap < 0.5 and (model.predict(x) == y).mean() > 0.8
    shown = model.transform(table(spark, x, y)).select("__p").toPandas()["__p"]
    assert sorted(shown) == sorted(model.predict(x))


@pytest.mark.parametrize("classes", [0, 2, 3])
def test_dual_rounds_write_no_rows_again(spark, monkeypatch, classes):
    """The rounds are those without Spark; after the first table only dual variables and sums are stored, and no row is shuffled."""
    monkeypatch.setattr(dual, "BLOCK_ROWS", 60)
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (200, 3))
    y = np.digitize(x[:, 0] + x[:, 1], [0.0, 1.0][: classes - 1]).astype(float) if classes else x[:, 0] + 0.3 * rng.normal(0, 1, 200)
    names = lambda: {t.name for t in spark.catalog.listTables()}
    before = names()
    spec = dual.DualAscent(classes, strength=0.05, rounds=4, gap=0.0)
    model = spec.fit(table(spark, x, y))
    made = sorted(names() - before, reverse=True)
    stored = [spark.table(n) for n in made]
    assert [t.columns for t in stored] == [["block", "x", "y"], *[["block", "alpha", "sums"]] * 4]
    again = spec.stepped(stored[0], stored[1], model.weights, 200, 4)
    assert "Exchange" not in again._jdf.queryExecution().executedPlan().toString()
    margins = 3 if classes == 3 else 1
    blocks = [(np.frombuffer(r["x"]).reshape(-1, 4), np.frombuffer(r["y"]).reshape(-1, margins)) for r in stored[0].orderBy("block").collect()]
    assert sum(len(own) for own, _ in blocks) == 200
    weights, gap = rounds_of(spec, blocks, 4)
    assert np.allclose(model.weights, weights) and model.gap == pytest.approx(gap)


@pytest.mark.parametrize("classes", [0, 3])
def test_forest_arrays(spark, classes):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (300, 4))
    y = x[:, 0] + x[:, 1] if not classes else np.digitize(x[:, 0] + x[:, 1], [-0.5, 0.5])
    rows = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, d double, y double")
    ds = Dataset.of(rows, list("abcd"), "y")
    kind = RandomForestClassifier if classes else RandomForestRegressor
    model = kind(numTrees=6, maxDepth=4, featuresCol="x", labelCol="y", predictionCol="p", seed=3).fit(vectors(ds, base_exprs(ds)))
    arrays = forest.ForestArrays.of(spark, model)
    own = np.array([list(r["x"]) for r in vectors(ds, base_exprs(ds)).collect()])
    want = np.array([r["p"] for r in model.transform(vectors(ds, base_exprs(ds))).collect()])
    assert np.allclose(arrays.predicted(arrays.votes(own)), want)
    other = own[::-1]
    for variant, found in arrays.replaced(own, other):
        changed = own.copy()
        if variant:
            changed[:, variant - 1] = other[:, variant - 1]
        assert np.allclose(found, arrays.predicted(arrays.votes(changed)))


def test_line_means(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(m, 0.1, 200) for m in (0, 5, 9)])
    rows = [(float(v), float(i % 3), None if i % 9 == 0 else float(v * v)) for i, v in enumerate(x)]
    ds = Dataset.of(spark.createDataFrame(rows, "a double, b double, c double").repartition(3))
    assert [v if v is None else list(v) for v in few_values(ds, 3)] == [None, [0.0, 1.0, 2.0], None]
    fitted = Binning.fit(ds, k=3, tolerance=0.0)
    assert np.allclose(fitted.centres["a"], [x[:200].mean(), x[200:400].mean(), x[400:].mean()])
    assert fitted.centres["b"] == (0.0, 1.0, 2.0)


def test_cells_hold_all_rows_and_visits_are_few(spark, monkeypatch):
    """A row is in one cell, cells are bounded, and the visits of a query do not grow with the table."""
    monkeypatch.setattr(cells, "CHUNK_ROWS", 500)
    monkeypatch.setattr(cells, "FAN", 8)
    monkeypatch.setattr(cells, "CELL_ROWS", 64)
    means = []
    for count in (3000, 24000):
        rng = np.random.default_rng(count)
        frame = [(i, *map(float, r)) for i, r in enumerate(rng.uniform(0, 1, (count, 3)))]
        df = spark.createDataFrame(frame, "tid long, x0 double, x1 double, x2 double")
        grown = cells.grow(df, ["x0", "x1", "x2"], "tid")
        assert grown.depth >= 2 and grown.rows.count() == count
        assert grown.rows.groupBy("cell").count().agg(F.max("count")).first()[0] <= 2 * 64
        # The radius within which k rows are expected shrinks as the table grows.
        radius = (5 / count) ** (1 / 3)
        asked = df.limit(400).withColumnRenamed("tid", "qid").withColumn("bound", F.lit(radius))
        visited = cells.visits(asked, grown, "qid", cells.touched)
        means.append(visited.count() / 400)
        home = cells.visits(asked.drop("bound"), grown, "qid", cells.nearest_box)
        assert home.count() == 400
        boxes = grown.boxes.where("leaf").toPandas()
        points = np.array(asked.select("x0", "x1", "x2").collect())
        near = cells.gaps(points, np.array(boxes["low"].tolist()), np.array(boxes["high"].tolist())) <= radius * (1 + 1e-9) + 1e-12
        assert visited.count() == near.sum()
    assert means[1] < 1.5 * means[0]


@pytest.mark.parametrize("classes", [0, 2, 3])
def test_boosting_reads_a_row_per_cell_and_label(spark, monkeypatch, classes):
    """Many rows in few cells: the rounds read the cells, with the result of all rows."""
    rng = np.random.default_rng(8)
    x = rng.integers(0, 4, (3000, 2)).astype(float)
    y = (x[:, 0] + rng.integers(0, 3, 3000)) % classes if classes else x[:, 0] * 2 + rng.normal(size=3000)
    read = []
    own = boosting.HistogramBoosting.binned
    monkeypatch.setattr(boosting.HistogramBoosting, "binned", lambda self, *a: read.append(own(self, *a)) or read[0])
    model = boosting.HistogramBoosting(classes, rounds=2, depth=2).fit(table(spark, x, y))
    assert read[0].count() == len({(*r, v if classes else 0) for r, v in zip(x.tolist(), y.tolist())})
    assert read[0].agg({"weight": "sum"}).first()[0] == 3000
    start = np.full((3000, max(1, classes if classes > 2 else 1)), model.base)
    g, h = boosting.derivatives(start, y, classes)
    for k, tree in enumerate(model.rounds[0]):
        assert np.isclose(tree.weight[0], -0.3 * g[:, k].sum() / (h[:, k].sum() + 1.0))
        leaf = tree.nodes(x, binned=False)
        for n in np.unique(leaf):
            at = leaf == n
            assert np.isclose(tree.weight[n], -0.3 * g[at, k].sum() / (h[at, k].sum() + 1.0))


@pytest.mark.parametrize("classes", [0, 2, 3])
def test_boosting_of_cells_in_one_task_is_that_of_passes(spark, monkeypatch, classes):
    rng = np.random.default_rng(30 + classes)
    x = np.column_stack([rng.integers(0, 30, 900), rng.normal(0, 1, 900), rng.integers(0, 2, 900)])
    y = (x[:, 0] > 9 + 4 * x[:, 1]) + (x[:, 2] * (x[:, 0] > 20)) if classes else x[:, 0] + rng.normal(0, 1, 900)
    df = table(spark, x, np.minimum(y, classes - 1) if classes else y)
    boosted = boosting.HistogramBoosting(classes, rounds=4, depth=4, bins=64)
    monkeypatch.setattr(boosting.HistogramBoosting, "grow", lambda *a: pytest.fail("cells that fit need no pass a level"))
    own = boosted.fit(df)
    monkeypatch.undo()
    monkeypatch.setattr(boosting, "CELL_BYTES", 0)
    passes = boosted.fit(df)
    assert len(own.rounds) == len(passes.rounds) == 4
    assert np.allclose(own.margins(x), passes.margins(x))


@pytest.mark.parametrize("classes", [0, 2, 3])
def test_boosted_rows_look_their_prediction_up(spark, monkeypatch, classes):
    rng = np.random.default_rng(40 + classes)
    x = np.column_stack([rng.normal(0, 1, 700), rng.integers(0, 5, 700), np.ones(700)])
    y = (x[:, 0] > 0).astype(float) + (x[:, 1] > 2) * (classes != 2) if classes else x[:, 0] * x[:, 1]
    df = table(spark, x, y)
    model = boosting.HistogramBoosting(classes, rounds=9, bins=32).fit(df)
    cuts, found = model.lattice()
    near = [np.concatenate([c, np.nextafter(c, -np.inf), [-1e9, 1e9]]) for c in cuts]
    points = np.column_stack([*[rng.choice(c, 500) for c in near], *[np.zeros(500)] * (3 - len(cuts))])
    assert np.array_equal(boosting._looked_up(cuts, found, points), model.predict(points))
    rows = [(r["__x"].toArray(), r["__p"]) for r in df.select("__x", F.col("__x").alias("x")).transform(lambda d: model.transform(d).withColumnRenamed("x", "__x")).collect()]
    assert np.array_equal([p for _, p in rows], model.predict(np.array([v for v, _ in rows])))
    monkeypatch.setattr(boosting, "LATTICE_CELLS", 3)
    assert model.lattice() is None


@pytest.mark.parametrize("name, rows", [
    ("boosting_classification", ("orders", "o_orderkey long, o_totalprice double, o_orderdate timestamp, o_orderpriority string, o_orderstatus string")),
    ("boosting_regression", ("part", "p_partkey long, p_size int, p_retailprice double"))])
def test_boosting_queries_fit_all_rounds(spark, tmp_path, monkeypatch, name, rows):
    at, schema = rows
    day = lambda i: datetime.datetime(1995, 1, 1) + datetime.timedelta(days=i)
    made = {"orders": lambda i: (i, float(i * 37 % 101), day(i * 7), f"{i % 5 + 1}-X", "FOP"[i * i % 7 % 3]), "part": lambda i: (i, i * 11 % 50, float(i * i % 97))}
    spark.createDataFrame([made[at](i) for i in range(120)], schema).write.parquet(str(tmp_path / f"{at}.parquet"))
    asked = []
    fit = boosting.HistogramBoosting.fit
    monkeypatch.setattr(boosting.HistogramBoosting, "fit", lambda self, df: (asked.append((self.rounds, self.depth)), fit(self, df))[1])
    found = QUERIES[name](spark, str(tmp_path)).collect()
    assert asked and set(asked) == {(boosting.ROUNDS, boosting.DEPTH)} and {r["n"] for r in found} == {120}
