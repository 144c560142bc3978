import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from featloom import Dataset
from featloom.functions import metrics
from featloom.operators import cells, neighbors, network
from featloom.operators import supervised as M
from featloom.operators.expr import Ref, Unary
from featloom.operators.folds import with_folds
from featloom.operators.moments import base_exprs
from featloom.plans import fitness, selection
from featloom.session import materialise


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (400, 3))
    y = 2 * x[:, 0] - x[:, 1] + 0.1 * rng.normal(0, 1, 400)
    c = (y > 0).astype(float) + (y > 1.5)
    rows = [(i, *map(float, r), float(t), float(k)) for i, (r, t, k) in enumerate(zip(x, y, c))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y double, k double").repartition(4)
    df = materialise(df, "test")
    return Dataset.of(df, ["a", "b", "c"], "y", "R", "id"), Dataset.of(df, ["a", "b", "c"], "k", "C", "id")


def folded(ds):
    ds = with_folds(ds)
    return ds.with_df(materialise(ds.df, "folds"))


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 2.0), (4.0, 5.0)], "y double, p double")
    assert metrics.relative_absolute_error(df, "y", "p").collect()[0]["rae"] == 0.5
    counts = spark.createDataFrame([(0.0, 0.0, 6), (0.0, 1.0, 2), (1.0, 1.0, 2)], "actual double, predicted double, n long")
    f0, f1 = 2 * 6 / (8 + 6), 2 * 2 / (2 + 4)
    assert metrics.weighted_f1(counts).collect()[0]["f1"] == pytest.approx((8 * f0 + 2 * f1) / 10)
    assert metrics.f1_of_matrix(np.array([[6, 2], [0, 2]])) == pytest.approx((8 * f0 + 2 * f1) / 10)


def reference_linear(pdf, columns, label, task):
    """The same cross-validation with numpy alone."""
    x = np.column_stack([np.ones(len(pdf)), (pdf[columns] - pdf[columns].mean()) / pdf[columns].std(ddof=0)])
    y, fold = pdf[label].to_numpy(), pdf["fold"].to_numpy()
    scores = []
    for f in range(5):
        test = fold == f
        target = np.eye(3)[y.astype(int)] if task == "C" else y[:, None]
        beta = np.linalg.lstsq(x[~test], target[~test], rcond=None)[0]
        p = x[test] @ beta
        if task == "C":
            m = np.zeros((3, 3))
            np.add.at(m, (y[test].astype(int), p.argmax(1)), 1)
            scores.append(metrics.f1_of_matrix(m))
        else:
            scores.append(np.abs(y[test] - p[:, 0]).sum() / np.abs(y[test] - y[test].mean()).sum())
    mean = np.mean(scores) if task == "C" else 1 - np.mean(scores)
    return mean, np.std(scores)


def test_linear_scores_equal_plain_cross_validation(frames):
    for ds in frames:
        ds = folded(ds)
        pdf = ds.df.toPandas()
        groups = [["a"], ["a", "b"], ["c", "b"], ["a", "b", "c"]]
        got = fitness.LinearScorer(ridge=0.0).score_many(ds, [[Ref(n) for n in g] for g in groups])
        for g, score in zip(groups, got):
            assert score == pytest.approx(reference_linear(pdf, g, ds.label, ds.task), abs=1e-9)


def test_linear_scores_in_many_passes(frames, monkeypatch):
    ds = folded(frames[0])
    groups = [[Ref("a")], [Ref("b")], [Ref("a"), Unary("sin", Ref("b"))]]
    once = fitness.LinearScorer().score_many(ds, groups)
    monkeypatch.setattr(fitness, "_EXPRS_PER_PASS", 1)
    assert np.allclose(fitness.LinearScorer().score_many(ds, groups), once)


def test_missing_values_are_refused(spark):
    df = spark.createDataFrame([(1, 1.0, 0.0, 0), (2, None, 1.0, 1)], "id long, x double, y double, fold int")
    with pytest.raises(ValueError):
        fitness.LinearScorer().score(Dataset.of(df, ["x"], "y", "C", "id"))


def test_forest_scores(frames):
    r, c = map(folded, frames)
    scorer = fitness.ForestScorer(trees=10, depth=5)
    assert scorer.score(c)[0] > 0.7 and scorer.score(r)[0] > 0.5
    assert scorer.score(c) == scorer.score(c)
    row = fitness.score_compare(r, r.keep(["a"]), fitness.LinearScorer()).collect()[0]
    assert row["increase"] < 0 and row["increase"] == pytest.approx((row["current"] - row["initial"]) / row["initial"])


def test_holdout_scores(frames):
    regression, classes = (fitness.HoldoutScorer(repeats=2, trees=5, depth=5).score(ds)[0] for ds in frames)
    assert classes > 0.6 and 0 < regression < 1


def test_importances(frames):
    found = fitness.permutation_importance(frames[0], fitness.ForestScorer(trees=10, depth=6), repeats=1)
    values = {r["feature"]: r["importance"] for r in found.collect()}
    assert values["a"] > values["b"] > values["c"]
    assert selection.important_features(frames[0], trees=10).names == ["a"]
    assert selection.top_important(frames[0], 2, trees=10).names == ["a", "b"]


def test_shadow_selection(frames):
    found = selection.shadow_selection(frames[0], rounds=10, trees=10)
    assert "a" in found.accepted and "c" not in found.accepted
    assert sorted([*found.accepted, *found.rejected, *found.undecided]) == ["a", "b", "c"]


def test_shrink_ends(frames):
    assert len(selection.shrink(frames[1], 0, lambda d: selection.important_features(d, trees=5)).names) >= 1
    same = selection.shrink(frames[1], 1, lambda d: d)
    assert same.names == frames[1].names


def test_correlation_rule(spark):
    rng = np.random.default_rng(0)
    rows = [(float(v), 2 * float(v), float(w)) for v, w in rng.normal(0, 1, (100, 2))]
    ds = Dataset.of(spark.createDataFrame(rows, "x double, y double, z double"))
    assert selection.drop_correlated(ds).names == ["x", "z"]


def test_limits(frames):
    assert selection.constrain(frames[0], 4).names == ["a", "b", "c"]
    assert selection.constrain(frames[0], 2).names == ["a", "b"]
    assert selection.preselect_wide(frames[0], above=3, keep=1).names == ["a"]
    assert selection.missing_initial(["a", "b"], ["a"], []) == ["b"] and selection.union_names(["a"], ["b", "a"]) == ["a", "b"]


def test_forest_search(frames):
    found = selection.forest_search(folded(frames[1]), {"trees": [3, 5], "depth": [2]}).collect()
    assert len(found) == 2 and all(0 < r["fitness"] <= 1 for r in found)


def predictions(made, names):
    return made.df.select("id", *[made.value(n).alias(n) for n in names]).toPandas()


def test_linear_stack(frames):
    ds = frames[0]
    made = M.linear_regression().fit(ds).transform(ds)
    out, pdf = predictions(made, ["linear_pred", "linear_pred_diff"]).sort_values("id"), ds.df.toPandas().sort_values("id")
    x = np.column_stack([np.ones(len(pdf)), pdf[["a", "b", "c"]]])
    want = x @ np.linalg.lstsq(x, pdf["y"], rcond=None)[0]
    assert np.allclose(out["linear_pred"], want, atol=1e-6) and np.abs(out["linear_pred_diff"]).max() < 1e-6


@pytest.mark.parametrize("spec", [M.support_vector_regression(rounds=5), M.dot_product_process("R"), M.rational_quadratic_process("R"),
                                  M.rbf_process("R"), M.random_forest("R", trees=5), M.gradient_boosting("R", rounds=3)],
                         ids=lambda s: s.name)
def test_regression_stacks(frames, spec):
    made = spec.fit(frames[0]).transform(frames[0])
    assert made.names[3:] == [f"{spec.name}_pred", f"{spec.name}_pred_diff"]
    out = predictions(made, made.names[3:]).merge(frames[0].df.toPandas(), on="id")
    assert np.corrcoef(out[f"{spec.name}_pred"], out["y"])[0, 1] > 0.8


@pytest.mark.parametrize("spec", [M.support_vector_classification(rounds=4), M.dot_product_process("C"), M.rbf_process("C"),
                                  M.random_forest("C", trees=5), M.gradient_boosting("C", rounds=2)], ids=lambda s: s.name)
def test_classification_stacks(frames, spec):
    ds = frames[1]
    if spec.name == "svc":
        ds = ds.with_df(ds.df.withColumn("k", (F.col("k") > 0).cast("double")))
    made = spec.fit(ds).transform(ds)
    out = predictions(made, made.names[3:]).merge(ds.df.toPandas()[["id", "k"]], on="id")
    assert (out[f"{spec.name}_pred"] == out["k"]).mean() > 0.7


def test_always_right_has_no_error_model(spark):
    df = spark.createDataFrame([(float(i), float(i > 5)) for i in range(12)], "x double, k double")
    made = M.random_forest("C", trees=3).fit(Dataset.of(df, ["x"], "k")).transform(Dataset.of(df, ["x"], "k"))
    assert made.names == ["x", "rfc_pred"]


def test_tree_paths():
    debug = "\n".join(["DecisionTreeModel", "  If (feature 0 <= 1.5)", "   Predict: 0.0", "  Else (feature 0 > 1.5)",
                       "   If (feature 1 <= 2.0)", "    Predict: 1.0", "   Else (feature 1 > 2.0)", "    Predict: 0.0"])
    right = (0, ">", 1.5)
    assert M.tree_paths(debug) == [[], [(0, "<=", 1.5)], [right], [right, (1, "<=", 2.0)], [right, (1, ">", 2.0)]]


def test_tree_features(frames):
    for ds, suffix in zip(frames, ("reg", "cla")):
        fitted = M.TreeFeatures.fit(ds)
        made = fitted.transform(ds)
        nodes = [n for n in made.names if n.startswith(f"dt_n_{suffix}_")]
        out = predictions(made, nodes)
        assert (out[nodes[0]] == 1.0).all()
        for i, n in enumerate(nodes):
            assert set(out[n].round(12)) <= {0.0, round(fitted.shares[i], 12)}
            assert (out[n] > 0).mean() == pytest.approx(fitted.shares[i])


def test_leaky(frames):
    ds = frames[0]
    made = M.LeakyInfo.fit(ds).transform(ds)
    pdf = ds.df.toPandas().sort_values("id")
    x = np.column_stack([np.ones(len(pdf)), pdf[["b", "c"]]])
    want = x @ np.linalg.lstsq(x, pdf["a"], rcond=None)[0] - pdf["a"]
    assert np.allclose(predictions(made, ["a_leaky"]).sort_values("id")["a_leaky"], want, atol=1e-8)


@pytest.mark.parametrize("which", [0, 1])
def test_embedding(frames, which):
    ds = frames[which]
    fitted = network.NetworkEmbedding.fit(ds, epochs=3, batch_rows=100, rate=0.01)
    made = fitted.transform(ds)
    assert len(made.names) == 35 and made.names[3] == "mlp_pred_0_3"
    hidden = predictions(made, made.names[3:]).sort_values("id")[made.names[3:]].to_numpy()
    assert (hidden >= 0).all() and (hidden == 0).any()
    x = ds.df.toPandas().sort_values("id")[["a", "b", "c"]].to_numpy()
    weight, bias = fitted.layers[-1]
    out = hidden @ weight + bias
    assert np.allclose(fitted.predict(x), out.argmax(axis=1) if fitted.classes else out[:, 0])
    assert fitted.losses[-1] < fitted.losses[0]


@pytest.mark.parametrize("which", [0, 1])
def test_one_network_step_is_that_of_one_machine(frames, which):
    ds = frames[which]
    pdf = ds.df.toPandas()
    x, y = pdf[["a", "b", "c"]].to_numpy(), pdf[ds.label].to_numpy(float)
    fitted = network.NetworkEmbedding.fit(ds, epochs=1, batch_rows=10**6, seed=4)
    sizes = [3, 32, 32, fitted.classes or 1]
    start = network.flat(network.initial_layers(sizes, 4))
    z = (x - x.mean(0)) / x.std(0)
    loss, gradient = network.gradients(network.unflat(start, sizes), z, y, fitted.classes)
    assert fitted.losses == (pytest.approx(loss / len(y)),)
    want = network.Adam(len(start)).move(start, gradient / len(y))
    assert np.allclose(network.flat(list(fitted.layers)), want, atol=1e-12)
    for at in np.random.default_rng(0).integers(0, len(start), 25):
        up, down = start.copy(), start.copy()
        up[at] += 1e-6
        down[at] -= 1e-6
        slope = (network.gradients(network.unflat(up, sizes), z, y, fitted.classes)[0] - network.gradients(network.unflat(down, sizes), z, y, fitted.classes)[0]) / 2e-6
        assert slope == pytest.approx(gradient[at], rel=1e-3, abs=0.2 if not fitted.classes else 1e-3)


def test_network_epochs_are_single_jobs_and_shards_are_averaged(frames, monkeypatch):
    ds = frames[0]
    epochs, summed = [], network.gram_matrices
    monkeypatch.setattr(network, "gram_matrices", lambda *a: (epochs.append(1), summed(*a))[1])
    size = -(-ds.df.count() // 8)
    sequence = network.NetworkEmbedding.fit(ds, epochs=2, batch_rows=size, rate=0.01)
    assert len(epochs) == 2 and len(sequence.losses) == 16
    monkeypatch.setattr(network, "SHARD_BATCHES", 4)
    rows, total = network._in_shards(ds, size)
    shards = rows.orderBy("shard").collect()
    assert len(shards) == 2 and sum(len(r["rows"]) for r in shards) == total * 4 * 8
    fitted = network.NetworkEmbedding.fit(ds, epochs=1, batch_rows=size, rate=0.01)
    sizes = [3, 32, 32, fitted.classes or 1]
    ends = []
    for shard in shards:
        own, at = np.frombuffer(shard["rows"]).reshape(-1, 4), 0
        values = network.flat(network.initial_layers(sizes, 0))
        adam = network.Adam(len(values), 0.01)
        for count in np.frombuffer(shard["sizes"], np.int64):
            part = own[at : at + count]
            loss, gradient = network.gradients(network.unflat(values, sizes), (part[:, 1:] - fitted.means) / fitted.scales, part[:, 0], fitted.classes)
            values, at = adam.move(values, gradient / count), at + count
        ends.append(values * len(own) / total)
    assert np.allclose(network.flat(list(fitted.layers)), sum(ends), atol=1e-9)


def test_neighbours_both_ways(frames, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 64)
    monkeypatch.setattr(cells, "CELL_ROWS", 40)
    for ds in frames:
        pdf = ds.df.toPandas().sort_values("id")
        x = pdf[["a", "b", "c"]].to_numpy()
        near = np.argsort(((x[:, None] - x[None]) ** 2).sum(-1), axis=1, kind="stable")[:, :5]
        for room in (10**6, 0):
            made = neighbors.NearestNeighbours.fit(ds, max_cells=room).transform(ds)
            names = made.names[3:]
            out = predictions(made, names).sort_values("id")[names].to_numpy()
            y = pdf[ds.label].to_numpy()[near]
            want = np.stack([(y == i).sum(1) for i in range(3)], 1) if ds.task == "C" else y.mean(1, keepdims=True)
            assert np.allclose(out, want)


def test_duplicates_do_not_hide_neighbours(spark):
    rows = [(i, 0.0 if i < 60 else float(i), float(i)) for i in range(120)]
    ds = Dataset.of(spark.createDataFrame(rows, "id long, x double, y double"), ["x"], "y", "R", "id")
    for room in (10**6, 0):
        made = neighbors.NearestNeighbours.fit(ds, max_cells=room).transform(ds)
        out = predictions(made, ["nn_target"]).sort_values("id")["nn_target"]
        assert out.iloc[10] == 2.0 and out.iloc[119] == 117.0


def test_missing_inputs_are_filled_forward(spark):
    df = spark.createDataFrame([(1, 7.0), (2, None), (3, float("inf")), (4, 9.0)], "id long, v double")
    out = M.complete_rows_forward(Dataset.of(df, ["v"], row_id="id"))
    assert [r["v"] for r in out.df.orderBy("id").collect()] == [7.0, 7.0, 7.0, 9.0]


def test_stacks_apply_to_rows_with_gaps(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, 300)
    rows = [(i, None if i == 0 or i % 11 == 0 else float(v), float(3 * v + 1)) for i, v in enumerate(x)]
    ds = Dataset.of(spark.createDataFrame(rows, "id long, x double, y double").repartition(3), ["x"], "y", "R", "id")
    made = M.linear_regression().fit(ds).transform(ds)
    got = made.df.select("id", made.value("x").alias("x"), made.value("linear_pred").alias("p")).orderBy("id").toPandas()
    filled = pd.Series([r[1] for r in rows], dtype=float).ffill().fillna(np.nanmean([r[1] for r in rows if r[1] is not None]))
    assert np.allclose(got["x"], filled) and got["p"].notna().all()
    slope, level = np.polyfit(filled, [r[2] for r in rows], 1)
    assert np.allclose(got["p"], slope * filled + level, atol=1e-4)


def test_fits_do_not_follow_the_partitioning(spark):
    df = spark.range(3000).select("id", *[F.rand(i).alias(f"x{i}") for i in range(3)]).withColumn("y", (F.col("x1") > 0.6).cast("double"))
    df = spark.createDataFrame(df.toPandas())
    found = [selection.forest_importances(Dataset.of(df.repartition(n), ["x0", "x1", "x2"], "y", "C", "id"), trees=5) for n in (2, 5)]
    assert found[0] == found[1]


def test_dealt_rows_are_those_of_the_fit_and_kept_while_it_runs(spark, monkeypatch):
    from featloom import dataset

    monkeypatch.setattr(dataset, "SPREAD_ROWS", 40)
    df = spark.range(300).select("id", (F.col("id") % 7).cast("double").alias("x"), F.rand(3).alias("z"), (F.col("id") % 2).cast("double").alias("y"))
    ds = Dataset.of(df.withColumn("unused", F.lit("text")), ["x", "z"], "y", "C", "id")
    shown = lambda d: [tuple(r) for r in d.df.select(F.spark_partition_id(), "id", "x", "z", "y").collect()]
    with ds.dealt() as dealt:
        assert dealt.df.storageLevel.useDisk and dealt.df.columns == ["id", "y", "x", "z"]
        assert shown(dealt) == shown(ds.spread()) and len({r[0] for r in shown(dealt)}) > 1
    assert not dealt.df.storageLevel.useDisk


def test_fits_read_kept_rows(spark, monkeypatch):
    from featloom.plans import selection

    seen = []
    vectors = selection.vectors
    monkeypatch.setattr(selection, "vectors", lambda ds, *a: seen.append(ds.df.storageLevel.useDisk) or vectors(ds, *a))
    inputs = M._inputs
    monkeypatch.setattr(M, "_inputs", lambda ds, fourier: seen.append(ds.df.storageLevel.useDisk) or inputs(ds, fourier))
    df = spark.range(200).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 3 % 2).cast("double").alias("y"))
    ds = Dataset.of(df, ["x"], "y", "C", "id")
    selection.forest_importances(ds, trees=2, depth=2)
    M.random_forest("C", trees=2, depth=2).fit(ds)
    assert len(seen) > 3 and seen[:2] == [True, True] and seen[-1]


def test_shadow_rounds_share_the_positions(spark, monkeypatch):
    from featloom.operators import sampling
    from featloom.plans import selection

    calls = []
    place = sampling.with_position
    monkeypatch.setattr(sampling, "with_position", lambda *a, **k: calls.append(1) or place(*a, **k))
    df = spark.range(150).select("id", (F.col("id") * 37 % 11).cast("double").alias("x"), (F.col("id") * 29 % 13).cast("double").alias("z"), (F.col("id") % 2).cast("double").alias("y"))
    ds = Dataset.of(df, ["x", "z"], "y", "C", "id")
    stored = sampling.placed_rows(ds)
    own, shared = (sampling.donors(ds, ["x", "z"], "d_", 4, placed=p).df.select("id", "x", "z", "y", "d_x", "d_z") for p in (None, stored))
    assert sorted(own.collect()) == sorted(shared.collect())
    calls.clear()
    selection.shadow_selection(ds, rounds=2, trees=2, depth=2)
    assert len(calls) == 1
