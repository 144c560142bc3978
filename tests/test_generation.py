import math

import numpy as np
import pytest

from featloom import Dataset
from featloom.functions.summary import FeatureStats
from featloom.functions.scalar import BINARY, RBF
from featloom.operators import catalog, moments
from featloom.operators.binary import fit_binary, pair_catalog
from featloom.operators.expr import Ref
from featloom.operators.generate import append, children, fit_operator
from featloom.operators.moments import base_exprs, collect_stats, moments_frame, stats_of
from featloom.operators.unary import fit_unary, fourier_weights, random_cosines
from featloom.operators.univariate import univariate_scores


@pytest.fixture(scope="module")
def gates(spark):
    rows = [(1.0, -1.0, 0.0, 0.5), (2.0, 0.0, 0.0, 0.25), (4.0, 2.0, 0.0, -3.0)]
    return Dataset.of(spark.createDataFrame(rows, "a double, b double, c double, d double"))


def made(ds, op):
    return [e.name for e in fit_unary(op, base_exprs(ds), stats_of(ds))]


def test_gates(gates):
    assert made(gates, "abs") == ["b_abs", "d_abs"]
    assert made(gates, "exp") == ["c_exp", "d_exp"]
    assert made(gates, "ln") == ["a_ln"]
    assert made(gates, "sigmoid") == ["a_sigmoid", "c_sigmoid"]
    assert len(made(gates, "sigmoid_any")) == 4


def test_boundaries(spark):
    ds = Dataset.of(spark.createDataFrame([(1.0, -1.0), (0.5, 0.0)], "one double, minus double"))
    assert made(ds, "exp") == ["minus_exp"]
    assert made(ds, "sigmoid") == ["one_sigmoid"]


def test_reciprocal(gates):
    exprs, _ = children(gates, "reciprocal")
    ds = append(gates, exprs, keep_base=False)
    rows = ds.df.select(*[ds.value(n).alias(f"v{i}") for i, n in enumerate(ds.names)]).toPandas().to_numpy()
    assert np.allclose(rows[:, 0], [1, 0.5, 0.25])
    assert np.allclose(rows[:, 1], [-1, 0, 2])
    assert np.allclose(rows[:, 3], [2, 4, -1 / 3])
    each = append(gates, fit_unary("reciprocal_each", base_exprs(gates), stats_of(gates)), keep_base=False)
    assert [r[0] for r in each.df.select(each.value("b_recip")).collect()] == [-1.0, 0.0, 0.5]


def test_pairs(spark):
    ds = Dataset.of(spark.createDataFrame([(2.0, 1.0, 0.0), (4.0, 2.0, 1.0), (6.0, 3.0, 2.0)], "a double, b double, z double"))
    assert [e.name for e in children(ds, "div")[0]] == ["(a/b)"]
    assert [e.name for e in children(ds, "add")[0]] == ["(a+b)", "(a+z)", "(b+z)"]
    exprs, stats = children(ds, "product")
    assert stats["(a*b)"].hi == 18 and stats["(a*b)"].mean == pytest.approx(28 / 3)
    assert [e.name for e in children(ds, "minus", previous=["z"])[0]] == ["(a-b)", "(a-z)", "(b-z)"]


def test_zero_right_operand_is_skipped(spark):
    ds = Dataset.of(spark.createDataFrame([(1.0, 0.0), (2.0, 0.0)], "a double, z double"))
    assert fit_operator("add", base_exprs(ds), stats_of(ds)) == []


def test_near_zero_share(spark):
    eight = [(0.0, 0.0)] * 8 + [(1.0, 0.0)] + [(1.0, 1.0)]
    stats = stats_of(Dataset.of(spark.createDataFrame(eight, "p double, q double")))
    assert stats["p"].valid and not stats["q"].valid


def test_validity_limits():
    fine = dict(rows=10, nulls=0, zeros=0, near_zeros=0, mean=0.0, m2=1.0, lo=-1.0, hi=1.0)
    assert FeatureStats(**fine).valid
    for change in ({"nulls": 1}, {"hi": math.inf}, {"hi": 1e39}, {"lo": -1e39}, {"near_zeros": 9}):
        assert not FeatureStats(**{**fine, **change}).valid


def test_scalers(spark):
    ds = Dataset.of(spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (4.0, 5.0)], "x double, k double"))
    for op, want in (("mmnorm", [0, 1 / 3, 2 / 3, 1]), ("zscore", [-1.341641, -0.447214, 0.447214, 1.341641])):
        out = append(ds, children(ds, op)[0], keep_base=False)
        assert np.allclose([r[0] for r in out.df.select(out.value(f"x_{op}")).collect()], want)
        assert [r[0] for r in out.df.select(out.value(f"k_{op}")).collect()] == [0.0] * 4
        again = append(out, children(out, op)[0], keep_base=False)
        assert np.allclose([r[0] for r in again.df.select(again.value(f"x_{op}_{op}")).collect()], want, atol=1e-6)


def test_random_cosines_follow_the_kernel():
    weights, bias = fourier_weights(2, 20000, 1.0, 0)
    x, y = np.array([0.1, 0.2]), np.array([0.4, -0.1])
    z = [np.sqrt(2 / 20000) * np.cos(v @ weights + bias) for v in (x, y)]
    assert z[0] @ z[1] == pytest.approx(np.exp(-((x - y) ** 2).sum()), abs=0.02)
    assert random_cosines([Ref("a"), Ref("b")], seed=3) == random_cosines([Ref("a"), Ref("b")], seed=3)
    assert [e.name for e in random_cosines([Ref("a"), Ref("b")])] == ["a_rbfFeature", "b_rbfFeature"]


def test_both_summary_forms_agree(spark):
    rng = np.random.default_rng(1)
    rows = [
        (float(i % 3), None if i % 7 == 0 else float(v), float(w) + 1e6, float("inf") if i == 5 else 0.0)
        for i, (v, w) in enumerate(zip(rng.normal(0, 1, 500), rng.normal(0, 1e-3, 500)))
    ]
    df = spark.createDataFrame(rows, "y double, a double, b double, c double").repartition(5)
    for task in ("C", "R"):
        ds = Dataset.of(df, ["a", "b", "c"], "y", task)
        one = moments._narrow(ds, base_exprs(ds), True).orderBy("feature", "cls").toPandas()
        two = moments._wide(ds, base_exprs(ds), True).orderBy("feature", "cls").toPandas()
        finite = one["feature"] != "c"
        for c in ("rows", "nulls", "zeros", "near_zeros", "lo", "hi"):
            assert np.allclose(one[c].astype(float), two[c].astype(float), equal_nan=True), c
        for c in ("mean", "m2", "ym2", "cxy"):
            a, b = one[c][finite].astype(float), two[c][finite].astype(float)
            assert np.allclose(a, b, rtol=1e-4, atol=1e-9, equal_nan=True), c


def test_merged_classes_are_the_whole(spark):
    df = spark.createDataFrame([(float(i % 4), float(i * i)) for i in range(40)], "y double, x double")
    ds = Dataset.of(df, ["x"], "y")
    whole, parts = stats_of(ds)["x"], collect_stats(moments_frame(ds, by_label=True))["x"]
    assert parts.rows == whole.rows and parts.m2 == pytest.approx(whole.m2) and parts.hi == whole.hi


def test_univariate_scores(spark):
    c = Dataset.of(spark.createDataFrame([(0.0, 1.0), (0.0, 2.0), (1.0, 3.0), (1.0, 4.0)], "y double, x double"), ["x"], "y")
    assert univariate_scores(c).collect()[0]["score"] == pytest.approx(8.0)
    r = Dataset.of(spark.createDataFrame([(1.0, 1.0), (3.0, 2.0), (2.0, 3.0), (5.0, 4.0)], "y double, x double"), ["x"], "y", "R")
    assert univariate_scores(r).collect()[0]["score"] == pytest.approx(4.481481, abs=1e-5)


def test_catalog_lists_every_pair(spark):
    found = pair_catalog(spark, ["a", "b"], ["c"]).toPandas()
    assert set(found[found["op"] == "minus"]["name"]) == {"(a-b)", "(a-c)", "(b-c)"}
    assert len(found) == 12


def test_label_is_never_a_feature(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    assert Dataset.of(df, label="y").names == ["x"]
    with pytest.raises(ValueError):
        Dataset.of(df, ["x", "y"], "y")


@pytest.fixture(scope="module")
def parents(spark):
    """Two generations of columns: zeros, constants, gaps, large and tiny values among them."""
    rng = np.random.default_rng(8)
    x = rng.normal(1, 2, (200, 7))
    x[:, 2] = np.abs(x[:, 2]) + 0.1
    x[:, 3] = 0.0
    x[:, 4] = np.where(rng.random(200) < 0.9, 0.0, x[:, 4])
    x[:, 5] = 1e200 * x[:, 5]
    y = (x[:, 0] * x[:, 1] > 1) + (x[:, 2] > 2).astype(float)
    rows = [(i, *[None if k == 6 and i % 3 == 0 else float(v) for k, v in enumerate(r)], float(t)) for i, (r, t) in enumerate(zip(x, y))]
    names = list("abcdefg")
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} double" for n in names) + ", y double").repartition(5)
    return {task: Dataset.of(df, names, "y", task, "id") for task in ("C", "R")}


def listed(ds, operators, previous, rules):
    """Candidates listed one by one, judged from their own statistics: the plain way."""
    exprs = base_exprs(ds)
    stats = stats_of(ds)
    current, history = [e for e in exprs if e.name not in previous], [e for e in exprs if e.name in previous]
    found, taken = {}, set(ds.names)
    for op in operators:
        if op in BINARY:
            made = fit_binary(op, current, stats, history, rules.with_self, rules.skip_zero)
        else:
            made = fit_unary(rules.unary_name(op) if op != RBF else op, current, stats, seed=3)
        own = stats_of(ds, made) if made else {}
        for e in made:
            s = own[e.name]
            usable = s.nulls == 0 and math.isfinite(s.lo) and math.isfinite(s.hi) and s.lo < s.hi and s.zeros < 0.8 * s.rows
            if usable and (s.valid or not catalog.is_checked(rules.unary_name(op))) and e.name not in taken:
                taken.add(e.name)
                found.setdefault(op, []).append((e, s))
    return found


@pytest.mark.parametrize("task", ["C", "R"])
@pytest.mark.parametrize("rules", [catalog.DEFAULT_SET, catalog.OLDER_SET])
def test_blocks_give_the_listed_candidates(parents, monkeypatch, task, rules):
    monkeypatch.setattr(catalog, "SIDE", 2)
    monkeypatch.setattr(catalog, "PASS_BYTES", 4000)
    monkeypatch.setattr(catalog, "side_of", lambda classes: 2)
    ds, operators = parents[task], ["ln", "square", "sigmoid", "reciprocal", "abs", RBF, "div", "minus", "product"]
    want = listed(ds, operators, ["b", "f"], rules)
    tribes, stats = catalog.surviving(ds, operators, ["b", "f"], 3, None, rules)
    assert tribes == {op: [e for e, _ in own] for op, own in want.items()}
    for own in want.values():
        for e, s in own:
            got = stats[e.name]
            assert (got.rows, got.nulls, got.zeros, got.near_zeros) == (s.rows, s.nulls, s.zeros, s.near_zeros)
            assert np.allclose([got.mean, got.m2, got.lo, got.hi], [s.mean, s.m2, s.lo, s.hi], rtol=1e-9, equal_nan=True)


@pytest.mark.parametrize("task", ["C", "R"])
def test_best_candidates_by_score(parents, task):
    ds = parents[task]
    table = catalog.candidates(ds, ["product", "sin"], ["b"])
    scores = {r["feature"]: r["score"] for r in table.collect()}
    every, _ = catalog.surviving(ds, ["product", "sin"], ["b"])
    for op, exprs in every.items():
        want = univariate_scores(ds, exprs).collect()
        assert all(scores[r["feature"]] == pytest.approx(r["score"], rel=1e-6) for r in want)
    kept, stats = catalog.surviving(ds, ["product", "sin"], ["b"], limit=3)
    for op, exprs in kept.items():
        ranked = sorted(every[op], key=lambda e: -scores[e.name])[:3]
        assert {e.name for e in exprs} == {e.name for e in ranked} and set(stats) >= {e.name for e in exprs}


def test_catalog_bounds():
    assert catalog.side_of(1) == catalog.SIDE and catalog.side_of(10**6) == 1
    stats = {f"c{i}": FeatureStats(10, 0, 0, 0, 1.0, 1.0, 0.5, 2.0) for i in range(150)}
    names = list(stats)
    blocks = list(catalog.blocks_of(["add", "sin", "div"], names[:100], names[100:], stats))
    assert sum(b.size for b in blocks if b.operator == "add") == 100 * 99 // 2 + 100 * 50
    assert all(sum(b.size for b in part) * catalog.SUM_BYTES <= catalog.PASS_BYTES for part in catalog.passes(blocks, 1))
    assert all(len(list(b.rows())) == b.size for b in blocks)
