from functools import partial

import numpy as np
import pytest

from featloom import Dataset
from featloom.functions.scalar import OPERATOR_NAMES
from featloom.operators.moments import stats_of
from featloom.operators.sampling import random_groups
from featloom.plans import evolve as E
from featloom.plans import tournament as G
from featloom.plans.fitness import LinearScorer
from featloom.plans.selection import important_features
from featloom.streaming.apply import stream_features, write_features
from featloom.operators.generate import children


class LengthScorer:
    """Fitness is known by name: the sum of the numbers in the names."""

    def score_many(self, ds, groups, stats=None):
        return [(float(sum(int(e.name[1:]) for e in g)), 0.0) for g in groups]


class Named:
    def __init__(self, name):
        self.name = name


def arena():
    return G.Arena(None, LengthScorer(), {f"f{i}": Named(f"f{i}") for i in range(40)}, {}, 0)


def group(*numbers):
    return G.Group(tuple(f"f{i}" for i in numbers), float(sum(numbers)))


def test_weights():
    ranking = ["a", "b", "c", "d"]
    assert G.updated_weights(dict.fromkeys(ranking, 4.0), ranking) == {"a": 3.0, "b": 3.5, "c": 4.0, "d": 4.5}
    low = G.updated_weights({"a": 0.5, "b": 1.0, "z": 7.0}, ["a", "b"])
    assert low == {"a": 0.0, "b": 1.0, "z": 7.0}


def test_operator_sample():
    weights = G.initial_weights(4)
    drawn = G.sample_operators(weights, seed=1)
    assert len(drawn) == round(0.9 * 21) == len(set(drawn)) and set(drawn) <= set(OPERATOR_NAMES)
    assert drawn == G.sample_operators(weights, seed=1)
    assert "cos" not in G.sample_operators({**weights, "cos": 0.0}, 1.0, 2)


def test_heavier_operators_are_drawn_more_often():
    weights = {"a": 9.0, "b": 1.0}
    first = [G.sample_operators(weights, 0.5, seed)[0] for seed in range(300)]
    assert 0.82 < first.count("a") / 300 < 0.97


def test_plunge_takes_the_better_halves():
    a = arena()
    weak, strong = group(30, 1), group(10, 2)
    (winner,) = G.plunge(a, [(weak, strong)])
    assert set(winner.names) == {"f30", "f10"}
    (kept,) = G.plunge(a, [(group(1, 2), group(20, 21))])
    assert set(kept.names) == {"f20", "f21"}


def test_trade_pairs_opposite_ranks():
    ranking = [(f"t{i}", group(i + 1)) for i in range(5)]
    survivors = G.plunge_between(arena(), ranking)
    assert len(survivors) == 3 and survivors[-1].names == ("f3",)


def test_inner_rounds_only_improve():
    a = arena()
    ranked = {"t": sorted((group(*g) for g in random_groups(range(30), 10, 1)), key=lambda g: g.fitness)}
    best = G.plunge_inside(a, ranked)["t"]
    assert best.fitness >= ranked["t"][-1].fitness


def test_frames_agree_with_the_rules(spark):
    scores = spark.createDataFrame([(f"t{i}", float(i), 4.0) for i in range(5)], "tribe string, fitness double, weight double")
    ranked = G.rank_frame(scores)
    weights = {r["tribe"]: r["new_weight"] for r in G.weight_frame(ranked).collect()}
    assert weights == G.updated_weights(dict.fromkeys(weights, 4.0), sorted(weights))
    trades = {(r["weak"], r["strong"]) for r in G.trade_frame(ranked).collect()}
    assert trades == {("t0", "t4"), ("t1", "t3"), ("t2", None)}


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(2, 1, (300, 3))
    y = (x[:, 0] * x[:, 1] + 0.1 * rng.normal(0, 1, 300) > 4).astype(float)
    rows = [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return Dataset.of(spark.createDataFrame(rows, "id long, a double, b double, c double, y double"), ["a", "b", "c"], "y", "C", "id")


def small_config(tmp_path=None, **changes):
    settings = dict(generations=2, inflation=3, current_limit=12, history_limit=4, final_scorer=LinearScorer(),
                    selector=partial(important_features, trees=5, depth=4), share_steps=(0.5, 0.9), size_steps=(0.9, 0.6),
                    seed=1, folder=str(tmp_path) if tmp_path else None)
    return E.Config(**{**settings, **changes})


def test_candidates_are_valid_and_new(table):
    ds = E.prepared(table)
    tribes, stats = G.new_candidates(ds, (), ["abs", "product", "zscore"], 0)
    assert set(tribes) <= {"abs", "product", "zscore"} and len(tribes["product"]) == 3
    names = [e.name for c in tribes.values() for e in c]
    assert len(names) == len(set(names)) and not set(names) & set(ds.names) and set(stats) == set(names)
    assert all(stats[n].nulls == 0 for n in names)


def test_run_end_to_end(table, tmp_path):
    config = small_config(tmp_path)
    result = E.run(table, config)
    report = {r["stage"]: r for r in result.report.collect()}
    assert set(report) == {"base", "coarse", "final"} and report["final"]["features"] <= report["coarse"]["features"]
    total = result.evolution.total
    assert {"a", "b", "c"} <= set(total.names) and "y" not in total.names and total.df.count() == 300
    catalog = {r["feature"]: r["operators"] for r in result.evolution.catalog().collect()}
    assert max(catalog.values()) == 2 and catalog["a"] == 0
    assert (tmp_path / "final").exists() and (tmp_path / "gen=2").exists()
    again = E.evolve(E.prepared(table), config)
    assert again.total.names == total.names and again.weights == result.evolution.weights


def test_first_version(table):
    config = small_config(generations=2, first_version=True, history_limit=3, operators=("square", "add", "product", "sin"))
    evolution = E.evolve(E.prepared(table), config)
    assert set(evolution.weights.values()) == {2.0} and {"a", "b", "c"} <= set(evolution.total.names)
    assert all("y" not in n for n in evolution.total.names) and evolution.total.df.count() == 300


def test_stored_values_equal_the_names(table, tmp_path):
    """Every stored column holds what its name says."""
    evolution = E.evolve(E.prepared(table), small_config(tmp_path, generations=1))
    total = evolution.total
    pdf = total.df.select("id", *[total.value(n).alias(f"v{i}") for i, n in enumerate(total.names)]).toPandas().set_index("id")
    base = table.df.toPandas().set_index("id").loc[pdf.index]
    for i, n in enumerate(total.names):
        if n in ("(a*b)", "(a+b)", "(a-b)", "(b*c)"):
            want = eval(n, {}, {c: base[c] for c in "abc"})
            assert np.allclose(pdf[f"v{i}"], want, rtol=1e-5)


def test_stream_has_the_batch_values(spark, table, tmp_path):
    exprs, _ = children(table, "zscore")
    source = str(tmp_path / "in")
    table.df.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(table.df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    features = stream_features(stream, table, exprs, ["id"])
    query = write_features(features, str(tmp_path / "out"), f"f{abs(hash(str(tmp_path)))}")
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).toPandas().sort_values("id")
    stats = stats_of(table)
    want = (table.df.toPandas().sort_values("id")["a"] - stats["a"].mean) / stats["a"].std
    assert len(got) == 300 and np.allclose(got["a_zscore"], want)
