"""Work that a run does once for many feature sets."""

from __future__ import annotations

from functools import partial

import numpy as np

from featloom import Dataset
from featloom.operators.expr import Ref
from featloom.operators.folds import with_folds
from featloom.operators.moments import stats_of
from featloom.plans import evolve as E
from featloom.plans import fitness, selection
from featloom.plans import tournament as G


def _table(spark, rows=400):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(rows, 4))
    y = (x[:, 0] + 0.5 * x[:, 1] + 0.3 * rng.normal(size=rows) > 0).astype(float)
    table = [(i, *map(float, r), float(c)) for i, (r, c) in enumerate(zip(x, y))]
    return Dataset.of(spark.createDataFrame(table, "id long, a double, b double, c double, d double, y double"), list("abcd"), "y", "C", "id")


def test_products_of_a_set_serve_the_groups_inside_it(spark, monkeypatch):
    ds = with_folds(_table(spark))
    ds = ds.with_df(spark.createDataFrame(ds.df.toPandas()))
    exprs = [Ref(n) for n in ds.names]
    stats = stats_of(ds, exprs)
    groups = [[exprs[0]], [exprs[2], exprs[1]], exprs[1:]]
    alone = fitness.LinearScorer().score_many(ds, groups, stats)
    calls, summed = [], fitness.gram_matrices
    monkeypatch.setattr(fitness, "gram_matrices", lambda *a: calls.append(1) or summed(*a))
    scorer = fitness.LinearScorer()
    scorer.sum_together(ds, [exprs], stats)
    assert np.allclose(scorer.score_many(ds, groups, stats), alone)
    assert np.allclose(scorer.score_many(ds, groups[1:], stats), alone[1:])
    # One pass for the products, one for the outcomes of each call.
    assert len(calls) == 3
    wide = fitness.LinearScorer()
    wide.sum_together(ds, [exprs], stats, widest=3)
    assert not wide._products.get("kept")
    assert np.allclose(wide.score_many(ds, groups, stats), alone)


def test_contests_read_the_products_of_their_tribe(spark, monkeypatch):
    ds = with_folds(_table(spark))
    ds = ds.with_df(spark.createDataFrame(ds.df.toPandas()))
    tribes, stats = G.new_candidates(ds, (), ["square", "add"], seed=1)
    exprs = {e.name: e for own in tribes.values() for e in own}
    names = {op: [e.name for e in own] for op, own in tribes.items()}
    calls, summed = [], fitness._products
    monkeypatch.setattr(fitness, "gram_matrices", lambda t, f, _g=fitness.gram_matrices: calls.append(f.func is summed) or _g(t, f))
    arena = G.Arena(ds, fitness.LinearScorer(), exprs, stats)
    ranked = G.inner_competition(arena, names, {op: 2 for op in names})
    G.plunge_eliminate(arena, ranked)
    assert calls.count(True) == 1


def test_prepared_rows_are_dealt_to_all_tasks(spark, monkeypatch):
    monkeypatch.setattr(E, "ROWS_PER_TASK", 100)
    ds = E.prepared(_table(spark, 2000))
    assert ds.df.count() == 2000
    cores = spark.sparkContext.defaultParallelism
    assert len(ds.df.inputFiles()) == cores * -(-2000 // (100 * cores))


def test_final_selection_repeats_no_fit_of_the_search(spark, monkeypatch):
    ds = E.prepared(_table(spark))
    fits, inner = [], selection.forest_importances
    monkeypatch.setattr(selection, "forest_importances", lambda d, *a: fits.append(tuple(d.names)) or inner(d, *a))
    config = E.Config(final_scorer=fitness.LinearScorer(), selector=partial(selection.important_features, trees=3, depth=2),
                      share_steps=(0.5, 1.0), size_steps=(0.9, 0.4))
    known = E.Known(config)
    share, size, rows = E.search_coefficients(ds, ds, config, known)
    final, report = E.final_selection(ds, ds, share, size, config, known)
    assert len(fits) == len(set(fits))
    assert final.df is ds.df
    again, expected = E.final_selection(ds, ds, share, size, config)
    assert again.names == final.names and expected.collect() == report.collect()
    assert E.search_coefficients(ds, ds, config) == (share, size, rows)
