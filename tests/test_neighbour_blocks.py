"""Blocks of the neighbour search: tiles of the products, and cells where a ball touches most of them."""

from __future__ import annotations

import numpy as np
import pytest

from featloom import Dataset
from featloom.operators import cells, neighbors


def _brute(query, train, ids, k):
    exact = np.sqrt(((query[:, None, :] - train[None, :, :]) ** 2).sum(axis=2))
    return np.array([np.lexsort((ids, row))[:k] for row in exact])


def test_tiles_find_the_neighbours_of_all_rows(monkeypatch):
    rng = np.random.default_rng(5)
    train = np.round(rng.normal(size=(300, 3)), 1)
    train[100:180] = train[7]
    ids = rng.permutation(300).astype(float)
    for tile, pairs in ((3, 10), (7, 1 << 17), (64, 50), (1000, 1)):
        monkeypatch.setattr(neighbors, "_TRAIN_TILE", tile)
        monkeypatch.setattr(neighbors, "_EXACT_PAIRS", pairs)
        monkeypatch.setattr(neighbors, "_QUERY_CHUNK", 41)
        found, distance = neighbors.nearest(train, train, ids, 5)
        assert (found == _brute(train, train, ids, 5)).all()
        assert np.array_equal(distance, np.sqrt(((train[found] - train[:, None, :]) ** 2).sum(axis=2)))


def test_incomplete_features_are_an_error():
    train = np.ones((10, 2))
    train[3, 1] = np.nan
    with pytest.raises(ValueError):
        neighbors.nearest(train, train, np.arange(10.0), 5)


def test_blocks_grow_with_the_rows_where_no_side_is_cut():
    # What moves is rows times blocks.
    for rows in (100_000, 600_000, 1_000_000):
        assert rows / neighbors.block_rows(rows, 64) <= 16
    assert neighbors.block_rows(10**9, 64) == 1 << 16
    assert neighbors.block_rows(10**6, 2) == neighbors.BLOCK_ROWS
    assert neighbors.block_rows(10**9, 4000) <= 2 * neighbors.BLOCK_ROWS


def test_few_cells_in_many_dimensions(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 16)
    monkeypatch.setattr(cells, "CELL_ROWS", 16)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1200, 8))
    names = [f"e{i}" for i in range(8)]
    df = spark.createDataFrame([(i, float(i % 7), *map(float, r)) for i, r in enumerate(x)], ["id", "y", *names])
    ds = Dataset.of(df, names, "y", "R", "id")
    grown, met = [], neighbors.met
    monkeypatch.setattr(neighbors, "met", lambda visiting, found, *a: grown.append(found) or met(visiting, found, *a))
    made = neighbors.NearestNeighbours.fit(ds, max_cells=0).transform(ds)
    got = {r[0]: r[1] for r in made.df.select("id", made.value("nn_target")).collect()}
    found = _brute(x, x, np.arange(1200), 5)
    assert all(got[i] == pytest.approx(np.mean(own % 7)) for i, own in enumerate(found))
    assert grown[0].boxes.count() <= 2 * neighbors.FEW_CELLS
