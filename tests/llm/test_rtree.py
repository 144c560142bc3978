"""Hard negatives against brute force, and the tree's bounds."""

import math

import numpy as np
import pytest

from featloom.llm import rtree


def plain(rows, chosen, positives=5, negatives=10, window=(30, 90)):
    """(anchor, positive, rank, negative, positive score, negative score) by comparing all rows."""
    one = {}
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        own = (label, [math.floor(256 * x) for x in vector])
        one[vec_id] = min(one.get(vec_id, own), own)
    found = []
    for anchor, (label, vector) in one.items():
        if not chosen(anchor):
            continue
        scores = sorted((-sum(a * b for a, b in zip(vector, v)), i, own) for i, (own, v) in one.items() if i != anchor)
        for less, positive, _ in [s for s in scores if s[2] == label][:positives]:
            fit = [(-s, i) for s, i, own in scores if own != label and window[0] * -less <= 100 * -s <= window[1] * -less]
            found += [(anchor, positive, rank + 1, i, -less, s) for rank, (s, i) in enumerate(fit[:negatives])]
    return sorted(found)


def vectors(seed, count, width, spread):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(6, width))
    return [(i, (middle[i % 6] + spread * rng.normal(size=width)).astype(np.float32).tolist(), int(rng.integers(0, 4))) for i in range(count)]


@pytest.mark.parametrize("seed, width, spread", [(1, 3, 0.3), (2, 16, 1.0), (3, 1, 0.5)])
def test_against_all_pairs(spark, monkeypatch, seed, width, spread):
    monkeypatch.setattr(rtree, "ANCHORS", 20)
    rows = vectors(seed, 700, width, spread)
    rows += [(1000 + i, rows[5][1], rows[5][2] + i % 2) for i in range(80)]
    df = spark.createDataFrame([(*r, r[0], "x") for r in rows], "vec_id long, embedding array<float>, label int, rank long, tile string")
    small = rtree.tiles
    monkeypatch.setattr(rtree, "tiles", lambda given, width: small(given, width, 60))
    found = rtree.hard_negatives(df, rtree.F.col("vec_id") % 10 == 0)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in found.collect()) == plain(rows, lambda i: i % 10 == 0)


def test_odd_rows(spark):
    rows = vectors(4, 120, 4, 0.8)
    rows += [(200, None, 1), (201, [1.0, None, 0.5], 1), (202, [float("nan")], 2), (203, [float("-inf")], 2), (204, [0.5, 0.5, 0.5, 0.5], None), (None, [1.0], 1)]
    rows += [(300, [0.25, -0.5], 1), (310, [], 1), (320, [0.1] * 9, 2), (50, [0.0, 2.0], 0), (50, [0.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = rtree.hard_negatives(df, positives=2, negatives=3, window=(10, 95))
    assert sorted(tuple(r) for r in found.collect()) == plain(rows, lambda i: True, 2, 3, (10, 95))


def test_empty_and_single(spark):
    schema = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(100, [1.0, 2.0], 3)], [(100, None, 3)]):
        assert rtree.hard_negatives(spark.createDataFrame(rows, schema)).count() == 0


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    points = rng.integers(-500, 500, (3000, 3))
    tree = rtree.Tree.packed(np.arange(3000), np.zeros(3000, np.int64), points)
    assert sorted(tree.ids.tolist()) == list(range(3000))
    asked = rng.integers(-500, 500, (40, 3))
    scores = rtree.products(asked, tree.vectors)
    for level, size in enumerate(rtree.LEAF * rtree.FAN**k for k in range(len(tree.lows))):
        least, most = tree.intervals(asked, level, slice(None))
        for box in range(len(tree.lows[level])):
            own = scores[:, box * size : (box + 1) * size]
            assert (least[:, box] <= own.min(axis=1)).all() and (own.max(axis=1) <= most[:, box]).all()
    opened = []
    keep = rtree.products

    def counted(left, right):
        if right is not None and len(right) <= rtree.LEAF and np.shares_memory(right, tree.vectors):
            opened.append(len(left))
        return keep(left, right)

    rtree.products = counted
    try:
        many = np.full(40, np.iinfo(np.int64).max)
        questions = rtree.Questions(asked, np.full(40, -1), np.zeros(40, np.int64), -many, many, np.zeros(40, np.int64))
        best = rtree.search(tree, questions, 5, True)
    finally:
        rtree.products = keep
    order = np.lexsort((np.broadcast_to(tree.ids, scores.shape), -scores), axis=1)[:, :5]
    assert (best.score == np.take_along_axis(scores, order, axis=1)).all() and (best.id == tree.ids[order]).all()
    assert sum(opened) < 40 * len(tree.lows[0]) / 3


def test_large_components():
    big = np.full((1, 2), 2**30)
    assert rtree.products(big, big).tolist() == [[2**61]]
    with pytest.raises(OverflowError):
        rtree.products(big * 4, big)
