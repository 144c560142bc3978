"""Repeated byte strings under an anchor that too many runs share."""

import random

import numpy as np
import pytest

from featloom.llm import suffixes
from test_duplicates import brute_bytes


@pytest.mark.parametrize("hot_runs", [0, 8])
def test_hot_anchors_give_the_same_bytes(spark, hot_runs, monkeypatch):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choices("abcdefgh", k=n))
    footer, passage = word(60), word(150)
    rows = [(i, word(80) + footer + word(80)) for i in range(40)] + [(100 + i, word(i) + passage[i:] + footer * (i % 3)) for i in range(30)]
    rows += [(200, rows[3][1]), (201, rows[3][1] + rows[3][1]), (202, None), (203, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = suffixes.remove_repeated_bytes(docs, chunk_bytes=2_000, hot_runs=hot_runs).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["left_bytes"])) for r in found} == brute_bytes(rows)


def test_a_hot_anchor_leaves_its_bucket():
    """No bucket is sent the runs of an anchor that occurs more often than the limit."""
    text = np.random.default_rng(3).integers(97, 123, 400).astype(np.uint8)
    data = np.tile(text, 6)
    given = suffixes.C.Texts(np.arange(6), data, np.arange(7) * 400, 0, None)
    request = suffixes.anchor_requests(0, 40)(given, suffixes.C.reply_table([]))
    cold = suffixes.answer_keys(suffixes.ANCHORS, 3)(request)
    assert set(cold["kind"].to_pylist()) == {suffixes.HOT}
    # Bucket 0 is of runs; those from 1 on are of the hashes under hot anchors.
    assert set(suffixes.run_requests(0, 40, 0)(given, cold)["bucket"].to_pylist()) == {1}
    strings = suffixes.hot_strings(suffixes.Runs(given, 40), 0, 40, cold)
    assert len(strings.key) == 301 and np.count_nonzero(strings.later) == 5 * 301


def test_equal_suffixes_have_equal_anchors_over_block_borders(monkeypatch):
    """Anchors are the smallest grams of their suffixes, whatever the blocks; rows of any length, empty ones too."""
    rng = np.random.default_rng(5)
    lengths = [0, 99, 100, 0, 5000, 1, 131, 2000, 0]
    data = rng.integers(97, 100, sum(lengths)).astype(np.uint8)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    given = suffixes.C.Texts(np.arange(len(lengths)), data, starts, 0, None)
    whole = suffixes.Runs(given, 40)
    monkeypatch.setattr(suffixes, "BLOCK", 64)
    small = suffixes.Runs(given, 40)
    for name in ("first", "last", "anchor", "row", "key"):
        assert getattr(whole, name).tolist() == getattr(small, name).tolist()
    covered = sorted(i for a, b in zip(whole.first, whole.last) for i in range(a, b + 1))
    assert covered == [i for r, n in enumerate(lengths) for i in range(starts[r], starts[r] + n - 99)]
    sums = suffixes.gram_sums(data) * suffixes.SHUFFLER & ~suffixes.LOW
    for a, b, anchor in zip(whole.first, whole.last, whole.anchor):
        for i in range(a, b + 1):
            assert anchor == i + int(np.argmin(sums[i : i + 69]))


def test_more_chunks_than_table_buckets(spark, monkeypatch):
    rng = random.Random(12)
    passage = "".join(rng.choices("abcdefgh", k=160))
    rows = [(i, "".join(rng.choices("abcdefgh ", k=90)) + passage[i % 7 :]) for i in range(60)]
    monkeypatch.setattr(suffixes.C, "TABLE_BUCKETS", 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = suffixes.remove_repeated_bytes(docs, chunk_bytes=500).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["left_bytes"])) for r in found} == brute_bytes(rows)
