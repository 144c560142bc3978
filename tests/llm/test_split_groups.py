"""Links inside groups that longer prefixes split."""

import random

import pytest

from featloom.llm import forest


# With a share of one no group is hot, and all are joined by shuffle.
@pytest.mark.parametrize("hot_share", [forest.HOT_SHARE, 1])
def test_every_link_of_a_split_group_is_found(spark, monkeypatch, hot_share):
    """Pairs of similarity 0.85 in a family whose other members are alike enough to crowd every group."""
    monkeypatch.setattr(forest, "GROUP", 2)
    monkeypatch.setattr(forest, "HOT_SHARE", hot_share)
    rng, base, family = random.Random(5), [f"w{i}" for i in range(300)], []
    for i in range(30):
        places = rng.sample(range(4, 296, 5), 15)
        edit = lambda words, at, tag: [f"{tag}{k}" if k in at else w for k, w in enumerate(words)]
        member = edit(base, set(places[:7]), f"m{i}x")
        family += [(i, " ".join(member)), (100 + i, " ".join(edit(member, set(places[7:]), f"p{i}x")))]
    found = forest.near_duplicates(spark.createDataFrame(family, "doc_id long, text string"), 3, 0.85).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {i: i % 100 for i, _ in family}
