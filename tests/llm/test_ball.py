"""SimHash fingerprints and their links against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from featloom.llm import ball, components
from test_runs import split


def plain_print(text, length=3):
    words = split("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    found = [" ".join(words[i : i + length]) for i in range(len(words) - length + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in found]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=3):
    """Root of each fingerprint by comparing all pairs."""
    parent = {p: p for p in prints}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    own = sorted(parent)
    for i, a in enumerate(own):
        for b in own[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                parent[root(b)] = root(a)
    return {p: root(p) for p in own}


def family(rng, count):
    """Fingerprints at all small distances from one another, alone and in crowds."""
    found = [0, 2**64 - 1]
    for _ in range(count):
        base = rng.getrandbits(64) if rng.random() < 0.4 else rng.choice(found)
        found.append(base ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(6))}))
    return found


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_links_keep_components(spark, radius):
    rng = random.Random(radius)
    prints = sorted(set(family(rng, 600)))
    rows = spark.createDataFrame([(p - (p >> 63 << 64),) for p in prints], "fingerprint long")
    found = {tuple(v % 2**64 for v in r) for r in ball.near_links(rows, radius).collect()}
    assert all(0 < (a ^ b).bit_count() <= radius for a, b in found)
    parent = {p: p for p in prints}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a, b in found:
        parent[root(b)] = root(a)
    want = plain_components(prints, radius)
    assert len({root(p) for p in prints}) == len(set(want.values()))
    assert all(root(p) == root(want[p]) for p in prints)


def test_crowd_around_one_variant(spark):
    """Every fingerprint within two bits of one: the largest group that one variant can have."""
    rng = random.Random(4)
    middle = rng.getrandbits(64)
    prints = [middle] + [middle ^ 1 << i for i in range(64)] + [middle ^ 1 << i ^ 1 << j for i in range(64) for j in range(i)]
    rows = spark.createDataFrame([(p - (p >> 63 << 64),) for p in prints], "fingerprint long")
    found, _ = components.roots(ball.near_links(rows))
    assert found.count() == len(prints) and found.select("root").distinct().count() == 1


def test_fingerprints(spark):
    rng = random.Random(2)
    given = [None, "", " \n", "One", "one TWO", "ÄB c d", "a b c", "a  b\tc", "x " * 50, "é" * 500, "w" * 200_000]
    given += [" ".join(rng.choice(["a", "B", "cc", "Ddd", "é"]) for _ in range(rng.randrange(400))) for _ in range(60)]
    given.append(" ".join(f"w{i % 977}" for i in range(250_000)))
    rows = [(i, t, "x") for i, t in enumerate(given)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    found = {r["doc_id"]: r["fingerprint"] % 2**64 for r in ball.fingerprints(docs).collect()}
    assert found == {i: plain_print(t) for i, t in enumerate(given)}
    own = spark.createDataFrame([("a b c",), ("é",)], "s string").select("s", F.xxhash64("s").alias("h"))
    assert all(r["h"] % 2**64 == xxhash.xxh64_intdigest(r["s"].encode(), 42) for r in own.collect())


def test_query(spark, tmp_path):
    rng = random.Random(6)
    base = [f"w{rng.randrange(300)}" for _ in range(250)]
    given = [(3, None), (1, ""), (None, "  "), (40, "solo"), (40, "solo"), (None, "only here")]
    for i in range(80):
        words = list(base if i % 2 else rng.sample(base, 200))
        for _ in range(i % 4):
            words[rng.randrange(len(words))] = f"v{rng.randrange(9)}"
        given.append((100 + i, " ".join(words)))
    given += [(500 + i, given[6 + i % 9][1]) for i in range(300)]
    path = str(tmp_path)
    rows = [(i, t, i, "x") for i, t in given]
    spark.createDataFrame(rows, "doc_id long, text string, component_id long, root string").repartition(7).write.parquet(f"{path}/documents.parquet")
    prints = [plain_print(t) for _, t in given]
    root = plain_components(prints)
    least = {}
    for (i, _), p in zip(given, prints):
        if i is not None:
            least[root[p]] = min(least.get(root[p], i), i)
    want = sorted([(i, f"{p:016x}", least.get(root[p])) for (i, _), p in zip(given, prints)], key=repr)
    assert sorted([tuple(r) for r in ball.op12_simhash_ball(spark, path).collect()], key=repr) == want
    assert len({c for _, _, c in want}) < len(set(prints))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ball.near_fingerprints(docs).count() == 0


def test_rounds_of_components(spark):
    """Neither long chains, however numbered, nor stars take many rounds."""
    count = 10_000
    ids = np.random.default_rng(1).permutation(count + 1)
    for chain in (np.arange(count + 1), ids):
        edges = spark.createDataFrame([(int(a), int(b)) for a, b in zip(chain[:-1], chain[1:])], "a long, b long")
        found, rounds = components.roots(edges)
        assert rounds <= 20 and found.count() == count + 1 and found.select("root").distinct().count() == 1
    star = spark.range(1, 5001).select(F.lit(777_777).cast("long").alias("a"), F.col("id").alias("b"))
    found, rounds = components.roots(star)
    assert rounds <= 3 and found.count() == 5001


def test_hot_keys_join(spark):
    """Rows of one key in a table large enough to be asked for hot keys."""
    rows = spark.range(150_000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 40_000).cast("long").alias("key"))
    table = spark.range(30_000).select(F.col("id").alias("key"), (F.col("id") * 2).alias("value"))
    found = components.keyed_join(rows, table, "key")
    want = rows.join(table, "key")
    assert found.columns == want.columns and found.exceptAll(want).isEmpty() and found.count() == want.count()
