"""Exact, near and substring duplicates against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from featloom.llm import blocks, chunks, components, exact, forest, suffixes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(seed=3):
    """Copies, near copies, shared passages, repeats inside a text, short, empty and null ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeéß", k=rng.randint(1, 7)))
    passage = [word() for _ in range(40)]
    found = [None, "", "  ", "one", "two words", "A b\tc", "a b c", "x " * 300, "ab" * 200]
    for _ in range(25):
        found.append(" ".join(word() for _ in range(rng.randint(1, 120))))
    base = [word() for _ in range(150)]
    for i in range(30):
        near = list(base)
        for _ in range(i % 6):
            near[rng.randrange(150)] = word()
        found.append(" ".join(near))
    for i in range(12):
        found.append("\n".join([word() for _ in range(20)]) + " " + " ".join(passage[: 10 + 3 * i]) + "  " + word())
    found += [found[12], found[12] + " ", found[14].replace(" ", "\n"), found[20] + " " + found[20]]
    return found


@pytest.fixture(scope="module")
def rows():
    return [(i, text) for i, text in enumerate(texts())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    clashing = [(i, t, True, i, "x", "y") for i, t in rows]
    return spark.createDataFrame(clashing, "doc_id long, text string, kept boolean, bucket long, digest string, row string").repartition(5)


def test_exact(docs, rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    want = {i: (own[0], len(own), i == own[0], hashlib.sha256(t.encode()).digest()) for t, own in groups.items() for i in own}
    found = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], bytes(r["digest"])) for r in exact.exact_duplicates(docs).collect()}
    assert found == want
    left = exact.drop_duplicates(docs)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == sorted(own[0] for own in groups.values())


def test_exact_with_repeated_and_null_ids(spark):
    rows = [(1, "a b"), (1, "a  b"), (1, "a b"), (None, "a b"), (None, "z"), (None, None), (5, ""), (2, "q"), (2, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = exact.exact_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in found) == Counter(
        [(1, 1, 4, True)] * 3 + [(None, 1, 4, False), (None, None, 1, True), (None, 5, 2, False), (5, 5, 2, True), (2, 2, 1, True), (2, 2, 1, True)])
    assert Counter(r["doc_id"] for r in exact.drop_duplicates(docs).collect()) == Counter([1, None, 5, 2, 2])


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(1).integers(0, 1 << 63, (5000, 4)).astype(np.uint64)
    mapped = exact.PerfectHash.unpacked(exact.PerfectHash.build(keys).packed())
    assert sorted(mapped.slots(keys).tolist()) == list(range(5000))
    other = np.random.default_rng(2).integers(0, 1 << 63, (1000, 4)).astype(np.uint64)
    slots = mapped.slots(other)
    assert slots.max() < 5000 and slots.min() >= -1


def shingle_set(text, length):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + length]) for i in range(max(1, len(words) - length + 1))}


def brute_components(rows, length, percent):
    sets = {i: shingle_set(t, length) for i, t in rows}
    label = {i: i for i, _ in rows}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {i: low if v == high else v for i, v in label.items()}
    return label, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("length,similarity", [(3, 0.85), (5, 0.8)])
def test_near(docs, rows, length, similarity):
    label, sizes = brute_components(rows, length, round(100 * similarity))
    found = forest.near_duplicates(docs, length, similarity).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == label
    assert {r["doc_id"]: r["n_shingles"] for r in found} == sizes
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


@pytest.mark.parametrize("open_pairs", [0, 100])
def test_near_in_dense_groups(docs, rows, monkeypatch, open_pairs):
    """Prefixes that have to grow, and covers in place of all pairs, lose no link."""
    monkeypatch.setattr(forest, "GROUP", 12)
    monkeypatch.setattr(forest, "SMALL", 2)
    monkeypatch.setattr(forest, "OPEN_PAIRS", open_pairs)
    label, _ = brute_components(rows, 3, 85)
    found = forest.near_duplicates(docs, 3, 0.85).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == label


def test_near_with_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(4, text), (None, text), (4, text), (9, text + " end"), (10, None), (11, "")], "doc_id long, text string")
    found = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in forest.near_duplicates(docs).collect())
    assert found == Counter([(4, 4, True)] * 2 + [(None, None, True), (9, 4, False), (10, 10, True), (11, 11, True)])
    assert Counter(r["doc_id"] for r in forest.drop_near_duplicates(docs).collect()) == Counter([4, 4, None, 10, 11])


def brute_words(rows, window=13):
    first, docs_words = {}, {i: WORD.findall(t or "") for i, t in rows}
    for i, words in docs_words.items():
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            first[key] = min(first.get(key, i), i)
    found = {}
    for i, words in docs_words.items():
        gone = set()
        for k in range(len(words) - window + 1):
            if first[tuple(words[k : k + window])] < i:
                gone.update(range(k, k + window))
        found[i] = (len(words), len(gone), [w for k, w in enumerate(words) if k not in gone])
    return found


@pytest.mark.parametrize("chunk_bytes,bucket_keys", [(4_000_000, 3_000_000), (3_000, 200)])
def test_repeated_words(docs, rows, chunk_bytes, bucket_keys, monkeypatch):
    monkeypatch.setattr(chunks, "BUCKET_KEYS", bucket_keys)
    want = brute_words(rows)
    found = blocks.remove_repeats(docs, chunk_bytes=chunk_bytes).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], WORD.findall(r["left_text"])) for r in found} == want
    assert all(sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in found)


def test_cut_texts_keep_rows_and_columns(docs, rows):
    want = brute_words(rows)
    left = blocks.cut_repeats(docs)
    assert left.columns == docs.columns
    original = dict(rows)
    for r in left.collect():
        assert (r["kept"], r["bucket"], r["digest"], r["row"]) == (True, r["doc_id"], "x", "y")
        assert r["text"] == original[r["doc_id"]] if not want[r["doc_id"]][1] else WORD.findall(r["text"]) == want[r["doc_id"]][2]


def brute_bytes(rows, length=100):
    seen, found = set(), {}
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - length + 1):
            part = raw[k : k + length]
            if part in seen:
                gone[k : k + length] = True
            seen.add(part)
        runs = int(np.sum(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        found[i] = (len(raw), int(gone.sum()), runs, bytes(np.frombuffer(raw, np.uint8)[~gone]))
    return found


@pytest.mark.parametrize("chunk_bytes,bucket_keys", [(4_000_000, 3_000_000), (3_000, 200)])
def test_repeated_bytes(docs, rows, chunk_bytes, bucket_keys, monkeypatch):
    monkeypatch.setattr(chunks, "BUCKET_KEYS", bucket_keys)
    found = suffixes.remove_repeated_bytes(docs, chunk_bytes=chunk_bytes).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["left_bytes"])) for r in found} == brute_bytes(rows)


def test_removal_with_null_and_repeated_ids(spark):
    text = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(3, text), (3, text), (None, text), (5, None)], "doc_id long, text string")
    words = Counter((r["doc_id"], r["n_removed"]) for r in blocks.remove_repeats(docs).collect())
    assert words == Counter([(3, 0)] * 2 + [(None, 40), (5, 0)])
    raw = Counter((r["doc_id"], r["n_removed"]) for r in suffixes.remove_repeated_bytes(docs).collect())
    assert raw == Counter([(3, 0)] * 2 + [(None, len(text)), (5, 0)])


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (205, 203), (203, 201)]
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[i] for i in range(61)} == {0} and {found[100 + i] for i in range(30)} == {100} and found[205] == 201
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("run", [exact.exact_duplicates, exact.drop_duplicates, forest.near_duplicates, forest.drop_near_duplicates, blocks.remove_repeats, blocks.cut_repeats, suffixes.remove_repeated_bytes])
def test_empty_tables(spark, run):
    assert run(spark.createDataFrame([], "doc_id long, text string")).count() == 0
