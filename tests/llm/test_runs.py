"""Periodic runs against a search of every period."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from featloom.llm import runs

BLANK = "\x20\t\n\x0b\x0c\r"


def split(text):
    found, word = [], ""
    for c in text or "":
        if c in BLANK:
            found += [word] if word else []
            word = ""
        else:
            word += c
    return found + ([word] if word else [])


def plain_runs(words, least=6, exponent=4):
    """(start, length, period) by trying every period."""
    found = {}
    for period in range(1, len(words) // exponent + 1):
        i = 0
        while i + period < len(words):
            start = i
            while i + period < len(words) and words[i] == words[i + period]:
                i += 1
            if i - start + period >= max(least, exponent * period):
                found.setdefault((start, i - start + period), period)
            i += 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda run: (run[0], run[2]))


def collapsed(words, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def random_texts(seed):
    rng = random.Random(seed)
    for _ in range(60):
        count = rng.choice([0, 1, 5, 6, 7, 24, 100, 300])
        words = [rng.choice(["a", "b", "é", "long" * 9][: rng.choice([1, 2, 4])]) for _ in range(count)]
        if count and rng.random() < 0.6:
            start = rng.randrange(count)
            period = 1 + (count - start) // rng.randint(3, 10)
            words = [words[i] if i < start else words[start + (i - start) % period] for i in range(count)]
        yield rng.choice(["", " ", "\n\t"]) + rng.choice([" ", "  ", "\r\n", "\x0b"]).join(words) + rng.choice(["", " "])


@pytest.mark.parametrize("seed", range(4))
def test_against_every_period(seed):
    given = list(random_texts(seed))
    raw = [t.encode() for t in given]
    starts = np.cumsum([0, *map(len, raw)]).astype(np.int64)
    counts, found, joined, bounds = runs.runs_of(np.frombuffer(b"".join(raw), np.uint8), starts, 6, 4)
    for k, text in enumerate(given):
        words = split(text)
        want = plain_runs(words)
        assert counts[k] == len(words)
        assert [tuple(r[1:].tolist()) for r in found if r[0] == k] == want
        assert joined.tobytes()[bounds[k] : bounds[k + 1]].decode() == collapsed(words, want)


def test_cover_meets_every_pair():
    for i in range(runs.PERIOD):
        for j in range(runs.PERIOD):
            k = runs.MEETING[i, j]
            assert k < runs.PERIOD and {(i + k) % runs.PERIOD, (j + k) % runs.PERIOD} <= set(runs.RESIDUES)


def test_extensions_of_tied_suffixes():
    rng = np.random.default_rng(5)
    codes = np.concatenate([np.tile(rng.integers(1, 3, 70), 9), [0], np.ones(500, np.int64), [0], rng.integers(1, 3, 200), [0]])
    row = np.cumsum(np.concatenate([[0], codes[:-1] == 0]))
    found = runs.Extensions(codes, row)
    left = rng.integers(0, len(codes), 3000)
    right = rng.integers(0, len(codes), 3000)
    fit = (row[left] == row[right]) & (left != right)
    left, right = left[fit], right[fit]
    for i, j, n in zip(left.tolist(), right.tolist(), found.between(left, right).tolist()):
        want = 0
        while codes[i + want] == codes[j + want] and codes[max(i, j) + want]:
            want += 1
        assert n == want


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_query(spark, tmp_path):
    rng = random.Random(9)
    given = [(i, t, "x") for i, t in enumerate(random_texts(7))]
    given += [(100 + i, " ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(400))), "y") for i in range(60)]
    given += [(7, None, None), (7, "a " * 9, None), (None, "b " * 8, "z"), (11, "ab cd " * 30_000 + "e " * 7, "long"), (12, "x" * 300_000, "long word")]
    path = str(tmp_path)
    spark.createDataFrame(given, "doc_id long, text string, runs string").write.parquet(f"{path}/documents.parquet")
    want = []
    for doc_id, text, _ in given:
        words = split(text) if doc_id is None else planted(doc_id, split(text))
        own = plain_runs(words) if len(words) < 1000 else [(0, 60_000, 2), (60_000, 7, 1)]
        best = min(own, key=lambda r: (-r[1], r[0], r[2])) if own else (None,) * 3
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in own)
        shas = [hashlib.sha256(t.encode()).hexdigest() for t in (lines, collapsed(words, own))]
        want.append((doc_id, len(own), *best, 1000 * best[1] // best[2] if own else None, *shas))
    assert zlib.crc32(b"11") % 10 and zlib.crc32(b"12") % 10
    found = [tuple(r) for r in runs.op11_word_runs(spark, path).collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n_words int")
    found = runs.periodic_runs(docs)
    assert found.columns == ["doc_id", "n_words", "runs", "collapsed_text"] and found.count() == 0
