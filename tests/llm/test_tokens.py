"""Token files, packing and relational BPE against the libraries themselves."""

import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import zstandard
from pyspark.sql import functions as F

from featloom.llm import bpe, packing, token_frames, tokens

ODD = [None, "", " ", "a  b", "\n\n x", "a\t b", "é\x1c!\x1c?", "c\r\n\r\nd", "<|endoftext|> a<|endoftext|>", "\x85 a \x85", "a  \n b", "😀 👩‍👩‍👧 x", " don't 've", "x" * 3000, "the same", "the same", "word, " * 4000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if i == 3 else 7 if i in (14, 15) else i * 2, text, i, "clash") for i, text in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, start long, ids string").repartition(3)


def ids_of(text, end=(0,)):
    found = tokens.encoder(tokens.default_vocabulary()).tokenizer.encode(text or "", add_special_tokens=False).ids
    return [*found, *end]


def raw(ids):
    return np.array(ids, "<u4").tobytes()


def test_kept_chunks_change_nothing():
    coder = tokens.Encoder(tokens.default_vocabulary(), kept=3)
    texts = [t or "" for t in ODD] * 2
    assert coder.encode(texts) == [raw(ids_of(t, ())) for t in texts]


def test_files_hold_every_document_in_order(spark, docs):
    found = token_frames.encode_table(docs).collect()
    start = 0
    want = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r["doc_id"] for r in found] == [w[0] for w in want] and len(found) == len(ODD)
    for got, (_, text) in zip(found, want):
        assert bytes(got["ids"]) == raw(ids_of(text)) and got["start"] == start and got["n_tokens"] == len(ids_of(text))
        start += got["n_tokens"]


def test_one_document_is_read_alone(spark, docs, tmp_path):
    folder = str(tmp_path / "ids")
    files = token_frames.write_documents(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), folder, tokens.default_vocabulary()).collect()
    found = {}
    for file in files:
        with open(file["path"], "rb") as stream:
            # A plain reader decompresses the whole file and skips the tables.
            whole = b"".join(iter(lambda s=zstandard.ZstdDecompressor().stream_reader(stream, read_across_frames=True): s.read(1 << 16), b""))
        assert len(whole) == 4 * file["ids"]
        for doc_id, ids in token_frames.fetch(file["path"], [7, 20, 999]).items():
            found.setdefault(doc_id, []).extend(ids)
    assert found[7] == [raw(ids_of("the same"))] * 2 and found[20] == [raw(ids_of(ODD[10]))] and found[999] == []


def test_a_changed_byte_is_noticed(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some text of a few words")], "doc_id long, text string")
    path = token_frames.write_documents(docs, str(tmp_path / "ids"), tokens.default_vocabulary()).first()["path"]
    content = bytearray(open(path, "rb").read())
    content[12] ^= 1
    open(path, "wb").write(content)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        token_frames.fetch(path, [1])


def test_packing_places_each_id_once(docs):
    rows = packing.pack_table(docs).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], []).append(raw(ids_of(r["text"])))
    for doc_id, own in by_doc.items():
        whole = sorted(b"".join(p for _, p in sorted((r["start"], bytes(r["ids"])) for r in own[i :: len(texts[doc_id])])) for i in range(1)) if len(texts[doc_id]) == 1 else None
        if whole is not None:
            assert whole == texts[doc_id] and {r["doc_tokens"] for r in own} == {len(whole[0]) // 4}
    assert sum(r["length"] for r in rows) == sum(len(t) // 4 for own in texts.values() for t in own)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= packing.CAPACITY


def test_cuts_are_sums_of_class_sizes():
    table = packing.cuts()
    sizes = {packing.CAPACITY // j for j in range(1, packing.CAPACITY + 1)}
    assert all(sum(cut) == length and set(cut) <= sizes for length, cut in enumerate(table))
    assert max(map(len, table)) <= 4


def test_little_padding(spark, sf_dir):
    rows = packing.pack_table(spark.read.parquet(f"{sf_dir}/documents.parquet")).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    total = sum(r["n"] for r in rows)
    padding = sum(packing.CAPACITY - r["n"] for r in rows if r["n"] & (r["n"] - 1))
    assert padding < 0.01 * total and len(rows) < 1.05 * total / packing.CAPACITY + 12


def test_bpe_equals_the_library(docs):
    ranks = bpe.read_ranks(bpe.default_ranks())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted(((r["text"] or ""), raw(library.encode_ordinary(r["text"] or "")).hex()) for r in docs.collect())
    found = bpe.encode_and_decode(docs).collect()
    assert sorted((bytes(r["decoded"]).decode(), bytes(r["ids"]).hex()) for r in found) == want
    assert sum(r["doc_id"] is None for r in found) == 1


def test_long_words_take_several_queries(monkeypatch):
    monkeypatch.setattr(bpe, "STATE_ROWS", 100)
    coder = bpe.RelationalBpe(bpe.default_ranks(), bpe.default_pattern())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    texts = ["xyzt" * 40, "antidisestablishmentarianism" * 3]
    assert coder.encode(texts) == [raw(library.encode_ordinary(t)) for t in texts]
    assert [d.decode() for d in coder.decode(coder.encode(texts))] == texts


@pytest.mark.parametrize("run", [token_frames.encode_table, packing.pack_table, bpe.encode_and_decode])
def test_empty_tables(spark, run):
    assert run(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_checksums_of_the_queries(spark, sf_dir):
    rows = token_frames.op1_token_frames(spark, sf_dir).orderBy("doc_id").limit(20).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert all(r["ids_crc32"] == zlib.crc32(raw(ids_of(texts[r["doc_id"]]))) for r in rows)


def test_words_and_marks_change_nothing():
    rng = np.random.default_rng(4)
    words = ["the", "Énorme", "ßein", "ñ9", "can't", "x²", "№", "don", "Ω", "ǅ", "\x01a", "\x1ca", "<s>", "a,b", "1.", "'s", "日本", "×", "ɏ", "ɐ", "é"]
    marks = ["", "", ",", ".", "...", "&&&", "***", "'", "!?|", "$"]
    gaps = [" ", " ", " ", "\n", "  ", "\n\n", " \n", "\n ", "\t", "\xa0", " ", " ", " ", "\r\n"]
    texts = []
    for i in range(600):
        own, count = gaps[: 4 if i % 2 else len(gaps)], rng.integers(1, 30)
        pieces = [rng.choice(words) + rng.choice(marks) + rng.choice(own) for _ in range(count)]
        texts.append("".join(pieces).strip(" \n") if i % 4 else "".join(pieces))
    texts += [",", "* *", " ", "\n", "\n,", " \x01", "\x01", "a\n", "\n\n"]
    want = [raw(ids_of(t, ())) for t in texts]
    for kept in (5, 40, 10_000):
        coder = tokens.Encoder(tokens.default_vocabulary(), kept=kept)
        for at in range(0, len(texts), 50):
            assert coder.encode(texts[at : at + 50], b"end!") == [w + b"end!" for w in want[at : at + 50]]


def test_a_word_is_encoded_once_whatever_marks_follow():
    coder, asked = tokens.Encoder(tokens.default_vocabulary(), kept=1000), []
    numbers = coder.numbers
    coder.numbers = lambda texts: asked.extend(texts) or numbers(texts)
    coder.encode(["die Größe, the Größe. Größe", "x\nGröße! Größe?\nGröße"])
    assert "".join(asked).count("Größe") == 2
    coder.encode(["Größe", "the Größe&&& x\nGröße, die"])
    assert "".join(asked).count("Größe") == 3
    # Words that were used last outlast the others.
    small = tokens.Encoder(tokens.default_vocabulary(), kept=8)
    for i in range(20):
        small.encode([f"the often w{i}"])
        assert "often" in small.known and len(small.known) <= 8
