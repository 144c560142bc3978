"""Byte-level BPE as relational queries: DuckDB inside each task, over token-position rows.

A word's tokens are rows (word, position, id). A step of a recursive query joins each row and its right
neighbour with the merge table, finds the leftmost pair of minimum rank of every word, and contracts it;
words without a pair drop out, and their last state is their encoding. Decoding joins ids with the bytes
they stand for and concatenates them in order. Spark deals the texts to tasks; DuckDB sees the distinct
words of a batch, and the ids of a batch.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featloom.llm.base import load, query, texts
from featloom.llm.tokens import ID, ChunkEncoder, batches

# State rows a recursive query may add up before it hands over to the next one.
STATE_ROWS = 2_000_000
WORDS_AT_ONCE = 20_000
MEMORY = "500MB"
BATCH_CHARACTERS = 3_000_000

MERGE = """
WITH RECURSIVE state(word, step, pos, id) AS (
  SELECT word, 0, pos, id FROM start
  UNION ALL (
    WITH pairs AS (
      SELECT word, step, pos, id,
        CASE WHEN lead(word) OVER w = word THEN lead(id) OVER w END AS following,
        CASE WHEN lag(word) OVER w = word THEN lag(pos) OVER w END AS before
      FROM state WHERE step < $steps WINDOW w AS (ORDER BY word, pos)
    ), best AS (
      SELECT word, min(merged * 4294967296 + pos) AS best
      FROM pairs JOIN merges ON left_id = id AND right_id = following GROUP BY word
    )
    SELECT word, step + 1, pos, CASE WHEN pos = best % 4294967296 THEN (best // 4294967296)::INTEGER ELSE id END
    FROM pairs JOIN best USING (word) WHERE before IS DISTINCT FROM best % 4294967296
  )
)
SELECT state.word, step, pos, id
FROM state JOIN (SELECT word, max(step) AS step FROM state GROUP BY word) AS last USING (word, step) ORDER BY state.word, pos
"""

DECODE = "SELECT doc, unhex(string_agg(hex, '' ORDER BY pos)) AS raw FROM encoded JOIN tokens USING (id) GROUP BY doc"


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def merge_rows(ranks: dict[bytes, int]) -> pa.Table:
    """(left_id, right_id, merged): every pair of tokens whose bytes together are a token."""
    rows = []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                rows.append((left, right, rank))
    left, right, merged = np.array(rows, np.int64).reshape(-1, 3).T
    return pa.table({"left_id": left.astype(np.int32), "right_id": right.astype(np.int32), "merged": merged})


class RelationalBpe(ChunkEncoder):
    """Encodes and decodes with the rank file's vocabulary in an in-memory database of the process."""

    def __init__(self, ranks: str, pattern: str):
        import duckdb
        import regex

        super().__init__()
        self.ranks = read_ranks(ranks)
        self.pattern = regex.compile(pattern)
        self.words: dict[str, bytes] = {}
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        # No folder to spill to: batches are small enough for the memory.
        self.base = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        self.store("merges", merge_rows(self.ranks))
        tokens = sorted((rank, token.hex()) for token, rank in self.ranks.items())
        self.store("tokens", pa.table({"id": pa.array([t[0] for t in tokens], pa.int32()), "hex": [t[1] for t in tokens]}))

    def store(self, name: str, table: pa.Table) -> None:
        self.base.register("given", table)
        self.base.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.base.unregister("given")

    def learn(self, chunks: Sequence[str]) -> None:
        cut = [self.pattern.findall(chunk) for chunk in chunks]
        if len(self.words) > self.kept:
            self.words.clear()
        unseen = list({word for words in cut for word in words if word not in self.words})
        for start in range(0, len(unseen), WORDS_AT_ONCE):
            part = unseen[start : start + WORDS_AT_ONCE]
            self.words.update(zip(part, self.merged([word.encode() for word in part])))
        of = self.words.__getitem__
        self.known.update((chunk, b"".join(map(of, words))) for chunk, words in zip(chunks, cut))

    def merged(self, words: Sequence[bytes]) -> list[bytes]:
        """Ids of each word. A word that is a token is that token; no merge is looked for."""
        found = [np.array([self.ranks[w]], ID).tobytes() if w in self.ranks else b"" for w in words]
        open_ = [i for i, ids in enumerate(found) if not ids and words[i]]
        if not open_:
            return found
        sizes = np.array([len(words[i]) for i in open_])
        state = pa.table(
            {
                "word": np.repeat(np.array(open_, np.int32), sizes),
                "pos": (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int64),
                "id": self.bytes[np.frombuffer(b"".join(words[i] for i in open_), np.uint8)],
            }
        )
        # A query stops after so many steps that its rows stay bounded; what is not at its fixpoint then
        # is where the next query starts. Only very long words need more than one.
        while state.num_rows:
            steps = max(8, STATE_ROWS // state.num_rows)
            self.base.register("start", state)
            last = self.base.sql(MERGE, params={"steps": steps}).to_arrow_table()
            self.base.unregister("start")
            done = last.filter(pc.less(last["step"], steps))
            word, ids = done["word"].to_numpy(), done["id"].to_numpy().astype(ID)
            bounds = np.flatnonzero(np.diff(word, prepend=-1, append=-1))
            for start, stop in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                found[word[start]] = ids[start:stop].tobytes()
            state = last.filter(pc.greater_equal(last["step"], steps)).select(["word", "pos", "id"])
        return found

    def decode(self, ids: Sequence[bytes]) -> list[bytes]:
        """The bytes that each row of ids stands for, concatenated in their order."""
        flat = np.frombuffer(b"".join(ids), ID).astype(np.int32)
        sizes = np.array([len(i) // ID.itemsize for i in ids], np.int64)
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        self.base.register("encoded", pa.table({"doc": doc, "pos": np.arange(len(flat), dtype=np.int64), "id": flat}))
        rows = self.base.execute(DECODE).fetchall()
        self.base.unregister("encoded")
        found = [b""] * len(ids)
        for at, raw in rows:
            found[at] = raw
        return found


@functools.lru_cache(maxsize=1)
def relational(ranks: str, pattern: str) -> RelationalBpe:
    """One per worker process."""
    return RelationalBpe(ranks, pattern)


def encode_and_decode(docs: DataFrame, ranks: str | None = None, pattern: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (unsigned 32-bit, little-endian), decoded (the bytes of the ids) of every row.

    A null or empty text has no ids and decodes to no bytes; a null id stays null; repeated rows are
    handled one by one; a word of any length is merged to its fixpoint; other columns are not looked
    at; an empty table gives no rows.
    """
    ranks, pattern = ranks or default_ranks(), pattern or default_pattern()
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = relational(ranks, pattern)
        for frame in frames:
            text_of = frame.column(1).to_pylist()
            for part in batches(text_of, BATCH_CHARACTERS):
                ids = coder.encode(text_of[part])
                columns = [frame.column(0)[part.start : part.stop], pa.array(ids, pa.binary()), pa.array(coder.decode(ids), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return texts(docs, doc_id, text).mapInArrow(run, "doc_id long, ids binary, decoded binary")


@query("op7_relational_bpe")
def op7_relational_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_and_decode(load(spark, sf_dir, "documents"))
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
