"""Chunks of documents that ask buckets of hashes and get bits back.

Searches over every position of every text cannot move a row per position. Here the documents are dealt
once into chunks of bounded size, kept as a table bucketed by chunk so that later steps read it without
a shuffle. A chunk sends each bucket of hashes one row: its distinct keys in order, packed as
differences. The bucket answers with one row per chunk: a bit per key, in the same order. The chunk
computes its keys anew from the same rows, so neither hashes nor positions travel back.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from featloom.llm.base import parts, text_bytes
from featloom.session import materialise, work_dir

CHUNK_BYTES = 4_000_000
# Buckets of the table of chunks; beyond, a bucket holds several chunks.
TABLE_BUCKETS = 10_000
# Keys that a bucket holds at a time, about.
BUCKET_KEYS = 3_000_000
# No id sorts behind every id.
NO_ID = np.iinfo(np.int64).max
REQUESTS = "bucket int, chunk int, payload binary"
REPLIES = "chunk int, bucket int, kind int, bits binary"
REPLY_KINDS = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()), ("bits", pa.binary())])
REQUEST_KINDS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("payload", pa.binary())])


@dataclass(frozen=True)
class Chunked:
    """The bucketed table (doc_id, text, chunk), the bytes of all texts and the number of chunks."""

    table: DataFrame
    total: int
    chunks: int


def chunked(rows: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> Chunked:
    """Deal (doc_id, text, ...) rows by a hash of both, so neither one id nor one source fills a chunk."""
    spark = rows.sparkSession
    total = text_bytes(rows)
    chunks = parts(total, chunk_bytes)
    name = f"chunks_{uuid.uuid4().hex}"
    keyed = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))
    buckets = min(chunks, TABLE_BUCKETS)
    writer = keyed.repartition(buckets, "chunk").write.option("compression", "zstd").option("path", f"{work_dir(spark)}/featloom/{name}")
    writer.bucketBy(buckets, "chunk").saveAsTable(name)
    return Chunked(spark.table(name), total, chunks)


def packed(values: np.ndarray) -> bytes:
    """Integers as zstandard over their byte planes: small numbers leave planes of zeros."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpacked(raw: bytes, kind: np.dtype) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def joined(fields: list[bytes]) -> bytes:
    """Byte strings behind their lengths."""
    lengths = np.array([len(fields), *map(len, fields)], "<i8")
    return lengths.tobytes() + b"".join(fields)


def parted(raw: bytes) -> list[bytes]:
    count = int(np.frombuffer(raw, "<i8", 1)[0])
    lengths = np.frombuffer(raw, "<i8", count, 8)
    ends = 8 * (count + 1) + np.cumsum(lengths)
    return [raw[end - length : end] for end, length in zip(ends.tolist(), lengths.tolist())]


def differences(keys: np.ndarray) -> np.ndarray:
    """Of ascending unsigned keys, the first as it is."""
    return np.diff(keys, prepend=keys.dtype.type(0))


def sums(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=steps.dtype)


@dataclass
class Texts:
    """The rows of a chunk as one run of bytes; row i is ``data[starts[i]:starts[i + 1]]``."""

    doc_id: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    chunk: int
    rows: pa.Table

    @classmethod
    def of(cls, table: pa.Table) -> Texts:
        """In the order of id and text, which is the same whenever the chunk is read."""
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
        text = table["text"].cast(pa.large_string()).combine_chunks()
        text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
        _, offsets, data = text.buffers()
        starts = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        ids = table["doc_id"].combine_chunks().fill_null(NO_ID).to_numpy().astype(np.int64)
        chunk = table["chunk"][0].as_py() if table.num_rows else 0
        return cls(ids, raw[starts[0] : starts[-1]], starts - starts[0], chunk, table)

    def without(self, cut: np.ndarray) -> pa.Array:
        """The texts without the marked bytes."""
        kept = np.concatenate([[0], np.cumsum(~cut)])
        return pa.LargeStringArray.from_buffers(len(self.doc_id), pa.py_buffer(kept[self.starts].astype(np.int64)), pa.py_buffer(self.data[~cut].tobytes()))

    def ids(self) -> pa.Array:
        return pa.array(self.doc_id, pa.int64(), mask=self.doc_id == NO_ID)


def bucket_bits(total_keys: float) -> int:
    """Two to this power is the number of buckets."""
    return max(0, int(np.ceil(np.log2(max(1.0, total_keys / BUCKET_KEYS)))))


def cut_points(keys: np.ndarray, bits: int, width: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, first, last) of each bucket's part of ascending keys of ``width`` bits, by their top bits."""
    bucket = (keys >> keys.dtype.type(width - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    for first, last in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield int(bucket[first]), first, last


def request_table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, REQUEST_KINDS)], schema=REQUEST_KINDS)


def reply_table(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows)) or [(), (), (), ()]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, REPLY_KINDS)], schema=REPLY_KINDS)


def bits_of(replies: pa.Table, kind: int) -> dict[int, bytes]:
    """Bits by bucket of the replies of one kind."""
    rows = zip(replies["kind"].to_pylist(), replies["bucket"].to_pylist(), replies["bits"].to_pylist())
    return {bucket: bits for own, bucket, bits in rows if own == kind}


def marks(bits: bytes | None, count: int) -> np.ndarray:
    if bits is None:
        return np.zeros(count, bool)
    return np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(bits), np.uint8), count=count).astype(bool)


def as_bits(marked: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.packbits(marked).tobytes())


def split_replies(chunk_ids: list[int], bucket: int, kind: int, flagged: np.ndarray, sizes: list[int]) -> pa.Table:
    """Replies with the bits of each chunk's part; none where no bit is set."""
    ends = np.cumsum(sizes)
    rows = [(chunk, bucket, kind, as_bits(flagged[end - n : end])) for chunk, end, n in zip(chunk_ids, ends.tolist(), sizes) if flagged[end - n : end].any()]
    return reply_table(rows)


def ask(docs: Chunked, request: Callable[[Texts, pa.Table], pa.Table], answer: Callable[[pa.Table], pa.Table], tasks: int, replies: DataFrame | None = None) -> DataFrame:
    """One round: every chunk's requests, built from its texts and earlier replies, answered by bucket.

    ``tasks`` of them answer: requests are small for the work they make, so their size must not decide it.
    """
    read = docs.table.select("doc_id", "text", "chunk").groupBy("chunk")
    if replies is None:
        sent = read.applyInArrow(lambda table: request(Texts.of(table), reply_table([])), REQUESTS)
    else:
        sent = read.cogroup(replies.groupBy("chunk")).applyInArrow(
            lambda table, own: request(Texts.of(table), own) if table.num_rows else request_table([]), REQUESTS
        )
    dealt = sent.repartition(tasks, "bucket")
    return materialise(dealt.groupBy("bucket").applyInArrow(answer, REPLIES), "replies")


def conclude(docs: Chunked, work: Callable[[Texts, pa.Table], pa.Table], replies: DataFrame, schema: str, carried: Sequence[str] = ()) -> DataFrame:
    """Every chunk's result from its texts and all replies, with the carried columns of its rows."""
    kept = StructType([*StructType.fromDDL(schema).fields, *(docs.table.schema[c] for c in carried)])
    empty = to_arrow_schema(kept).empty_table()

    def finish(table: pa.Table, own: pa.Table) -> pa.Table:
        if not table.num_rows:
            return empty
        given = Texts.of(table)
        found = work(given, own)
        for column in carried:
            found = found.append_column(column, given.rows[column])
        return found

    read = docs.table.select("doc_id", "text", "chunk", *carried)
    return read.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(finish, kept)
