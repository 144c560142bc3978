"""Token files: one independent zstandard frame per document, a document table, a trailing seek table.

Layout of a file:

* one zstandard frame per document: its ids as little-endian unsigned 32-bit integers;
* a skippable frame with the document table: (doc_id int64, present uint8) per document;
* a skippable frame with the seek table of the public seekable format: per frame its compressed and
  decompressed size and the low 32 bits of the XXH64 of the decompressed bytes, then a footer.

Any zstandard reader can decompress a file; one that knows the tables reads a single document with
three small reads. Files are cut by ranges of doc_id and sorted inside, so that their order, and the
documents' order in them, is the ascending order of doc_id.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featloom.llm.base import load, query, texts
from featloom.llm.tokens import CHARACTERS, ID, batches, default_vocabulary, encoder
from featloom.session import materialise, work_dir

# Fixed values of the zstandard and seekable formats.
DOCUMENTS_MAGIC = 0x184D2A50
SEEK_MAGIC = 0x184D2A5E
FOOTER_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

FOOTER, FOOTER_SIZE = "<IBI", 9
HEADER, HEADER_SIZE = "<II", 8
ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])
DOCUMENT = np.dtype([("doc_id", "<i8"), ("present", "u1")])
LEVEL = 3
MANIFEST = "number long, path string, documents long, ids long"
READ_BYTES = 4_000_000


def checksum(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF


class Writer:
    """Appends documents to an open binary file, the tables on ``finish``."""

    def __init__(self, sink, level: int = LEVEL):
        self.sink, self.packer = sink, zstandard.ZstdCompressor(level=level)
        self.entries: list[tuple[int, int, int]] = []
        self.documents: list[tuple[int, int]] = []
        self.ids = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        packed = self.packer.compress(ids)
        self.sink.write(packed)
        self.entries.append((len(packed), len(ids), checksum(ids)))
        self.documents.append((0, 0) if doc_id is None else (doc_id, 1))
        self.ids += len(ids) // ID.itemsize

    def finish(self) -> None:
        documents = np.array(self.documents, DOCUMENT).tobytes()
        self.sink.write(struct.pack(HEADER, DOCUMENTS_MAGIC, len(documents)) + documents)
        table = np.array([*self.entries, (HEADER_SIZE + len(documents), 0, 0)], ENTRY).tobytes()
        self.sink.write(struct.pack(HEADER, SEEK_MAGIC, len(table) + FOOTER_SIZE) + table)
        self.sink.write(struct.pack(FOOTER, len(self.entries) + 1, CHECKSUM_FLAG, FOOTER_MAGIC))


class Reader:
    """Reads the tables at the end of a file, then any document by its place."""

    def __init__(self, source):
        self.source, size = source, source.size()
        frames, flags, magic = struct.unpack(FOOTER, self.read(size - FOOTER_SIZE, FOOTER_SIZE))
        if magic != FOOTER_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("no seek table with checksums at the end of the file")
        start = size - FOOTER_SIZE - frames * ENTRY.itemsize
        entries = np.frombuffer(self.read(start, frames * ENTRY.itemsize), ENTRY)
        self.entries = entries[:-1]
        self.starts = np.concatenate([[0], np.cumsum(self.entries["packed"], dtype=np.int64)])
        length = int(entries["packed"][-1]) - HEADER_SIZE
        self.documents = np.frombuffer(self.read(int(self.starts[-1]) + HEADER_SIZE, length), DOCUMENT)
        self.unpacker = zstandard.ZstdDecompressor()

    def read(self, start: int, length: int) -> bytes:
        self.source.seek(start)
        return self.source.read(length)

    def span(self, first: int, last: int) -> Iterator[bytes]:
        """Documents first..last-1 by one read."""
        raw = self.read(int(self.starts[first]), int(self.starts[last] - self.starts[first]))
        for i in range(first, last):
            start = int(self.starts[i] - self.starts[first])
            size, check = int(self.entries["size"][i]), int(self.entries["check"][i])
            ids = self.unpacker.decompress(raw[start : start + int(self.entries["packed"][i])], max_output_size=max(1, size))
            if len(ids) != size or checksum(ids) != check:
                raise ValueError(f"frame {i} does not match its checksum")
            yield ids

    def of(self, doc_id: int) -> list[bytes]:
        """Ids of the documents with this id; no other frame is decompressed."""
        places = np.flatnonzero((self.documents["doc_id"] == doc_id) & (self.documents["present"] == 1))
        return [next(self.span(int(i), int(i) + 1)) for i in places]


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store that holds ``path`` and the path inside it; works for every store that Arrow knows."""
    return pyarrow.fs.FileSystem.from_uri(path)


def write_documents(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 0) -> DataFrame:
    """Encode (doc_id, text) rows into files below ``folder``; returns the manifest, one row per file.

    Rows are cut into ranges of (doc_id, hash of the text), so an id that many rows share is split
    too; null ids come first, rows of one id are ordered by their text. A task writes one file under a
    name of its attempt and renames it, so a repeated attempt replaces the file by an equal one. An
    empty table gives an empty manifest.
    """
    end = np.array([end_id], ID).tobytes()

    def write(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        number = task.partitionId()
        store, root = opened(folder)
        final = f"{root}/part-{number:06d}.ids"
        attempt = f"{root}/attempt-{number:06d}-{task.taskAttemptId()}"
        coder, writer, sink = encoder(vocabulary), None, None
        for frame in frames:
            ids_of, text = frame.column(0).to_pylist(), frame.column(1).to_pylist()
            for part in batches(text, CHARACTERS):
                if writer is None:
                    store.create_dir(root, recursive=True)
                    sink = store.open_output_stream(attempt)
                    writer = Writer(sink)
                for doc_id, ids in zip(ids_of[part], coder.encode(text[part], end)):
                    writer.add(doc_id, ids)
        if writer is not None:
            writer.finish()
            sink.close()
            store.move(attempt, final)
            row = {"number": number, "path": f"{folder}/part-{number:06d}.ids", "documents": len(writer.documents), "ids": writer.ids}
            yield pa.RecordBatch.from_pylist([row])

    ranged = docs.select("doc_id", "text", F.xxhash64("text").alias("spread")).repartitionByRange("doc_id", "spread")
    ordered = ranged.sortWithinPartitions("doc_id", "spread", "text").select("doc_id", "text")
    return materialise(ordered.mapInArrow(write, MANIFEST), "token-files")


def read_documents(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids of every document, from the files alone, each frame checked.

    ``start`` counts the ids of all documents before it. The manifest has one row per file; its
    running total is the only thing the driver holds.
    """
    files, before = [], 0
    for row in manifest.orderBy("number").collect():
        files.append((row["number"], row["path"], before))
        before += row["ids"]
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for path, start in zip(frame.column("path").to_pylist(), frame.column("before").to_pylist()):
                store, place = opened(path)
                with store.open_input_file(place) as source:
                    reader = Reader(source)
                    sizes = reader.entries["size"].astype(np.int64)
                    group = np.cumsum(sizes) // READ_BYTES
                    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
                    for first, last in zip(cuts[:-1], cuts[1:]):
                        counts = sizes[first:last] // ID.itemsize
                        known = reader.documents[first:last]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(known["doc_id"].astype(np.int64), mask=known["present"] == 0),
                                pa.array(start + np.cumsum(counts) - counts),
                                pa.array(counts),
                                pa.array(list(reader.span(first, last)), pa.binary()),
                            ],
                            schema=schema,
                        )
                        start += int(counts.sum())

    listed = spark.createDataFrame(files, "number long, path string, before long")
    if files:
        listed = listed.repartition(len(files))
    return listed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def new_folder(spark: SparkSession) -> str:
    return f"{work_dir(spark)}/featloom/ids-{uuid.uuid4().hex}"


def encode_table(docs: DataFrame, vocabulary: str | None = None, doc_id: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """Write the whole texts of ``docs`` as token files and read them back.

    A null or empty text has the end id alone; a null id stays null and comes first; repeated rows are
    documents of their own; other columns are not looked at; an empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = new_folder(spark)
    manifest = write_documents(texts(docs, doc_id, text), folder, vocabulary or default_vocabulary(), end_id)
    return read_documents(spark, manifest)


def fetch(path: str, doc_ids: Sequence[int]) -> dict[int, list[bytes]]:
    """Ids of the given documents of one file, their frames alone decompressed."""
    store, place = opened(path)
    with store.open_input_file(place) as source:
        reader = Reader(source)
        return {doc_id: reader.of(doc_id) for doc_id in doc_ids}


@query("op1_token_frames")
def op1_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_table(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
