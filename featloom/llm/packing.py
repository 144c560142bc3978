"""Harmonic packing of token sequences.

Lengths are cut to the sizes ``capacity // j``. Class j holds pieces of that one size and its bins take
exactly j of them, so a bin never asks what else is in it and every task fills its own. Pieces are cut
so that the lengths of a document are sums of few class sizes. What is left in the unfinished bins of a
task (fewer than j pieces of class j) is laid end to end into full sequences; its tail is cut at powers
of two, lengths that need no padding.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featloom.llm.base import load, query, texts
from featloom.llm.tokens import CHARACTERS, ID, batches, default_vocabulary, encoder

CAPACITY = 1024
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
PIECE_ROWS = 20_000
# What one more piece may cost in padding, in tokens.
CUT_COST = 8.0


@functools.lru_cache(maxsize=8)
def cuts(capacity: int = CAPACITY) -> list[list[int]]:
    """For every length up to the capacity its best cut into class sizes, largest first.

    Best: least padding, where a further piece counts as much as CUT_COST padded tokens.
    """
    sizes = sorted({capacity // j for j in range(1, capacity + 1)})
    waste = {c: (capacity - c * (capacity // c)) / (capacity // c) for c in sizes}
    best: list[tuple[float, list[int]]] = [(0.0, [])]
    for length in range(1, capacity + 1):
        options = ((best[length - c][0] + CUT_COST + waste[c], c) for c in sizes if c <= length)
        cost, size = min(options)
        best.append((cost, [size, *best[length - size][1]]))
    return [sorted(found, reverse=True) for _, found in best]


class Packer:
    """Places documents one by one; hands out finished sequences as (piece, sequence, offset)."""

    def __init__(self, task: int, capacity: int = CAPACITY):
        self.capacity, self.cuts = capacity, cuts(capacity)
        # Sequence ids of a task are its own: the task's number above 40 bits of its counter.
        self.next = task << 40
        self.open: dict[int, list] = {}

    def sequence(self, pieces: list) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids, total in pieces:
            yield doc, start, len(ids) // ID.itemsize, ids, total, self.next, offset
            offset += len(ids) // ID.itemsize
        self.next += 1

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[tuple]:
        width, total, start = ID.itemsize, len(ids) // ID.itemsize, 0
        whole = [self.capacity] * (total // self.capacity)
        for size in [*whole, *self.cuts[total % self.capacity]]:
            bin_ = self.open.setdefault(size, [])
            bin_.append((doc_id, start, ids[start * width : (start + size) * width], total))
            start += size
            if len(bin_) == self.capacity // size:
                yield from self.sequence(bin_)
                self.open[size] = []

    def finish(self) -> Iterator[tuple]:
        """The unfinished bins, laid end to end, cut anew at sequence ends."""
        rest = [piece for size in sorted(self.open, reverse=True) for piece in self.open[size]]
        self.open = {}
        left = sum(len(piece[2]) for piece in rest) // ID.itemsize
        at = 0
        while left:
            room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
            left -= room
            taken = []
            while room:
                doc, start, ids, total = rest[at]
                length = min(room, len(ids) // ID.itemsize)
                taken.append((doc, start, ids[: length * ID.itemsize], total))
                rest[at] = (doc, start + length, ids[length * ID.itemsize :], total)
                at += not rest[at][2]
                room -= length
            yield from self.sequence(taken)


def pack_table(docs: DataFrame, vocabulary: str | None = None, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    Tasks pack the rows they read, without a shuffle; a task holds at most j - 1 pieces per class j.
    A null or empty text is the end id alone; a null id stays null; repeated rows are documents of
    their own; a text of any length is cut; other columns are not looked at; an empty table gives no
    rows. A repeated attempt of a task gives the same sequences.
    """
    if capacity < 2 or capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    vocabulary = vocabulary or default_vocabulary()
    end = np.array([end_id], ID).tobytes()
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())]
    schema = pa.schema([*kinds, ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(columns, schema)], schema=schema)

    def pack(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, coder, rows = Packer(TaskContext.get().partitionId(), capacity), encoder(vocabulary), []
        for frame in frames:
            ids_of, text_of = frame.column(0).to_pylist(), frame.column(1).to_pylist()
            for part in batches(text_of, CHARACTERS):
                for doc, ids in zip(ids_of[part], coder.encode(text_of[part], end)):
                    rows.extend(packer.add(doc, ids))
                    if len(rows) >= PIECE_ROWS:
                        yield batch(rows)
                        rows = []
        rows.extend(packer.finish())
        if rows:
            yield batch(rows)

    return texts(docs, doc_id, text).mapInArrow(pack, PIECES)


def pieces(packed: DataFrame) -> DataFrame:
    """Packed pieces with the checksum of their ids in place of the ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op8_harmonic_packing")
def op8_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(pack_table(load(spark, sf_dir, "documents")))
