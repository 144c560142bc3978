"""Near duplicates by SimHash fingerprints that meet in the middle.

Two fingerprints differ in at most three bits if, and only if, one bit of the one and two bits of the
other can be turned so that both become the same. So every fingerprint emits the variants within half the
radius, and those that share a variant are candidates. Half of three is one and two: as links over an odd
distance join fingerprints of even and of odd weight, the even ones emit the variants within one bit, the
odd ones those within two. Of three bits two lie in the same half of the fingerprint, so the two turned
bits are taken from one half.

A variant of a group of copies is emitted once, as only distinct fingerprints take part, and no more than
a ball's worth of fingerprints can share one. A group needs no pairs: a member within one bit of the
variant is within three bits of every other member, so links to one such member keep the group
together; without one, no two members of the group are three bits apart or closer but by another variant.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featloom.llm import chunks as C
from featloom.llm.base import load, parts, query, texts
from featloom.llm.blocks import mixed
from featloom.llm.components import keyed_join, roots
from featloom.llm.exact import with_groups
from featloom.llm.forest import lowered
from featloom.llm.runs import WordBounds, text_parts
from featloom.session import materialise

SHINGLE = 3
SEED = 42
BITS = 64
RADIUS = 3
# Shingles whose bits are counted at a time.
COUNTED = 200_000
# Fingerprints that emit together, and those of a task.
EMITTED = 2048
TASK = 4 * EMITTED


def shingle_bounds(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Texts with single spaces, and (row, first, last) byte bounds of their shingles, repeats included, by row."""
    words = WordBounds(lowered(data), starts)
    joined, bounds = words.joined(np.ones(len(words.first), bool))
    size = words.last - words.first
    row = np.repeat(np.arange(len(words.counts)), words.counts)
    filled = np.cumsum(words.counts > 0)
    first = np.cumsum(size + 1) - (size + 1) - (filled[row] - 1)
    count = max(0, len(row) - length + 1)
    whole = np.flatnonzero(row[:count] == row[length - 1 : length - 1 + count])
    short = np.flatnonzero((words.counts > 0) & (words.counts < length))
    rows = np.concatenate([row[whole], short])
    order = np.argsort(rows, kind="stable")
    opens = np.concatenate([first[whole], bounds[short]])[order]
    closes = np.concatenate([first[whole + length - 1] + size[whole + length - 1], bounds[short + 1]])[order]
    return joined.tobytes(), rows[order], opens, closes


def fingerprints_of(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The fingerprint of each text: a bit is set that is set in over half the hashes of its shingles."""
    raw, row, opens, closes = shingle_bounds(data, starts, length)
    rows = len(starts) - 1
    ones = np.zeros((rows, BITS), np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(row), COUNTED):
        part = slice(at, at + COUNTED)
        hashes = np.fromiter((digest(raw[a:b], SEED) for a, b in zip(opens[part].tolist(), closes[part].tolist())), np.uint64, len(row[part]))
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, BITS)
        edges = np.flatnonzero(np.diff(row[part], prepend=-1))
        ones[row[part][edges]] += np.add.reduceat(bits, edges, axis=0, dtype=np.int64)
    above = 2 * ones > np.bincount(row, minlength=rows)[:, None]
    return np.packbits(above, axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint as a long) of every row; a text without words has the fingerprint zero."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.int64())])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            found = [fingerprints_of(data, starts, shingle) for _, _, data, starts in text_parts(frame.column(1))]
            flat = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([frame.column(0), pa.array(flat)], schema=schema)

    return texts(docs, doc_id, text).mapInArrow(run, "doc_id long, fingerprint long")


class Ball:
    """Which bits a fingerprint turns; a variant's number is its place in ``masks``."""

    def __init__(self, radius: int):
        if not 1 <= radius <= 3:
            raise ValueError("a radius of one, two or three bits")
        single = [1 << i for i in range(BITS)]
        half = BITS // 2
        double = [1 << i | 1 << j for low in (0, half) for i, j in combinations(range(low, low + half), 2)]
        self.masks = np.array([0, *single, *double], np.uint64)
        self.radius = radius
        self.even = 1 if radius == 1 else 1 + BITS
        self.odd = 1 + BITS if radius < 3 else len(self.masks)
        # A member with a number below this is near enough to every other member of its variant.
        self.centres = 1 if radius == 1 else 1 + BITS

    def size(self) -> float:
        """Variants of a fingerprint, on average."""
        return (self.even + self.odd) / 2

    def variants(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the fingerprint, number of the variant) of all variants, by place."""
        sizes = np.where(np.bitwise_count(prints) & 1, self.odd, self.even)
        at = np.repeat(np.arange(len(prints)), sizes)
        return at, np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def emitted(prints: np.ndarray, ball: Ball, bits: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, payload): the variants that fall into a bucket, as fingerprints and numbers."""
    at, number = ball.variants(prints)
    bucket = (mixed(prints[at] ^ ball.masks[number]) >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(at), np.int32)
    order = np.argsort(bucket, kind="stable")
    at, number, bucket = at[order], number[order].astype("<u2"), bucket[order]
    edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    for first, last in zip(edges[:-1].tolist(), edges[1:].tolist()):
        heads = np.flatnonzero(np.diff(at[first:last], prepend=-1))
        sizes = np.diff(heads, append=last - first).astype("<u2")
        fields = [prints[at[first:last][heads]].astype("<u8"), sizes, number[first:last]]
        yield int(bucket[first]), C.joined([C.packed(field) for field in fields])


def links(payloads: list[bytes], ball: Ball) -> tuple[np.ndarray, np.ndarray]:
    """Links that keep the fingerprints of each variant of a bucket together, verified bit by bit."""
    opened = [C.parted(raw) for raw in payloads]
    own, sizes, number = (np.concatenate([C.unpacked(fields[k], kind) for fields in opened]) for k, kind in enumerate(("<u8", "<u2", "<u2")))
    prints = np.repeat(own, sizes)
    variant = prints ^ ball.masks[number]
    order = np.lexsort((prints, number >= ball.centres, variant))
    variant, prints, number = variant[order], prints[order], number[order]
    heads = np.flatnonzero(np.concatenate([[True], variant[1:] != variant[:-1]]))
    sizes = np.diff(heads, append=len(variant))
    centre, central = np.repeat(prints[heads], sizes), np.repeat(number[heads] < ball.centres, sizes)
    linked = central & (centre != prints)
    a, b = centre[linked], prints[linked]
    near = np.bitwise_count(a ^ b) <= ball.radius
    pairs = np.unique(np.stack([np.minimum(a, b)[near], np.maximum(a, b)[near]], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def near_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between the distinct fingerprints of a column, whose components are those of all links."""
    ball = Ball(radius)
    count = distinct.count()
    bits = C.bucket_bits(count * ball.size())
    sent_schema = pa.schema([("bucket", pa.int32()), ("payload", pa.binary())])

    def send(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            prints = frame.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(prints), EMITTED):
                buckets, payloads = zip(*emitted(prints[at : at + EMITTED], ball, bits))
                yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(payloads, pa.binary())], schema=sent_schema)

    def meet(table: pa.Table) -> pa.Table:
        a, b = links(table["payload"].to_pylist(), ball)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    dealt = distinct.repartition(parts(count, TASK)).mapInArrow(send, "bucket int, payload binary").repartition(1 << bits, "bucket")
    return dealt.groupBy("bucket").applyInArrow(meet, "a long, b long")


def near_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (long), component_id: one row per row of ``docs``.

    A fingerprint is the majority of each bit over the XXH64 of the shingles of the text's words with A-Z
    as a-z, repeats included; fewer words are one shingle, and a text without words, empty or null, has the
    fingerprint zero, linked like any other. Texts are linked whose fingerprints differ in ``radius`` bits
    or fewer. component_id is the smallest doc_id reachable, null only where no reachable row has an id.
    Rows that repeat an id are judged each for itself, other columns are not looked at, and an empty table
    gives no rows.
    """
    rows = materialise(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    grouped = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("group_size"))
    classes = materialise(grouped, "fingerprint-classes")
    found, _ = roots(near_links(classes.select("fingerprint"), radius))
    if found is None:
        groups = classes.withColumnRenamed("first_id", "keep_id")
    else:
        rooted = classes.join(found.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
        rooted = materialise(rooted, "rooted")
        least = rooted.groupBy("root").agg(F.min("first_id").alias("keep_id"))
        groups = materialise(keyed_join(rooted, least, "root").select("fingerprint", "keep_id", "group_size"), "fingerprint-groups")
    met = with_groups(rows, groups.withColumnRenamed("fingerprint", "digest"), F.col("fingerprint"), rows.count())
    return met.select("doc_id", "fingerprint", F.col("keep_id").alias("component_id"))


@query("op12_simhash_ball")
def op12_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_fingerprints(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
