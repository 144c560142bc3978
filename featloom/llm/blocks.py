"""Repeated word windows found by fixed-block anchors.

Each document is cut into reference blocks of 7 words that do not overlap; any 13 words hold at least
one of them whole. Round one sends the hash of every rolling 7-word window, with a mark on those that are
blocks, and flags hashes that are a block of some document and a window of another. Round two extends
the hits: every 13-word window around a flagged anchor sends its 128-bit fingerprint and the smallest
doc_id it starts in, and hears whether it starts in a smaller document elsewhere. The union of the
repeated windows are the maximal exact repeats, which are cut out.

Hot passages cost nothing extra: a chunk names a hash once, however often its documents hold it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featloom.llm import chunks as C
from featloom.llm.base import BLANKS, load, named, query, texts

WINDOW = 13
# 2 * BLOCK - 1 <= WINDOW: a window holds a whole block wherever it starts.
BLOCK = (WINDOW + 1) // 2
# Fixed odd multipliers of the hashes.
BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
ANCHOR_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
FIRST_BASE = np.uint64(0x165667B19E3779F9)
SECOND_BASE = np.uint64(0xD6E8FEB86659FD93)
BYTES_PER_WORD = 5.0
# Bits that a hash has beyond those that number all windows; chance hits are that rare.
SPARE_BITS = 12
RESULT = "doc_id long, n_words long, n_removed long, left_text string, spans array<struct<start: long, stop: long>>"
SPAN = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
RESULT_KINDS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("left_text", pa.string()), ("spans", SPAN)])


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def powers(base: np.uint64, count: int) -> np.ndarray:
    found = np.full(count, base, np.uint64)
    if count:
        found[0] = 1
    return np.cumprod(found, dtype=np.uint64)


def rolling(values: np.ndarray, length: int, base: np.uint64) -> np.ndarray:
    """Hash of each run of ``length`` values, mixed."""
    count = max(0, len(values) - length + 1)
    found = np.zeros(count, np.uint64)
    for k in range(length):
        found = found * base + values[k : k + count]
    return mixed(found)


class Words:
    """Words of a chunk's texts: byte bounds, hashes, and the row that each belongs to."""

    def __init__(self, given: C.Texts):
        self.given = given
        data, n = given.data, len(given.data)
        word = ~((data == 0x20) | ((data >= 0x09) & (data <= 0x0D)))
        before = np.concatenate([[False], word[:-1]]) if n else word
        before[given.starts[:-1][given.starts[:-1] < n]] = False
        self.first = np.flatnonzero(word & ~before)
        after = np.concatenate([word[1:], [False]]) if n else word
        ends = given.starts[1:]
        after[ends[ends > 0] - 1] = False
        self.last = np.flatnonzero(word & ~after) + 1
        # A prefix hash over all bytes gives a word's as a difference, moved back to the word's start.
        power = powers(BYTE_BASE, n + 1)
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], dtype=np.uint64)])
        inverse = np.uint64(pow(int(BYTE_BASE), -1, 1 << 64))
        back = powers(inverse, n + 1)[self.first]
        self.hash = mixed((prefix[self.last] - prefix[self.first]) * back + (self.last - self.first).astype(np.uint64))
        self.row = np.searchsorted(given.starts, self.first, "right") - 1
        self.counts = np.bincount(self.row, minlength=len(given.doc_id))
        self.begin = np.cumsum(self.counts) - self.counts

    def windows(self, length: int) -> np.ndarray:
        """Which places start a window that stays in its document."""
        count = max(0, len(self.row) - length + 1)
        return self.row[:count] == self.row[length - 1 : length - 1 + count]


def key_width(total: int) -> int:
    """Bits of the anchors' keys: enough that chance hits stay rare among all windows."""
    return int(min(63, np.ceil(np.log2(max(2.0, total / BYTES_PER_WORD))) + SPARE_BITS))


class Anchors:
    """Distinct keys of a chunk's rolling windows, ascending, and the windows of each."""

    def __init__(self, words: Words, width: int):
        self.at = np.flatnonzero(words.windows(BLOCK))
        keys = (rolling(words.hash, BLOCK, ANCHOR_BASE) >> np.uint64(64 - width))[self.at]
        order = np.argsort(keys, kind="stable")
        self.at = self.at[order]
        ordered = keys[order]
        self.edges = np.flatnonzero(np.diff(ordered, prepend=~ordered[:1]) != 0) if len(ordered) else np.zeros(0, np.int64)
        self.keys = ordered[self.edges]
        if not len(self.keys):
            self.block = self.shared = np.zeros(0, bool)
            return
        block = (self.at - words.begin[words.row[self.at]]) % BLOCK == 0
        ids = words.given.doc_id[words.row[self.at]]
        self.block = np.logical_or.reduceat(block, self.edges)
        self.shared = np.minimum.reduceat(ids, self.edges) != np.maximum.reduceat(ids, self.edges)

    def places(self, flagged: np.ndarray) -> np.ndarray:
        """Start of every window with a flagged key."""
        sizes = np.diff(self.edges, append=len(self.at))
        return self.at[np.repeat(flagged, sizes)]


def flags(keys: np.ndarray, bits: int, width: int, replies: dict[int, bytes]) -> np.ndarray:
    found = np.zeros(len(keys), bool)
    for bucket, first, last in C.cut_points(keys, bits, width):
        found[first:last] = C.marks(replies.get(bucket), last - first)
    return found


def candidates(words: Words, anchors: Anchors, flagged: np.ndarray) -> np.ndarray:
    """Starts of the windows that hold a flagged anchor."""
    hit = np.zeros(len(words.row) + 1, np.int64)
    hit[anchors.places(flagged)] = 1
    upto = np.concatenate([[0], np.cumsum(hit)])
    inside = words.windows(WINDOW)
    start = np.arange(len(inside))
    return start[inside & (upto[start + WINDOW - BLOCK + 1] > upto[start])]


class Fingerprints:
    """Distinct fingerprints of a chunk's candidate windows, ascending, with the smallest doc_id of each."""

    def __init__(self, words: Words, at: np.ndarray):
        one = rolling(words.hash, WINDOW, FIRST_BASE)[at]
        two = rolling(mixed(words.hash + SECOND_BASE), WINDOW, SECOND_BASE)[at]
        ids = words.given.doc_id[words.row[at]]
        order = np.lexsort((ids, two, one))
        self.at, one, two, ids = at[order], one[order], two[order], ids[order]
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(one) != 0) | (np.diff(two) != 0)
        self.edges = np.flatnonzero(new)
        self.one, self.two, self.least = one[self.edges], two[self.edges], ids[self.edges]
        self.ids, self.group = ids, np.cumsum(new) - 1

    def repeated(self, flagged: np.ndarray) -> np.ndarray:
        """Starts of windows that also start in a smaller document, here or (flagged) elsewhere."""
        return self.at[(self.ids > self.least[self.group]) | flagged[self.group]]


def anchor_requests(bits: int, width: int):
    def request(given: C.Texts, _: pa.Table) -> pa.Table:
        found = Anchors(Words(given), width)
        rows = []
        for bucket, first, last in C.cut_points(found.keys, bits, width):
            fields = [C.packed(C.differences(found.keys[first:last])), C.as_bits(found.block[first:last]), C.as_bits(found.shared[first:last])]
            rows.append((bucket, given.chunk, C.joined(fields)))
        return C.request_table(rows)

    return request


def gathered(table: pa.Table, fields: int) -> tuple[list[int], list[list[bytes]]]:
    """Chunks of a bucket's requests and their fields."""
    table = table.sort_by("chunk")
    parts = [C.parted(raw) for raw in table["payload"].to_pylist()]
    return table["chunk"].to_pylist(), [[part[i] for part in parts] for i in range(fields)]


def answer_anchors(table: pa.Table) -> pa.Table:
    """Flags the keys that are a block in one document and a window in another."""
    bucket = table["bucket"][0].as_py()
    chunk_ids, (steps, blocks, shares) = gathered(table, 3)
    keys = [C.sums(C.unpacked(raw, np.uint64)) for raw in steps]
    sizes = [len(k) for k in keys]
    block = np.concatenate([C.marks(raw, n) for raw, n in zip(blocks, sizes)])
    shared = np.concatenate([C.marks(raw, n) for raw, n in zip(shares, sizes)])
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    ordered = every[order]
    edges = np.flatnonzero(np.diff(ordered, prepend=~ordered[:1]) != 0)
    many = np.diff(edges, append=len(ordered)) > 1
    hit = np.logical_or.reduceat(block[order], edges) & (many | np.logical_or.reduceat(shared[order], edges))
    flagged = np.empty(len(every), bool)
    flagged[order] = np.repeat(hit, np.diff(edges, append=len(ordered)))
    return C.split_replies(chunk_ids, bucket, 1, flagged, sizes)


def window_requests(bits: int, width: int):
    def request(given: C.Texts, replies: pa.Table) -> pa.Table:
        words = Words(given)
        found = window_candidates(words, bits, width, replies)
        rows = []
        for bucket, first, last in C.cut_points(found.one, bits, 64):
            fields = [C.packed(C.differences(found.one[first:last])), C.packed(found.two[first:last]), C.packed(found.least[first:last])]
            rows.append((bucket, given.chunk, C.joined(fields)))
        return C.request_table(rows)

    return request


def window_candidates(words: Words, bits: int, width: int, replies: pa.Table) -> Fingerprints:
    anchors = Anchors(words, width)
    return Fingerprints(words, candidates(words, anchors, flags(anchors.keys, bits, width, C.bits_of(replies, 1))))


def answer_windows(table: pa.Table) -> pa.Table:
    """Flags the fingerprints that start in a smaller document of another chunk."""
    bucket = table["bucket"][0].as_py()
    chunk_ids, (steps, seconds, leasts) = gathered(table, 3)
    ones = [C.sums(C.unpacked(raw, np.uint64)) for raw in steps]
    sizes = [len(k) for k in ones]
    one = np.concatenate(ones)
    two = np.concatenate([C.unpacked(raw, np.uint64) for raw in seconds])
    least = np.concatenate([C.unpacked(raw, np.int64) for raw in leasts])
    order = np.lexsort((two, one))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)
    edges = np.flatnonzero(new)
    smallest = np.repeat(np.minimum.reduceat(least[order], edges), np.diff(edges, append=len(order)))
    flagged = np.empty(len(order), bool)
    flagged[order] = least[order] > smallest
    return C.split_replies(chunk_ids, bucket, 2, flagged, sizes)


def covered(count: int, at: np.ndarray, length: int) -> np.ndarray:
    """Places inside runs of ``length`` that start at the given places."""
    steps = np.zeros(count + length + 1, np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + length, -1)
    return np.cumsum(steps)[:count] > 0


def remove_windows(bits: int, width: int):
    def work(given: C.Texts, replies: pa.Table) -> pa.Table:
        words = Words(given)
        found = window_candidates(words, bits, width, replies)
        flagged = flags(found.one, bits, 64, C.bits_of(replies, 2))
        gone = covered(len(words.row), found.repeated(flagged), WINDOW)
        # A removed run takes the blanks behind it; those before it stay behind the last kept word.
        follows = np.append(words.first[1:], len(given.data))
        stop = np.minimum(follows, given.starts[words.row + 1]) if len(words.row) else follows[:0]
        steps = np.zeros(len(given.data) + 1, np.int64)
        np.add.at(steps, words.first[gone], 1)
        np.add.at(steps, stop[gone], -1)
        removed = np.bincount(words.row[gone], minlength=len(given.doc_id))
        columns = [given.ids(), pa.array(words.counts), pa.array(removed), given.without(np.cumsum(steps[:-1]) > 0), spans(words, gone)]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, RESULT_KINDS)], schema=RESULT_KINDS)

    return work


def spans(words: Words, gone: np.ndarray) -> pa.Array:
    """Maximal runs of removed words of each row, as places in the row."""
    before = np.concatenate([[False], gone[:-1]]) if len(gone) else gone
    before = before & np.concatenate([[False], words.row[1:] == words.row[:-1]])[: len(gone)]
    after = np.concatenate([gone[1:], [False]]) if len(gone) else gone
    after = after & np.concatenate([words.row[1:] == words.row[:-1], [False]])[: len(gone)]
    first, last = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after)
    row = words.row[first]
    offsets = np.searchsorted(row, np.arange(len(words.given.doc_id) + 1))
    begin = words.begin[row]
    pairs = pa.StructArray.from_arrays([pa.array(first - begin, pa.int64()), pa.array(last + 1 - begin, pa.int64())], ["start", "stop"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chunk_bytes: int = C.CHUNK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, left_text, spans (removed word runs) of every row.

    A word goes if a 13-word window that covers it also starts in a document with a smaller doc_id. The
    blanks between the words that stay are as they were. Texts of fewer words than a window, empty and
    null ones are left alone (null becomes empty); rows of one id are no smaller than each other; a
    null id is larger than any; other columns are not looked at; an empty table gives no rows.
    """
    return removed(C.chunked(texts(docs, doc_id, text), chunk_bytes))


def removed(held: C.Chunked, carried: Sequence[str] = ()) -> DataFrame:
    """The result of all rounds, with the carried columns of the rows."""
    bits, width = C.bucket_bits(held.total / BYTES_PER_WORD), key_width(held.total)
    anchors = C.ask(held, anchor_requests(bits, width), answer_anchors, 1 << bits)
    windows = C.ask(held, window_requests(bits, width), answer_windows, 1 << bits, anchors)
    return C.conclude(held, remove_windows(bits, width), anchors.unionByName(windows), RESULT, carried)


def cut_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``docs`` with the repeats cut out of its texts and their lengths, if there is such a column, adjusted.

    All rows and columns stay: they travel with their texts through the chunks, so rows that share an id
    keep their own columns. A null text stays null; a text that is all repeats becomes empty.
    """
    others = F.struct(F.lit(True).alias("row"), *[named(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text])
    rows = docs.select(named(doc_id).cast("long").alias("doc_id"), F.coalesce(named(text), F.lit("")).alias("text"), named(text).isNull().alias("missing"), others.alias("others"))
    found = removed(C.chunked(rows), carried=["missing", "others"])
    columns = []
    for i, column in enumerate(docs.columns):
        value = F.col(f"others.c{i}") if column != text else F.when(~F.col("missing"), F.col("left_text"))
        if column == n_chars:
            value = F.when(F.col("n_removed") > 0, F.length("left_text").cast(docs.schema[column].dataType)).otherwise(value)
        columns.append(value.alias(column))
    return found.select(*columns)


SQL = r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM t
), win AS (
  SELECT doc_id, unnest(range(1, len(words) - 11)) AS start, words FROM t WHERE len(words) >= 13
), h AS (SELECT doc_id, start, array_to_string(words[start : start + 12], ' ') AS window_text FROM win
), rep AS (SELECT doc_id, start FROM (SELECT doc_id, start, min(doc_id) OVER (PARTITION BY window_text) AS least FROM h) WHERE least < doc_id
), gone AS (SELECT DISTINCT doc_id, unnest(range(start, start + 13)) AS pos FROM rep
), kept AS (
  SELECT w.doc_id, count(gone.pos) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (gone.pos IS NULL), '') AS left_text
  FROM w LEFT JOIN gone USING (doc_id, pos) GROUP BY w.doc_id
)
SELECT t.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(left_text, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)
"""


@query("op4_block_anchors", SQL)
def op4_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(load(spark, sf_dir, "documents"))
    words = F.trim(F.regexp_replace("left_text", BLANKS, " "))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))
