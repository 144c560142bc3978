"""Repeated byte strings by a radix sort of suffixes that stops at the threshold.

Suffixes are ordered only through their first 100 bytes, most significant digit first, and a suffix
leaves as soon as its group has no other member; what is left in one group after the last digit is a
repeated string. The first digit is the anchor: of all 32-byte grams of a suffix's 100 bytes the one with
the smallest hash, leftmost on ties. Equal strings have equal anchors at equal places, so a suffix whose
anchor occurs once in the corpus leaves before any byte of it is moved. One anchor serves a run of about
35 neighbouring suffixes; round one asks which anchors occur again. Round two sends, for those, the
bytes of each distinct run once per chunk to the anchor's bucket, where the passes over the remaining
digits run, eight bytes at a time.

An anchor with more runs than a task should sort is hot: its suffixes are dealt by a hash of all their 100
bytes instead. Round two also asks which of those hashes occur again; for them a third one sends each
distinct string once per chunk, with its earliest place, to the hash's bucket, which makes the digit passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featloom.llm import chunks as C
from featloom.llm.base import load, query, texts
from featloom.llm.blocks import SPAN, covered, flags, mixed

LENGTH = 100
GRAM = 32
# Anchors a byte, about: two for every window of grams.
DENSITY = 2.0 / (LENGTH - GRAM + 2)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SHUFFLER = np.uint64(0xD6E8FEB86659FD93)
LOW = np.uint64(0xFFFFFFFF)
DIGIT = 8
# A run of suffixes with one anchor covers at most so many bytes.
WIDTH = 2 * LENGTH - GRAM
# Bytes of a run with its anchor and size, in whole words.
ROW = -(-(WIDTH + 2) // 8) * 8
# Suffixes whose anchors are sought at a time.
BLOCK = 1 << 15
SPARE_BITS = 12
# Suffixes that a pass sorts at a time, about.
SORTED_AT_ONCE = 2_000_000
# Runs with one anchor that meet in its bucket; with more the anchor is hot.
HOT_RUNS = SORTED_AT_ONCE // (LENGTH - GRAM + 1)
STRING_BITS = 63
# What a reply tells of: cold anchors that occur again, their runs, hot anchors, hashes of their strings, strings.
ANCHORS, RUNS, HOT, AGAIN, STRINGS = 1, 2, 3, 4, 5
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, left_bytes binary, spans array<struct<start: long, stop: long>>"
COUNTS = [(name, pa.int64()) for name in ("doc_id", "n_bytes", "n_removed", "n_spans")]
RESULT_KINDS = pa.schema([*COUNTS, ("left_bytes", pa.binary()), ("spans", SPAN)])


def gram_sums(data: np.ndarray) -> np.ndarray:
    """Polynomial of the gram at every place of the last axis, built by doubling."""
    found, length, base = data.astype(np.uint64), 1, MULTIPLIER
    with np.errstate(over="ignore"):
        while length < GRAM:
            if found.shape[-1] <= length:
                return found[..., :0]
            found = found[..., :-length] * base + found[..., length:]
            base, length = base * base, 2 * length
    return found


def sliding_least(values: np.ndarray, count: int) -> np.ndarray:
    """Smallest of each ``count`` neighbours, by doubling."""
    width = 1
    while 2 * width <= count:
        values = np.minimum(values[:-width], values[width:]) if len(values) > width else values[:0]
        width *= 2
    rest = count - width
    return np.minimum(values[: len(values) - rest], values[rest:]) if len(values) > rest else values[:0]


def anchors(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes at which a row or another anchor begins, with the place and polynomial of their anchors.

    Blocks are small enough for a core's cache.
    """
    found, before = [], -1
    place = np.arange(BLOCK + LENGTH - GRAM, dtype=np.uint64)
    for at in range(0, len(data) - LENGTH + 1, BLOCK):
        sums = gram_sums(data[at : at + BLOCK + LENGTH - 1])
        least = sliding_least((sums * SHUFFLER & ~LOW) | place[: len(sums)], LENGTH - GRAM + 1)
        anchor = (least & LOW).astype(np.int64)
        new = np.diff(anchor, prepend=before - at) != 0
        begins = starts[np.searchsorted(starts, at) : np.searchsorted(starts, at + len(anchor))]
        new[begins - at] = True
        edges = np.flatnonzero(new)
        found.append((edges + at, anchor[edges] + at, sums[anchor[edges]]))
        before = int(anchor[-1]) + at
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    return tuple(np.concatenate(parts) for parts in zip(*found)) if found else none


def contents(data: np.ndarray, begin: np.ndarray, anchor: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A row per run: where its anchor is, its size, its bytes, then zeros."""
    found = np.zeros((len(size), ROW), np.uint8)
    found[:, 0], found[:, 1] = anchor, size
    reach = np.arange(WIDTH)
    for at in range(0, len(size), 20_000):
        part = slice(at, at + 20_000)
        where = np.minimum(begin[part, None] + reach, len(data) - 1)
        found[part, 2 : WIDTH + 2] = np.where(reach < size[part, None], data[where], 0)
    return found


def equal_rows(rows: np.ndarray) -> np.ndarray:
    """Number of the group of equal byte rows that each row is in; grouped by a hash, then compared."""
    words, found = rows.view(np.uint64), np.zeros(len(rows), np.uint64)
    with np.errstate(over="ignore"):
        for column in range(words.shape[1]):
            found = mixed(found * MULTIPLIER + words[:, column])
    _, head, same = np.unique(found, return_index=True, return_inverse=True)
    if not (words == words[head[same]]).all():
        _, same = np.unique(rows.view(f"V{rows.shape[1]}").ravel(), return_inverse=True)
    return same


class Runs:
    """Runs of neighbouring suffixes of a chunk that share an anchor: first and last suffix, anchor, key."""

    def __init__(self, given: C.Texts, width: int):
        self.given = given
        first, anchor, sums = anchors(given.data, given.starts)
        row = np.searchsorted(given.starts, first, side="right") - 1
        # A run ends with the suffixes of its row.
        stop = np.minimum(np.append(first[1:], max(0, len(given.data) - LENGTH + 1))[: len(first)], given.starts[row + 1] - LENGTH + 1)
        own = np.flatnonzero(stop > first)
        self.first, self.last, self.anchor, self.row = first[own], stop[own] - 1, anchor[own], row[own]
        # Anchors are small by choice; mixed they spread evenly over the buckets.
        key = mixed(sums[own]) >> np.uint64(64 - width)
        order = np.argsort(key, kind="stable")
        self.first, self.last, self.anchor, self.row, self.key = (a[order] for a in (self.first, self.last, self.anchor, self.row, key))
        self.edges = np.flatnonzero(np.diff(self.key, prepend=~self.key[:1]) != 0) if len(key) else np.zeros(0, np.int64)

    def sizes(self) -> np.ndarray:
        return np.diff(self.edges, append=len(self.key))


class Entries:
    """Distinct runs with a flagged anchor, in order of key and content, each with its earliest place.

    ``of`` gives the entry of every flagged run, ``later`` tells runs that lie behind their entry's place.
    """

    def __init__(self, runs: Runs, flagged: np.ndarray):
        given = runs.given
        pick = np.flatnonzero(np.repeat(flagged, runs.sizes()))
        self.first, self.last, row = runs.first[pick], runs.last[pick], runs.row[pick]
        content = contents(given.data, self.first, runs.anchor[pick] - self.first, self.last - self.first + LENGTH)
        ids, place = given.doc_id[row], self.first - given.starts[row]
        same = equal_rows(content)
        order = np.lexsort((place, ids, same, runs.key[pick]))
        new = np.ones(len(pick), bool)
        new[1:] = (np.diff(same[order]) != 0) | (np.diff(runs.key[pick][order]) != 0)
        head = order[new]
        self.key, self.content, self.ids, self.place = runs.key[pick][head], content[head], ids[head], place[head]
        self.of = np.empty(len(pick), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.later = (ids != self.ids[self.of]) | (place != self.place[self.of])
        self.suffixes = self.content[:, 1].astype(np.int64) - LENGTH + 1


class Strings:
    """Distinct 100-byte strings of the runs with a hot anchor, in order of their hash, each with its earliest place.

    ``start`` has every suffix, ``of`` its string; ``later`` tells suffixes that lie behind their string's place.
    """

    def __init__(self, runs: Runs, hot: np.ndarray):
        given, pick = runs.given, np.flatnonzero(np.repeat(hot, runs.sizes()))
        count = runs.last[pick] - runs.first[pick] + 1
        start = np.repeat(runs.first[pick], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        row = np.repeat(runs.row[pick], count)
        ids, place, key = given.doc_id[row], start - given.starts[row], string_hashes(given.data, runs.first[pick], count)
        order = np.lexsort((place, ids, key))
        self.start, ids, place, key = start[order], ids[order], place[order], key[order]
        self.keys, first, self.counts = np.unique(key, return_index=True, return_counts=True)
        head = np.repeat(first, self.counts)
        # Strings that share a hash with another one of the chunk stay apart.
        every = np.arange(len(key))
        head = np.where(equal_strings(given.data, self.start, self.start[head]), head, every)
        self.of = (np.cumsum(head == every) - 1)[head]
        self.later = (ids != ids[head]) | (place != place[head])
        own = np.flatnonzero(head == every)
        self.key, self.ids, self.place, self.at = key[own], ids[own], place[own], self.start[own]

    def again(self, bits: int, replies: pa.Table) -> np.ndarray:
        """The strings whose hash occurs a second time."""
        found = flags(self.keys, bits, STRING_BITS, C.bits_of(replies, AGAIN))
        return np.flatnonzero(found[np.searchsorted(self.keys, self.key)])


def string_hashes(data: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Hash of the 100 bytes of every suffix of the runs, from the grams that cover them."""
    found, reach, offset = [np.zeros(0, np.uint64)], np.arange(WIDTH), np.arange(LENGTH - GRAM + 1)
    for at in range(0, len(first), 500):
        part = slice(at, at + 500)
        grams = gram_sums(data[np.minimum(first[part, None] + reach, len(data) - 1)])
        hashes = np.zeros((len(grams), len(offset)), np.uint64)
        with np.errstate(over="ignore"):
            for begin in [*range(0, LENGTH - GRAM, GRAM), LENGTH - GRAM]:
                hashes = mixed(hashes * MULTIPLIER + grams[:, begin : begin + len(offset)])
        found.append(hashes[offset < count[part, None]])
    return np.concatenate(found) >> np.uint64(64 - STRING_BITS)


def equal_strings(data: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    found, reach = one == two, np.arange(LENGTH)
    open_ = np.flatnonzero(~found)
    for at in range(0, len(open_), 20_000):
        part = open_[at : at + 20_000]
        found[part] = (data[one[part, None] + reach] == data[two[part, None] + reach]).all(axis=1)
    return found


def key_width(total: int) -> int:
    return int(min(63, np.ceil(np.log2(max(2.0, total * DENSITY))) + SPARE_BITS))


def anchor_requests(bits: int, width: int):
    def request(given: C.Texts, _: pa.Table) -> pa.Table:
        runs = Runs(given, width)
        return key_requests(given.chunk, runs.key[runs.edges], runs.sizes(), bits, width)

    return request


def key_requests(chunk: int, keys: np.ndarray, counts: np.ndarray, bits: int, width: int, shift: int = 0) -> pa.Table:
    """How often each of the ascending keys occurs in the chunk, for buckets from ``shift`` on."""
    rows, counts = [], counts.astype(np.uint32)
    for bucket, first, last in C.cut_points(keys, bits, width):
        rows.append((bucket + shift, chunk, C.joined([C.packed(C.differences(keys[first:last])), C.packed(counts[first:last])])))
    return C.request_table(rows)


def answer_keys(kind: int, hot_runs: int | None = None, shift: int = 0):
    """Flags the keys that occur a second time, in one chunk or two; those that occur too often are hot instead."""

    def answer(table: pa.Table) -> pa.Table:
        bucket, table = table["bucket"][0].as_py() - shift, table.sort_by("chunk")
        fields = [C.parted(raw) for raw in table["payload"].to_pylist()]
        keys = [C.sums(C.unpacked(steps, np.uint64)) for steps, _ in fields]
        counts = np.concatenate([C.unpacked(raw, np.uint32) for _, raw in fields]).astype(np.int64)
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        edges = np.flatnonzero(np.diff(every[order], prepend=~every[order][:1]) != 0)
        total = np.empty(len(every), np.int64)
        total[order] = np.repeat(np.add.reduceat(counts[order], edges), np.diff(edges, append=len(order)))
        hot = total > hot_runs if hot_runs is not None else np.zeros(len(total), bool)
        reply = lambda kind, flagged: C.split_replies(table["chunk"].to_pylist(), bucket, kind, flagged, [len(k) for k in keys])
        return pa.concat_tables([reply(kind, (total > 1) & ~hot), reply(HOT, hot)])

    return answer


def hot_strings(runs: Runs, bits: int, width: int, replies: pa.Table) -> Strings:
    return Strings(runs, flags(runs.key[runs.edges], bits, width, C.bits_of(replies, HOT)))


def string_requests(bits: int, width: int, hot_bits: int):
    def request(given: C.Texts, replies: pa.Table) -> pa.Table:
        found = hot_strings(Runs(given, width), bits, width, replies)
        sent, rows = found.again(hot_bits, replies), []
        for bucket, first, last in C.cut_points(found.key[sent], hot_bits, STRING_BITS):
            part = sent[first:last]
            raw = zstandard.ZstdCompressor(level=3).compress(given.data[found.at[part, None] + np.arange(LENGTH)].tobytes())
            rows.append((bucket, given.chunk, C.joined([C.packed(found.ids[part]), C.packed(found.place[part]), raw])))
        return C.request_table(rows)

    return request


def answer_strings(table: pa.Table) -> pa.Table:
    """Flags every sent string that also starts earlier: digit passes over the strings of a bucket."""
    bucket, table = table["bucket"][0].as_py(), table.sort_by("chunk")
    fields = [C.parted(raw) for raw in table["payload"].to_pylist()]
    sizes = [len(C.unpacked(f[0], np.int64)) for f in fields]
    ids, place = (np.concatenate([C.unpacked(f[i], np.int64) for f in fields]) for i in (0, 1))
    data = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(f[2]) for f in fields), np.uint8)
    flagged = repeated(np.zeros(len(ids), np.int64), data, np.arange(len(ids)) * LENGTH, ids, place)
    return C.split_replies(table["chunk"].to_pylist(), bucket, STRINGS, flagged, sizes)


def hot_starts(given: C.Texts, runs: Runs, bits: int, width: int, hot_bits: int, replies: pa.Table) -> np.ndarray:
    """The suffixes under hot anchors whose 100 bytes also start earlier."""
    found = hot_strings(runs, bits, width, replies)
    sent, bits_of = found.again(hot_bits, replies), C.bits_of(replies, STRINGS)
    marked = np.zeros(len(found.key), bool)
    for bucket, first, last in C.cut_points(found.key[sent], hot_bits, STRING_BITS):
        marked[sent[first:last]] = C.marks(bits_of.get(bucket), last - first)
    return found.start[found.later | marked[found.of]]


def flagged_entries(runs: Runs, bits: int, width: int, replies: pa.Table) -> Entries:
    return Entries(runs, flags(runs.key[runs.edges], bits, width, C.bits_of(replies, ANCHORS)))


def run_requests(bits: int, width: int, hot_bits: int):
    """Runs under cold anchors that occur again, and how often the strings' hashes under hot ones occur."""

    def request(given: C.Texts, replies: pa.Table) -> pa.Table:
        runs = Runs(given, width)
        found = flagged_entries(runs, bits, width, replies)
        rows = []
        for bucket, first, last in C.cut_points(found.key, bits, width):
            part = slice(first, last)
            used = np.arange(WIDTH) < found.content[part, 1, None]
            raw = zstandard.ZstdCompressor(level=3).compress(found.content[part, 2 : WIDTH + 2][used].tobytes())
            numbers = [C.packed(C.differences(found.key[part])), C.packed(found.ids[part]), C.packed(found.place[part])]
            rows.append((bucket, given.chunk, C.joined([*numbers, found.content[part, :2].tobytes(), raw])))
        hot = hot_strings(runs, bits, width, replies)
        hashes = key_requests(given.chunk, hot.keys, hot.counts, hot_bits, STRING_BITS, 1 << bits)
        return pa.concat_tables([C.request_table(rows), hashes])

    return request


def answer_both(bits: int):
    """Buckets behind those of the runs hold the hashes of strings under hot anchors."""
    hashes = answer_keys(AGAIN, shift=1 << bits)

    def answer(table: pa.Table) -> pa.Table:
        return answer_runs(table) if table["bucket"][0].as_py() < 1 << bits else hashes(table)

    return answer


def answer_runs(table: pa.Table) -> pa.Table:
    """Flags every suffix of every sent run whose 100 bytes also start earlier."""
    bucket, table = table["bucket"][0].as_py(), table.sort_by("chunk")
    fields = [C.parted(raw) for raw in table["payload"].to_pylist()]
    keys = [C.sums(C.unpacked(f[0], np.uint64)) for f in fields]
    key = np.concatenate(keys)
    ids = np.concatenate([C.unpacked(f[1], np.int64) for f in fields])
    place = np.concatenate([C.unpacked(f[2], np.int64) for f in fields])
    heads = np.concatenate([np.frombuffer(f[3], np.uint8).reshape(-1, 2) for f in fields]).astype(np.int64)
    data = np.frombuffer(b"".join([zstandard.ZstdDecompressor().decompress(f[4]) for f in fields] + [bytes(DIGIT)]), np.uint8)
    anchor, size = heads[:, 0], heads[:, 1]
    begin = np.cumsum(size) - size
    suffixes = size - LENGTH + 1
    upto = np.cumsum(suffixes) - suffixes
    # Of equal runs the earliest stands for all: every suffix of a later one starts earlier too.
    head = earliest_equal(anchor, size, data, begin, ids, place)
    later = (ids != ids[head]) | (place != place[head])
    flagged = np.repeat(later, suffixes)
    alone = np.flatnonzero(head == np.arange(len(head)))
    for part in slices(key, suffixes, alone):
        run = np.repeat(part, suffixes[part])
        offset = np.arange(len(run)) - np.repeat(np.cumsum(suffixes[part]) - suffixes[part], suffixes[part])
        group = ranks(key[run], anchor[run] - offset)
        flagged[upto[run] + offset] = repeated(group, data, begin[run] + offset, ids[run], place[run] + offset)
    for twin in np.flatnonzero(~later & (head != np.arange(len(head)))).tolist():
        flagged[upto[twin] : upto[twin] + suffixes[twin]] = flagged[upto[head[twin]] : upto[head[twin]] + suffixes[twin]]
    total = [int((f[:, 1].astype(np.int64) - LENGTH + 1).sum()) for f in (np.frombuffer(f[3], np.uint8).reshape(-1, 2) for f in fields)]
    return C.split_replies(table["chunk"].to_pylist(), bucket, RUNS, flagged, total)


def earliest_equal(anchor: np.ndarray, size: np.ndarray, data: np.ndarray, begin: np.ndarray, ids: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For each run the equal run with the smallest (id, place)."""
    same = equal_rows(contents(data, begin, anchor, size))
    order = np.lexsort((place, ids, same))
    new = np.flatnonzero(np.diff(same[order], prepend=-1))
    found = np.empty(len(size), np.int64)
    found[order] = np.repeat(order[new], np.diff(new, append=len(order)))
    return found


def slices(key: np.ndarray, suffixes: np.ndarray, among: np.ndarray) -> Iterator[np.ndarray]:
    """The runs among ``among`` whose key has a second one there, whole keys, about so many suffixes at a time."""
    order = among[np.argsort(key[among], kind="stable")]
    edges = np.flatnonzero(np.diff(key[order], prepend=~key[order][:1]) != 0)
    count = np.diff(edges, append=len(order))
    many = np.repeat(count > 1, count)
    order, label = order[many], np.repeat(np.arange(len(edges)), count)[many]
    slice_ = np.cumsum(suffixes[order]) // SORTED_AT_ONCE
    # A key belongs to the slice in which it begins.
    begins = np.flatnonzero(np.diff(label, prepend=-1))
    slice_ = np.repeat(slice_[begins], np.diff(begins, append=len(label)))
    cuts = np.flatnonzero(np.diff(slice_, prepend=-1, append=-1))
    for first, last in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield order[first:last]


def ranks(*columns: np.ndarray) -> np.ndarray:
    """Number of the group of equal values that each row is in."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for column in columns:
        new[1:] |= np.diff(column[order]) != 0
    found = np.empty(len(order), np.int64)
    found[order] = np.cumsum(new)
    return found


def repeated(group: np.ndarray, data: np.ndarray, at: np.ndarray, ids: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which suffixes have an equal one with a smaller (id, place): a pass for each digit of eight bytes."""
    digits = np.ndarray((len(data) - DIGIT + 1,), "<u8", data, strides=(1,))
    left = np.arange(len(group))
    for digit in [*range(0, LENGTH - DIGIT, DIGIT), LENGTH - DIGIT]:
        left = left[np.bincount(group)[group] > 1]
        if not len(left):
            break
        group = group[np.bincount(group)[group] > 1]
        group = ranks(group, digits[at[left] + digit])
    found = np.zeros(len(at), bool)
    keep = np.bincount(group)[group] > 1 if len(left) else np.zeros(0, bool)
    left, group = (left[keep], group[keep]) if len(left) else (left, left)
    if len(left):
        order = np.lexsort((place[left], ids[left], group))
        heads = np.flatnonzero(np.diff(group[order], prepend=-1))
        earliest = left[order][np.repeat(heads, np.diff(heads, append=len(order)))]
        own = left[order]
        found[own] = (ids[own] != ids[earliest]) | (place[own] != place[earliest])
    return found


def remove_suffixes(bits: int, width: int, hot_bits: int):
    def work(given: C.Texts, replies: pa.Table) -> pa.Table:
        runs = Runs(given, width)
        found = flagged_entries(runs, bits, width, replies)
        bits_of = C.bits_of(replies, RUNS)
        upto = np.concatenate([[0], np.cumsum(found.suffixes)])
        marked = np.zeros(int(upto[-1]), bool)
        for bucket, first, last in C.cut_points(found.key, bits, width):
            marked[upto[first] : upto[last]] = C.marks(bits_of.get(bucket), int(upto[last] - upto[first]))
        count = found.last - found.first + 1
        offset = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        entry = np.repeat(found.of, count)
        gone = marked[upto[entry] + offset] | np.repeat(found.later, count)
        start = (np.repeat(found.first, count) + offset)[gone]
        start = np.concatenate([start, hot_starts(given, runs, bits, width, hot_bits, replies)])
        cut = covered(len(given.data), start, LENGTH)
        return result(given, cut)

    return work


def result(given: C.Texts, cut: np.ndarray) -> pa.Table:
    """The rows of a chunk without the marked bytes."""
    total = np.concatenate([[0], np.cumsum(cut)])
    row = np.repeat(np.arange(len(given.doc_id)), np.diff(given.starts))
    begins = np.flatnonzero(cut & ~(np.concatenate([[False], cut[:-1]]) & (np.diff(row, prepend=-1) == 0))) if len(cut) else np.zeros(0, np.int64)
    ends = np.flatnonzero(cut & ~(np.concatenate([cut[1:], [False]]) & (np.diff(row, append=-1) == 0))) + 1 if len(cut) else begins
    count = np.bincount(row[begins], minlength=len(given.doc_id))
    shift = given.starts[row[begins]]
    pairs = pa.StructArray.from_arrays([pa.array(begins - shift, pa.int64()), pa.array(ends - shift, pa.int64())], ["start", "stop"])
    spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pairs)
    removed = total[given.starts[1:]] - total[given.starts[:-1]]
    left = given.without(cut)
    raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(left), left.buffers())
    columns = [given.ids(), pa.array(np.diff(given.starts)), pa.array(removed), pa.array(count), raw, spans]
    return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, RESULT_KINDS)], schema=RESULT_KINDS)


def remove_repeated_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chunk_bytes: int = C.CHUNK_BYTES, hot_runs: int = HOT_RUNS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, left_bytes, spans (removed byte runs) of every row.

    A byte goes if a 100-byte string of its document that covers it also starts earlier: in a smaller
    doc_id, or before it in the same document. Shorter, empty and null texts are left alone; a null id is
    larger than any; rows of one id count as one document whose places they share; other columns are
    not looked at; an empty table gives no rows.
    """
    held = C.chunked(texts(docs, doc_id, text), chunk_bytes)
    # A run is far more work than a key, so a bucket holds fewer.
    bits, width = C.bucket_bits(held.total * DENSITY * 16), key_width(held.total)
    # A string is more bytes than a run's share of it.
    hot_bits, tasks = bits + 2, 1 << bits
    anchors = C.ask(held, anchor_requests(bits, width), answer_keys(ANCHORS, hot_runs), tasks)
    replies = anchors.unionByName(C.ask(held, run_requests(bits, width, hot_bits), answer_both(bits), tasks, anchors))
    if not replies.where(F.col("kind") == AGAIN).isEmpty():
        known = replies.where(F.col("kind").isin(HOT, AGAIN))
        replies = replies.unionByName(C.ask(held, string_requests(bits, width, hot_bits), answer_strings, tasks, known))
    return C.conclude(held, remove_suffixes(bits, width, hot_bits), replies, RESULT)


SQL = r"""
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), s AS (SELECT doc_id, unnest(range(0, len(h) // 2 - 99)) AS p, h FROM t WHERE len(h) >= 200
), f AS (SELECT doc_id, p, md5_number(substr(h, 2 * p + 1, 200)) AS k FROM s
), rep AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS r FROM f) WHERE r > 1
), run AS (SELECT doc_id, p, sum(CASE WHEN p <= before + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS n
  FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM rep)
), span AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM run GROUP BY doc_id, n
), gap AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM span
), kept AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS left_part, max(b) AS stop
  FROM gap JOIN t USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(left_part, '') || substr(h, 2 * coalesce(stop, 0) + 1))) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)
"""


@query("op5_suffix_radix", SQL)
def op5_suffix_radix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated_bytes(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("left_bytes", 256).alias("kept_sha256"))
