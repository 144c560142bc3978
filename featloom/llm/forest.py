"""Near-duplicate texts by a forest of sorted MinHash signatures.

A signature is read in several orders, one per tree, each with four leading values of its own. Texts that
agree on the leading values of an order are neighbours there; where a region is too dense for one task,
the prefix grows until its groups are small enough. Inside a group the whole signatures are compared, and
pairs that can hardly be links are dropped. Every link is confirmed on the full shingle sets.

Texts with equal sets are one class from the start, so copies are never compared. In a dense group the
first round proposes a cover only: texts that are like many others, paired with those. The second round
looks at every likely pair of a group whose two texts the confirmed links have not brought together yet,
so that no link is lost by the cover. Where a group has few such pairs they are proposed one by one;
where it has many, the sets of its texts come to the group, and only links that join two components
leave it. What moves thus grows with the members of the groups, not with their pairs.

Longer prefixes only bring a dense region together early; they may part texts that are alike. So a group
that was split is also compared whole: its texts outside its largest component, with one another and with
that component, in pairs of blocks that fit a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featloom.llm import chunks as C
from featloom.llm.base import load, named, query, texts
from featloom.llm.blocks import ANCHOR_BASE, SECOND_BASE, Words, mixed, rolling
from featloom.llm.components import HOT_SHARE, components
from featloom.llm.exact import with_groups
from featloom.session import materialise

SHINGLE = 5
SIMILARITY = 0.8
TREES = 24
LEADING = 4
VALUES = TREES * LEADING
# Members of a group that one task compares; beyond it the prefix grows, and blocks of half as many meet in pairs.
GROUP = 4096
DEPTHS = (8, 16, 32, 64, VALUES)
# Groups up to this size are compared pair by pair without a cover.
SMALL = 8
# Standard errors below the threshold at which an estimate still makes a candidate.
MARGIN = 4.5
BATCH_BYTES = 2_000_000
# Bytes kept of a shingle's hash in the sets that confirm links.
HASH_BYTES = 6
SIGNATURES = "doc_id long, text_key long, n_shingles long, digest binary, signature binary"
PAIRS = "a long, b long"
# Open pairs per member up to which a group proposes them one by one.
OPEN_PAIRS = 2
# Shingles that are compared at a time.
COLUMNS = 4096


def steps() -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of the signature's hash functions."""
    base = mixed(np.arange(1, VALUES + 1, dtype=np.uint64) * SECOND_BASE)
    return base | np.uint64(1), mixed(base)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, byte by byte."""
    return np.where((data >= 0x41) & (data <= 0x5A), data + np.uint8(0x20), data)


def slices(text: pa.Array) -> Iterator[tuple[int, int, C.Texts]]:
    """Rows first..last-1 of an Arrow column of texts as lower-case bytes, a bounded part at a time."""
    text = text.cast(pa.large_string())
    _, offsets, data = text.buffers()
    starts = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(text):
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + BATCH_BYTES, "right")) - 1)
        own = lowered(raw[starts[first] : starts[last]])
        yield first, last, C.Texts(np.arange(first, last), own, starts[first : last + 1] - starts[first], 0, None)
        first = last


def shingles(given: C.Texts, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles, in order; fewer words than a shingle are one shingle."""
    words = Words(given)
    inside = words.windows(length)
    row, found = words.row[: len(inside)][inside], rolling(words.hash, length, ANCHOR_BASE)[inside]
    short = np.flatnonzero((words.counts > 0) & (words.counts < length))
    own = np.zeros(len(short), np.uint64)
    for k in range(length - 1):
        there = words.counts[short] > k
        own[there] = mixed(own[there] * ANCHOR_BASE + words.hash[words.begin[short[there]] + k] + np.uint64(k + 1))
    row, found = np.concatenate([row, short]), np.concatenate([found, own])
    order = np.lexsort((found, row))
    row, found = row[order], found[order]
    new = np.ones(len(row), bool)
    new[1:] = (np.diff(row) != 0) | (np.diff(found) != 0)
    return row[new], found[new]


def signatures(rows: DataFrame, length: int) -> DataFrame:
    """Set size, 128-bit digest of the set and signature of every (doc_id, text) row."""
    kinds = [("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("signature", pa.binary())]
    schema = pa.schema(kinds)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, offsets = steps()
        for frame in frames:
            for first, last, given in slices(frame.column(1)):
                row, found = shingles(given, length)
                count = np.bincount(row, minlength=last - first)
                full = np.flatnonzero(count)
                edges = np.flatnonzero(np.diff(row, prepend=-1))
                sums = [np.add.reduceat(mixed(found + base), edges) if len(edges) else found for base in (ANCHOR_BASE, SECOND_BASE)]
                least = np.empty((len(full), VALUES), "<u4")
                for i in range(VALUES):
                    least[:, i] = np.minimum.reduceat((found * factors[i] + offsets[i]) >> np.uint64(32), edges) if len(edges) else 0
                digests = np.stack(sums, axis=1).astype("<u8")
                digest, signature = [None] * (last - first), [None] * (last - first)
                for k, at in enumerate(full.tolist()):
                    digest[at], signature[at] = digests[k].tobytes(), least[k].tobytes()
                part = frame.slice(first, last - first)
                columns = [part.column(0), part.column(2), pa.array(count, pa.int64()), pa.array(digest, pa.binary()), pa.array(signature, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    read = rows.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    return materialise(read.mapInArrow(run, SIGNATURES), "signatures")


def tree_rows(classes: DataFrame) -> DataFrame:
    """(tree, key, node): the leading values of every class in every tree's order."""
    schema = pa.schema([("tree", pa.int32()), ("key", pa.int64()), ("node", pa.int64())])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            values = signature_matrix(frame.column(1))
            for tree in range(TREES):
                node = frame.column(0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), tree, np.int32)), pa.array(prefix(values, tree, 0, LEADING)), node], schema=schema)

    return classes.select("node", "signature").mapInArrow(run, "tree int, key long, node long")


def signature_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, VALUES)


def prefix(values: np.ndarray, tree: int, first: int, last: int) -> np.ndarray:
    """Hash of the values first..last-1 of a tree's order: its own four, then those of the next trees."""
    order = (np.arange(first, last) + tree * LEADING) % VALUES
    found = np.full(len(values), np.uint64(tree + 1))
    for column in order:
        found = mixed(found * ANCHOR_BASE + values[:, column].astype(np.uint64))
    return found.view(np.int64)


def grouped(classes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, node) of all groups of two or more that fit a task, pairs of those that never do, and the split groups.

    A group beyond the limit is split by longer prefixes of its tree's order. Texts that agree on the
    whole signature and are still too many are paired with the smallest of them. The third table has the
    (key, node) rows of the groups as they were before the first split.
    """
    rows = materialise(tree_rows(classes), "tree-rows")
    found, stars = [], classes.select(F.col("node").alias("a"), F.col("node").alias("b")).where("false")
    depth, split = LEADING, classes.select(F.col("node").alias("key"), "node").where("false")
    for deeper in (*DEPTHS, None):
        sizes = materialise(rows.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("least")).where("size > 1"), "tree-sizes")
        met = rows.join(sizes.where(F.col("size") <= GROUP).select("tree", "key"), ["tree", "key"])
        found.append(met.select("key", "node"))
        large = sizes.where(F.col("size") > GROUP)
        if large.isEmpty():
            break
        kept = members(rows, large, ["tree", "key"])
        if depth == LEADING:
            split = materialise(kept.select("key", "node"), "split-groups")
        if deeper is None:
            stars = kept.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
            break
        rows = materialise(deepened(kept.select("tree", "key", "node").join(classes.select("node", "signature"), "node"), depth, deeper), "tree-rows")
        depth = deeper
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every, stars, split


def members(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of the groups (keys, size, ...), with the groups' other columns.

    Only groups with a thousandth of the rows are broadcast, of which there are a thousand at most. The
    others are small against the table, so their rows are shuffled.
    """
    hot = F.col("size") >= -(-rows.count() // HOT_SHARE)
    large = groups.where(hot)
    found, small = rows.join(F.broadcast(large), keys), groups.where(~hot)
    if small.isEmpty():
        return found
    rest = rows.join(F.broadcast(large.select(*keys)), keys, "left_anti")
    return found.unionByName(rest.join(small, keys))


def blocked(split: DataFrame, member: DataFrame, block: int) -> DataFrame:
    """(key, node, label) of the split groups as groups of two blocks at most, each with a key of its own.

    Every pair of texts of one group and different labels meets in a block or in a pair of blocks. Texts
    of the group's largest label are not paired with one another; a group of one label is left out.
    """
    labelled = split.join(member, "node", "left").select("key", "node", F.coalesce("component", "node").alias("label"))
    labelled = materialise(labelled, "split-labels")
    counts = labelled.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    groups = counts.groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("size"))
    blocks = lambda n: F.ceil(n / F.lit(block)).cast("int")
    groups = groups.where("size > top.n").select("key", "size", F.col("top.label").alias("main"), blocks(F.col("size") - F.col("top.n")).alias("outer"), blocks(F.col("top.n")).alias("inner"))
    met = members(labelled, materialise(groups, "split-sizes"), ["key"])
    inside = F.col("label") == F.col("main")
    own = F.pmod(F.xxhash64("node", "key"), F.when(inside, F.col("inner")).otherwise(F.col("outer"))).cast("int")
    # Blocks of the largest label are numbered behind the others.
    placed = met.withColumn("own", F.when(inside, F.col("outer") + own).otherwise(own))
    others = F.sequence(F.lit(0), F.when(inside, F.col("outer")).otherwise(F.col("outer") + F.col("inner")) - 1)
    paired = placed.withColumn("other", F.explode(others)).where("other <> own")
    return paired.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "node", "label")


def deepened(rows: DataFrame, first: int, last: int) -> DataFrame:
    """The rows with the values first..last-1 of their tree's order added to their keys."""
    schema = pa.schema([("tree", pa.int32()), ("key", pa.int64()), ("node", pa.int64())])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            values, trees = signature_matrix(frame.column(3)), frame.column(0).to_numpy()
            key = frame.column(1).to_numpy().view(np.uint64).copy()
            for tree in np.unique(trees):
                own = trees == tree
                key[own] = mixed(key[own] * SECOND_BASE + prefix(values[own], int(tree), first, last).view(np.uint64))
            yield pa.RecordBatch.from_arrays([frame.column(0), pa.array(key.view(np.int64)), frame.column(2)], schema=schema)

    return rows.select("tree", "key", "node", "signature").mapInArrow(run, "tree int, key long, node long")


def short_signatures(classes: DataFrame) -> DataFrame:
    """(node, short): the low byte of every value, enough to estimate a similarity."""
    schema = pa.schema([("node", pa.int64()), ("short", pa.binary())])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            low = (signature_matrix(frame.column(1)) & np.uint32(0xFF)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([frame.column(0), pa.array([row.tobytes() for row in low], pa.binary())], schema=schema)

    return classes.select("node", "signature").mapInArrow(run, "node long, short binary")


def least_matches(similarity: float) -> int:
    return int(np.floor(VALUES * (similarity - MARGIN * np.sqrt(similarity * (1 - similarity) / VALUES))))


def likely_pairs(key: np.ndarray, node: np.ndarray, label: np.ndarray, short: np.ndarray, least: int, cover: bool) -> tuple[np.ndarray, list[int]]:
    """Pairs of nodes of a group, of different labels, that agree in at least so many values; and dense groups.

    With ``cover``, groups beyond a few members give pairs that reach every text with a partner. Without,
    they give all their pairs, or, if those are many, their key.
    """
    dense = []
    edges = np.flatnonzero(np.diff(key, prepend=~key[:1]) != 0) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(edges, append=len(key))
    found = []
    for size in range(2, SMALL + 1):
        begin = edges[sizes == size]
        for i in range(size):
            for k in range(i + 1, size):
                a, b = begin + i, begin + k
                near = (label[a] != label[b]) & ((short[a] == short[b]).sum(axis=1) >= least)
                found.append(np.stack([node[a[near]], node[b[near]]], axis=1))
    for begin, size in zip(edges[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        part = slice(begin, begin + size)
        like = alike(short[part], least) & (label[part, None] != label[None, part])
        if not cover and np.count_nonzero(like) > 2 * OPEN_PAIRS * size:
            dense.append(int(key[begin]))
            continue
        one, two = covering(like) if cover else np.nonzero(np.triu(like))
        found.append(np.stack([node[part][one], node[part][two]], axis=1))
    pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    return np.unique(np.sort(pairs, axis=1), axis=0), dense


def alike(short: np.ndarray, least: int) -> np.ndarray:
    found = np.zeros((len(short), len(short)), bool)
    step = max(1, 8_000_000 // short.size)
    for at in range(0, len(short), step):
        found[at : at + step] = (short[at : at + step, None, :] == short[None, :, :]).sum(axis=2, dtype=np.uint8) >= least
    np.fill_diagonal(found, False)
    return found


def covering(like: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of hubs with the texts like them, until every text that has a partner is in a pair."""
    open_ = like.any(axis=1)
    degree = (like & open_).sum(axis=1)
    one, two = [], []
    while open_.any():
        hub = int(np.argmax(degree))
        reached = np.flatnonzero(like[hub] & open_)
        if not len(reached):
            break
        one.append(np.full(len(reached), hub))
        two.append(reached)
        gone = reached if not open_[hub] else np.append(reached, hub)
        open_[gone] = False
        degree -= like[:, gone].sum(axis=1)
    return (np.concatenate(one), np.concatenate(two)) if one else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def whole_groups(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in order of ``key``, cut so that no group is split."""
    rest = None
    for frame in frames:
        table = pa.Table.from_batches([frame])
        rest = table if rest is None else pa.concat_tables([rest, table])
        key = rest["key"].to_numpy()
        # The last group may go on in the next batch.
        cut = int(np.searchsorted(key, key[-1], "left"))
        if cut:
            yield rest.slice(0, cut)
            rest = rest.slice(cut)
    if rest is not None:
        yield rest


def by_group(rows: DataFrame) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key", "node")


def candidate_pairs(groups: DataFrame, similarity: float, cover: bool) -> DataFrame:
    """Distinct (a, b, dense) from (key, node, label, short) rows; a dense group is named by its key in both."""
    schema, least = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("dense", pa.bool_())]), least_matches(similarity)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(frames):
            short = np.frombuffer(b"".join(table["short"].to_pylist()), np.uint8).reshape(-1, VALUES)
            pairs, dense = likely_pairs(*[table[c].to_numpy() for c in ("key", "node", "label")], short, least, cover)
            keys = np.array(dense, np.int64)
            sides = [pa.array(np.concatenate([pairs[:, i], keys])) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*sides, pa.array(np.arange(len(sides[0])) >= len(pairs))], schema=schema)

    return by_group(groups.select("key", "node", "label", "short")).mapInArrow(run, PAIRS + ", dense boolean").distinct()


def dense_links(rows: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that join components inside dense groups, from (key, node, label, hashes) rows."""
    schema, percent = pa.schema([("a", pa.int64()), ("b", pa.int64())]), round(similarity * 100)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(frames):
            key, node, label = (table[c].to_numpy() for c in ("key", "node", "label"))
            edges = np.flatnonzero(np.diff(key, prepend=~key[:1]) != 0)
            found = []
            for begin, end in zip(edges.tolist(), np.append(edges[1:], len(key)).tolist()):
                sets = [read_set(raw.as_py()) for raw in table["hashes"].slice(begin, end - begin)]
                found += joining_links(node[begin:end], label[begin:end], sets, percent)
            sides = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(sides[:, 0]), pa.array(sides[:, 1])], schema=schema)

    return by_group(rows.select("key", "node", "label", "hashes")).mapInArrow(run, PAIRS).distinct()


def joining_links(node: np.ndarray, label: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between texts of different labels, as many as it takes to join what they connect.

    Every text outside the largest label is compared with all others on the full sets, as products of
    membership matrices; shingles of one text alone need no column.
    """
    sizes = np.array([len(s) for s in sets])
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = often[column] > 1
    row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
    names, own = np.unique(label, return_inverse=True)
    outside = np.flatnonzero(own != np.bincount(own).argmax())
    common = np.zeros((len(outside), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [first, first + COLUMNS])
        member = np.zeros((len(sets), COLUMNS), np.float32)
        member[row[a:b], column[a:b] - first] = 1.0
        common += member[outside] @ member.T
    like = 100 * common >= percent * (sizes[outside, None] + sizes[None, :] - common)
    one, two = np.nonzero(like & (own[outside, None] != own[None, :]))
    one = outside[one]
    _, first = np.unique(own[one] * len(names) + own[two], return_index=True)
    parent = list(range(len(names)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    found = []
    for a, b in zip(one[first].tolist(), two[first].tolist()):
        ra, rb = root(own[a]), root(own[b])
        if ra != rb:
            parent[ra] = rb
            found.append((min(int(node[a]), int(node[b])), max(int(node[a]), int(node[b]))))
    return found


def shingle_sets(rows: DataFrame, length: int) -> DataFrame:
    """(node, hashes): the full set of every (node, text) row, ascending, as byte planes."""
    schema = pa.schema([("node", pa.int64()), ("hashes", pa.binary())])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for first, last, given in slices(frame.column(1)):
                row, found = shingles(given, length)
                bounds = np.searchsorted(row, np.arange(last - first + 1))
                found >>= np.uint64(64 - 8 * HASH_BYTES)
                raw = [found[a:b].view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays([frame.column(0).slice(first, last - first), pa.array(raw, pa.binary())], schema=schema)

    return rows.select("node", "text").mapInArrow(run, "node long, hashes binary")


def read_set(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // HASH_BYTES, 8), np.uint8)
    wide[:, :HASH_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, HASH_BYTES)
    return wide.view("<u8").ravel()


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose full sets are similar enough; both sets meet in the task that compares them."""
    percent = round(similarity * 100)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            keep = []
            for one, two in zip(frame.column(2), frame.column(3)):
                one, two = read_set(one.as_py()), read_set(two.as_py())
                shared = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * shared >= percent * (len(one) + len(two) - shared))
            kept = frame.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], schema=schema)

    first = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("one")), "a")
    both = first.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("two")), "b")
    return materialise(both.select("a", "b", "one", "two").mapInArrow(run, PAIRS), "links")


def linked(rows: DataFrame, classes: DataFrame, length: int, similarity: float) -> DataFrame:
    """(node, component) of the classes that have a link."""
    groups, stars, split = grouped(classes)
    short = short_signatures(classes)
    groups = materialise(groups.join(short, "node"), "tree-groups")
    proposed = candidate_pairs(groups.withColumn("label", F.col("node")), similarity, cover=True).drop("dense")
    proposed = materialise(proposed.unionByName(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct(), "pairs")
    # Texts of the classes that share a group: the sets of no other are ever needed.
    wanted = groups.select("node").unionByName(split.select("node")).distinct()
    keyed = classes.join(wanted, "node", "left_semi").select(F.col("node").alias("doc_id"), "text_key", "node")
    texts_of = rows.withColumn("text_key", F.xxhash64("text")).join(keyed, ["doc_id", "text_key"]).select("node", "text")
    sets = materialise(shingle_sets(texts_of.dropDuplicates(["node"]), length), "sets")
    first = confirmed(proposed, sets, similarity)
    member = components(first)
    labelled = groups.join(member, "node", "left").withColumn("label", F.coalesce("component", "node"))
    member = joined_components(member, links_between(labelled, sets, similarity, proposed))
    if split.isEmpty():
        return member
    member = materialise(member, "components")
    pairs = materialise(blocked(split, member, GROUP // 2), "split-blocks")
    return joined_components(member, links_between(materialise(pairs.join(short, "node"), "split-groups"), sets, similarity, proposed))


def links_between(labelled: DataFrame, sets: DataFrame, similarity: float, known: DataFrame) -> DataFrame:
    """Links of texts of different labels in (key, node, label, short) groups; ``known`` pairs are not looked at again."""
    apart = materialise(candidate_pairs(labelled, similarity, cover=False), "pairs")
    single = apart.where("NOT dense").drop("dense").join(known, ["a", "b"], "left_anti")
    dense = labelled.join(apart.where("dense").select(F.col("a").alias("key")), "key", "left_semi").select("key", "node", "label").join(sets, "node")
    return materialise(confirmed(single, sets, similarity).unionByName(dense_links(dense, similarity)), "links")


def joined_components(member: DataFrame, links: DataFrame) -> DataFrame:
    """The components of the first round, put together by the links of the second.

    Only components that a new link touches are worked on again.
    """
    label = lambda side: member.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))
    met = links.join(label("a"), "a", "left").join(label("b"), "b", "left")
    upper = components(met.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")))
    above = upper.select(F.col("node").alias("component"), F.col("component").alias("top"))
    known = member.join(above, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    return known.unionByName(upper.join(member.select("node"), "node", "left_anti").select("node", "component"))


def near_duplicates(docs: DataFrame, length: int = SHINGLE, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key (a hash of the text), n_shingles, component_id, kept of every row.

    Two texts are linked if the Jaccard similarity of their sets of distinct lower-case word shingles is
    high enough. A text of fewer words than a shingle is one shingle; an empty or null one has an empty
    set and links with nothing. A component's id is its smallest doc_id, whose row is kept. Rows with a
    null id stand alone: their component is null and they are kept. Rows that share an id have one
    component; if their texts differ, the one with the smallest key speaks for the id. Other columns are
    not looked at; an empty table gives no rows.
    """
    rows = texts(docs, doc_id, text)
    signed = signatures(rows, length)
    usable = signed.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    grouped_sets = usable.groupBy("digest").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.count(F.lit(1)).alias("group_size"), F.first("signature").alias("signature"))
    classes = materialise(grouped_sets.select(F.col("first.doc_id").alias("node"), F.col("first.text_key").alias("text_key"), "digest", "group_size", "signature"), "classes")
    single = classes.groupBy("node").agg(F.min(F.struct("text_key", "signature")).alias("one"))
    member = linked(rows, single.select("node", "one.text_key", "one.signature"), length, similarity)
    groups = classes.join(member, "node", "left").select("digest", F.coalesce("component", "node").alias("keep_id"), "group_size")
    groups = materialise(groups, "near-groups")
    columns = ["doc_id", "text_key", "n_shingles"]
    met = with_groups(usable.drop("signature"), groups, F.col("digest"), signed.count()).select(*columns, F.col("keep_id").alias("component_id"))
    alone = signed.where("doc_id IS NULL OR digest IS NULL").select(*columns, F.col("doc_id").alias("component_id"))
    return met.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, length: int = SHINGLE, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component, all columns as they were."""
    lost = near_duplicates(docs, length, similarity, doc_id, text).where("NOT kept").select("doc_id", "text_key").distinct()
    wrapped = docs.select(
        F.struct(*[named(c) for c in docs.columns]).alias("row"),
        named(doc_id).cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce(named(text), F.lit(""))).alias("text_key"),
    )
    return wrapped.join(lost, ["doc_id", "text_key"], "left_anti").select("row.*")


SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + 2], ' ') AS shingle FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 1) + 1)) AS i FROM t WHERE len(words) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), link AS (
  SELECT a, b FROM shared JOIN n AS na ON na.doc_id = a JOIN n AS nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)
), both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link
), reach AS (SELECT doc_id, doc_id AS other FROM t UNION SELECT reach.doc_id, b FROM reach JOIN both_ways ON other = a
)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) LEFT JOIN n USING (doc_id)
"""


@query("op6_signature_forest", SQL)
def op6_signature_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(load(spark, sf_dir, "documents"), length=3, similarity=0.85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")
