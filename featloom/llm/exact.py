"""Exact duplicates against a history that is indexed by a minimal perfect hash.

The distinct digests of the history are dealt into buckets of bounded size. Each bucket gets a minimal
perfect hash (levels of bit arrays; a key's slot is the rank of its bit) whose slots hold the full
digest, the locator of the winner and the number of copies. New texts are counted per digest before
anything moves, looked up bucket by bucket, and believed to be known only if the slot's bytes equal
theirs. Digests that are no members form groups of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featloom.llm.base import BLANKS, load, named, parts, query, texts
from featloom.session import materialise

BUCKET_KEYS = 50_000
DIGEST_BYTES = 32
# Room of a level: bits per key that is still to be placed.
SPACE = 2.0
# A digest with this share of all rows is hot; there can be no more than so many.
HOT_GROUPS = 1000
INDEX = "bucket int, levels array<binary>, digests binary, winners binary, present binary, copies binary"
GROUPS = "digest binary, keep_id long, group_size long"


def normalised(text: Column) -> Column:
    """Each run of blanks as one space."""
    return F.regexp_replace(text, BLANKS, " ")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


class PerfectHash:
    """Minimal perfect hash over distinct 256-bit keys, given as rows of four uint64."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        ones = np.concatenate([level.astype(np.int64) for level in levels]) if levels else np.zeros(0, np.int64)
        self.ranks = np.cumsum(ones) - ones
        self.starts = np.cumsum([0, *map(len, levels)])

    @staticmethod
    def places(keys: np.ndarray, level: int, room: int) -> np.ndarray:
        """Each level mixes the words of a key anew."""
        with np.errstate(over="ignore"):
            mixed = keys[:, 0] ^ (keys[:, 1] * np.uint64(2 * level + 1))
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + keys[:, 2]
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(level)
        return ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(room)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys):
            room = max(64, int(SPACE * len(keys)))
            at = cls.places(keys, len(levels), room)
            alone = np.bincount(at, minlength=room) == 1
            levels.append(alone)
            keys = keys[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of every key, -1 where no level has its bit. A key outside the set may get any slot."""
        found = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for i, level in enumerate(self.levels):
            at = self.places(keys[left], i, len(level))
            hit = level[at]
            found[left[hit]] = self.ranks[self.starts[i] + at[hit]]
            left = left[~hit]
        return found

    def packed(self) -> list[bytes]:
        return [len(level).to_bytes(8, "little") + np.packbits(level).tobytes() for level in self.levels]

    @classmethod
    def unpacked(cls, raw: list[bytes]) -> PerfectHash:
        return cls([np.unpackbits(np.frombuffer(r, np.uint8, offset=8), count=int.from_bytes(r[:8], "little")).astype(bool) for r in raw])


def keys_of(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, DIGEST_BYTES // 8)


def build_bucket(table: pa.Table) -> pa.Table:
    """One index row from the (digest, first_id, copies, bucket) rows of a bucket."""
    keys = keys_of(table["digest"].to_pylist())
    mapped = PerfectHash.build(keys)
    order = np.argsort(mapped.slots(keys))
    first = table["first_id"].combine_chunks()
    present = np.asarray(first.is_valid().to_numpy(zero_copy_only=False), np.uint8)
    winners = first.fill_null(0).to_numpy().astype(np.int64)
    row = {
        "bucket": table["bucket"][0].as_py(),
        "levels": mapped.packed(),
        "digests": keys[order].tobytes(),
        "winners": winners[order].tobytes(),
        "present": present[order].tobytes(),
        "copies": table["copies"].to_numpy().astype(np.int64)[order].tobytes(),
    }
    kinds = [("bucket", pa.int32()), ("levels", pa.list_(pa.binary())), *((n, pa.binary()) for n in ("digests", "winners", "present", "copies"))]
    return pa.Table.from_pylist([row], schema=pa.schema(kinds))


def groups_table(keys: np.ndarray, winners: np.ndarray, present: np.ndarray, copies: np.ndarray) -> pa.Table:
    raw = keys.tobytes()
    digests = [raw[i : i + DIGEST_BYTES] for i in range(0, len(raw), DIGEST_BYTES)]
    return pa.table({"digest": pa.array(digests, pa.binary()), "keep_id": pa.array(winners, pa.int64(), mask=present == 0), "group_size": pa.array(copies, pa.int64())})


def look_up(fresh: pa.Table, index: pa.Table) -> pa.Table:
    """All groups of a bucket: known ones with the new copies added, then those of nonmembers."""
    keys = keys_of(fresh["digest"].to_pylist())
    first = fresh["first_id"].combine_chunks()
    present = np.asarray(first.is_valid().to_numpy(zero_copy_only=False), np.uint8)
    winners = first.fill_null(0).to_numpy().astype(np.int64)
    copies = fresh["copies"].to_numpy().astype(np.int64)
    if not index.num_rows:
        return groups_table(keys, winners, present, copies)
    row = index.to_pylist()[0]
    known = np.frombuffer(row["digests"], np.uint64).reshape(-1, DIGEST_BYTES // 8)
    totals = np.frombuffer(row["copies"], np.int64).copy()
    slots = PerfectHash.unpacked(row["levels"]).slots(keys)
    member = slots >= 0
    member[member] = (known[slots[member]] == keys[member]).all(axis=1)
    totals[slots[member]] += copies[member]
    new = ~member
    return groups_table(
        np.concatenate([known, keys[new]]),
        np.concatenate([np.frombuffer(row["winners"], np.int64), winners[new]]),
        np.concatenate([np.frombuffer(row["present"], np.uint8), present[new]]),
        np.concatenate([totals, copies[new]]),
    )


def counted(rows: DataFrame) -> DataFrame:
    """(digest, first_id, copies): partial counts leave the tasks, so no copy is moved."""
    return rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))


def bucketed(groups: DataFrame, buckets: int) -> DataFrame:
    return groups.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int"))


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """The stored index over (doc_id, digest) rows of the history: one row per bucket."""
    built = bucketed(counted(history), buckets).groupBy("bucket").applyInArrow(build_bucket, INDEX)
    return materialise(built, "digest-index")


def find_groups(rows: DataFrame, historical: Column) -> DataFrame:
    """(digest, keep_id, group_size) of all (doc_id, digest) rows.

    ``historical`` tells the rows of the index from the new ones. The winner of a known digest is the
    history's smallest doc_id, that of a new one the smallest of the new rows; ids that are null win
    only where a group has no other.
    """
    historical = F.coalesce(historical, F.lit(False))
    distinct = rows.agg(F.approx_count_distinct("digest")).first()[0]
    buckets = parts(distinct, BUCKET_KEYS)
    index = build_index(rows.where(historical), buckets)
    fresh = bucketed(counted(rows.where(~historical)), buckets)
    found = fresh.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(look_up, GROUPS)
    return materialise(found, "digest-groups")


def digest_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return materialise(texts(docs, doc_id, text).select("doc_id", digest(F.col("text")).alias("digest")), "digests")


def earlier_half(rows: DataFrame) -> Column:
    """The rows up to the middle doc_id: the part of a table that came first."""
    middle = rows.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    return F.col("doc_id") <= F.lit(middle).cast("long")


def with_groups(rows: DataFrame, groups: DataFrame, key: Column, total: int) -> DataFrame:
    """Join rows to their groups by the digest in ``key``.

    Groups with a thousandth of all rows, a thousand at most, are broadcast; their rows stay where they
    are. All other rows meet their group by a shuffle that no group can dominate.
    """
    least = max(2, -(-total // HOT_GROUPS))
    rows = rows.withColumn("join_digest", key)
    renamed = groups.withColumnRenamed("digest", "join_digest")
    hot = renamed.where(F.col("group_size") >= least)
    met = rows.join(F.broadcast(hot), "join_digest", "left")
    rest = met.where(F.col("group_size").isNull()).drop("keep_id", "group_size")
    cold = rest.join(renamed.where(F.col("group_size") < least), "join_digest")
    return met.where(F.col("group_size").isNotNull()).unionByName(cold)


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest: one row per row of ``docs``.

    Texts are equal when identical after each run of blanks is replaced by one space; a null text is
    the empty one. The smallest doc_id of a group stays; rows that repeat that id stay as well, rows
    with a null id only where the whole group has none. Other columns are not looked at. An empty
    table gives no rows.
    """
    rows = digest_rows(docs, doc_id, text)
    groups = find_groups(rows, earlier_half(rows))
    found = with_groups(rows, groups, F.col("digest"), rows.count())
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def drop_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were.

    Rows that repeat both the id and the text of the winner count as one.
    """
    rows = digest_rows(docs, doc_id, text)
    groups = find_groups(rows, earlier_half(rows))
    wrapped = docs.select(
        F.struct(*[named(c) for c in docs.columns]).alias("row"),
        named(doc_id).cast("long").alias("doc_id"),
        digest(F.coalesce(named(text), F.lit(""))).alias("digest"),
    )
    # Only groups of several rows have something to drop; single texts are kept as they pass.
    several = groups.where(F.col("group_size") > 1)
    lost = with_groups(rows, several, F.col("digest"), rows.count()).where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id", "digest").distinct()
    same = (F.col("wrapped.doc_id").eqNullSafe(F.col("lost.doc_id"))) & (F.col("wrapped.digest") == F.col("lost.digest"))
    kept = wrapped.alias("wrapped").join(lost.alias("lost"), same, "left_anti")
    repeated = materialise(rows.groupBy("digest", "doc_id").count().where("count > 1").select("digest", "doc_id"), "repeated")
    if not repeated.isEmpty():
        again = F.col("kept.doc_id").eqNullSafe(F.col("repeated.doc_id")) & (F.col("kept.digest") == F.col("repeated.digest"))
        single = kept.alias("kept").join(repeated.alias("repeated"), again, "left_anti")
        tied = kept.alias("kept").join(repeated.alias("repeated"), again, "left_semi")
        kept = single.unionByName(tied.groupBy("digest", "doc_id").agg(F.first("row").alias("row")).select("row", "doc_id", "digest"))
    return kept.select("row.*")


SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""


@query("op10_exact_dedup", SQL)
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
