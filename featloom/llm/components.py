"""Connected components of a large graph by contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featloom.session import materialise

# Keys with a thousandth of the rows are hot; there are a thousand at most, and a table is asked for them from so many rows on.
HOT_SHARE = 1000
ASKED_FROM = 100_000


def keyed_join(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Rows with the other columns of ``table``, which holds every key once; rows without a partner go.

    Rows of hot keys stay where they are, as the table's rows for those are broadcast.
    """
    total = rows.count()
    if total < ASKED_FROM:
        return rows.join(table, key)
    often = rows.groupBy(key).count().where(F.col("count") >= -(-total // HOT_SHARE)).select(key)
    hot = table.join(F.broadcast(often), key, "left_semi").withColumn("is_hot", F.lit(True))
    met = rows.join(F.broadcast(hot), key, "left")
    rest = met.where("is_hot IS NULL").select(*rows.columns).join(table, key)
    return met.where("is_hot").drop("is_hot").unionByName(rest)


def rank(node: str, turn: int) -> Column:
    """An order of the nodes, a new one every second round; the hash maps different nodes to different numbers.

    Two rounds in the same order close a star, of which a first round leaves what came before the hub.
    """
    return F.xxhash64(node, F.lit(turn // 2))


def roots(edges: DataFrame) -> tuple[DataFrame | None, int]:
    """(node, root) of every node of the undirected edges (a, b), and the rounds it took.

    A round orders the nodes by a hash, gives each node the first of itself and its neighbours as parent,
    follows the parents once more, and replaces every edge by one between parents. In a random order a
    chain keeps some two fifths of its nodes, however its ids run, so the rounds grow with the logarithm
    of the nodes. Only least neighbours are gathered, by partial minima; no
    neighbour list is ever built. Rounds, and the levels on the way back, are written to the shared folder.
    """
    left = materialise(distinct_edges(edges.where("a <> b")), "edges")
    if left.isEmpty():
        return None, 0
    steps = []
    while True:
        turn = len(steps)
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min_by("b", rank("b", turn)).alias("least"))
        first = F.when(rank("least", turn) < rank("node", turn), F.col("least")).otherwise(F.col("node"))
        parent = materialise(least.select("node", first.alias("parent")), "parents")
        above = parent.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        step = materialise(keyed_join(parent, above, "parent").select("node", F.col("grand").alias("parent")), "parents")
        steps.append(step)
        to_a = step.select(F.col("node").alias("a"), F.col("parent").alias("new_a"))
        to_b = step.select(F.col("node").alias("b"), F.col("parent").alias("new_b"))
        half = keyed_join(left, to_a, "a").select(F.col("new_a").alias("a"), "b").where("a <> b")
        if turn:
            half = half.distinct()
        moved = keyed_join(materialise(half, "edges"), to_b, "b").select("a", F.col("new_b").alias("b"))
        left = materialise(distinct_edges(moved.where("a <> b")), "edges")
        if left.isEmpty():
            break
    rounds = len(steps)
    found = steps.pop()
    while steps:
        top = found.select(F.col("node").alias("parent"), F.col("parent").alias("top"))
        step = steps.pop()
        # A parent that is no node of the next graph has lost all its edges: it is a root.
        ends = step.select("parent").distinct().join(top, "parent", "left").select("parent", F.coalesce("top", "parent").alias("top"))
        found = materialise(keyed_join(step, ends, "parent").select("node", F.col("top").alias("parent")), "parents")
    return found.select("node", F.col("parent").alias("root")), rounds


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the undirected edges (a, b); a component is its smallest node."""
    found, _ = roots(edges)
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component")).where("false")
    smallest = found.groupBy("root").agg(F.min("node").alias("component"))
    return materialise(keyed_join(found, smallest, "root").select("node", "component"), "components")


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
