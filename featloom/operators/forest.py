"""A fitted forest as arrays, evaluated per batch with one column replaced at a time."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featloom.session import work_dir


@dataclass(frozen=True)
class TreeArrays:
    """Nodes of a tree: feature (-1 for a leaf), threshold, children, and what a leaf says (class shares or a value)."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def says(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while (open_ := np.flatnonzero(self.feature[at] >= 0)).size:
            own = at[open_]
            low = x[open_, self.feature[own]] <= self.threshold[own]
            at[open_] = np.where(low, self.left[own], self.right[own])
        return self.value[at]


@dataclass(frozen=True)
class ForestArrays:
    trees: tuple[TreeArrays, ...]
    classes: int

    @classmethod
    def of(cls, spark: SparkSession, model) -> ForestArrays:
        """From a fitted forest of continuous features, by way of its stored nodes."""
        path = f"{work_dir(spark)}/featloom/forest-{uuid.uuid4().hex}"
        model.write().save(path)
        return cls.stored(spark.read.parquet(f"{path}/data"), getattr(model, "numClasses", 0))

    @classmethod
    def stored(cls, nodes: DataFrame, classes: int) -> ForestArrays:
        """From the nodes of stored forests, told apart by their ``treeID``."""
        by_tree: dict[int, list] = {}
        for row in _nodes(nodes).collect():
            by_tree.setdefault(row["tree"], []).append(row)
        return cls(tuple(_tree(sorted(by_tree[t], key=lambda r: r["id"]), classes) for t in sorted(by_tree)), classes)

    def with_thresholds(self, edges: Sequence[np.ndarray]) -> ForestArrays:
        """A forest over bin numbers as one over values: what is in bin k or below is at most ``edges[feature][k]``."""

        def of_values(tree: TreeArrays) -> TreeArrays:
            found = [0.0 if f < 0 else edges[f][int(t)] for f, t in zip(tree.feature.tolist(), tree.threshold.tolist())]
            return replace(tree, threshold=np.array(found, float))

        return replace(self, trees=tuple(map(of_values, self.trees)))

    def votes(self, x: np.ndarray) -> np.ndarray:
        return sum((t.says(x) for t in self.trees), np.zeros((len(x), max(self.classes, 1))))

    def predicted(self, votes: np.ndarray) -> np.ndarray:
        return votes.argmax(axis=1).astype(float) if self.classes else votes[:, 0] / len(self.trees)

    def replaced(self, x: np.ndarray, other: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(0, prediction) of the rows as they are, then (j + 1, prediction) with column j taken from ``other``.

        Only the trees that look at column j are evaluated anew, and only one column is replaced at a time.
        """
        said = [t.says(x) for t in self.trees]
        votes = sum(said, np.zeros((len(x), max(self.classes, 1))))
        yield 0, self.predicted(votes)
        uses = [set(t.feature.tolist()) for t in self.trees]
        changed = x.copy()
        for j in range(x.shape[1]):
            changed[:, j] = other[:, j]
            moved = votes.copy()
            for tree, own, old in zip(self.trees, uses, said):
                if j in own:
                    moved += tree.says(changed) - old
            yield j + 1, self.predicted(moved)
            changed[:, j] = x[:, j]


def _nodes(stored: DataFrame) -> DataFrame:
    node = F.col("nodeData")
    return stored.select(
        F.col("treeID").alias("tree"),
        node["id"].alias("id"),
        node["prediction"].alias("prediction"),
        node["impurityStats"].alias("stats"),
        node["leftChild"].alias("left"),
        node["rightChild"].alias("right"),
        node["split"]["featureIndex"].alias("feature"),
        F.get(node["split"]["leftCategoriesOrThreshold"], 0).alias("threshold"),
    )


def _tree(rows: list, classes: int) -> TreeArrays:
    leaf = np.array([r["left"] < 0 for r in rows])
    if classes:
        stats = np.array([list(r["stats"])[:classes] for r in rows], dtype=float)
        value = stats / np.maximum(stats.sum(axis=1, keepdims=True), 1e-300)
    else:
        value = np.array([[r["prediction"]] for r in rows], dtype=float)
    return TreeArrays(
        np.where(leaf, -1, [r["feature"] for r in rows]),
        np.array([0.0 if r["threshold"] is None else r["threshold"] for r in rows]),
        np.array([r["left"] for r in rows]),
        np.array([r["right"] for r in rows]),
        value,
    )
