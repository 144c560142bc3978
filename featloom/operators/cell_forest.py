"""A random forest of classes, fitted on cells instead of rows.

Features are cut into as many bins as Spark's forest takes, and the rows of equal bins and label become one row. A tree's
bootstrap weights each row by a Poisson draw of mean 1; the draws of a cell's n rows add up to one draw of mean n, which
is the weight of the cell in that tree. So the trees read as many rows as there are cells, however many rows were counted.
"""

from __future__ import annotations

import math
import random
import uuid
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featloom.dataset import Dataset, as_double, quoted
from featloom.operators.batches import batch_matrix
from featloom.operators.fitted import few_values
from featloom.operators.forest import ForestArrays
from featloom.operators.quantiles import exact_quantiles
from featloom.session import materialise, run_parallel, work_dir

# Rows from which cells pay, and the most cells.
ROWS_FROM = 250_000
MOST_CELLS = 1 << 17
# Trees that are fitted at a time.
WIDTH = 8


def forest_of_cells(ds: Dataset, estimator, rows_from: int | None = None) -> ForestArrays | None:
    """The classifier's forest from the cells of the table; None where rows are few or cells are not bounded.

    Missing features and labels are errors, as they are for the classifier.
    """
    kept = ds.df.select(as_double(quoted(ds.label)).alias("y"), *[ds.value(n).alias(f"v{i}") for i, n in enumerate(ds.names)])
    names = [f"v{i}" for i in range(len(ds.names))]
    if not names or estimator.getMinInstancesPerNode() != 1 or kept.count() < (ROWS_FROM if rows_from is None else rows_from):
        return None
    kept = kept.persist(StorageLevel.DISK_ONLY)
    try:
        top, missing = kept.agg(F.max("y"), F.max(F.greatest(*[F.col(c).isNull().cast("int") for c in ["y", *names]]))).first()
        if missing:
            raise ValueError("rows with a missing label or feature cannot be fitted")
        edges = bin_edges(Dataset.of(kept, names), estimator.getMaxBins())
        classes = int(top) + 1
        if math.prod(len(e) + 1 for e in edges) * classes > MOST_CELLS or not all(np.isfinite(e).all() for e in edges):
            return None
        cells = weighted_cells(kept, edges, estimator.getNumTrees(), estimator.getSeed())
    finally:
        kept.unpersist()
    return _fitted(cells, estimator, edges, classes)


def bin_edges(ds: Dataset, bins: int) -> list[np.ndarray]:
    """Upper bounds of the bins below the last: all values but the largest where they are few, else quantiles."""
    few = few_values(ds, bins)
    many = [n for n, v in zip(ds.names, few) if v is None]
    marks = exact_quantiles(ds.keep(many), np.arange(1, bins) / bins) if many else {}
    return [np.unique(marks[n]) if v is None else np.array(v[:-1], float) for n, v in zip(ds.names, few)]


def weighted_cells(rows: DataFrame, edges: Sequence[np.ndarray], trees: int, seed: int) -> DataFrame:
    """Columns y, x (vector of bin numbers) and w0, w1, ... (the cell's weight in each tree), stored.

    A cell's draws follow from the seed and the cell alone.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch_matrix(batch, 1, len(edges))
            own = [pa.array(np.searchsorted(e, x[:, i], "left").astype(np.int32)) for i, e in enumerate(edges)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *own], names=["y", *bins])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.column_stack([batch.column(i).to_numpy() for i in range(1 + len(edges))]).astype(np.int64)
            sizes = batch.column("n").to_numpy()
            drawn = np.array([np.random.default_rng([seed % 2**32, *cell]).poisson(n, trees) for cell, n in zip(own.tolist(), sizes.tolist())])
            x = pa.ListArray.from_arrays(pa.array(np.arange(0, own[:, 1:].size + 1, len(edges), dtype=np.int32)), pa.array(own[:, 1:].ravel().astype(float)))
            yield pa.RecordBatch.from_arrays([batch.column(0), x, *[pa.array(drawn[:, t]) for t in range(trees)]], names=["y", "x", *weights])

    bins, weights = [f"b{i}" for i in range(len(edges))], [f"w{t}" for t in range(trees)]
    binned = rows.mapInArrow(cut, ", ".join(["y double", *[f"{b} int" for b in bins]]))
    counted = binned.groupBy("y", *bins).agg(F.count(F.lit(1)).alias("n"))
    drawn = counted.mapInArrow(draw, ", ".join(["y double", "x array<double>", *[f"{w} long" for w in weights]]))
    return materialise(drawn.withColumn("x", array_to_vector("x")), "forest-cells")


def _fitted(cells: DataFrame, estimator, edges: Sequence[np.ndarray], classes: int) -> ForestArrays:
    """A forest of one tree per weight, its thresholds read as values of the features."""
    spark, trees = cells.sparkSession, estimator.getNumTrees()
    folder = f"{work_dir(spark)}/featloom/forest-{uuid.uuid4().hex}"
    label = {"ml_attr": {"type": "nominal", "name": "y", "num_vals": classes}}
    # What the classifier's "auto" stands for.
    features = "sqrt" if trees > 1 else "all"
    seeds = random.Random(estimator.getSeed()).sample(range(1 << 31), trees)

    def grow(tree: int) -> None:
        own = {"numTrees": 1, "bootstrap": False, "featureSubsetStrategy": features, "seed": seeds[tree], "weightCol": "weight"}
        one = estimator.copy({estimator.getParam(name): value for name, value in own.items()})
        weighted = cells.select(F.col("y").alias("y", metadata=label), "x", F.col(f"w{tree}").cast("double").alias("weight"))
        one.fit(weighted.filter("weight > 0")).write().save(f"{folder}/{tree:06d}")

    run_parallel(spark, [partial(grow, t) for t in range(trees)], WIDTH)
    stored = spark.read.parquet(f"{folder}/*/data")
    numbered = stored.withColumn("treeID", F.regexp_extract("_metadata.file_path", r"/(\d+)/data/", 1).cast("int"))
    return ForestArrays.stored(numbered, classes).with_thresholds(edges)
