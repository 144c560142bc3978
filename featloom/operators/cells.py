"""A tree of cells over the rows of a table, and the cells that a ball around a row touches.

Cells are split at quantiles along their widest side until they hold a bounded number of rows. A
level of the tree splits every cell that is too large into up to ``FAN`` cells, by a tree of splits built
from a bounded sample of the cell's rows; so the depth follows the table. The first level's splits and
boxes travel with the job. Those of later levels are rows that meet chunks of their cell's rows, so that
neither the tree nor a cell is ever whole in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from featloom.session import materialise

# Rows of a cell, cells that a cell is split into at most, rows of the sample that places the splits.
CELL_ROWS = 4096
FAN_BITS = 10
FAN = 1 << FAN_BITS
SAMPLE = 1 << 16
# Rows that meet the splits or boxes of a deeper cell together.
CHUNK_ROWS = 1 << 17
ROOT = 1


def split_points(points: np.ndarray, leaves: int) -> np.ndarray:
    """Splits as rows (dimension, value, left, right): up to goes left; a negative child -1 - i is the i-th cell."""
    splits: list[list[float]] = []
    made = 0

    def grow(at: np.ndarray, wanted: int) -> int:
        nonlocal made
        part = points[at]
        spread = part.max(axis=0) - part.min(axis=0) if len(at) else np.zeros(points.shape[1])
        if wanted < 2 or len(at) < 2 or not spread.max() > 0:
            made += 1
            return -made
        dim = int(spread.argmax())
        values = np.sort(part[:, dim])
        value = values[max(0, len(values) * (wanted // 2) // wanted - 1)]
        if value == values[-1]:
            value = values[np.searchsorted(values, value) - 1]
        here = len(splits)
        splits.append([dim, value, 0, 0])
        low = part[:, dim] <= value
        splits[here][2] = grow(at[low], wanted // 2)
        splits[here][3] = grow(at[~low], wanted - wanted // 2)
        return here

    grow(np.arange(len(points)), min(leaves, FAN))
    return np.array(splits, dtype=float).reshape(-1, 4)


def placed(points: np.ndarray, splits: np.ndarray) -> np.ndarray:
    """Number of the cell of every point."""
    node = np.zeros(len(points), np.int64) if len(splits) else np.full(len(points), -1)
    while (open_ := np.flatnonzero(node >= 0)).size:
        own = splits[node[open_]]
        low = points[open_, own[:, 0].astype(int)] <= own[:, 1]
        node[open_] = np.where(low, own[:, 2], own[:, 3]).astype(np.int64)
    return -1 - node


def matrix(table: pa.Table | pa.RecordBatch, xs: Sequence[str]) -> np.ndarray:
    if not xs:
        return np.zeros((table.num_rows, 0))
    return np.column_stack([table[x].to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table[x].to_numpy() for x in xs])


@dataclass(frozen=True)
class Cells:
    """Rows with their cell, and per level the boxes of the cells: (parent, cell, leaf, low, high, rows)."""

    rows: DataFrame
    boxes: DataFrame
    xs: tuple[str, ...]
    depth: int


def level_of(cell: Column) -> Column:
    """Depth of a cell: its number has ``FAN_BITS`` bits a level behind the root's one."""
    return F.floor(F.log2(cell.cast("double")) / FAN_BITS).cast("int")


def in_chunks(rows: DataFrame, sizes: DataFrame, key: str, row: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the (cell, chunks) table with the chunk they fall into, and (cell, chunk) of all chunks."""
    known = sizes.select(F.col("cell").alias(key), "chunks")
    left = rows.join(known, key).withColumn("chunk", F.pmod(F.xxhash64(F.lit(3), F.col(row)), F.col("chunks")).cast("int")).drop("chunks")
    return left, known.select(key, F.explode(F.sequence(F.lit(0), F.col("chunks").cast("int") - 1)).alias("chunk"))


def grow(train: DataFrame, xs: Sequence[str], row: str, cell_rows: int | None = None) -> Cells:
    """Cells of about ``cell_rows`` rows; rows that are equal in all ``xs`` stay together."""
    cell_rows = cell_rows or CELL_ROWS
    xs = tuple(xs)
    rows = materialise(train.withColumn("cell", F.lit(ROOT).cast("long")), "cells")
    schema = rows.schema
    depth = 0
    while True:
        apart = [F.max(x) > F.min(x) for x in xs]
        sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.greatest(*apart, F.lit(False)).alias("apart"))
        large = materialise(sizes.where((F.col("n") > 2 * cell_rows) & F.col("apart")).select("cell", "n"), "large-cells")
        if large.isEmpty():
            break
        share = F.lit(float(SAMPLE)) / F.col("n")
        draw = F.pmod(F.xxhash64(F.lit(17 + depth), F.col(row)), F.lit(1 << 30)) / float(1 << 30)
        sampled = rows.join(large, "cell").where(draw < share).select("cell", "n", *xs)

        def split(table: pa.Table) -> pa.Table:
            leaves = -(-table["n"][0].as_py() // cell_rows)
            splits = split_points(matrix(table, xs), leaves)
            return pa.table({"cell": table["cell"][:1], "payload": pa.array([splits.tobytes()], pa.binary())})

        trees = materialise(sampled.groupBy("cell").applyInArrow(split, "cell long, payload binary"), "splits")

        def renumbered(table, payload: bytes):
            number = placed(matrix(table, xs), np.frombuffer(payload).reshape(-1, 4))
            at = table.schema.get_field_index("cell")
            own = table.column("cell").to_numpy() if isinstance(table, pa.Table) else table.column("cell").to_numpy(zero_copy_only=False)
            return table.set_column(at, "cell", pa.array((own << FAN_BITS) | number))

        if depth == 0:
            payload = trees.first()["payload"]

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    if batch.num_rows:
                        yield renumbered(batch, payload)

            rows = materialise(rows.mapInArrow(run, schema), "cells")
        else:
            counted = large.select("cell", F.ceil(F.col("n") / CHUNK_ROWS).alias("chunks"))
            left, chunks = in_chunks(rows, counted, "cell", row)
            right = trees.join(chunks, "cell").select(F.col("cell").alias("of"), F.col("chunk").alias("of_chunk"), "payload")
            names = [f.name for f in schema]

            def meet(table: pa.Table, tree: pa.Table) -> pa.Table:
                if not table.num_rows or not tree.num_rows:
                    return to_arrow_schema(schema).empty_table()
                return renumbered(table.select(names), tree["payload"][0].as_py())

            moved = left.groupBy("cell", "chunk").cogroup(right.groupBy("of", "of_chunk")).applyInArrow(meet, schema)
            rows = materialise(moved.unionByName(rows.join(large.select("cell"), "cell", "left_anti").select(*names)), "cells")
        depth += 1
    bounds = [F.struct(*[f(x).alias(x) for x in xs]).alias(name) for name, f in (("low", F.min), ("high", F.max))]
    leaves = materialise(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *bounds), "leaf-boxes")
    levels = []
    for level in range(1, depth + 1):
        up = F.greatest(level_of(F.col("cell")) - level, F.lit(0)) * FAN_BITS
        inside = leaves.where(level_of(F.col("cell")) >= level).withColumn("at", F.call_function("shiftright", "cell", up))
        corners = [F.array(*[f(F.col(f"{side}.{x}")) for x in xs]).alias(side) for side, f in (("low", F.min), ("high", F.max))]
        own = inside.groupBy("at").agg(*corners, F.max(F.col("cell") == F.col("at")).alias("leaf"), F.sum("n").alias("n"))
        levels.append(own.select(F.lit(level).alias("level"), F.call_function("shiftright", "at", F.lit(FAN_BITS)).alias("parent"), F.col("at").alias("cell"), "leaf", "low", "high", "n"))
    if not levels:
        corners = [F.array(*[F.col(f"{side}.{x}") for x in xs]).alias(side) for side in ("low", "high")]
        levels = [leaves.select(F.lit(1).alias("level"), F.lit(0).cast("long").alias("parent"), "cell", F.lit(True).alias("leaf"), *corners, "n")]
    boxes = levels[0]
    for own in levels[1:]:
        boxes = boxes.unionByName(own)
    return Cells(rows, materialise(boxes, "boxes"), xs, max(depth, 1))


def gaps(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Distance of every point to every box, added up a dimension at a time."""
    found = np.zeros((len(points), len(low)))
    for i in range(points.shape[1]):
        away = np.maximum(low[None, :, i] - points[:, i, None], points[:, i, None] - high[None, :, i])
        found += np.square(np.maximum(away, 0.0, out=away))
    return np.sqrt(found)


Choice = Callable[[np.ndarray, np.ndarray | None], np.ndarray]


def nearest_box(gap: np.ndarray, bound: np.ndarray | None) -> np.ndarray:
    chosen = np.zeros(gap.shape, bool)
    chosen[np.arange(len(gap)), gap.argmin(axis=1)] = True
    return chosen


def touched(gap: np.ndarray, bound: np.ndarray | None) -> np.ndarray:
    """Boxes that can hold a row within the bound, with room for rounding."""
    return gap <= bound[:, None] * (1.0 + 1e-9) + 1e-12


def visits(query: DataFrame, cells: Cells, row: str, choose: Choice) -> DataFrame:
    """The rows of ``query`` once for every cell that ``choose`` picks, level by level; ``cell`` is added.

    ``touched`` needs a column ``bound``.
    """
    xs, carried = cells.xs, [f.name for f in query.schema]
    schema = query.withColumn("cell", F.lit(ROOT).cast("long")).withColumn("leaf", F.lit(True)).schema
    empty = to_arrow_schema(schema).empty_table()

    def stepped(table, low, high, numbers, leaf):
        points = matrix(table, xs)
        bound = np.asarray(table.column("bound").to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table["bound"].to_numpy()) if "bound" in carried else None
        for at in range(0, len(points), 4096):
            part = slice(at, at + 4096)
            rows, boxes = np.nonzero(choose(gaps(points[part], low, high), None if bound is None else bound[part]))
            taken = table.slice(at, 4096).take(pa.array(rows))
            columns = [taken.column(c) for c in carried]
            yield [*columns, pa.array(numbers[boxes]), pa.array(leaf[boxes])]

    first = cells.boxes.where("level = 1").orderBy("cell").toArrow()
    low, high = (np.array(first[c].to_pylist(), dtype=float).reshape(len(first), -1) for c in ("low", "high"))
    numbers, leaf = first["cell"].to_numpy(), first["leaf"].to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and len(numbers):
                for columns in stepped(batch, low, high, numbers, leaf):
                    yield pa.RecordBatch.from_arrays(columns, schema=empty.schema)

    found = query.mapInArrow(run, schema)
    for level in range(2, cells.depth + 1):
        found = materialise(found, "visits")
        open_ = found.where(~F.col("leaf"))
        sizes = open_.groupBy("cell").count().select("cell", F.ceil(F.col("count") / CHUNK_ROWS).alias("chunks"))
        left, chunks = in_chunks(open_, sizes, "cell", row)
        below = cells.boxes.where(F.col("level") == level).withColumnRenamed("cell", "own").withColumnRenamed("leaf", "is_leaf")
        right = below.join(chunks, F.col("parent") == F.col("cell")).select(F.col("parent").alias("of"), F.col("chunk").alias("of_chunk"), "own", "is_leaf", "low", "high")

        def meet(table: pa.Table, own: pa.Table) -> pa.Table:
            if not table.num_rows or not own.num_rows:
                return empty
            own = own.sort_by("own")
            corners = (np.array(own[c].to_pylist(), dtype=float).reshape(len(own), -1) for c in ("low", "high"))
            parts = [pa.Table.from_arrays(columns, schema=empty.schema) for columns in stepped(table, *corners, own["own"].to_numpy(), own["is_leaf"].to_numpy())]
            return pa.concat_tables([empty, *parts])

        deeper = left.groupBy("cell", "chunk").cogroup(right.groupBy("of", "of_chunk")).applyInArrow(meet, schema)
        found = found.where("leaf").unionByName(deeper)
    return found.drop("leaf")
