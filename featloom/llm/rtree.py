"""Hard negatives by best-first search of STR-packed R-trees.

The rows are sorted into tiles: slabs of about equal size along one coordinate, each cut along the next.
Inside a tile the same goes on over the coordinates that spread most, down to leaves, whose minimum
bounding boxes are packed into the boxes of the levels above. A tile's tree is one stored row.

A box bounds the inner product with an anchor: per coordinate the anchor's value meets the lower or the
upper side, and the sums give an interval. Every anchor has a queue of boxes, the highest upper bound
first. It takes some boxes at a time, opens inner ones and scores the rows of leaves; boxes that lie
outside the score window are dropped, and so are those strictly below the k-th score found so far, as a tie
may still win by its id. The queues of all anchors of a block advance together, so that boxes and rows
are met by matrix products.

Positives are the first rows of the anchor's label; each sets a window of scores in which the negatives are
searched. Every tile gives its first rows per question, and the first of all tiles are the answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featloom.llm import chunks as C
from featloom.llm.base import load, named, parts, query
from featloom.llm.components import keyed_join
from featloom.session import materialise

SCALE = 256
LABELS = 10
POSITIVES = 5
NEGATIVES = 10
# Percent of the positive's score between which a negative's lies.
WINDOW = (30, 90)
# Rows of a tile, of a leaf, and boxes under a box.
TILE = 8192
LEAF = 64
FAN = 16
# Anchors that ask a tile together, and questions whose queues advance together.
ANCHORS = 8192
ASKED = 2048
# Sums of products up to this are exact as doubles.
EXACT = 2.0**53
# Below every score, and with a negative of its own.
NEVER = -np.iinfo(np.int64).max
FIRST = "anchor_id long, question long, row_id long, score long"
FIRST_KINDS = pa.schema([(name, pa.int64()) for name in ("anchor_id", "question", "row_id", "score")])


def points(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, vector of whole numbers) of the rows that take part, one per id.

    Rows without an id, label or vector, and rows with a component that is null or not finite, take no part.
    Of several rows with one id the one with the smallest label, then vector, does.
    """
    component = named(vector)
    finite = F.forall(component, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    told = named(vec_id).isNotNull() & named(label).isNotNull() & component.isNotNull()
    whole = F.transform(component, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    given = rows.where(told & finite).select(named(vec_id).cast("long").alias("vec_id"), named(label).cast("int").alias("label"), whole.alias("vector"))
    least = given.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("first"))
    return least.select("vec_id", "first.label", "first.vector")


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros, which leave every inner product as it is."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    found = np.zeros((len(column), width), np.int64)
    found[np.repeat(np.arange(len(column)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy()
    return found


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows, exact."""
    most = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * left.shape[1]
    if most < EXACT:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    if most < 2.0**63:
        return left @ right.T
    raise OverflowError("inner products beyond 64 bits")


def packed_order(vectors: np.ndarray) -> np.ndarray:
    """Rows in the order of their leaves: slabs along the coordinates that spread most, each cut along the next."""
    wide = np.argsort(-vectors.std(axis=0), kind="stable") if len(vectors) else np.zeros(0, int)
    order = np.arange(len(vectors))

    def cut(at: np.ndarray, depth: int) -> Iterator[np.ndarray]:
        leaves = parts(len(at), LEAF)
        if leaves == 1 or depth == len(wide):
            yield at
            return
        left = max(1, int(np.ceil(np.log2(leaves) / 2)))
        slabs = max(2, round(leaves ** (1 / min(left, len(wide) - depth))))
        at = at[np.argsort(vectors[at, wide[depth]], kind="stable")]
        size = parts(leaves, slabs) * LEAF
        for first in range(0, len(at), size):
            yield from cut(at[first : first + size], depth + 1)

    return np.concatenate(list(cut(order, 0))) if len(order) else order


@dataclass
class Tree:
    """Rows in leaf order and, per level from the leaves up, the boxes of every FAN boxes below."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    lows: list[np.ndarray]
    highs: list[np.ndarray]

    @classmethod
    def packed(cls, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> Tree:
        order = packed_order(vectors)
        return cls.over(ids[order], labels[order], vectors[order])

    @classmethod
    def over(cls, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> Tree:
        """The boxes above rows that are in leaf order."""
        lows, highs, size = [], [], LEAF
        low = high = vectors
        while len(low) > 1 or not lows:
            edges = np.arange(0, len(low), size)
            low, high, size = np.minimum.reduceat(low, edges, axis=0), np.maximum.reduceat(high, edges, axis=0), FAN
            lows.append(low)
            highs.append(high)
        return cls(ids, labels, vectors, lows, highs)

    def stored(self) -> bytes:
        shape = np.array(self.vectors.shape, "<i8")
        return C.joined([C.packed(part) for part in (shape, self.ids.astype("<i8"), self.labels.astype("<i8"), self.vectors.astype("<i8").ravel())])

    @classmethod
    def read(cls, raw: bytes) -> Tree:
        shape, ids, labels, vectors = (C.unpacked(part, "<i8") for part in C.parted(raw))
        return cls.over(ids, labels, vectors.reshape(shape))

    def intervals(self, vectors: np.ndarray, level: int, boxes: slice | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of each vector with any point of each box."""
        above, below = np.maximum(vectors, 0), np.minimum(vectors, 0)
        low, high = self.lows[level][boxes], self.highs[level][boxes]
        return products(above, low) + products(below, high), products(above, high) + products(below, low)


@dataclass
class Questions:
    """For each question the anchor's vector, id and label, the window of scores and its number."""

    vectors: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    lows: np.ndarray
    highs: np.ndarray
    numbers: np.ndarray

    def part(self, at: slice) -> Questions:
        return Questions(*(getattr(self, name)[at] for name in ("vectors", "ids", "labels", "lows", "highs", "numbers")))


class Best:
    """The first ``k`` (score, id) of every question."""

    def __init__(self, count: int, k: int):
        self.score = np.full((count, k), NEVER)
        self.id = np.full((count, k), np.iinfo(np.int64).max)

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Rows of scores for the questions ``at``, NEVER where a row is no answer."""
        k = self.score.shape[1]
        # Only a row that is not below the k-th can enter.
        beats = score >= np.maximum(self.score[at, -1], NEVER + 1)[:, None]
        some = np.flatnonzero(beats.any(axis=1))
        if not len(some):
            return
        at = at[some]
        both = np.concatenate([self.score[at], np.where(beats[some], score[some], NEVER)], axis=1)
        whose = np.concatenate([self.id[at], np.broadcast_to(ids, (len(at), len(ids)))], axis=1)
        order = np.lexsort((whose, -both), axis=1)[:, :k]
        self.score[at] = np.take_along_axis(both, order, axis=1)
        self.id[at] = np.take_along_axis(whose, order, axis=1)


def search(tree: Tree, asked: Questions, k: int, same_label: bool) -> Best:
    """The first ``k`` rows of every question: of the anchor's label or of another, inside the window, not the anchor."""
    best = Best(len(asked.ids), k)
    if not len(asked.ids):
        return best
    top = len(tree.lows) - 1
    least, most = tree.intervals(asked.vectors, top, slice(None))
    # The queue: level, box, bound, and the question that each entry belongs to.
    question, box = np.nonzero((most >= asked.lows[:, None]) & (least <= asked.highs[:, None]))
    bound, level = most[question, box], np.full(len(box), top)
    takes = 1
    while len(question):
        kth = best.score[:, -1]
        alive = bound >= kth[question]
        question, box, bound, level = question[alive], box[alive], bound[alive], level[alive]
        # Every question takes its first entries; the rest of the queue waits.
        order = np.lexsort((-bound, question))
        question, box, bound, level = question[order], box[order], bound[order], level[order]
        heads = np.flatnonzero(np.diff(question, prepend=-1))
        place = np.arange(len(question)) - np.repeat(heads, np.diff(heads, append=len(question)))
        taken = place < takes
        takes = min(2 * takes, 64)
        waiting = [(question[~taken], box[~taken], bound[~taken], level[~taken])]
        question, box, level = question[taken], box[taken], level[taken]
        order = np.lexsort((box, level))
        question, box, level = question[order], box[order], level[order]
        edges = np.flatnonzero(np.concatenate([[True], (np.diff(box) != 0) | (np.diff(level) != 0)])) if len(box) else np.zeros(0, int)
        for first, last in zip(edges.tolist(), [*edges[1:].tolist(), len(box)]):
            own, at, depth = question[first:last], int(box[first]), int(level[first])
            vectors = asked.vectors[own]
            if depth:
                below = slice(at * FAN, min((at + 1) * FAN, len(tree.lows[depth - 1])))
                least, most = tree.intervals(vectors, depth - 1, below)
                q, b = np.nonzero((most >= asked.lows[own][:, None]) & (least <= asked.highs[own][:, None]) & (most >= best.score[own, -1][:, None]))
                waiting.append((own[q], b + below.start, most[q, b], np.full(len(q), depth - 1)))
                continue
            rows = slice(at * LEAF, (at + 1) * LEAF)
            score = products(vectors, tree.vectors[rows])
            fits = (tree.labels[rows] == asked.labels[own][:, None]) == same_label
            fits &= (score >= asked.lows[own][:, None]) & (score <= asked.highs[own][:, None]) & (tree.ids[rows] != asked.ids[own][:, None])
            best.add(own, np.where(fits, score, NEVER), tree.ids[rows])
        question, box, bound, level = (np.concatenate([w[i] for w in waiting]) for i in range(4))
    return best


def tiles(rows: DataFrame, width: int, size: int = TILE) -> DataFrame:
    """(tile, payload): the stored tree of every tile of (vec_id, label, vector) rows.

    Edges of slabs and tiles are quantiles, a few numbers each on the driver; what lies on one coordinate
    in greater numbers than a tile holds is dealt by a hash of its ids.
    """
    total = rows.count()
    side = max(1, round(np.sqrt(parts(total, size))))
    shares = F.array(*[F.lit(i / side) for i in range(1, side)]) if side > 1 else None
    keyed = rows.withColumn("x", F.coalesce(F.get("vector", 0), F.lit(0))).withColumn("y", F.coalesce(F.get("vector", 1), F.lit(0)))

    def place(value: Column, edges: Column) -> Column:
        return F.size(F.filter(edges, lambda edge: edge < value)).cast("long")

    if side > 1:
        shares = F.array(*[F.lit(i / side) for i in range(1, side)])
        x_edges = keyed.agg(F.percentile_approx("x", shares)).first()[0]
        keyed = materialise(keyed.withColumn("slab", place(F.col("x"), F.array(*map(F.lit, x_edges)))), "slabs")
        y_edges = keyed.groupBy("slab").agg(F.percentile_approx("y", shares).alias("edges"))
        keyed = keyed_join(keyed, y_edges, "slab").withColumn("place", F.col("slab") * side + place(F.col("y"), F.col("edges")))
    else:
        keyed = keyed.withColumn("place", F.lit(0).cast("long"))
    placed = materialise(keyed.select("place", "vec_id", "label", "vector"), "placed")
    counts = placed.groupBy("place").count().select("place", F.ceil(F.col("count") / size).alias("shares"))
    spread = keyed_join(placed, counts, "place").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("shares")))

    def build(table: pa.Table) -> pa.Table:
        ids = table["vec_id"].to_numpy().astype(np.int64)
        labels = table["label"].to_numpy().astype(np.int64)
        tree = Tree.packed(ids, labels, matrix(table["vector"], width))
        return pa.table({"payload": pa.array([tree.stored()], pa.binary())})

    built = materialise(spread.groupBy("place", "part").applyInArrow(build, "payload binary"), "trees")
    return built.select(F.xxhash64("payload").alias("tile"), "payload")


def packed_questions(table: pa.Table, width: int) -> bytes:
    """The (anchor_id, label, vector, questions) rows of a block as bytes."""
    asked = table["questions"].combine_chunks()
    sizes = np.diff(asked.offsets.to_numpy())
    fields = [asked.flatten().field(i).to_numpy() for i in range(3)]
    vectors = matrix(table["vector"], width)
    columns = [np.array(vectors.shape), table["anchor_id"].to_numpy(), table["label"].to_numpy(), vectors.ravel(), sizes, *fields]
    return C.joined([C.packed(np.asarray(c).astype("<i8")) for c in columns])


def question_parts(raw: bytes) -> Iterator[Questions]:
    """The questions of a block, some at a time."""
    shape, ids, labels, vectors, sizes, number, low, high = (C.unpacked(part, "<i8") for part in C.parted(raw))
    vectors = vectors.reshape(shape)
    whose = np.repeat(np.arange(len(ids)), sizes)
    for first in range(0, len(whose), ASKED):
        part = slice(first, first + ASKED)
        own = whose[part]
        yield Questions(vectors[own], ids[own], labels[own], low[part], high[part], number[part])


def answers(trees: DataFrame, asked: DataFrame, width: int, k: int, same_label: bool) -> DataFrame:
    """(anchor_id, question, row_id, score): every tile's first ``k`` rows for each question of the (anchor_id, label, vector, questions) rows.

    ``questions`` is an array of (question, low, high). Anchors go to all tiles in packed blocks of bounded
    size; a task holds one block and one tree.
    """
    blocks = parts(asked.count(), ANCHORS)

    def pack(table: pa.Table) -> pa.Table:
        return pa.table({"block": table["block"][:1].cast(pa.int32()), "asked": pa.array([packed_questions(table, width)], pa.binary())})

    dealt = asked.withColumn("block", F.pmod(F.xxhash64("anchor_id"), F.lit(blocks)).cast("int"))
    packed = materialise(dealt.groupBy("block").applyInArrow(pack, "block int, asked binary"), "anchor-blocks")
    keys = trees.select("tile", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def run(questions: pa.Table, tree: pa.Table) -> pa.Table:
        if not questions.num_rows or not tree.num_rows:
            return FIRST_KINDS.empty_table()
        grown = Tree.read(tree["payload"][0].as_py())
        return pa.concat_tables([first_rows(grown, part, k, same_label) for part in question_parts(questions["asked"][0].as_py())] or [FIRST_KINDS.empty_table()])

    sent = packed.join(keys.select(F.col("tile").alias("to_tile"), "block"), "block").groupBy("to_tile", F.col("block").alias("to_block"))
    known = trees.join(keys, "tile").groupBy("tile", "block")
    return materialise(sent.cogroup(known).applyInArrow(run, FIRST), "answers")


def first_rows(tree: Tree, asked: Questions, k: int, same_label: bool) -> pa.Table:
    best = search(tree, asked, k, same_label)
    q, place = np.nonzero(best.score > NEVER)
    columns = [asked.ids[q], asked.numbers[q], best.id[q, place], best.score[q, place]]
    return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=FIRST_KINDS)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of every question with their rank; the tiles gave a bounded number each."""
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("below"), "row_id"))), 1, k)
    grouped = found.groupBy("anchor_id", "question").agg(best.alias("best"))
    opened = grouped.select("anchor_id", "question", F.posexplode("best").alias("place", "own"))
    return opened.select("anchor_id", "question", (F.col("place") + 1).cast("int").alias("rank"), F.col("own.row_id").alias("row_id"), (-F.col("own.below")).alias("score"))


def hard_negatives(
    rows: DataFrame, anchors: Column | None = None, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of every anchor and positive.

    A score is the inner product of two vectors whose components x became floor(256 * x); higher scores
    come first, ties by the smaller id. The positives of an anchor are its first other rows of the same
    label; a positive's negatives are the first rows of another label with a score of ``window`` percent of
    the positive's. ``anchors`` is a condition on (vec_id, label, vector); without one all rows are anchors.

    Rows with a null id, label or vector, or with a component that is null or not finite, take no part; of
    rows that share an id one does, see ``points``. Vectors of different lengths count as ended by zeros,
    an empty one has the score zero with all others. Other columns are not looked at, and an empty table
    gives no rows. Scores beyond 64 bits raise an error.
    """
    taking = materialise(points(rows, vec_id, vector, label), "points")
    width = taking.agg(F.max(F.size("vector"))).first()[0] or 0
    trees = tiles(taking, width)
    chosen = (taking if anchors is None else taking.where(anchors)).withColumnRenamed("vec_id", "anchor_id")
    number = lambda value, name: F.lit(value).cast("long").alias(name)
    whole = F.array(F.struct(number(0, "question"), number(NEVER + 1, "low"), number(np.iinfo(np.int64).max, "high")))
    own = ranked(answers(trees, chosen.withColumn("questions", whole), width, positives, True), positives)
    own = materialise(own.select("anchor_id", F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    low, high = (F.expr(f"{percent} * positive_score") for percent in window)
    low, high = (F.call_function("div", edge, F.lit(100)) for edge in (low + F.pmod(-low, F.lit(100)), high - F.pmod(high, F.lit(100))))
    asked = own.select("anchor_id", F.struct(F.col("positive_id").alias("question"), low.alias("low"), high.alias("high")).alias("asked"))
    grouped = asked.where("asked.low <= asked.high").groupBy("anchor_id").agg(F.collect_list("asked").alias("questions"))
    found = ranked(answers(trees, chosen.join(grouped, "anchor_id"), width, negatives, False), negatives)
    found = found.select("anchor_id", F.col("question").alias("positive_id"), "rank", F.col("row_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(own, ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


SQL = """
WITH given AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM given a JOIN given b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY rank <= 10
"""


@query("op13_str_negatives", SQL)
def op13_str_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = load(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return hard_negatives(given.withColumn("label", moved), F.col("vec_id") % 100 == 0)
