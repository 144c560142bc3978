"""First centres of k-means for many sets of columns together.

The draws are those of Spark's k-means||: the same generator per partition and step, so the centres are the ones that
``KMeans`` starts from. Spark makes six passes or more for every clustering over a copy of its rows; here a pass serves all
clusterings, and as all of them have the same seed, one draw per row and step serves them too. Rows are kept as blocks
of columns, which reach Python whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featloom.operators.batches import batch_matrix
from featloom.operators.gram import gram_matrices, task_slot

# Steps that draw candidates, candidates wanted per step and centre, and moves of the candidates' own k-means.
STEPS = 2
OVERSAMPLED = 2.0
LOCAL_ROUNDS = 30
# Rows of a block, from which it is closed.
BLOCK_ROWS = 1 << 14
# Tasks per core, and bytes of a task, of a pass that may read several partitions in one task.
TASKS_PER_CORE = 4
TASK_BYTES = 64 << 20
_WORD = (1 << 64) - 1


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of the nearest centre of every row, the first of equal ones."""
    return nearest(x, centres)[0]


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same, and the squared distance."""
    columns = np.ascontiguousarray(x.T)
    kind = np.uint8 if len(centres) <= 256 else np.int64
    label, least = np.zeros(len(x), kind), np.full(len(x), np.inf)
    away, part, near, number = np.zeros(len(x)), np.empty(len(x)), np.empty(len(x), bool), np.empty(len(x), kind)
    held = near.view(np.uint8)
    for i, centre in enumerate(centres):
        for j, (column, value) in enumerate(zip(columns, centre)):
            own = part if j else away
            np.subtract(column, value, out=own)
            np.multiply(own, own, out=own)
            if j:
                np.add(away, part, out=away)
        # Numbers go up, so the last centre that was nearer has the largest.
        np.less(away, least, out=near)
        np.multiply(held, kind(i), out=number)
        np.maximum(label, number, out=label)
        np.minimum(least, away, out=least)
    return label.astype(np.int64), least


def packed(rows: DataFrame) -> DataFrame:
    """Rows of doubles without gaps as blocks of columns, in the same partitions and order."""

    def block(kept: list[np.ndarray]) -> pa.RecordBatch:
        x = np.concatenate(kept, axis=1)
        return pa.RecordBatch.from_arrays([pa.array([x.shape[1]], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["n", "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        for batch in batches:
            if batch.num_rows:
                kept.append(batch_matrix(batch, 0, batch.num_columns).T)
                if np.isnan(kept[-1]).any():
                    raise ValueError("a row to be clustered has a missing value")
            if sum(x.shape[1] for x in kept) >= BLOCK_ROWS:
                yield block(kept)
                kept = []
        if kept:
            yield block(kept)

    return rows.mapInArrow(run, "n int, x binary")


def blocks(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """Matrices of a batch of blocks, a row per column."""
    for n, x in zip(batch.column("n").to_pylist(), batch.column("x")):
        yield np.frombuffer(x.as_buffer()).reshape(-1, n)


def fewer_tasks(rows: DataFrame, width: int) -> DataFrame:
    """The blocks in partitions for all cores, where what is made of them does not depend on partitions."""
    count = rows.agg(F.sum("n")).first()[0] or 0
    return rows.coalesce(max(TASKS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism, -(-count * width * 8 // TASK_BYTES)))


def first_centres(rows: DataFrame, wide: DataFrame, plan: Sequence[Sequence[int]], k: int, seed: int) -> list[np.ndarray]:
    """Centres per list of columns. ``rows`` are blocks, kept in partitions that do not change; ``wide`` in any others."""
    seed = Draws(seed).next_int()
    row = _sampled(rows, seed)
    found = [row[None, list(at)] for at in plan]
    for step in range(STEPS):
        costs = gram_matrices(wide, partial(_costs, plan, found))
        shares = [OVERSAMPLED * k, *(float(costs[(i, 0)][0, 0]) for i in range(len(plan)))]
        drawn = _drawn(rows, plan, found, shares, seed ^ (step << 16))
        found = [np.concatenate([own, drawn[i]]) for i, own in enumerate(found)]
    found = [own[np.sort(np.unique(own, axis=0, return_index=True)[1])] for own in found]
    many = {i: own for i, own in enumerate(found) if len(own) > k}
    counts = gram_matrices(wide, partial(_counts, plan, many)) if many else {}
    return [_reduced(own, counts[(i, 0)][0], k) if i in many else own for i, own in enumerate(found)]


def _sampled(rows: DataFrame, seed: int) -> np.ndarray:
    """The row that Spark's sample of one takes; which it is follows from the sizes of the partitions."""
    each = rows.select(F.explode(F.sequence(F.lit(1), F.col("n")))).select(F.monotonically_increasing_id())
    taken = each._jdf.javaRDD().takeSample(False, 1, seed)
    if not taken:
        raise ValueError("there are no rows to be clustered")
    part, row = divmod(taken[0].getLong(0), 1 << 33)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed = 0
        for batch in batches:
            for x in blocks(batch):
                if 0 <= row - passed < x.shape[1]:
                    yield pa.RecordBatch.from_arrays([pa.array([x[:, row - passed].tobytes()], pa.binary())], names=["x"])
                passed += x.shape[1]

    return np.frombuffer(rows.filter(F.spark_partition_id() == part).mapInArrow(run, "x binary").collect()[0]["x"])


def _costs(plan, centres, batch: pa.RecordBatch):
    for x in blocks(batch):
        for i, (at, own) in enumerate(zip(plan, centres)):
            yield (i, 0), np.array([[nearest(x[at].T, own)[1].sum()]])


def _counts(plan, centres: Mapping[int, np.ndarray], batch: pa.RecordBatch):
    for x in blocks(batch):
        for i, own in centres.items():
            yield (i, 0), np.bincount(nearest_centre(x[plan[i]].T, own), minlength=len(own))[None, :]


def _drawn(rows: DataFrame, plan, centres, shares: Sequence[float], seed: int) -> list[np.ndarray]:
    """Rows drawn for every clustering by their share of its cost, in the order of the rows."""
    wanted, *totals = shares

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, passed = task_slot(), 0
        draws = Draws(seed ^ slot)
        for x in (x for batch in batches for x in blocks(batch)):
            u = draws.doubles(x.shape[1])
            for i, (at, own) in enumerate(zip(plan, centres)):
                cost = nearest(x[at].T, own)[1]
                with np.errstate(divide="ignore", invalid="ignore"):
                    hit = np.flatnonzero(u < wanted * cost / totals[i])
                if len(hit):
                    values = [x[at, h].tobytes() for h in hit]
                    columns = [pa.array(np.full(len(hit), i), pa.int32()), pa.array(np.full(len(hit), slot), pa.int32())]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(passed + hit, pa.int64()), pa.array(values, pa.binary())], names=["own", "slot", "row", "x"])
            passed += x.shape[1]

    chosen = sorted(rows.mapInArrow(run, "own int, slot int, row long, x binary").collect(), key=lambda r: (r["slot"], r["row"]))
    return [np.array([np.frombuffer(r["x"]) for r in chosen if r["own"] == i]).reshape(-1, len(at)) for i, at in enumerate(plan)]


def _reduced(points: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """``k`` centres of weighted candidates: k-means++ and its steps."""
    rand = JavaRandom(0)
    index = _passed(weights, rand.next_double() * sum(weights.tolist()))
    centres = [points[index - 1]]
    cost = nearest(points, points[[index - 1]])[1]
    for _ in range(1, k):
        shares = weights * cost
        index = _passed(shares, rand.next_double() * sum(shares.tolist()))
        centres.append(points[max(index - 1, 0)])
        cost = np.minimum(cost, nearest(points, centres[-1][None, :])[1])
    found, before = np.array(centres), None
    for _ in range(LOCAL_ROUNDS):
        label = nearest_centre(points, found)
        for j in range(k):
            own = np.flatnonzero(label == j)
            if not weights[own].sum():
                found[j] = points[rand.next_int(len(points))]
                continue
            total = np.zeros(points.shape[1])
            for i in own:
                total += weights[i] * points[i]
            found[j] = total * (1.0 / weights[own].sum())
        if before is not None and (label == before).all():
            break
        before = label
    return found


def _passed(shares: np.ndarray, limit: float) -> int:
    """How many shares it takes to reach a limit."""
    total, count = 0.0, 0
    while count < len(shares) and total < limit:
        total += float(shares[count])
        count += 1
    return count


class JavaRandom:
    """``java.util.Random``."""

    def __init__(self, seed: int):
        self.state = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)

    def bits(self, count: int) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        found = self.state >> 16
        found -= (found >> 31) << 32
        return found >> (32 - count)

    def next_double(self) -> float:
        return (((self.bits(26) & ((1 << 26) - 1)) << 27) + (self.bits(27) & ((1 << 27) - 1))) * 2.0**-53

    def next_int(self, bound: int) -> int:
        found = self.bits(31) & ((1 << 31) - 1)
        if not bound & (bound - 1):
            return (bound * found) >> 31
        while found - found % bound + bound - 1 >= 1 << 31:
            found = self.bits(31) & ((1 << 31) - 1)
        return found % bound


class Draws:
    """Spark's ``XORShiftRandom``, many numbers at a time: every step is a linear map of the bits, and so are many."""

    def __init__(self, seed: int):
        data = (seed & _WORD).to_bytes(8, "big")
        low = _murmur(data, 0x3C074A61)
        self.state = (_murmur(data, low) << 32) | low

    def states(self, count: int) -> np.ndarray:
        """The next ``count`` states."""
        found = np.empty(count, np.uint64)
        if not count:
            return found
        found[:1] = _stepped(np.array([self.state], np.uint64))
        done = 1
        while done < count:
            more = min(done, count - done)
            found[done : done + more] = _mapped(_jump(done.bit_length() - 1), found[:more])
            done += more
        self.state = int(found[-1])
        return found

    def next_int(self) -> int:
        low = int(self.states(1)[0]) & 0xFFFFFFFF
        return low - ((low >> 31) << 32)

    def doubles(self, count: int) -> np.ndarray:
        found = self.states(2 * count)
        high, low = found[0::2] & np.uint64((1 << 26) - 1), found[1::2] & np.uint64((1 << 27) - 1)
        return ((high << np.uint64(27)) + low).astype(float) * 2.0**-53


def _stepped(x: np.ndarray) -> np.ndarray:
    x = x ^ (x << np.uint64(21))
    x = x ^ (x >> np.uint64(35))
    return x ^ (x << np.uint64(4))


@lru_cache(maxsize=None)
def _jump(power: int) -> np.ndarray:
    """What each value of each byte of a state adds to the state 2**power steps later."""
    bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
    after = _stepped(bits) if not power else _mapped(_jump(power - 1), _mapped(_jump(power - 1), bits))
    table = np.zeros((8, 256), np.uint64)
    for bit in range(8):
        holds = (np.arange(256) >> bit & 1).astype(bool)
        table ^= np.where(holds, after[bit::8][:, None], np.uint64(0))
    return table


def _mapped(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    found = np.zeros(len(x), np.uint64)
    for byte, own in enumerate(table):
        found ^= own[(x >> np.uint64(8 * byte) & np.uint64(255)).astype(np.intp)]
    return found


def _murmur(data: bytes, seed: int) -> int:
    """32 bits of MurmurHash3 of whole words."""
    h = seed
    for at in range(0, len(data), 4):
        k = int.from_bytes(data[at : at + 4], "little") * 0xCC9E2D51 & 0xFFFFFFFF
        k = ((k << 15) | (k >> 17)) * 0x1B873593 & 0xFFFFFFFF
        h ^= k
        h = ((h << 13) | (h >> 19)) & 0xFFFFFFFF
        h = (h * 5 + 0xE6546B64) & 0xFFFFFFFF
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ h >> 16
