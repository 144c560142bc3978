"""Periodic runs of words by longest common extensions over a difference cover.

The extension of two places of a text is the number of words on which they agree. Only the suffixes at
the places of a difference cover are sorted: first word by word through one period of the cover, then by
doubling the ranks of what is still tied. Any two places reach two sampled ones at the same distance
within a period, so an extension is a comparison of a few words and, if they agree, the least common
prefix between two sorted suffixes, read from a sparse table.

Runs are looked for on a harmonic grid. Where words ``period`` apart agree, a run of the least exponent
makes a stretch of known length, so a grid with that step has a point in it. Extensions forward from the
point and from a place before it tell whether the stretch is long enough and where it starts. A text of
n words has about n log n grid points, of which only those with two equal words ask for an extension.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featloom.llm.base import BLANKS, load, query, texts

# Differences of these residues give every residue of the period, so two places meet in the sample.
PERIOD = 31
RESIDUES = (0, 1, 3, 8, 12, 18)
LEAST_LENGTH = 6
LEAST_EXPONENT = 4
BATCH_BYTES = 2_000_000
# Grid points looked at a time.
POINTS = 1 << 19
RUN = "array<struct<start: long, length: long, period: long>>"
FOUND = f"doc_id long, n_words long, runs {RUN}, collapsed_text string"
RUN_KIND = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND_KINDS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN_KIND)), ("collapsed_text", pa.string())])


def text_parts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows first..last-1 of a column of texts as bytes with row bounds; a part ends where it grows large."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + BATCH_BYTES, "right")) - 1)
        yield first, last, raw[starts[first] : starts[last]], starts[first : last + 1] - starts[first]
        first = last


class WordBounds:
    """Byte bounds of the words of some texts, and where each text's words begin."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        self.data, self.starts = data, starts
        word = ~((data == 0x20) | ((data >= 0x09) & (data <= 0x0D)))
        opens, closes = word.copy(), word.copy()
        opens[1:] &= ~word[:-1]
        closes[:-1] &= ~word[1:]
        edge = starts[1:-1]
        edge = edge[(edge > 0) & (edge < len(data))]
        opens[edge] = word[edge]
        closes[edge - 1] = word[edge - 1]
        self.inside = word
        self.first = np.flatnonzero(opens)
        self.last = np.flatnonzero(closes) + 1
        self.begin = np.searchsorted(self.first, starts)
        self.counts = np.diff(self.begin)

    def codes(self) -> np.ndarray:
        """Equal numbers for equal words, from 1."""
        ends = np.concatenate([[0], np.cumsum(self.last - self.first)]).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.first), [None, pa.py_buffer(ends), pa.py_buffer(self.data[self.inside].tobytes())])
        return words.dictionary_encode().indices.to_numpy().astype(np.int64) + 1

    def joined(self, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The kept words of each text with one space between them, as bytes and row bounds."""
        at = np.flatnonzero(kept)
        row = np.searchsorted(self.begin, at, "right") - 1
        # A kept word takes the blank behind it along, unless it is the last one of its text.
        followed = np.zeros(len(at), bool)
        followed[:-1] = row[1:] == row[:-1]
        edges = np.zeros(len(self.data) + 2, np.int8)
        np.add.at(edges, self.first[at], 1)
        np.add.at(edges, self.last[at] + followed, -1)
        taken = np.cumsum(edges[: len(self.data)], dtype=np.int8).astype(bool)
        bounds = np.concatenate([[0], np.cumsum(taken)])[self.starts]
        return np.where(self.inside[taken], self.data[taken], np.uint8(0x20)), bounds


def meeting_table() -> np.ndarray:
    """Least distance from two residues to two sampled ones."""
    sampled = np.isin(np.arange(2 * PERIOD) % PERIOD, RESIDUES)
    table = np.empty((PERIOD, PERIOD), np.int64)
    for i in range(PERIOD):
        for j in range(PERIOD):
            table[i, j] = np.flatnonzero(sampled[i : i + PERIOD] & sampled[j : j + PERIOD])[0]
    return table


MEETING = meeting_table()
SLOT = np.full(PERIOD, -1, np.int64)
SLOT[list(RESIDUES)] = np.arange(len(RESIDUES))


class Extensions:
    """Common extensions between places of the same text.

    ``codes`` holds the words of all texts, each text closed by one zero; ``row`` is the text of a place.
    """

    def __init__(self, codes: np.ndarray, row: np.ndarray):
        self.codes = codes
        blocks = -(-len(codes) // PERIOD)
        places = (np.arange(blocks)[:, None] * PERIOD + np.array(RESIDUES)).ravel()
        self.places = places[places < len(codes)]
        self.sort(row)
        self.levels = [self.common]
        while 2 << (len(self.levels) - 1) <= len(self.common):
            half, below = 1 << (len(self.levels) - 1), self.levels[-1]
            self.levels.append(np.minimum(below[:-half], below[half:]))

    def sample(self, place: np.ndarray) -> np.ndarray:
        return place // PERIOD * len(RESIDUES) + SLOT[place % PERIOD]

    def sort(self, row: np.ndarray) -> None:
        """Rank of every sampled suffix, and the words it shares with the one before it in the order."""
        places, codes, count = self.places, self.codes, len(self.places)
        kinds = int(codes.max(initial=0)) + 1
        order = np.arange(count)
        group = np.zeros(count, np.int64)
        common = np.full(count, -1, np.int64)
        new = np.ones(count, bool)
        new[1:] = np.diff(row[places]) != 0
        common[new] = 0

        def regroup() -> None:
            heads = np.flatnonzero(new)
            group[:] = np.repeat(heads, np.diff(heads, append=count))

        def tied() -> np.ndarray:
            return np.flatnonzero(~new | np.concatenate([~new[1:], [False]]))

        def refine(at: np.ndarray, keys: np.ndarray, width: int) -> np.ndarray:
            """Order the tied members by keys; which of them now differ from the one before."""
            moved = np.argsort(group[at] * width + keys, kind="stable")
            order[at] = order[at[moved]]
            keys = keys[moved]
            apart = np.zeros(len(at), bool)
            apart[1:] = (np.diff(keys) != 0) & (np.diff(group[at]) == 0)
            return at[apart]

        regroup()
        # No two suffixes of a text tie to its end: the shorter one closes with a zero before the other.
        for offset in range(PERIOD):
            at = tied()
            if not len(at):
                break
            split = refine(at, codes[places[order[at]] + offset], kinds)
            new[split] = True
            common[split] = offset
            regroup()
        ranks, length, deep = [], PERIOD, np.flatnonzero(~new)
        at = tied()
        while len(at):
            rank = np.empty(count, np.int64)
            rank[order] = group
            ranks.append(rank)
            split = refine(at, rank[self.sample(places[order[at]] + length)], count)
            new[split] = True
            regroup()
            length *= 2
            at = tied()
        if len(deep):
            left, right = places[order[deep - 1]].copy(), places[order[deep]].copy()
            found = np.zeros(len(deep), np.int64)
            for level in range(len(ranks) - 1, -1, -1):
                same = ranks[level][self.sample(left)] == ranks[level][self.sample(right)]
                jump = same * (PERIOD << level)
                left, right, found = left + jump, right + jump, found + jump
            common[deep] = found + self.compare(left, right, np.full(len(deep), PERIOD))[0]
        self.rank = np.empty(count, np.int64)
        self.rank[order] = np.arange(count)
        self.common = common

    def compare(self, left: np.ndarray, right: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words that agree up to a limit, and which pairs reach it."""
        found = limit.copy()
        open_ = np.flatnonzero(limit > 0)
        differ = np.zeros(len(left), bool)
        offset = 0
        while len(open_):
            same = self.codes[left[open_] + offset] == self.codes[right[open_] + offset]
            found[open_[~same]] = offset
            differ[open_[~same]] = True
            offset += 1
            open_ = open_[same]
            open_ = open_[limit[open_] > offset]
        return found, ~differ

    def between(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Words on which the places agree; left and right differ."""
        if not len(left):
            return np.zeros(0, np.int64)
        distance = MEETING[left % PERIOD, right % PERIOD]
        found, through = self.compare(left, right, distance)
        at = np.flatnonzero(through)
        a, b = self.rank[self.sample(left[at] + distance[at])], self.rank[self.sample(right[at] + distance[at])]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for own in np.unique(level).tolist():
            mine = level == own
            table = self.levels[own]
            found[at[mine]] += np.minimum(table[low[mine]], table[high[mine] - (1 << own)])
        return found


def grid(counts: np.ndarray, least_length: int, least_exponent: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, period, step, place in the text) of the harmonic grid, some points at a time."""
    most = np.where(counts >= least_length, counts // least_exponent, 0)
    ends = np.cumsum(most)
    pair = 0
    total = int(ends[-1]) if len(ends) else 0
    while pair < total:
        stop = min(total, pair + POINTS)
        at = np.arange(pair, stop)
        text = np.searchsorted(ends, at, "right")
        period = at - (ends[text] - most[text]) + 1
        step = np.maximum(least_length, least_exponent * period) - period
        points = (counts[text] - 1 - period) // step + 1
        done = np.cumsum(points)
        # At least one pair a time, and no more points than fit.
        take = max(1, int(np.searchsorted(done, POINTS, "right")))
        text, period, step, points = text[:take], period[:take], step[:take], points[:take]
        number = np.arange(int(points.sum())) - np.repeat(np.cumsum(points) - points, points)
        yield np.repeat(text, points), np.repeat(period, points), np.repeat(step, points), number * np.repeat(step, points)
        pair += take


def find_runs(codes: np.ndarray, begin: np.ndarray, counts: np.ndarray, least_length: int, least_exponent: int) -> np.ndarray:
    """(text, start, length, period) of all runs, in order; ``codes`` as ``Extensions`` takes them."""
    row = np.repeat(np.arange(len(counts)), counts + 1)
    extend = None
    found = []
    for text, period, step, place in grid(counts, least_length, least_exponent):
        base = begin[text]
        same = codes[base + place] == codes[base + place + period]
        text, period, step, place, base = text[same], period[same], step[same], place[same], base[same]
        if not len(text):
            continue
        extend = extend or Extensions(codes, row)
        ahead = extend.between(base + place, base + place + period)
        # The stretch must reach back far enough to have the length of a step ...
        back = np.maximum(step - ahead, 0)
        able = np.flatnonzero(back <= place)
        at = base[able] + place[able] - back[able]
        able = able[(back[able] == 0) | (extend.between(at, at + period[able]) >= back[able])]
        # ... and not as far as the grid point before, which then reports it.
        before = np.flatnonzero(place[able] >= step[able])
        at = base[able[before]] + place[able[before]] - step[able[before]]
        reported = extend.between(at, at + period[able[before]]) >= step[able[before]]
        able = np.delete(able, before[reported])
        text, period, step, place, base, ahead = text[able], period[able], step[able], place[able], base[able], ahead[able]
        low, high = np.maximum(place - step + 1, 0), place.copy()
        while (low < high).any():
            middle = (low + high) // 2
            at = base + middle
            holds = extend.between(at, at + period) >= place - middle
            high = np.where(holds, middle, high)
            low = np.where(holds, low, np.minimum(middle + 1, high))
        found.append(np.stack([text, low, place + ahead + period - low, period], axis=1))
    if not found:
        return np.zeros((0, 4), np.int64)
    runs = np.concatenate(found)
    # A stretch with a period has all its multiples; the smallest names the run.
    runs = runs[np.lexsort((runs[:, 3], runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (np.diff(runs[:, :3], axis=0) != 0).any(axis=1)
    runs = runs[first]
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def runs_of(data: np.ndarray, starts: np.ndarray, least_length: int, least_exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word counts, runs, and the bytes and bounds of the collapsed texts."""
    words = WordBounds(data, starts)
    rows = len(words.counts)
    closed = np.insert(words.codes(), words.begin[1:], 0) if len(words.first) else np.zeros(rows, np.int64)
    runs = find_runs(closed, words.begin[:-1] + np.arange(rows), words.counts, least_length, least_exponent)
    depth = np.zeros(len(words.first) + 1, np.int64)
    own = words.begin[runs[:, 0]] + runs[:, 1]
    np.add.at(depth, own + runs[:, 3], 1)
    np.add.at(depth, own + runs[:, 2], -1)
    joined, bounds = words.joined(np.cumsum(depth[:-1]) == 0)
    return words.counts, runs, joined, bounds


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """doc_id, n_words, runs (start, length, period), collapsed_text: one row per row of ``docs``.

    A run is a stretch of consecutive words in which words ``period`` apart are equal, the period being
    the smallest such number and the stretch as long as its neighbours allow, with at least
    ``least_length`` words and ``least_exponent`` periods. Runs are ordered by start, then period. The
    collapsed text holds, with one space between them, the words that no run contains after its first
    period. A null text is the empty one, without words and runs; a null id stays null, rows that
    repeat an id are judged each for itself, other columns are not looked at, and an empty table gives
    no rows. A text is searched whole in one task, in memory of a few dozen numbers a word.
    """
    if least_exponent < 2 or least_length < 2:
        raise ValueError("a run needs two periods and two words at least")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for first, last, data, starts in text_parts(frame.column(1)):
                counts, runs, joined, bounds = runs_of(data, starts, least_length, least_exponent)
                ends = np.searchsorted(runs[:, 0], np.arange(last - first + 1)).astype(np.int32)
                fields = [pa.array(np.ascontiguousarray(runs[:, k])) for k in (1, 2, 3)]
                own = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, fields=list(RUN_KIND)))
                text_ = pa.LargeStringArray.from_buffers(last - first, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(joined.tobytes()))
                columns = [frame.column(0).slice(first, last - first), pa.array(counts, pa.int64()), own, text_.cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, schema=FOUND_KINDS)

    return texts(docs, doc_id, text).mapInArrow(run, FOUND)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in which a tenth of the texts, by a checksum of the id, repeats some of its words to its end."""
    checksum = F.crc32(F.col("doc_id").cast("string"))
    rest = F.floor(checksum / 10).cast("long")
    split = F.filter(F.split("text", BLANKS), lambda word: word != "")

    def repeated(words: Column) -> Column:
        count = F.size(words)
        start = rest % count
        period = 1 + F.floor((count - start) / (3 + rest % 8)).cast("long")

        def word(i: Column) -> Column:
            return F.get(words, F.when(i < start, i).otherwise(start + (i - start) % period).cast("int"))

        return F.when(count > 0, F.array_join(F.transform(F.sequence(F.lit(0), count - 1), word), " ")).otherwise("")

    # The words are bound once, as the element of an array of one.
    changed = F.get(F.transform(F.array(split), repeated), 0)
    return texts(docs).select("doc_id", F.when(checksum % 10 == 0, changed).otherwise(F.col("text")).alias("text"))


SQL = r"""
WITH table_ AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce([CAST(n AS BIGINT)] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) AS r(n))
), hashed AS (
  SELECT doc_id, coalesce(text, '') AS text,
    xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
      lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS h
  FROM documents, table_
), split AS (
  SELECT doc_id, h, h // 10 AS g, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM hashed
), sized AS (SELECT *, CAST(len(ws) AS BIGINT) AS n FROM split
), placed AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM sized
), d AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE ws END AS ws
  FROM placed
), w AS (SELECT doc_id, n, unnest(ws) AS word, unnest(range(n)) AS i FROM d
), same AS (
  SELECT x.doc_id, y.i - x.i AS p, x.i AS i FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), stretch AS (
  SELECT doc_id, p, min(i) AS start, count(*) + p AS length
  FROM (SELECT doc_id, p, i, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM same) GROUP BY doc_id, p, island
), runs AS (
  SELECT doc_id, start, length, min(p) AS period FROM stretch WHERE length >= greatest(6, 4 * p) GROUP BY doc_id, start, length
), summed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
    arg_min(struct_pack(start, length, period), struct_pack(a := -length, b := start, c := period)) AS longest
  FROM runs GROUP BY doc_id
), gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) FILTER (gone.i IS NULL) AS text FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id AND w.i = gone.i GROUP BY w.doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, longest.start AS start, longest.length AS length, longest.period AS period,
  1000 * longest.length // longest.period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN summed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query("op11_word_runs", SQL)
def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_runs(load(spark, sf_dir, "documents")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("back"), (-r.period).alias("less"))))
    return found.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.back")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.less")).alias("period"),
        F.floor(1000 * F.col("longest.length") / -F.col("longest.less")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )
