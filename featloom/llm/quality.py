"""Quality rules as learned decision lists, in DataFrame functions alone.

Every text gets a row of statistics. Sequential covering learns, from labelled rows, an ordered list of
conjunctions of thresholds that reject: a rule grows on one part of the rows by the best gain, is
pruned on the other part, and enters the list only if it is precise there; the rows it covers are
taken out before the next one grows. Cut points are quantiles of the bad and of the good rows that are
still at hand. All counts come from Spark aggregations over binned statistics, so the driver sees numbers per statistic, bin and part, never rows. The list is applied as one ordered
conditional expression.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featloom.llm.base import BLANKS, load, named, query
from featloom.session import materialise

WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
BINS = 32
MAX_RULES = 12
MAX_CONDITIONS = 4
MIN_PRECISION = 0.95
MIN_COVERED = 5

# The statistics a rule may use: counts of a text over the count they are shares of.
STATISTICS = {
    "symbols_per_char": ("n_symbols", "word_chars"),
    "chars_per_word": ("word_chars", "n_words"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "repeated_lines": ("n_dup_lines", "n_lines"),
    "capitals_per_char": ("n_capitals", "word_chars"),
    "digits_per_char": ("n_digits", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
    "short_words": ("n_short", "n_words"),
    "distinct_words": ("n_distinct", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}


def statistic(name: str) -> Column:
    """Null where there is nothing to divide by."""
    count, total = STATISTICS[name]
    return F.try_divide(F.col(count), F.col(total))


@dataclass(frozen=True)
class Condition:
    """A threshold on one statistic."""

    statistic: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = statistic(self.statistic)
        test = value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)
        return F.coalesce(test, F.lit(False))

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.threshold:.4g}"


Rule = tuple[Condition, ...]


def covers(rule: Sequence[Condition]) -> Column:
    test = F.lit(True)
    for condition in rule:
        test = test & condition.column()
    return test


def verdict(rules: Sequence[Rule]) -> Column:
    """True where the first rule that fits rejects; the end of the list keeps."""
    found = F.when(F.lit(False), F.lit(True))
    for rule in rules:
        found = found.when(covers(rule), F.lit(True))
    return found.otherwise(F.lit(False))


def text_statistics(rows: DataFrame) -> DataFrame:
    """Adds counts to rows that have a column ``text``; drops the text. Other columns pass.

    A null text is the empty one: all its counts are 0 and every share is null.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = rows.withColumns(
        {
            "words": F.array_remove(F.split(text, BLANKS), ""),
            "lines": F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD)),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
            "n_capitals": F.regexp_count(text, F.lit("[A-Z]")).cast("long"),
            "n_digits": F.regexp_count(text, F.lit("[0-9]")).cast("long"),
            "n_marks": F.regexp_count(text, F.lit("[.,;:!?]")).cast("long"),
        }
    ).drop("text")
    n = F.size("words")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(window(i).alias("w"), i.alias("i"))))
    counted = cut.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_lines": F.size("lines").cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "n_short": F.size(F.filter("words", lambda w: F.length(w) <= 3)).cast("long"),
            "n_distinct": F.size(F.array_distinct("words")).cast("long"),
            "ordered": F.sort_array(windows),
        }
    ).drop("words", "lines")
    placed = counted.withColumn("places", repeated_places(F.col("ordered"))).drop("ordered")
    return placed.withColumn("n_repeat_words", covered_words(F.col("places"))).drop("places")


def window(i: Column) -> Column:
    """Three words from place ``i``. No word holds a space, so the joined text tells windows apart."""
    words = F.col("words")
    return F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))


def repeated_places(ordered: Column) -> Column:
    """Places of windows found twice or more, from the windows in order of their text."""
    equal = F.zip_with(
        ordered,
        F.slice(ordered, F.lit(2), F.greatest(F.size(ordered) - 1, F.lit(0))),
        lambda one, two: F.when(one["w"] == two["w"], F.array(one["i"], two["i"])),
    )
    return F.sort_array(F.array_distinct(F.flatten(F.filter(equal, lambda pair: pair.isNotNull()))))


def covered_words(places: Column) -> Column:
    """Words in windows at these places: each reaches three words, or to the next place."""
    following = F.slice(places, F.lit(2), F.greatest(F.size(places), F.lit(1)))
    reach = F.zip_with(places, following, lambda at, then: F.least(F.lit(3), F.coalesce(then - at, F.lit(3))))
    return F.coalesce(F.aggregate(reach, F.lit(0), lambda total, words: total + words), F.lit(0)).cast("long")


def failed_base(min_words: int = MIN_WORDS) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def thresholds(rows: DataFrame, bins: int = BINS) -> dict[str, list[float]]:
    """Cut points of each statistic: equal shares of the bad and of the good rows, ends included, and the middles between."""
    shares = [i / bins for i in range(bins + 1)]
    points = lambda name, bad: F.percentile_approx(F.when(F.col("bad") == bad, statistic(name)), shares, 10_000)
    row = rows.agg(*[points(name, bad).alias(f"{name}_{bad}") for name in STATISTICS for bad in (0, 1)]).first()
    found = {name: sorted({*(row[f"{name}_0"] or []), *(row[f"{name}_1"] or [])}) for name in STATISTICS}
    return {name: sorted({*points, *((a + b) / 2 for a, b in zip(points, points[1:]))}) for name, points in found.items()}


def learn_rules(labelled: DataFrame, bad: Column, max_rules: int = MAX_RULES, min_precision: float = MIN_PRECISION) -> list[Rule]:
    """The ordered rules that reject, from rows with statistics, an ``id`` and the label ``bad``.

    All labelled rows take part. Two thirds of them, by a hash of their id, grow the rules, the rest
    prunes them and has to confirm them. A rule that covers too few rows there, or too many good ones, gives
    way to one that starts from the next best condition; the list ends when no start is left. No labelled
    rows, or none of a class: no rules.
    """
    counts = sorted({column for pair in STATISTICS.values() for column in pair})
    rows = labelled.select(bad.cast("int").alias("bad"), (F.pmod(F.xxhash64("id"), F.lit(3)) > 0).alias("grows"), *counts)
    # Rows with equal counts are one row with a number.
    rows = materialise(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")), "labelled")
    rules: list[Rule] = []
    while len(rules) < max_rules:
        rest = rows
        for rule in rules:
            rest = rest.where(~covers(rule))
        rule = next_rule(rest.where("grows"), rest.where("NOT grows"), min_precision)
        if not rule:
            break
        rules.append(rule)
    return centred(labelled, rules)


def centred(labelled: DataFrame, rules: Sequence[Rule]) -> list[Rule]:
    """Every threshold moved into the middle of the gap between the values on its two sides.

    A cut point is itself a value that occurs; the middle leaves equal room to either side.
    """
    if not rules:
        return []
    sides = []
    for i, rule in enumerate(rules):
        for k, condition in enumerate(rule):
            value, others = statistic(condition.statistic), covers(rule[:k] + rule[k + 1 :])
            sides.append(F.max(F.when(others & (value <= condition.threshold), value)).alias(f"low{i}_{k}"))
            sides.append(F.min(F.when(others & (value > condition.threshold), value)).alias(f"high{i}_{k}"))
    row = labelled.agg(*sides).first()

    def moved(i: int, k: int, condition: Condition) -> Condition:
        low, high = row[f"low{i}_{k}"], row[f"high{i}_{k}"]
        if low is None or high is None:
            return condition
        return Condition(condition.statistic, condition.above, (low + high) / 2)

    return [tuple(moved(i, k, condition) for k, condition in enumerate(rule)) for i, rule in enumerate(rules)]


def class_counts(rows: DataFrame) -> tuple[int, int]:
    row = rows.agg(F.sum(F.col("bad") * F.col("n")).alias("bad"), F.sum((1 - F.col("bad")) * F.col("n")).alias("good")).first()
    return row["bad"] or 0, row["good"] or 0


def next_rule(growing: DataFrame, pruning: DataFrame, min_precision: float) -> Rule | None:
    """The first rule the pruning rows confirm, from the best start on."""
    for start, left in conditions(growing, *class_counts(growing)):
        rule = prune(pruning, grow(growing, start, left), min_precision)
        if rule:
            return rule
    return None


def grow(rows: DataFrame, start: Condition, left: tuple[int, int]) -> Rule:
    """Conditions added to the first, each the one with the highest gain, until no good row is covered."""
    rule: Rule = (start,)
    while left[1] and len(rule) < MAX_CONDITIONS:
        found = conditions(rows.where(covers(rule)), *left)
        if not found:
            break
        rule, left = (*rule, found[0][0]), found[0][1]
    return rule


def conditions(rows: DataFrame, bad: int, good: int) -> list[tuple[Condition, tuple[int, int]]]:
    """The best condition of each statistic and side with the (bad, good) rows it leaves, by falling gain.

    Cut points come from the rows at hand, so they grow finer as a rule or the list proceeds.
    """
    if not bad or not good:
        return []
    cuts = {name: points for name, points in thresholds(rows).items() if points}
    if not cuts:
        return []
    below = lambda name: F.size(F.filter(F.array(*map(F.lit, cuts[name])), lambda point: point < statistic(name)))
    cells = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.when(statistic(name).isNotNull(), below(name)).alias("bin")) for name in cuts]))
    sums = rows.select(cells.alias("cell"), "bad", "n").where("cell.bin IS NOT NULL").groupBy("cell.name", "cell.bin")
    counts = sums.agg(F.sum(F.col("bad") * F.col("n")).alias("bad"), F.sum((1 - F.col("bad")) * F.col("n")).alias("good")).collect()
    best: dict[tuple[str, bool], tuple[float, float, tuple[int, int]]] = {}
    for name, points in cuts.items():
        own = {row["bin"]: (row["bad"], row["good"]) for row in counts if row["name"] == name}
        all_bad, all_good = (sum(c[i] for c in own.values()) for i in (0, 1))
        low_bad = low_good = 0
        for bin_, point in enumerate(points):
            low_bad, low_good = low_bad + own.get(bin_, (0, 0))[0], low_good + own.get(bin_, (0, 0))[1]
            for above, p, n in ((False, low_bad, low_good), (True, all_bad - low_bad, all_good - low_good)):
                if p >= MIN_COVERED:
                    gain = p * (math.log2(p / (p + n)) - math.log2(bad / (bad + good)))
                    # Of equal gains the later: the middle of a gap, not the last value before it.
                    if gain > 1e-9 and gain >= best.get((name, above), (0.0,))[0] - 1e-9:
                        best[name, above] = (gain, point, (p, n))
    ranked = sorted(best.items(), key=lambda item: -item[1][0])
    return [(Condition(name, above, point), left) for (name, above), (_, point, left) in ranked]


def prune(rows: DataFrame, rule: Rule, min_precision: float) -> Rule | None:
    """The shortest head of the rule that is as precise as any, or None if none is precise enough."""
    heads = [rule[:length] for length in range(1, len(rule) + 1)]
    sums = []
    for i, head in enumerate(heads):
        weight = F.when(covers(head), F.col("n")).otherwise(0)
        sums += [F.sum(weight * F.col("bad")).alias(f"bad{i}"), F.sum(weight).alias(f"all{i}")]
    row = rows.agg(*sums).first()
    best, worth = None, -1.0
    for i, head in enumerate(heads):
        bad, total = row[f"bad{i}"] or 0, row[f"all{i}"] or 0
        if total and bad >= max(1, MIN_COVERED // 2) and bad / total >= min_precision and bad / total > worth + 1e-9:
            best, worth = head, bad / total
    return best


def label_rows(labels: DataFrame, doc_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """(id, label) once per id; of repeated ids the smallest label counts, null ids and labels are left out."""
    rows = labels.select(named(doc_id).cast("long").alias("id"), named(label).cast("int").alias("label"))
    return rows.where("id IS NOT NULL AND label IS NOT NULL").groupBy("id").agg(F.min("label").alias("label"))


def judged(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, the statistics, base_failed and kept of every row of ``docs``.

    Rows with a null id are judged like all others but teach nothing. Repeated rows are judged one by
    one. An empty table gives no rows. Other columns are not looked at.
    """
    rows = docs.select(named(doc_id).cast("long").alias("id"), named(text).alias("text"))
    stats = materialise(text_statistics(rows).withColumn("base_failed", failed_base()), "text-statistics")
    rules = fitted_rules(stats, labels)
    return stats.withColumn("kept", ~F.col("base_failed") & ~verdict(rules))


def fitted_rules(stats: DataFrame, labels: DataFrame) -> list[Rule]:
    """Rules learned from the labelled rows that pass the base rules."""
    labelled = stats.where(~F.col("base_failed")).join(label_rows(labels), "id")
    return learn_rules(labelled, F.col("label") == 0)


def drop_rejected(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that the base rules or the learned list reject, all columns as they were.

    The rules are learned in one pass over the statistics; a second pass applies them to the rows it
    reads, so no row is joined to its own verdict.
    """
    rows = docs.select(named(doc_id).cast("long").alias("id"), named(text).alias("text"))
    known = rows.join(label_rows(labels).select("id"), "id", "left_semi")
    rules = fitted_rules(materialise(text_statistics(known).withColumn("base_failed", failed_base()), "text-statistics"), labels)
    wrapped = docs.select(F.struct(*[named(c) for c in docs.columns]).alias("row"), named(text).alias("text"))
    # Above the row count the filter stays where it is; pushed down, it would repeat every statistic it names.
    counted = text_statistics(wrapped).observe("judged documents", F.count(F.lit(1)).alias("rows"))
    return counted.where(~failed_base() & ~verdict(rules)).select("row.*")


@query("op9_quality_rules")
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return found.select(F.col("id").alias("doc_id"), *counts, "base_failed", "kept")
