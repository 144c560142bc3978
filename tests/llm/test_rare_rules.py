"""Kinds of bad rows too rare for cut points at equal shares of all rows."""

import random

from pyspark.sql import functions as F

from featloom.llm import quality


def test_rare_kinds_are_told_from_good_rows(spark):
    rng, rows = random.Random(6), []
    for i in range(4000):
        symbols, capitals, bad = rng.randint(0, 3000), rng.randint(0, 3000), 0
        if i % 100 == 0:
            symbols, bad = rng.randint(6000, 9000), 1
        elif i % 100 == 50:
            capitals, bad = rng.randint(6000, 9000), 1
        rows.append((i, bad, symbols, capitals))
    stats = spark.createDataFrame(rows, "id long, bad int, n_symbols long, n_capitals long")
    others = {c for pair in quality.STATISTICS.values() for c in pair} - {"n_symbols", "n_capitals"}
    stats = stats.select("*", *[F.lit(100_000).alias(c) for c in sorted(others)])
    rules = quality.learn_rules(stats, F.col("bad") == 1)
    found = stats.select("bad", quality.verdict(rules).alias("rejected"))
    assert found.where("bad = 1 AND NOT rejected").count() == 0
    # A good row beyond the cut of the growing rows is possible, a handful is not.
    assert found.where("bad = 0 AND rejected").count() <= 4
