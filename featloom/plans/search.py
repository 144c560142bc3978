"""Search of forest settings by successive halving over one binned table.

All settings are scored on one fold, the better half on two, and so on; the last ones see every
fold. A fold is fitted once per setting and its score is kept, so the fitness of a setting that comes through is
that of the full grid, and a loser costs only the folds it was given. Columns are cut at their
exact quantiles once; every fit reads the stored bin numbers.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import partial
from itertools import product

import numpy as np
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featloom.dataset import Dataset, as_double, quoted
from featloom.operators.folds import FOLD
from featloom.operators.quantiles import exact_quantiles
from featloom.plans.fitness import ForestScorer, summarise
from featloom.session import materialise, run_parallel

# A forest looks at no more bins of a column; one more is for missing values.
BINS = 31


@dataclass
class Trial:
    """A setting with the scores of the folds it was fitted for."""

    place: int
    setting: dict
    scores: list[float] = field(default_factory=list)
    rung: int = 0

    def fitness(self, task: str) -> tuple[float, float]:
        return summarise(self.scores, task)


def cut_points(ds: Dataset, bins: int = BINS) -> dict[str, list[float]]:
    """Where the columns are cut: their distinct inner quantiles; none for a column without values."""
    found = exact_quantiles(ds, np.arange(1, bins) / bins)
    return {n: sorted({float(v) for v in values if np.isfinite(v)}) for n, values in found.items()}


def binned(ds: Dataset, bins: int = BINS) -> DataFrame:
    """Stored columns x (bin numbers; missing values in a bin of their own behind the others), y and fold.

    A value on a cut lies above it. Rows are dealt by their content, so seeded fits do not depend on the files.
    """
    cuts = cut_points(ds, bins)
    names = [f"v{i}" for i in range(len(ds.names))]
    codes = [f"b{i}" for i in range(len(ds.names))]
    spread = ds.spread()
    values = spread.values()
    wide = spread.df.select(
        as_double(quoted(ds.label)).alias("y"),
        F.col(FOLD).alias("fold"),
        *[F.coalesce(values[n], F.lit(float("nan"))).alias(c) for n, c in zip(ds.names, names)],
    )
    splits = [[-math.inf, *(cuts[n] or [0.0]), math.inf] for n in ds.names]
    cut = Bucketizer(inputCols=names, outputCols=codes, splitsArray=splits, handleInvalid="keep")
    # A sum sheds the marks of a nominal column: bins are ordered, and the last one counts.
    ordered = cut.transform(wide).withColumns({c: F.col(c) + F.lit(0.0) for c in codes})
    made = VectorAssembler(inputCols=codes, outputCol="x").transform(ordered)
    return materialise(made.select("x", "y", "fold"), "binned")


def rungs(settings: int, folds: int, keep: int) -> list[tuple[int, int]]:
    """(settings, folds) of every rung: settings shrink by ``keep``, folds grow to all of them."""
    last = 0
    while keep ** (last + 1) <= settings:
        last += 1
    return [(-(-settings // keep**r), max(1, -(-folds // keep ** (last - r)))) for r in range(last + 1)]


def halving_search(
    ds: Dataset, grid: Mapping[str, Sequence], keep: int = 2, bins: int = BINS, base: ForestScorer | None = None
) -> DataFrame:
    """Columns place, setting, rung, fits, fitness, std: every setting of the grid, the winner first.

    Settings are ordered by the rung they reached, then by fitness, then by their place in the grid.
    The dataset carries folds. An empty grid gives no rows.
    """
    if keep < 2:
        raise ValueError(f"at least every second setting must go, not one in {keep}")
    base = base or ForestScorer()
    trials = [Trial(i, dict(zip(grid, values))) for i, values in enumerate(product(*grid.values()))] if grid else []
    task, better = ds.task, lambda t: (-t.rung, -t.fitness(ds.task)[0], t.place)
    if trials:
        table = binned(ds, bins)
        folds = sorted(r[0] for r in table.select("fold").distinct().collect())
        live = trials
        for rung, (settings, wanted) in enumerate(rungs(len(trials), len(folds), keep)):
            live = sorted(live, key=better)[:settings] if rung else live
            due = [(t, f) for t in live for f in folds[len(t.scores) : wanted]]
            jobs = [partial(replace(base, **t.setting)._fold_score, table, task, f) for t, f in due]
            for (trial, _), score in zip(due, run_parallel(ds.spark, jobs, base.width)):
                trial.scores.append(score)
            for trial in live:
                trial.rung = rung
    rows = []
    for place, trial in enumerate(sorted(trials, key=better), 1):
        fitness, std = trial.fitness(task)
        rows.append((place, str(trial.setting), trial.rung, len(trial.scores), float(fitness), float(std)))
    return ds.spark.createDataFrame(rows, "place int, setting string, rung int, fits int, fitness double, std double")
