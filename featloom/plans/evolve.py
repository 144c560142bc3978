"""Generations of features over one table, coefficient search and final selection."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from featloom.dataset import Dataset, quoted
from featloom.functions.scalar import OPERATOR_NAMES
from featloom.operators.catalog import DEFAULT_SET, OperatorSet
from featloom.operators.expr import Ref, operator_count, read_name, to_column
from featloom.operators.folds import FOLD, with_folds
from featloom.plans.fitness import FOLDS, ForestScorer, LinearScorer
from featloom.plans.selection import (
    Selector,
    best_features,
    important_features,
    missing_initial,
    preselect_wide,
    ranked_features,
    shrink,
    shrink_steps,
)
from featloom.plans.tournament import NextGeneration, initial_weights, next_generation
from featloom.session import materialise, work_dir
from featloom.sources.tables import write_final, write_generation, write_total


# Rows of a task of the prepared table at most.
ROWS_PER_TASK = 500_000


@dataclass(frozen=True)
class Config:
    """Limits count the label as a column where the selection rules do.

    ``first_version`` runs the earlier competition and enforces the limits by repeated importance
    selection instead of the univariate score. ``candidate_limit`` is how many candidates of an operator
    enter the competition, the best by the univariate score that enforces ``current_limit`` after it.
    ``rules`` choose the operator library, ``OLDER_SET`` the older one.
    """

    generations: int = 4
    inflation: int = 10
    current_limit: int = 2000
    history_limit: int = 1000
    candidate_limit: int | None = 2000
    operators: tuple[str, ...] = tuple(OPERATOR_NAMES)
    rules: OperatorSet = DEFAULT_SET
    scorer: object = field(default_factory=LinearScorer)
    final_scorer: object = field(default_factory=ForestScorer)
    selector: Selector = important_features
    share_steps: tuple[float, ...] = tuple(i / 10 for i in range(1, 10))
    size_steps: tuple[float, ...] = tuple(i / 10 for i in range(9, 0, -1))
    initial_every: int = 1
    first_version: bool = False
    wide_above: int = 10_000
    wide_keep: int = 50
    folder: str | None = None
    seed: int = 0


@dataclass(frozen=True)
class Evolution:
    """All candidate features as one stored table, and how they came about."""

    total: Dataset
    base: Dataset
    weights: dict[str, float]
    history: tuple[tuple[int, str, float, float], ...]

    def catalog(self) -> DataFrame:
        """Columns feature, operators: every candidate with the operators on its longest path."""
        bases = self.base.names
        rows = [(n, operator_count(read_name(n, bases))) for n in self.total.names]
        return self.total.spark.createDataFrame(rows, "feature string, operators int")


@dataclass(frozen=True)
class RunResult:
    final: Dataset
    coefficients: tuple[float, float]
    report: DataFrame
    evolution: Evolution


def prepared(ds: Dataset, folds: int = FOLDS) -> Dataset:
    """The dataset with its fold column, stored once for every later pass."""
    rows = ds.df.count()
    ds = with_folds(ds, folds)
    table = ds.df.select(*_roles(ds), *[quoted(c) for c in ds.columns])
    # Generations compute far more than they read, and folds leave a task per class and bucket: the rows are dealt evenly.
    cores = ds.spark.sparkContext.defaultParallelism
    return ds.with_df(materialise(table.repartition(cores * max(1, -(-rows // (ROWS_PER_TASK * cores)))), "base"))


def _roles(ds: Dataset) -> list:
    names = [*ds.roles(), *([FOLD] if FOLD in ds.df.columns else [])]
    return [quoted(c) for c in dict.fromkeys(names)]


def _with(ds: Dataset, exprs: Sequence) -> Dataset:
    """Table of the given expressions with the role and fold columns."""
    values = ds.values()
    made = ds.derived({e.name: to_column(e, values) for e in exprs})
    columns = [to_column(e, values).alias(f.column) for e, f in zip(exprs, made.features)]
    return replace(made, df=ds.df.select(*_roles(ds), *columns))


def evolve(ds: Dataset, config: Config = Config()) -> Evolution:
    """Run the generations. ``ds`` comes from :func:`prepared`.

    One stored table per generation holds the current and the earlier features, so expressions
    over it are one operator deep and no lineage grows.
    """
    base = ds
    start = preselect_wide(base, config.wide_above, config.wide_keep)
    folder = config.folder or f"{work_dir(ds.spark)}/featloom/run-{uuid.uuid4().hex}"
    weights = initial_weights(config.generations, config.operators)
    table, current, previous = start, start.names, []
    size, history = len(current), []
    for generation in range(1, config.generations + 1):
        found: NextGeneration = next_generation(
            table, config.scorer, weights, previous, config.seed + generation, config.first_version, config.candidate_limit, config.rules
        )
        weights = found.weights
        history += [(generation, op, fitness, std) for op, fitness, std in found.ranking]
        made = list(found.exprs)
        limit = min(config.inflation * size, config.current_limit)
        if len(made) + 1 > limit:
            if config.first_version:
                best = set(shrink(_with(table, made), limit - 1, config.selector).names)
            else:
                best = set(ranked_features(table, made)[:limit])
            made = [e for e in made if e.name in best]
        size = max(len(made), 1)
        past = list(dict.fromkeys([*previous, *current]))
        if len(past) + 1 > config.history_limit:
            kept = table.keep(past)
            if config.first_version:
                past = shrink(kept, config.history_limit - 1, config.selector).names
            else:
                past = best_features(kept, config.history_limit).names
        names = [e.name for e in made]
        initial = []
        if (generation - 1) % config.initial_every == 0:
            initial = [n for n in missing_initial(start.names, names, past)]
        columns = [*made, *[Ref(n) for n in past], *[Ref(n) for n in initial if n in table.by_name]]
        stored = _with(table, columns)
        lost = [n for n in initial if n not in table.by_name]
        if lost:
            stored = _rejoin(stored, start.keep(lost))
        table = write_generation(stored, folder, generation)
        previous, current = past, [*names, *initial]
        if not current:
            break
    total = write_total(table, folder)
    return Evolution(total, start, weights, tuple(history))


def _rejoin(table: Dataset, lost: Dataset) -> Dataset:
    """Bring base columns back that were dropped from the history: one join on the row id."""
    names = lost.df.select(quoted(lost.row_id).alias("__id"), *[quoted(c).alias(f"init_{c}") for c in lost.columns])
    joined = table.df.join(names, quoted(table.row_id) == quoted("__id")).drop("__id")
    added = tuple(replace(f, column=f"init_{f.column}") for f in lost.features)
    return replace(table, df=joined, features=(*table.features, *added))


@dataclass
class Known:
    """What a run has found out about feature sets of its tables: order by score, smaller sets, fitness."""

    config: Config
    _found: dict = field(default_factory=dict, repr=False)

    def _once(self, what: str, ds: Dataset, find):
        # The table is kept with the result, so that its identity stays its own.
        key = (what, id(ds.df), tuple(ds.names))
        if key not in self._found:
            self._found[key] = (ds.df, find(ds))
        return self._found[key][1]

    def ranked(self, ds: Dataset) -> list[str]:
        return self._once("ranked", ds, ranked_features)

    def score(self, ds: Dataset) -> tuple[float, float]:
        return self._once("score", ds, self.config.final_scorer.score)

    def select(self, ds: Dataset) -> Dataset:
        return ds.keep(self._once("select", ds, self.config.selector).names)


def search_coefficients(
    total: Dataset, base: Dataset, config: Config = Config(), known: Known | None = None
) -> tuple[float, float, list[tuple]]:
    """Best (share of candidates kept, final size as share of the base) by relative fitness increase.

    Univariate scores are computed once for all shares; for every share the chain of shrinking
    sets is computed once for all sizes; a feature set is scored once. ``known`` carries all of it on.
    """
    known = known or Known(config)
    order = known.ranked(total)
    initial = known.score(base)[0]
    best, rows = (0.0, 0.0, 0.0), []
    for coef1 in config.share_steps:
        keep = round(coef1 * (len(total.names) + 1))
        chosen = total.keep(order[:keep]) if keep < len(total.names) else total
        if not chosen.features:
            continue
        steps, chain = shrink_steps(chosen, known.select), []
        last = len(base.names) + 1
        for coef2 in config.size_steps:
            limit = max(2, round(coef2 * (len(base.names) + 1)))
            if limit > last:
                continue
            while not chain or len(chain[-1].names) + 1 > limit:
                step = next(steps, None)
                if step is None:
                    break
                chain.append(step)
            reached = next((s for s in chain if len(s.names) + 1 <= limit), chain[-1])
            last = len(reached.names) + 1
            fitness = known.score(reached)[0]
            increase = (fitness - initial) / initial if initial else 0.0
            rows.append((coef1, coef2, len(reached.names), fitness, increase))
            if increase > best[2]:
                best = (coef1, coef2, increase)
    return best[0], best[1], rows


def final_selection(
    total: Dataset, base: Dataset, coef1: float, coef2: float, config: Config = Config(), known: Known | None = None
) -> tuple[Dataset, DataFrame]:
    """Coarse univariate cut, then repeated importance selection; a fitness report of every stage."""
    known = known or Known(config)
    keep = round(coef1 * (len(total.names) + 1))
    coarse = total.keep(known.ranked(total)[:keep]) if 0 < keep < len(total.names) else total
    limit = max(2, round(coef2 * (len(base.names) + 1))) if coef2 else len(base.names) + 1
    final = coarse
    for step in shrink_steps(coarse, known.select):
        final = step
        if len(step.names) + 1 <= limit:
            break
    scored = [(name, ds, known.score(ds)) for name, ds in (("base", base), ("coarse", coarse), ("final", final))]
    start = scored[0][2][0]
    rows = [(n, len(d.names), f, s, (f - start) / start if start else 0.0) for n, d, (f, s) in scored]
    report = total.spark.createDataFrame(rows, "stage string, features int, fitness double, std double, increase double")
    return final, report


def run(ds: Dataset, config: Config = Config()) -> RunResult:
    """Generations, coefficient search and final selection on a loaded dataset."""
    base = prepared(ds)
    evolution = evolve(base, config)
    known = Known(config)
    coef1, coef2, _ = search_coefficients(evolution.total, evolution.base, config, known)
    final, report = final_selection(evolution.total, evolution.base, coef1, coef2, config, known)
    if config.folder:
        write_final(final, f"{config.folder.rstrip('/')}/final")
    return RunResult(final, (coef1, coef2), report, evolution)
