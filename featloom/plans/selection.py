"""Choosing a bounded set of features."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import partial
from itertools import product as grid_product

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featloom.dataset import CLASSIFICATION, Dataset
from featloom.operators.batches import batch_matrix
from featloom.operators.expr import Expr, Ref
from featloom.operators.gram import gram_matrices
from featloom.operators.moments import base_exprs, collect_stats, moments_frame
from featloom.operators.sampling import donors, placed_rows
from featloom.operators.univariate import univariate_scores
from featloom.plans.fitness import ForestScorer, permutation_importance, vectors

CORRELATION_LIMIT = 0.98
WIDE_TABLE = 10_000
WIDE_KEEP = 50


def ranked_features(ds: Dataset, exprs: Sequence[Expr] | None = None) -> list[str]:
    """Names by falling univariate score; equal scores keep table order, undefined ones come last."""
    names = ds.names if exprs is None else [e.name for e in exprs]
    scores = {r["feature"]: r["score"] for r in univariate_scores(ds, exprs).collect()}
    position = {n: i for i, n in enumerate(names)}

    def worth(n):
        s = scores.get(n)
        return -math.inf if s is None or math.isnan(s) else s

    return sorted(names, key=lambda n: (-worth(n), position[n]))


def best_features(ds: Dataset, size: int) -> Dataset:
    """The ``size`` features with the best univariate score, in table order."""
    return ds if len(ds.features) <= size else ds.keep(ranked_features(ds)[:size])


def constrain(ds: Dataset, limit: int) -> Dataset:
    """At most ``limit`` columns counting the label; beyond it the ``limit`` best features."""
    return best_features(ds, limit) if len(ds.features) + 1 > limit else ds


def preselect_wide(ds: Dataset, above: int = WIDE_TABLE, keep: int = WIDE_KEEP) -> Dataset:
    """Tables with more than ``above`` columns start from their ``keep`` best features."""
    return best_features(ds, keep) if len(ds.features) + 1 > above else ds


def forest_importances(ds: Dataset, trees: int | None = None, depth: int = 10, seed: int = 10) -> dict[str, float]:
    if ds.task == CLASSIFICATION:
        model = RandomForestClassifier(numTrees=trees or 80, maxDepth=depth, seed=seed, featuresCol="x", labelCol="y")
    else:
        model = RandomForestRegressor(numTrees=trees or 100, maxDepth=depth, seed=seed, featuresCol="x", labelCol="y")
    with ds.dealt() as dealt:
        fitted = model.fit(vectors(dealt, base_exprs(dealt)))
    return dict(zip(ds.names, (float(v) for v in fitted.featureImportances.toArray())))


def important_features(ds: Dataset, trees: int | None = None, depth: int = 10, seed: int = 10) -> Dataset:
    """Features whose forest importance reaches the mean importance."""
    found = forest_importances(ds, trees, depth, seed)
    mean = sum(found.values()) / len(found)
    return ds.keep([n for n, v in found.items() if v >= mean])


def top_important(ds: Dataset, size: int = 10, trees: int = 100, depth: int = 5, seed: int = 10) -> Dataset:
    """The ``size`` features with the largest forest importance."""
    found = forest_importances(ds, trees, depth, seed)
    order = sorted(ds.names, key=lambda n: -found[n])
    return ds.keep(order[:size])


Selector = Callable[[Dataset], Dataset]


def shrink_steps(ds: Dataset, select: Selector = important_features):
    """The dataset and every smaller one that repeated selection gives, until nothing is dropped."""
    while True:
        yield ds
        smaller = select(ds)
        if not smaller.features or len(smaller.features) >= len(ds.features):
            return
        ds = smaller


def shrink(ds: Dataset, limit: int, select: Selector = important_features) -> Dataset:
    """First step with at most ``limit`` features (at least one), or the last step there is."""
    for step in shrink_steps(ds, select):
        ds = step
        if len(step.features) <= max(limit, 1):
            break
    return ds


def correlations(ds: Dataset) -> tuple[list[str], np.ndarray]:
    """Pearson correlations of all feature pairs over complete rows; the matrix is features x features."""
    stats = collect_stats(moments_frame(ds))
    means = np.array([stats[n].mean for n in ds.names])
    scales = np.array([stats[n].std or 1.0 for n in ds.names])
    table = ds.df.select(*[v.alias(f"v{i}") for i, v in enumerate(ds.values().values())])
    count = len(ds.names)
    product = gram_matrices(table, partial(_standard_products, means, scales, count))[(0, 0)]
    n, sums = product[0, 0], product[0, 1:]
    covariance = product[1:, 1:] - np.outer(sums, sums) / n
    deviation = np.sqrt(np.maximum(np.diag(covariance), 0.0))
    bottom = np.outer(deviation, deviation)
    return ds.names, np.where(bottom > 0, covariance / np.where(bottom > 0, bottom, 1.0), np.nan)


def _standard_products(means, scales, count, batch: pa.RecordBatch):
    z = (batch_matrix(batch, 0, count) - means) / scales
    z = z[~np.isnan(z).any(axis=1)]
    design = np.column_stack([np.ones(len(z)), z])
    yield (0, 0), design.T @ design


def drop_correlated(ds: Dataset, limit: float = CORRELATION_LIMIT) -> Dataset:
    """Drop a feature when any feature before it correlates with it beyond ``limit``."""
    names, matrix = correlations(ds)
    strong = np.abs(np.nan_to_num(matrix)) > limit
    return ds.keep([n for j, n in enumerate(names) if not strong[:j, j].any()])


def missing_initial(initial: Sequence[str], current: Sequence[str], previous: Sequence[str]) -> list[str]:
    """Initial features found in neither generation, to be added to the current one."""
    known = {*current, *previous}
    return [n for n in initial if n not in known]


def union_names(*parts: Sequence[str]) -> list[str]:
    """Column union: first occurrence of every name."""
    return list(dict.fromkeys(n for part in parts for n in part))


def permutation_selected(ds: Dataset, share: float = 0.3, repeats: int = 5, seed: int = 0) -> Dataset:
    """The ``share`` of features (rounded up) with the largest permutation importance."""
    rows = permutation_importance(ds, repeats=repeats, seed=seed).orderBy(F.desc("importance"), "feature").collect()
    return ds.keep([r["feature"] for r in rows[: math.ceil(len(ds.features) * share)]])


def forest_search(ds: Dataset, grid: dict[str, Sequence], samples: int | None = None, seed: int = 0) -> DataFrame:
    """Cross-validated fitness per forest setting; ``samples`` draws that many settings of the grid."""
    settings = [dict(zip(grid, values)) for values in grid_product(*grid.values())]
    if samples is not None and samples < len(settings):
        chosen = np.random.default_rng(seed).choice(len(settings), samples, replace=False)
        settings = [settings[i] for i in sorted(chosen)]
    rows = []
    for setting in settings:
        fitness, std = replace(ForestScorer(), **setting).score(ds)
        rows.append((str(setting), fitness, std))
    return ds.spark.createDataFrame(rows, "setting string, fitness double, std double")


@dataclass(frozen=True)
class ShadowResult:
    accepted: tuple[str, ...]
    rejected: tuple[str, ...]
    undecided: tuple[str, ...]


def shadow_selection(
    ds: Dataset, rounds: int = 20, alpha: float = 0.05, trees: int = 50, depth: int = 5, seed: int = 1
) -> ShadowResult:
    """All-relevant selection: a feature must beat the best permuted copy more often than chance.

    Each round pairs every row with a donor row for the shadow columns, fits one forest on real
    and shadow columns, and counts hits. Decisions use the binomial tail, Bonferroni corrected.
    """
    open_names, hits = list(ds.names), dict.fromkeys(ds.names, 0)
    accepted: list[str] = []
    rejected: list[str] = []
    # The rows' positions are the same in every round.
    placed = placed_rows(ds)
    for done in range(1, rounds + 1):
        live = [*accepted, *open_names]
        if not open_names:
            break
        current = ds.keep(live)
        paired = donors(current, current.columns, "shadow_", seed + done, placed=placed)
        both = Dataset.of(paired.df, [*current.columns, *["shadow_" + c for c in current.columns]], ds.label, ds.task, ds.row_id)
        found = forest_importances(both, trees, depth, seed + done)
        best = max(v for n, v in found.items() if n.startswith("shadow_"))
        column = current.by_name
        for n in open_names:
            hits[n] += found[column[n]] > best
        level = alpha / len(ds.names)
        for n in list(open_names):
            if _upper_tail(hits[n], done) <= level:
                accepted.append(n)
                open_names.remove(n)
            elif _upper_tail(done - hits[n], done) <= level:
                rejected.append(n)
                open_names.remove(n)
    return ShadowResult(tuple(accepted), tuple(rejected), tuple(open_names))


def _upper_tail(successes: int, trials: int) -> float:
    """Probability of at least ``successes`` heads in ``trials`` fair tosses."""
    return sum(math.comb(trials, k) for k in range(successes, trials + 1)) / 2.0**trials
