"""Cross-validated fitness of feature sets.

Two scorers answer with the same metric (weighted F1, or 1 - relative absolute error).
``ForestScorer`` fits random forests, five per feature set. ``LinearScorer`` scores any number
of feature sets in two passes over the table: the first sums inner products per set and fold,
from which every fold's least-squares model follows on the driver; the second counts the
out-of-fold predictions of all models at once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featloom.dataset import CLASSIFICATION, Dataset, as_double, quoted
from featloom.functions.metrics import confusion, f1_of_matrix, relative_absolute_error, weighted_f1
from featloom.functions.summary import FeatureStats
from featloom.operators.batches import batch_matrix
from featloom.operators.cell_forest import forest_of_cells
from featloom.operators.expr import Expr, Ref, refs, to_array, to_column
from featloom.operators.folds import FOLD
from featloom.operators.forest import ForestArrays
from featloom.operators.gram import gram_matrices
from featloom.operators.moments import stats_of
from featloom.operators.sampling import donors, holdout
from featloom.session import run_parallel

FOLDS = 5
Score = tuple[float, float]

_EXPRS_PER_PASS = 512
_BYTES_PER_PASS = 16 << 20
# Products that a scorer keeps on the driver.
_BYTES_KEPT = 64 << 20


def check_complete(stats: Mapping[str, FeatureStats], names: Sequence[str]) -> None:
    """Scoring needs complete features."""
    missing = [n for n in names if stats[n].nulls]
    if missing:
        raise ValueError(f"features with missing values cannot be scored: {missing[:5]}")


def class_count(ds: Dataset) -> int:
    return int(ds.df.agg(F.max(quoted(ds.label))).collect()[0][0]) + 1


def summarise(scores: Sequence[float], task: str) -> Score:
    values = np.asarray(scores, dtype=float)
    mean = values.mean() if task == CLASSIFICATION else 1.0 - values.mean()
    return float(mean), float(values.std())


@dataclass
class LinearScorer:
    """Least squares on standardised features; classes as indicator targets, largest wins."""

    ridge: float = 1e-9
    _classes: dict = field(default_factory=dict, repr=False)
    _products: dict = field(default_factory=dict, repr=False)

    def score(self, ds: Dataset, exprs: Sequence[Expr] | None = None, stats: Mapping[str, FeatureStats] | None = None) -> Score:
        return self.score_many(ds, [[Ref(n) for n in ds.names] if exprs is None else list(exprs)], stats)[0]

    def score_many(
        self, ds: Dataset, groups: Sequence[Sequence[Expr]], stats: Mapping[str, FeatureStats] | None = None
    ) -> list[Score]:
        """(fitness, standard deviation over folds) of every group. The table needs a fold column."""
        if not groups:
            return []
        unique = list({e.name: e for g in groups for e in g}.values())
        stats = stats_of(ds, unique) if stats is None else stats
        check_complete(stats, [e.name for e in unique])
        classes = self._class_count(ds) if ds.task == CLASSIFICATION else 0
        scores: list[Score] = []
        for part in _passes(groups, classes):
            scores += self._score_pass(ds, part, stats, classes)
        return scores

    def sum_together(self, ds: Dataset, sets: Sequence[Sequence[Expr]], stats: Mapping[str, FeatureStats], widest: int | None = None) -> None:
        """Sum the inner products of whole sets, and keep them for the groups inside these sets that are scored later.

        Sets of more than ``widest`` expressions, or with products beyond a pass, are left to their groups; so are those
        beyond the bytes that are kept, the oldest of which go first.
        """
        classes = self._class_count(ds) if ds.task == CLASSIFICATION else 0
        wanted = []
        for own in sets:
            own = list({e.name: e for e in own}.values())
            fits = (widest is None or len(own) <= widest) and _cost(len(own), classes) <= _BYTES_PER_PASS
            if fits and self._known_products(ds, own, stats) is None:
                wanted.append(own)
        check_complete(stats, list({e.name for own in wanted for e in own}))
        for part in _passes(wanted, classes):
            unique, _, split, table = _pass_of(ds, part, stats, classes)
            position = {e.name: i for i, e in enumerate(unique)}
            found = gram_matrices(table, partial(_products, split, [np.array([position[e.name] for e in own], dtype=int) for own in part]))
            for g, own in enumerate(part):
                places = {e.name: i for i, e in enumerate(own)}
                self._products["kept"].append((places, {f: m for (b, f), m in found.items() if b == g}))
        while len(kept := self._products.get("kept", ())) > 1 and sum(m.nbytes for _, found in kept for m in found.values()) > _BYTES_KEPT:
            del kept[0]

    def _known_products(self, ds: Dataset, group: Sequence[Expr], stats) -> dict[int, np.ndarray] | None:
        """Products of the group per fold, cut out of those of a set that holds it."""
        if self._products.get("table") is not ds.df or self._products.get("stats") is not stats:
            self._products = {"table": ds.df, "stats": stats, "kept": []}
        for places, found in self._products["kept"]:
            if all(e.name in places for e in group):
                rows = np.array([0, *[places[e.name] + 1 for e in group]])
                return {f: m[np.ix_(rows, [*rows, *range(len(places) + 1, m.shape[1])])] for f, m in found.items()}
        return None

    def _class_count(self, ds: Dataset) -> int:
        if self._classes.get("table") is not ds.df:
            self._classes = {"table": ds.df, "count": class_count(ds)}
        return self._classes["count"]

    def _score_pass(self, ds, groups, stats, classes) -> list[Score]:
        _, members, split, table = _pass_of(ds, groups, stats, classes)
        grams = {}
        unknown = []
        for g, group in enumerate(groups):
            found = self._known_products(ds, group, stats)
            if found is None:
                unknown.append(g)
            else:
                grams.update({(g, f): m for f, m in found.items()})
        if unknown:
            _, inside, only, narrow = _pass_of(ds, [groups[g] for g in unknown], stats, classes)
            found = gram_matrices(narrow, partial(_products, only, inside))
            grams.update({(unknown[b], f): m for (b, f), m in found.items()})
        models, centres = {}, {}
        for g, columns in enumerate(members):
            d = len(columns) + 1
            folds = sorted(f for b, f in grams if b == g)
            total = sum(grams[(g, f)] for f in folds)
            for f in folds:
                train = total - grams[(g, f)]
                system = train[:, :d] + self.ridge * max(train[0, 0], 1.0) * np.eye(d)
                models[(g, f)] = np.linalg.lstsq(system, train[:, d:], rcond=None)[0]
                centres[f] = grams[(g, f)][0, d] / max(grams[(g, f)][0, 0], 1.0)
        outcomes = gram_matrices(table, partial(_outcomes, split, members, models, centres, classes))
        result = []
        for g in range(len(groups)):
            per_fold = [outcomes[key] for key in sorted(outcomes) if key[0] == g]
            if classes:
                result.append(summarise([f1_of_matrix(m) for m in per_fold], ds.task))
            else:
                result.append(summarise([m[0, 0] / m[0, 1] if m[0, 1] else np.nan for m in per_fold], ds.task))
        return result


def _cost(size: int, classes: int) -> int:
    """Bytes of the products of a set of features in a task."""
    return 8 * FOLDS * (size + 1) * (size + 1 + max(classes, 1))


def _passes(groups, classes):
    """Split the groups so that one pass stays within fixed memory per task."""
    part, names, size = [], set(), 0
    for group in groups:
        cost = _cost(len(group), classes)
        grown = names | {e.name for e in group}
        if part and (len(grown) > _EXPRS_PER_PASS or size + cost > _BYTES_PER_PASS):
            yield part
            part, names, size = [], set(), 0
            grown = {e.name for e in group}
        part.append(group)
        names, size = grown, size + cost
    if part:
        yield part


def _pass_of(ds: Dataset, groups, stats, classes):
    """The expressions of the groups, the groups' places among them, how a batch is split, and the table that is read."""
    unique = list({e.name: e for g in groups for e in g}.values())
    position = {e.name: i for i, e in enumerate(unique)}
    members = [np.array([position[e.name] for e in g], dtype=int) for g in groups]
    needed = sorted(set().union(*(refs(e) for e in unique)))
    means = np.array([stats[e.name].mean for e in unique])
    scales = np.array([stats[e.name].std or 1.0 for e in unique])
    table = ds.df.select(
        F.col(FOLD).cast("int").alias("fold"),
        as_double(quoted(ds.label)).alias("y"),
        *[ds.value(n).alias(f"b{i}") for i, n in enumerate(needed)],
    )
    return unique, members, partial(_folded, unique, needed, means, scales, classes), table


def _folded(unique, needed, means, scales, classes, batch: pa.RecordBatch):
    """(fold, design, targets, label) of every fold present in the batch; a feature is a row of the design, ones are the first.

    The rows of the table are brought into the order of their folds, so that a fold is a stretch of each feature.
    """
    fold = batch.column(0).to_numpy(zero_copy_only=False)
    order = np.argsort(fold, kind="stable")
    fold = fold[order]
    y = batch.column(1).to_numpy(zero_copy_only=False).astype(float)[order]
    values = {n: batch.column(2 + i).to_numpy(zero_copy_only=False).astype(float)[order] for i, n in enumerate(needed)}
    design = np.empty((len(unique) + 1, len(order)))
    design[0] = 1.0
    with np.errstate(all="ignore"):
        for row, e, mean, scale in zip(design[1:], unique, means, scales):
            np.subtract(to_array(e, values), mean, out=row)
            row /= scale
            if not np.isfinite(row).all():
                np.nan_to_num(row, copy=False, posinf=0.0, neginf=0.0)
    targets = np.eye(classes)[y.astype(int)] if classes else y[:, None]
    found, starts = np.unique(fold, return_index=True)
    for f, start, stop in zip(found, starts, [*starts[1:], len(order)]):
        yield int(f), design[:, start:stop], targets[start:stop], y[start:stop]


def _products(split, members, batch):
    for f, design, targets, _ in split(batch):
        for g, columns in enumerate(members):
            a = design[np.concatenate([[0], columns + 1])]
            yield (g, f), np.concatenate([a @ a.T, a @ targets], axis=1)


def _outcomes(split, members, models, centres, classes, batch):
    for f, design, _, y in split(batch):
        if classes:
            # Where the matrix of the cells begins the row's class.
            begins = y.astype(int) * classes
        for g, columns in enumerate(members):
            predicted = models[(g, f)].T @ design[np.concatenate([[0], columns + 1])]
            if classes:
                cells = np.bincount(begins + predicted.argmax(axis=0), minlength=classes * classes)
                yield (g, f), cells.reshape(classes, classes).astype(float)
            else:
                error = np.abs(y - predicted[0]).sum()
                yield (g, f), np.array([[error, np.abs(y - centres[f]).sum()]])


@dataclass
class ForestScorer:
    """Random forest per fold, as many fits at a time as ``width``."""

    trees: int = 150
    depth: int = 10
    min_leaf: int = 1
    seed: int = 10
    width: int = 4

    def estimator(self, task: str):
        kind = RandomForestClassifier if task == CLASSIFICATION else RandomForestRegressor
        return kind(
            numTrees=self.trees,
            maxDepth=self.depth,
            minInstancesPerNode=self.min_leaf,
            seed=self.seed,
            featuresCol="x",
            labelCol="y",
            predictionCol="predicted",
        )

    def score(self, ds: Dataset, exprs: Sequence[Expr] | None = None, stats=None) -> Score:
        exprs = [Ref(n) for n in ds.names] if exprs is None else list(exprs)
        table = vectors(ds, exprs, [F.col(FOLD).alias("fold")]).persist()
        try:
            folds = sorted(r[0] for r in table.select("fold").distinct().collect())
            scores = run_parallel(ds.spark, [partial(self._fold_score, table, ds.task, f) for f in folds], self.width)
        finally:
            table.unpersist()
        return summarise(scores, ds.task)

    def score_many(self, ds: Dataset, groups: Sequence[Sequence[Expr]], stats=None) -> list[Score]:
        return [self.score(ds, g) for g in groups]

    def _fold_score(self, table: DataFrame, task: str, fold: int) -> float:
        model = self.estimator(task).fit(table.filter(F.col("fold") != fold))
        return metric(model.transform(table.filter(F.col("fold") == fold)), task)


@dataclass
class HoldoutScorer:
    """Mean over repeated 75/25 splits; regression is judged by 1 - mean absolute error."""

    repeats: int = 3
    trees: int = 100
    depth: int = 10
    seed: int = 0

    def score(self, ds: Dataset, exprs: Sequence[Expr] | None = None, stats=None) -> Score:
        exprs = [Ref(n) for n in ds.names] if exprs is None else list(exprs)
        forest = ForestScorer(self.trees, self.depth, seed=self.seed)

        def once(repeat: int) -> float:
            train, test = holdout(ds, seed=self.seed + repeat)
            model = forest.estimator(ds.task).fit(vectors(train, exprs))
            found = model.transform(vectors(test, exprs))
            if ds.task != CLASSIFICATION:
                return 1.0 - found.agg(F.avg(F.abs(F.col("y") - F.col("predicted")))).collect()[0][0]
            counts = confusion(found, "y", "predicted")
            cells = {(r["actual"], r["predicted"]): r["n"] for r in counts.collect()}
            if len({p for _, p in cells}) > 2 or sum(cells.values()) > 2:
                return weighted_f1(counts).collect()[0]["f1"]
            hits = cells.get((1.0, 1.0), 0)
            both = sum(n * ((a == 1.0) + (p == 1.0)) for (a, p), n in cells.items())
            return 2.0 * hits / both if both else 0.0

        scores = np.array(run_parallel(ds.spark, [partial(once, r) for r in range(self.repeats)]))
        return float(scores.mean()), float(scores.std())

    def score_many(self, ds: Dataset, groups: Sequence[Sequence[Expr]], stats=None) -> list[Score]:
        return [self.score(ds, g) for g in groups]


def vectors(ds: Dataset, exprs: Sequence[Expr], extra: Sequence = ()) -> DataFrame:
    """Columns x (vector of the expressions), y and ``extra``."""
    values = ds.values()
    wide = ds.df.select(
        as_double(quoted(ds.label)).alias("y"), *extra, *[to_column(e, values).alias(f"v{i}") for i, e in enumerate(exprs)]
    )
    names = [f"v{i}" for i in range(len(exprs))]
    return VectorAssembler(inputCols=names, outputCol="x", handleInvalid="error").transform(wide).drop(*names)


def metric(predicted: DataFrame, task: str) -> float:
    """Weighted F1, or the relative absolute error, of columns y and predicted."""
    if task == CLASSIFICATION:
        return weighted_f1(confusion(predicted, "y", "predicted")).collect()[0]["f1"]
    return relative_absolute_error(predicted, "y", "predicted").collect()[0]["rae"]


def score_compare(base: Dataset, candidate: Dataset, scorer) -> DataFrame:
    """One row: fitness of the base features, of the candidates, and the relative increase."""
    initial, initial_std = scorer.score(base)
    current, current_std = scorer.score(candidate)
    increase = (current - initial) / initial if initial else float("nan")
    return base.spark.createDataFrame(
        [(initial, initial_std, current, current_std, increase)],
        "initial double, initial_std double, current double, current_std double, increase double",
    )


def baseline_scores(datasets: Mapping[str, Dataset], scorer) -> DataFrame:
    """Columns dataset, features, fitness, std: every dataset scored as loaded."""
    rows = [(name, len(ds.names), *scorer.score(ds)) for name, ds in datasets.items()]
    spark = next(iter(datasets.values())).spark
    return spark.createDataFrame(rows, "dataset string, features int, fitness double, std double")


def permutation_importance(ds: Dataset, forest: ForestScorer | None = None, repeats: int = 5, seed: int = 0) -> DataFrame:
    """Columns feature, importance: mean loss of the metric when one feature's values are permuted.

    A forest of classes over many rows is fitted on the cells of its bins. Permuted values come from a donor row. All features are scored in one pass per repeat: a batch is
    evaluated as it is, then with one column replaced after the other, by the trees that look at it.
    """
    forest = forest or ForestScorer(trees=100)
    train, test = holdout(ds, seed=seed)
    estimator = forest.estimator(ds.task)
    arrays = forest_of_cells(train, estimator) if ds.task == CLASSIFICATION else None
    if arrays is None:
        arrays = ForestArrays.of(ds.spark, estimator.fit(vectors(train, [Ref(n) for n in ds.names])))
    losses = np.zeros(len(ds.names))
    centre = 0.0
    if ds.task != CLASSIFICATION:
        centre = test.df.agg(F.avg(as_double(quoted(ds.label)))).first()[0] or 0.0
    for repeat in range(repeats):
        paired = donors(test, test.columns, "__d_", seed + repeat)
        table = paired.df.select(
            as_double(quoted(ds.label)).alias("y"),
            *[as_double(quoted(c)).alias(f"x{i}") for i, c in enumerate(test.columns)],
            *[as_double(quoted("__d_" + c)).alias(f"d{i}") for i, c in enumerate(test.columns)],
        )
        outcomes = gram_matrices(table, partial(_replaced_outcomes, arrays, len(ds.names), centre))
        quality = {v: _outcome_metric(outcomes[(v, 0)], ds.task) for v in range(len(ds.names) + 1)}
        losses += np.array([quality[0] - quality[j + 1] for j in range(len(ds.names))])
    rows = [(n, float(v)) for n, v in zip(ds.names, losses / repeats)]
    return ds.spark.createDataFrame(rows, "feature string, importance double")


def _replaced_outcomes(forest: ForestArrays, width: int, centre: float, batch: pa.RecordBatch):
    """Confusion counts, or errors of the prediction and of the mean, of every variant."""
    y = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
    known = ~np.isnan(y)
    y = y[known]
    x, other = (batch_matrix(batch, 1 + at, width)[known] for at in (0, width))
    for variant, predicted in forest.replaced(x, other):
        if forest.classes:
            cells = np.bincount(y.astype(int) * forest.classes + predicted.astype(int), minlength=forest.classes**2)
            yield (variant, 0), cells.reshape(forest.classes, -1).astype(float)
        else:
            yield (variant, 0), np.array([[np.abs(y - predicted).sum(), np.abs(y - centre).sum()]])


def _outcome_metric(outcome: np.ndarray, task: str) -> float:
    if task == CLASSIFICATION:
        return f1_of_matrix(outcome)
    return 1.0 - (outcome[0, 0] / outcome[0, 1] if outcome[0, 1] else float("nan"))
