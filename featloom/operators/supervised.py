"""Feature builders that need the label: a model's prediction and a model of its error."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featloom.dataset import CLASSIFICATION, REGRESSION, Dataset, Feature, as_double, quoted
from featloom.operators.batches import append_vector
from featloom.operators.boosting import DEPTH, ROUNDS, HistogramBoosting
from featloom.operators.dual import ROUNDS as SVM_ROUNDS
from featloom.operators.dual import DualAscent
from featloom.operators.fitted import assembled
from featloom.operators.gram import gram_matrices
from featloom.operators.linear import GramRegression
from featloom.operators.moments import stats_of
from featloom.operators.network import NetworkEmbedding  # noqa: F401
from featloom.operators.ordering import forward_fill
from featloom.operators.process import DOT, RATIONAL, RBF, InducingProcess
from featloom.operators.unary import fourier_weights
from featloom.plans.fitness import class_count
from featloom.plans.selection import _standard_products, top_important

FOURIER_FEATURES = 64
TREE_DEPTH = 4
FULL_DEPTH = 12
LEAKY_COLUMNS = 10


@dataclass(frozen=True)
class FourierMap:
    """Standardised inputs through random Fourier features of a shift-invariant kernel."""

    means: np.ndarray
    scales: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    @classmethod
    def fit(cls, ds: Dataset, outputs: int = FOURIER_FEATURES, seed: int = 0) -> FourierMap:
        stats = stats_of(ds)
        d = len(ds.names)
        weights, bias = fourier_weights(d, outputs, 1.0 / d, seed)
        return cls(
            np.array([stats[n].mean for n in ds.names]), np.array([stats[n].std or 1.0 for n in ds.names]), weights, bias
        )

    def matrix(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(2.0 / len(self.bias)) * np.cos((x - self.means) / self.scales @ self.weights + self.bias)


def fitted_means(ds: Dataset) -> dict[str, float]:
    """Mean of the finite values of every feature; 0 where there is none."""
    stats = stats_of(ds.with_df(ds.df.withColumns(_finite_values(ds))))
    return {n: 0.0 if np.isnan(s.mean) else s.mean for n, s in stats.items()}


def _finite_values(ds: Dataset) -> dict[str, Column]:
    return {f.column: F.when(F.abs(ds.value(f.name)) != float("inf"), ds.value(f.name)) for f in ds.features}


def filled_forward(ds: Dataset, means: Mapping[str, float]) -> Dataset:
    """No gap left: :func:`complete_rows_forward`, then the fitted mean where no row before has a value."""
    done = complete_rows_forward(ds)
    if done is ds:
        return ds
    return done.with_df(done.df.withColumns({f.column: F.coalesce(quoted(f.column), F.lit(means[f.name])) for f in done.features}))


def complete_rows_forward(ds: Dataset) -> Dataset:
    """Infinity as missing, missing values from the last row before that has one."""
    finite = _finite_values(ds)
    if not finite or ds.df.agg(F.max(reduce(or_, [c.isNull() for c in finite.values()]))).first()[0] is False:
        return ds
    if ds.row_id is None:
        raise ValueError("filling forward needs a row id")
    return ds.with_df(forward_fill(ds.df.withColumns(finite), ds.columns, ds.row_id))


Estimator = Callable[[int], object]


@dataclass(frozen=True)
class StackResidual:
    """Append ``<name>_pred`` and ``<name>_pred_diff``.

    The second model sees the features and the prediction; its target is the residual
    (regression) or whether the prediction is right (classification). It is left out when a
    classifier is always right or always wrong.
    """

    name: str
    task: str
    estimator: Callable[[int], object]
    kernel: bool = False
    seed: int = 0
    drawn: bool = True

    def fit(self, ds: Dataset) -> FittedStack:
        means = fitted_means(ds)
        ds = filled_forward(ds, means)
        if not self.drawn:
            return self._fitted(ds, means)
        # Only fits that draw per partition need their rows dealt by content.
        with ds.dealt() as dealt:
            return self._fitted(dealt, means)

    def _fitted(self, ds: Dataset, means: Mapping[str, float]) -> FittedStack:
        # Labels are class codes, of which some may not occur.
        classes = class_count(ds) if self.task == CLASSIFICATION else 0
        map1 = FourierMap.fit(ds, seed=self.seed) if self.kernel else None
        first = _fit_model(self.estimator(classes), _inputs(ds, map1), as_double(quoted(ds.label)))
        stage = FittedStack(self, map1, first, None, None, means)
        predicted = stage.predict(ds, f"__{self.name}_pred")
        if not self.drawn:
            return self._with_error(stage, predicted)
        # The second model's jobs read the predictions again.
        kept = predicted.df.persist(StorageLevel.DISK_ONLY)
        try:
            return self._with_error(stage, predicted)
        finally:
            kept.unpersist()

    def _with_error(self, stage: FittedStack, predicted: Dataset) -> FittedStack:
        column, label = quoted(f"__{self.name}_pred"), as_double(quoted(predicted.label))
        if self.task == CLASSIFICATION:
            right = (label == column).cast("double")
            span = predicted.df.agg(F.min(right).alias("lo"), F.max(right).alias("hi")).collect()[0]
            if span["lo"] == span["hi"]:
                return stage
            target = right
        else:
            target = label - column
        map2 = FourierMap.fit(predicted, seed=self.seed + 1) if self.kernel else None
        second = _fit_model(self.estimator(2 if self.task == CLASSIFICATION else 0), _inputs(predicted, map2), target)
        return FittedStack(self, stage.map1, stage.first, map2, second, stage.means)


@dataclass(frozen=True)
class FittedStack:
    spec: StackResidual
    map1: FourierMap | None
    first: object
    map2: FourierMap | None
    second: object | None
    means: Mapping[str, float]

    def predict(self, ds: Dataset, column: str) -> Dataset:
        df = _apply_model(self.first, _inputs(ds, self.map1), column)
        return Dataset(df, (*ds.features, Feature(f"{self.spec.name}_pred", column)), ds.label, ds.task, ds.row_id)

    def transform(self, ds: Dataset) -> Dataset:
        done = self.predict(filled_forward(ds, self.means), f"__{self.spec.name}_pred")
        if self.second is None:
            return done
        column = f"__{self.spec.name}_pred_diff"
        df = _apply_model(self.second, _inputs(done, self.map2), column)
        added = Feature(f"{self.spec.name}_pred_diff", column)
        return Dataset(df, (*done.features, added), ds.label, ds.task, ds.row_id)


def _inputs(ds: Dataset, fourier: FourierMap | None) -> DataFrame:
    """All columns and the model input vector ``__x``."""
    if fourier is None:
        return assembled(ds.df, ds.columns)
    arrays = append_vector(ds.df, ds.columns, "__a", fourier.matrix)
    return arrays.withColumn("__x", array_to_vector("__a")).drop("__a")


def _fit_model(estimator, inputs: DataFrame, target: Column):
    return estimator.fit(inputs.select("__x", target.alias("__y")).filter(F.col("__y").isNotNull()))


def _apply_model(model, inputs: DataFrame, column: str) -> DataFrame:
    predicted = model.transform(inputs)
    kept = [quoted(c) for c in inputs.columns if c != "__x"]
    return predicted.select(*kept, F.col("__p").alias(column))


_COLUMNS = {"featuresCol": "__x", "labelCol": "__y", "predictionCol": "__p"}


def linear_regression(seed: int = 0) -> StackResidual:
    return StackResidual("linear", REGRESSION, lambda k: GramRegression(), seed=seed, drawn=False)


def support_vector_regression(seed: int = 0, rounds: int = SVM_ROUNDS) -> StackResidual:
    return StackResidual("svr", REGRESSION, lambda k: DualAscent(rounds=rounds), kernel=True, seed=seed, drawn=False)


def support_vector_classification(seed: int = 0, rounds: int = SVM_ROUNDS) -> StackResidual:
    return StackResidual("svc", CLASSIFICATION, lambda k: DualAscent(max(k, 2), rounds=rounds), kernel=True, seed=seed, drawn=False)


def _suffix(task: str) -> str:
    return "cla" if task == CLASSIFICATION else "reg"


def dot_product_process(task: str, seed: int = 0) -> StackResidual:
    return StackResidual(f"gaudotwhite_{_suffix(task)}", task, lambda k: InducingProcess(DOT, k), seed=seed, drawn=False)


def rational_quadratic_process(task: str, seed: int = 0) -> StackResidual:
    return StackResidual(f"gauexp_{_suffix(task)}", task, lambda k: InducingProcess(RATIONAL, k), seed=seed, drawn=False)


def rbf_process(task: str, seed: int = 0) -> StackResidual:
    return StackResidual(f"gaurbf_{_suffix(task)}", task, lambda k: InducingProcess(RBF, k), seed=seed, drawn=False)


def random_forest(task: str, seed: int = 0, trees: int = 100, depth: int = 10) -> StackResidual:
    if task == CLASSIFICATION:
        make = lambda k: RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, **_COLUMNS)
        return StackResidual("rfc", task, make, seed=seed)
    make = lambda k: RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed, **_COLUMNS)
    return StackResidual("rfr", task, make, seed=seed)


def gradient_boosting(task: str, seed: int = 0, rounds: int = ROUNDS, depth: int = DEPTH) -> StackResidual:
    """Histogram boosting; nothing in it is drawn, so ``seed`` changes nothing."""
    name = "xgb_cla" if task == CLASSIFICATION else "xgb_reg"
    return StackResidual(name, task, lambda k: HistogramBoosting(k, rounds, depth), seed=seed, drawn=False)


def _tree(task: str, depth: int, seed: int):
    kind = DecisionTreeClassifier if task == CLASSIFICATION else DecisionTreeRegressor
    return kind(maxDepth=depth, seed=seed, **_COLUMNS)


_STEP = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)$")


def tree_paths(debug: str) -> list[list[tuple[int, str, float]]]:
    """Conditions on the way to every node, in depth-first order; the root has none."""
    paths: list[list[tuple[int, str, float]]] = [[]]
    open_steps: list[tuple[int, tuple[int, str, float]]] = []
    for line in debug.splitlines():
        found = _STEP.match(line)
        if found:
            indent = len(found.group(1))
            while open_steps and open_steps[-1][0] >= indent:
                open_steps.pop()
            open_steps.append((indent, (int(found.group(2)), found.group(3), float(found.group(4)))))
            paths.append([step for _, step in open_steps])
    return paths


@dataclass(frozen=True)
class TreeFeatures:
    """``dt_n_*``: share of the fitted rows at every node on a row's path; then prediction and error."""

    task: str
    shares: tuple[float, ...]
    paths: tuple
    stack: FittedStack

    @classmethod
    def fit(cls, ds: Dataset, depth: int = TREE_DEPTH, full_depth: int = FULL_DEPTH, seed: int = 0) -> TreeFeatures:
        model = _fit_model(_tree(ds.task, depth, seed), _inputs(ds, None), as_double(quoted(ds.label)))
        paths = tuple(tuple(p) for p in tree_paths(model.toDebugString))
        row = ds.df.agg(
            F.count(F.lit(1)).alias("rows"), *[F.count_if(_passes(ds, p)).alias(f"n{i}") for i, p in enumerate(paths)]
        ).collect()[0]
        shares = tuple(row[f"n{i}"] / row["rows"] for i in range(len(paths)))
        suffix = _suffix(ds.task)
        spec = StackResidual(f"dt_{suffix}", ds.task, lambda k: _tree(ds.task, full_depth, seed), seed=seed)
        return cls(ds.task, shares, paths, spec.fit(_node_shares(ds, paths, shares)))

    def transform(self, ds: Dataset) -> Dataset:
        return self.stack.transform(_node_shares(ds, self.paths, self.shares))


def _passes(ds: Dataset, path) -> Column:
    condition = F.lit(True)
    for feature, sign, threshold in path:
        x = ds.value(ds.names[feature])
        condition = condition & (x <= F.lit(threshold) if sign == "<=" else x > F.lit(threshold))
    return condition


def _node_shares(ds: Dataset, paths, shares) -> Dataset:
    ds = ds.as_plain()
    suffix = _suffix(ds.task)
    added = {
        f"dt_n_{suffix}_{i}": F.when(_passes(ds, p), F.lit(s)).otherwise(F.lit(0.0))
        for i, (p, s) in enumerate(zip(paths, shares))
    }
    return ds.derived({**ds.values(), **added})


@dataclass(frozen=True)
class LeakyInfo:
    """``<c>_leaky``: what the other columns predict for ``c`` minus ``c``, for at most ten columns."""

    models: dict

    @classmethod
    def fit(cls, ds: Dataset, limit: int = LEAKY_COLUMNS, seed: int = 0) -> LeakyInfo:
        chosen = top_important(ds, limit, seed=seed) if len(ds.names) >= limit else ds
        names = chosen.names
        stats = stats_of(chosen)
        means = np.array([stats[n].mean for n in names])
        scales = np.array([stats[n].std or 1.0 for n in names])
        table = chosen.df.select(*[v.alias(f"v{i}") for i, v in enumerate(chosen.values().values())])
        count = len(names)
        # Every regression of one column on the others follows from the same inner products.
        gram = gram_matrices(table, lambda batch: _standard_products(means, scales, count, batch))[(0, 0)]
        models = {}
        for i, name in enumerate(names):
            others = [j for j in range(count + 1) if j != i + 1]
            solved = np.linalg.lstsq(gram[np.ix_(others, others)], gram[others, i + 1], rcond=None)[0]
            slopes = {names[j - 1]: solved[o] * scales[i] / scales[j - 1] for o, j in enumerate(others) if j}
            base = solved[0] * scales[i] + means[i] - sum(slopes[n] * means[names.index(n)] for n in slopes)
            models[name] = (float(base), {n: float(v) for n, v in slopes.items()})
        return cls(models)

    def transform(self, ds: Dataset) -> Dataset:
        ds = ds.as_plain()
        base = ds.values()
        added = {}
        for name, (start, slopes) in self.models.items():
            guess = reduce(lambda a, b: a + b, [base[n] * F.lit(v) for n, v in slopes.items()], F.lit(start))
            added[f"{name}_leaky"] = guess - base[name]
        return ds.derived({**base, **added})
