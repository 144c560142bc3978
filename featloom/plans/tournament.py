"""Competition between feature groups: inside an operator's tribe, then between tribes.

Names are moved on the driver; every step scores all groups of all tribes in one call, so the
number of Spark jobs depends on the number of rounds and not on the number of tribes.
"""

from __future__ import annotations

import math
import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from featloom.dataset import Dataset
from featloom.functions.scalar import OPERATOR_NAMES
from featloom.functions.summary import FeatureStats
from featloom.operators.catalog import DEFAULT_SET, OperatorSet, surviving
from featloom.operators.expr import Expr
from featloom.operators.sampling import random_groups

# Fixed values of the competition.
OPERATOR_SHARE = 0.9
SEARCH_RANGE = 20
WEIGHT_STEP = 0.5
# Largest tribe whose products are summed as a whole: beyond it, those of pairs from different groups cost more than a pass.
TRIBE_TOGETHER = 128


@dataclass(frozen=True)
class Group:
    names: tuple[str, ...]
    fitness: float
    std: float = 0.0


@dataclass
class Arena:
    """A table with folds, the candidate expressions over it, their statistics and a scorer."""

    ds: Dataset
    scorer: object
    exprs: dict[str, Expr]
    stats: dict[str, FeatureStats]
    seed: int = 0
    _known: dict = field(default_factory=dict, repr=False)

    def score(self, groups: Sequence[Sequence[str]]) -> list[Group]:
        """Score groups by name; a group already scored is not scored again."""
        keys = [tuple(sorted(g)) for g in groups]
        new = [k for k in dict.fromkeys(keys) if k not in self._known]
        found = self.scorer.score_many(self.ds, [[self.exprs[n] for n in k] for k in new], self.stats)
        self._known.update(zip(new, found))
        return [Group(tuple(g), *self._known[k]) for g, k in zip(groups, keys)]

    def expect(self, sets: Sequence[Sequence[str]], widest: int | None = None) -> None:
        """Tell the scorer of sets whose subsets are scored next; one that can share work between them does."""
        if hasattr(self.scorer, "sum_together"):
            self.scorer.sum_together(self.ds, [[self.exprs[n] for n in s] for s in sets], self.stats, widest)

    def split(self, names: Sequence[str], n: int) -> list[list[str]]:
        self.seed += 1
        return random_groups(names, n, self.seed)


def initial_weights(generations: int, names: Sequence[str] = tuple(OPERATOR_NAMES)) -> dict[str, float]:
    return dict.fromkeys(names, float(generations))


def sample_operators(weights: Mapping[str, float], share: float = OPERATOR_SHARE, seed: int = 0) -> list[str]:
    """Draw without replacement, probability by weight: the largest keys u^(1/w) win."""
    rng = random.Random(seed)
    keys = {name: rng.random() ** (1.0 / w) for name, w in weights.items() if w > 0}
    return sorted(keys, key=lambda n: -keys[n])[: round(share * len(keys))]


def new_candidates(
    ds: Dataset, previous: Sequence[str], operators: Sequence[str], seed: int = 0, limit: int | None = None, rules: OperatorSet = DEFAULT_SET
) -> tuple[dict[str, list[Expr]], dict[str, FeatureStats]]:
    """Children of every operator that are valid and survive cleaning, and their statistics.

    All candidates are judged in a distributed catalog; the ``limit`` best of an operator by univariate
    score come back (all, without one).
    """
    return surviving(ds, operators, previous, seed, limit, rules)


def inner_competition(arena: Arena, tribes: Mapping[str, Sequence[str]], groups: Mapping[str, int]) -> dict[str, list[Group]]:
    """Deal every tribe into groups and rank them by rising fitness."""
    dealt = [(op, g) for op, names in tribes.items() for g in arena.split(names, groups[op])]
    # Later contests inside a tribe need its products only.
    arena.expect(list(tribes.values()), TRIBE_TOGETHER)
    scored = arena.score([g for _, g in dealt])
    ranked: dict[str, list[Group]] = {op: [] for op in tribes}
    for (op, _), group in zip(dealt, scored):
        ranked[op].append(group)
    return {op: sorted(found, key=lambda g: g.fitness) for op, found in ranked.items()}


def plunge(arena: Arena, contests: Sequence[tuple[Group, Group]]) -> list[Group]:
    """For every (weak, strong): better half of weak with better half of strong, if that beats strong.

    Halves and all their unions are scored together, one call for all contests.
    """
    halves = [(arena.split(weak.names, 2), arena.split(strong.names, 2)) for weak, strong in contests]
    arena.expect([list(dict.fromkeys([*weak.names, *strong.names])) for weak, strong in contests])
    wanted = []
    for weak, strong in halves:
        wanted += [*weak, *strong]
        wanted += [list(dict.fromkeys([*w, *s])) for w in weak for s in strong]
    scored = iter(arena.score(wanted))
    result = []
    for (weak, strong), (_, champion) in zip(halves, contests):
        w = [next(scored) for _ in weak]
        s = [next(scored) for _ in strong]
        unions = [[next(scored) for _ in strong] for _ in weak]
        best_w = max(range(len(w)), key=lambda i: w[i].fitness)
        best_s = max(range(len(s)), key=lambda i: s[i].fitness)
        challenger = unions[best_w][best_s]
        result.append(challenger if challenger.fitness > champion.fitness else champion)
    return result


def plunge_inside(arena: Arena, ranked: Mapping[str, Sequence[Group]]) -> dict[str, Group]:
    """The best group of every tribe takes in what its next-best groups have to offer."""
    best = {op: groups[-1] for op, groups in ranked.items()}
    last = {op: min(SEARCH_RANGE, round(len(groups) / 2)) for op, groups in ranked.items()}
    for step in range(2, max(last.values(), default=0)):
        active = [op for op in ranked if step < last[op]]
        contests = [(ranked[op][-step], best[op]) for op in active]
        best.update(zip(active, plunge(arena, contests)))
    return best


def rank_tribes(arena: Arena, tribes: Mapping[str, Sequence[str]]) -> list[tuple[str, Group]]:
    """Tribes by rising fitness."""
    scored = arena.score(list(tribes.values()))
    return sorted(zip(tribes, scored), key=lambda t: t[1].fitness)


def updated_weights(weights: Mapping[str, float], ranking: Sequence[str]) -> dict[str, float]:
    """Rank r of n moves a weight by half of r - round(n / 2); the lower half never falls below 0."""
    changed = dict(weights)
    middle = round(len(ranking) / 2)
    for r, op in enumerate(ranking):
        moved = changed[op] + WEIGHT_STEP * (r - middle)
        changed[op] = max(0.0, moved) if r < middle else moved
    return changed


def plunge_between(arena: Arena, ranking: Sequence[tuple[str, Group]]) -> list[Group]:
    """Worst meets best, second worst second best, and so on; a middle tribe passes."""
    pairs = len(ranking) // 2
    contests = [(ranking[i][1], ranking[-1 - i][1]) for i in range(pairs)]
    survivors = plunge(arena, contests) if contests else []
    if len(ranking) % 2:
        survivors.append(ranking[pairs][1])
    return survivors


@dataclass(frozen=True)
class NextGeneration:
    exprs: tuple[Expr, ...]
    weights: dict[str, float]
    ranking: tuple[tuple[str, float, float], ...]


def next_generation(
    ds: Dataset,
    scorer,
    weights: Mapping[str, float],
    previous: Sequence[str] = (),
    seed: int = 0,
    first_version: bool = False,
    limit: int | None = None,
    rules: OperatorSet = DEFAULT_SET,
) -> NextGeneration:
    """Candidates, competition inside tribes, ranking, trade between tribes, union of the survivors.

    The first version of the competition applied every operator, split every tribe in two, let the
    worse half challenge the better one and kept all tribes; weights stayed as they were. ``limit``
    bounds the candidates of an operator that compete, ``rules`` choose the operator library.
    """
    operators = sample_operators(weights, 1.0 if first_version else OPERATOR_SHARE, seed)
    tribes, stats = new_candidates(ds, previous, operators, seed, limit, rules)
    if not tribes:
        return NextGeneration((), dict(weights), ())
    exprs = {e.name: e for children in tribes.values() for e in children}
    arena = Arena(ds, scorer, exprs, stats, seed * 1_000_003)
    names = {op: [e.name for e in children] for op, children in tribes.items()}
    sizes = {op: 2 if first_version else max(1, round(math.sqrt(len(n) + 1))) for op, n in names.items()}
    ranked = inner_competition(arena, names, sizes)
    if first_version:
        best = plunge_eliminate(arena, ranked)
        kept = list(dict.fromkeys(n for g in best.values() for n in g.names))
        found = tuple((op, g.fitness, g.std) for op, g in best.items())
        return NextGeneration(tuple(exprs[n] for n in kept), dict(weights), found)
    best = plunge_inside(arena, ranked)
    ranking = rank_tribes(arena, {op: g.names for op, g in best.items()})
    survivors = plunge_between(arena, ranking)
    kept = list(dict.fromkeys(n for g in survivors for n in g.names))
    return NextGeneration(
        tuple(exprs[n] for n in kept),
        updated_weights(weights, [op for op, _ in ranking]),
        tuple((op, g.fitness, g.std) for op, g in ranking),
    )


def plunge_eliminate(arena: Arena, ranked: Mapping[str, Sequence[Group]]) -> dict[str, Group]:
    """First version: only the worst group challenges the best one."""
    contested = [op for op, groups in ranked.items() if len(groups) > 1]
    result = {op: groups[-1] for op, groups in ranked.items()}
    result.update(zip(contested, plunge(arena, [(ranked[op][0], ranked[op][-1]) for op in contested])))
    return result


def rank_frame(scores: DataFrame, name: str = "tribe", fitness: str = "fitness") -> DataFrame:
    """0-based rising rank of a score table; ties by name. One row per tribe, so one task orders it."""
    rising = Window.orderBy(F.col(fitness), F.col(name))
    return scores.select("*", (F.row_number().over(rising) - 1).alias("rank"), F.count(F.lit(1)).over(Window.partitionBy()).alias("tribes"))


def weight_frame(ranked: DataFrame, weight: str = "weight") -> DataFrame:
    """New weight of every ranked tribe."""
    middle = F.bround(F.col("tribes") / 2)
    moved = F.col(weight) + WEIGHT_STEP * (F.col("rank") - middle)
    return ranked.withColumn("new_weight", F.when(F.col("rank") < middle, F.greatest(moved, F.lit(0.0))).otherwise(moved))


def trade_frame(ranked: DataFrame, name: str = "tribe") -> DataFrame:
    """Pairs (weak, strong) by opposite ranks; ``strong`` is NULL for a middle tribe that passes."""
    weak = ranked.select(F.col(name).alias("weak"), F.col("rank").alias("weak_rank"), "tribes")
    strong = ranked.select(F.col(name).alias("strong"), (F.col("tribes") - 1 - F.col("rank")).alias("weak_rank"))
    paired = weak.join(strong, "weak_rank").filter(F.col("weak_rank") * 2 <= F.col("tribes") - 1)
    middle = F.col("weak_rank") * 2 == F.col("tribes") - 1
    return paired.select("weak_rank", "weak", F.when(~middle, F.col("strong")).alias("strong"))


def score_frame(spark: SparkSession, ranking: Sequence[tuple[str, float, float]]) -> DataFrame:
    return spark.createDataFrame(list(ranking), "tribe string, fitness double, std double")
