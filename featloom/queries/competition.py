"""Queries over the tournament and the full run."""

from __future__ import annotations

from functools import partial
from itertools import combinations

from pyspark.sql import functions as F

from featloom.functions.scalar import BINARY, OPERATOR_NAMES
from featloom.operators.moments import base_exprs, moments_frame, stats_of
from featloom.operators.generate import fit_operator
from featloom.operators.sampling import random_groups
from featloom.operators.univariate import anova_scores
from featloom.plans import evolve as E
from featloom.plans import tournament as G
from featloom.plans.fitness import ForestScorer, LinearScorer
from featloom.plans.selection import important_features, missing_initial, ranked_features, union_names
from featloom.queries.base import LINE_FEATURES, LINE_SQL, labelled_line_items, query, single, single_sql, text
from featloom.queries.generation import UNARY_SQL
from featloom.queries.models import _folded, _orders, _part_brands

# Tribes whose children need no gate: the best child's F ranks the tribe.
_TRIBES = ["cos", "sin", "square", "tanh", "minus", "add", "product"]


def _tribe_sql() -> str:
    parts = []
    for op in _TRIBES:
        if op in BINARY:
            expressions = [f"{a} {BINARY[op].symbol} {b}" for a, b in combinations(LINE_FEATURES[:4], 2)]
        else:
            expressions = [UNARY_SQL[op][0].format(c=c) for c in LINE_FEATURES[:4]]
        parts += [f"SELECT {text(op)} AS tribe, {i} AS child, y, CAST({e} AS DOUBLE) AS x FROM base" for i, e in enumerate(expressions)]
    return (
        f"WITH {LINE_SQL}, long AS (" + " UNION ALL ".join(parts) + "), "
        "g AS (SELECT tribe, child, y, count(*) AS n, avg(x) AS m, var_pop(x) * count(*) AS ss FROM long GROUP BY 1, 2, 3), "
        "t AS (SELECT tribe, child, sum(n) AS nn, sum(n * m) / sum(n) AS gm, count(*) AS k, sum(ss) AS w FROM g GROUP BY 1, 2), "
        "f AS (SELECT g.tribe, g.child, (sum(n * (m - gm) * (m - gm)) / (max(k) - 1)) / nullif(max(w) / (max(nn) - max(k)), 0) AS score "
        "FROM g JOIN t ON g.tribe = t.tribe AND g.child = t.child GROUP BY 1, 2), "
        f"s AS (SELECT tribe, {single_sql('max(score)')} AS fitness FROM f GROUP BY tribe), "
        "r AS (SELECT tribe, fitness, row_number() OVER (ORDER BY fitness, tribe) - 1 AS rank, count(*) OVER () AS tribes FROM s)"
    )


def _ranked_tribes(spark, sf_dir):
    ds = labelled_line_items(spark, sf_dir, LINE_FEATURES[:4])
    stats = stats_of(ds)
    made = {op: fit_operator(op, base_exprs(ds), stats) for op in _TRIBES}
    owner = spark.createDataFrame([(e.name, op) for op, exprs in made.items() for e in exprs], "feature string, tribe string")
    scores = anova_scores(moments_frame(ds, [e for exprs in made.values() for e in exprs], by_label=True))
    fitness = scores.join(owner, "feature").groupBy("tribe").agg(single(F.max("score")).alias("fitness"))
    return G.rank_frame(fitness)


@query("tribe_ranks", _tribe_sql() + " SELECT tribe, fitness, rank::INTEGER AS rank, tribes FROM r")
def tribe_ranks(spark, sf_dir):
    return _ranked_tribes(spark, sf_dir)


@query(
    "tribe_weights",
    _tribe_sql() + " SELECT tribe, rank::INTEGER AS rank, CASE WHEN rank < round_even(tribes / 2, 0) "
    "THEN greatest(4.0 + 0.5 * (rank - round_even(tribes / 2, 0)), 0.0) ELSE 4.0 + 0.5 * (rank - round_even(tribes / 2, 0)) END::DOUBLE AS new_weight FROM r",
)
def tribe_weights(spark, sf_dir):
    ranked = _ranked_tribes(spark, sf_dir).withColumn("weight", F.lit(4.0))
    return G.weight_frame(ranked).select("tribe", "rank", F.col("new_weight").cast("double").alias("new_weight"))


@query(
    "tribe_trades",
    _tribe_sql() + " SELECT a.rank::INTEGER AS weak_rank, a.tribe AS weak, CASE WHEN a.rank * 2 <> a.tribes - 1 THEN b.tribe END AS strong "
    "FROM r a JOIN r b ON b.rank = a.tribes - 1 - a.rank WHERE a.rank * 2 <= a.tribes - 1",
)
def tribe_trades(spark, sf_dir):
    return G.trade_frame(_ranked_tribes(spark, sf_dir)).select(F.col("weak_rank").cast("int").alias("weak_rank"), "weak", "strong")


def _arena(spark, sf_dir) -> tuple[G.Arena, dict]:
    ds = _folded(_orders(spark, sf_dir))
    tribes, stats = G.new_candidates(ds, (), ["sin", "cos", "square", "add", "product"], seed=1)
    exprs = {e.name: e for children in tribes.values() for e in children}
    return G.Arena(ds, LinearScorer(), exprs, stats), {op: [e.name for e in c] for op, c in tribes.items()}


@query("operator_sample")
def operator_sample(spark, sf_dir):
    """Operators drawn by the weights their tribes earned on the given table."""
    ds = _folded(_orders(spark, sf_dir))
    found = G.next_generation(ds, LinearScorer(), G.initial_weights(4), seed=2)
    drawn = G.sample_operators(found.weights, seed=3)
    return spark.createDataFrame([(op, float(found.weights[op])) for op in drawn], "operator string, weight double")


@query("random_groups")
def groups(spark, sf_dir):
    _, tribes = _arena(spark, sf_dir)
    names = [n for children in tribes.values() for n in children]
    rows = [(i, n) for i, g in enumerate(random_groups(names, 4, seed=1)) for n in g]
    return spark.createDataFrame(rows, "group int, feature string")


@query("inner_competition")
def inner(spark, sf_dir):
    arena, tribes = _arena(spark, sf_dir)
    ranked = G.inner_competition(arena, tribes, {op: 2 for op in tribes})
    rows = [(op, i, g.fitness, g.std) for op, found in ranked.items() for i, g in enumerate(found)]
    return spark.createDataFrame(rows, "tribe string, place int, fitness double, std double")


@query("plunge_eliminate")
def eliminate(spark, sf_dir):
    arena, tribes = _arena(spark, sf_dir)
    found = G.plunge_eliminate(arena, G.inner_competition(arena, tribes, {op: 2 for op in tribes}))
    return spark.createDataFrame([(op, len(g.names), g.fitness) for op, g in found.items()], "tribe string, features int, fitness double")


@query("plunge_between_tribes")
def between(spark, sf_dir):
    arena, tribes = _arena(spark, sf_dir)
    survivors = G.plunge_between(arena, G.rank_tribes(arena, tribes))
    rows = [(i, len(g.names), g.fitness) for i, g in enumerate(survivors)]
    return spark.createDataFrame(rows, "survivor int, features int, fitness double")


@query("next_generation")
def generation(spark, sf_dir):
    ds = _folded(_orders(spark, sf_dir))
    found = G.next_generation(ds, LinearScorer(), G.initial_weights(4), seed=1)
    return G.score_frame(spark, found.ranking)


@query("next_generation_first_version")
def first_version(spark, sf_dir):
    """All operators, two groups per tribe."""
    ds = _folded(_part_brands(spark, sf_dir))
    found = G.next_generation(ds, LinearScorer(), G.initial_weights(1), seed=1, first_version=True)
    return G.score_frame(spark, found.ranking)


def _config() -> E.Config:
    return E.Config(
        generations=2,
        inflation=4,
        current_limit=20,
        history_limit=20,
        operators=tuple(OPERATOR_NAMES),
        final_scorer=LinearScorer(),
        selector=partial(important_features, trees=10, depth=4),
        share_steps=(0.4, 0.8),
        size_steps=(0.9, 0.6),
        seed=5,
    )


@query("evolve_catalog")
def evolve_catalog(spark, sf_dir):
    """Two generations over the orders table: every candidate with its number of operators."""
    evolution = E.evolve(E.prepared(_orders(spark, sf_dir)), _config())
    return evolution.catalog()


@query("full_run")
def full_run(spark, sf_dir):
    """Generations, coefficient search and final selection; fitness per stage."""
    return E.run(_orders(spark, sf_dir), _config()).report


@query("coefficient_search")
def coefficients(spark, sf_dir):
    config = _config()
    evolution = E.evolve(E.prepared(_part_brands(spark, sf_dir)), config)
    _, _, rows = E.search_coefficients(evolution.total, evolution.base, config)
    return spark.createDataFrame(rows, "share double, size double, features int, fitness double, increase double")


def _initial_sql() -> str:
    cells = " UNION ALL ".join(f"SELECT {text(c)} AS feature, y, CAST({c} AS DOUBLE) AS x FROM base" for c in LINE_FEATURES)
    return (
        f"WITH {LINE_SQL}, long AS ({cells}), "
        "g AS (SELECT feature, y, count(*) AS n, avg(x) AS m, var_pop(x) * count(*) AS ss FROM long GROUP BY 1, 2), "
        "t AS (SELECT feature, sum(n) AS nn, sum(n * m) / sum(n) AS gm, count(*) AS k, sum(ss) AS w FROM g GROUP BY 1), "
        "f AS (SELECT g.feature, (sum(n * (m - gm) * (m - gm)) / (max(k) - 1)) / (max(w) / (max(nn) - max(k))) AS score "
        "FROM g JOIN t ON g.feature = t.feature GROUP BY 1) "
        "SELECT feature FROM (SELECT feature, row_number() OVER (ORDER BY score DESC) AS r FROM f) ranked WHERE r > 3"
    )


@query("initial_features", _initial_sql())
def initial(spark, sf_dir):
    """Base columns that fell out of both generations when these were cut to their best columns."""
    ds = labelled_line_items(spark, sf_dir)
    ranked = ranked_features(ds)
    current, previous = union_names(ranked[:2], ranked[:1]), ranked[2:3]
    missing = missing_initial(ds.names, current, previous)
    return spark.createDataFrame([(n,) for n in missing], "feature string")
