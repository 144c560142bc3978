import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from featloom import Dataset
from featloom.functions.scalar import BINARY, OPERATOR_NAMES, OPTIONAL_UNARY, RBF, UNARY, unary_op
from featloom.operators.expr import Binary, Ref, Unary, canonical_key, distinct_exprs, operator_count, read_name, refs, to_array, to_column

BASES = ["2nd", "0.75", "plain", "under_score", "x.y", "plain_sin"]


def walk(seed, steps=7):
    """An expression grown step by step: a chain of operators over columns that begin with digits, hold dots or look like a suffix."""
    rng = random.Random(seed)
    tree = Ref(rng.choice(BASES))
    for _ in range(steps):
        op = rng.choice([n for n in OPERATOR_NAMES if n != RBF])
        if op in BINARY:
            other = Ref(rng.choice(BASES))
            other = Unary(rng.choice(list(UNARY)), other) if rng.random() < 0.5 else other
            tree = Binary(op, tree, other) if rng.random() < 0.5 else Binary(op, other, tree)
        else:
            tree = Unary(op, tree)
    return tree


@pytest.mark.parametrize("seed", range(12))
def test_name_round_trip(seed):
    tree = walk(seed)
    assert read_name(tree.name, BASES).name == tree.name


def test_longest_base_wins():
    assert read_name("x_abs_abs", ["x", "x_abs"]) == Unary("abs", Ref("x_abs"))


def test_unknown_name():
    with pytest.raises(ValueError):
        read_name("(a%b)", ["a", "b"])


def trees():
    leaves = st.sampled_from([Ref("a"), Ref("b_1"), Ref("c.d")])
    unary = [op for op in UNARY]
    return st.recursive(
        leaves,
        lambda t: st.one_of(
            st.builds(Unary, st.sampled_from(unary), t), st.builds(Binary, st.sampled_from(list(BINARY)), t, t)
        ),
        max_leaves=6,
    )


@settings(max_examples=60, deadline=None)
@given(trees())
def test_print_then_read_is_identity(tree):
    assert read_name(tree.name, ["a", "b_1", "c.d"]) == tree


def test_registry():
    assert len(UNARY) == 16 and len(BINARY) == 4 and len(OPERATOR_NAMES) == 21


def test_commutative_pairs_are_one():
    a, b = Ref("a"), Ref("b")
    made = [Binary("add", a, b), Binary("add", b, a), Binary("minus", a, b), Binary("minus", b, a)]
    assert [e.name for e in distinct_exprs(made)] == ["(a+b)", "(a-b)", "(b-a)"]
    twice = Unary("negative", Unary("negative", a))
    assert canonical_key(twice) == "a"
    assert operator_count(twice) == 2 and refs(Binary("div", twice, b)) == {"a", "b"}


def test_both_forms_agree(spark):
    """The column form and the array form of every operator give the same values."""
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 2, 40), [0.0, 1.0, -1.0]])
    y = np.concatenate([rng.normal(1, 1, 40), [0.0, 2.0, 0.0]])
    ds = Dataset.of(spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "x double, y double"))
    params = {"mmnorm": (0.5, 2.0), "zscore": (0.1, 3.0), "reciprocal": (False,)}
    exprs = [Unary(op, Ref("x"), params.get(op, ())) for op in [*UNARY, *OPTIONAL_UNARY]]
    exprs += [Binary(op, Ref("x"), Ref("y")) for op in BINARY]
    values = ds.values()
    rows = ds.df.select(*[to_column(e, values).alias(f"c{i}") for i, e in enumerate(exprs)]).toPandas()
    for i, e in enumerate(exprs):
        with np.errstate(all="ignore"):
            want = to_array(e, {"x": x, "y": y})
        assert np.allclose(rows[f"c{i}"].astype(float), want, equal_nan=True), e.name
    assert unary_op("sqrt").suffix == "sqrt"


def test_random_feature_names_count_as_an_operator():
    tree = read_name("(a_rbfFeature+b)_sin", ["a", "b"])
    assert tree.name == "(a_rbfFeature+b)_sin" and operator_count(tree) == 3 and refs(tree) == {"a", "b"}
