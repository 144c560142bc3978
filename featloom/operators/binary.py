"""Binary feature operators over the current and the previous generation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featloom.functions.scalar import BINARY
from featloom.functions.summary import FeatureStats
from featloom.operators.expr import Binary, Expr


def fit_binary(
    op: str,
    current: Sequence[Expr],
    stats: Mapping[str, FeatureStats],
    previous: Sequence[Expr] = (),
    with_self: bool = False,
    skip_zero: bool = True,
) -> list[Expr]:
    """Children over all pairs inside ``current`` and all pairs current x previous.

    A right operand without any non-zero value is skipped. A divisor that holds a zero can only
    give an invalid quotient, so that pair is not formed either. ``with_self`` adds (a op a).
    """

    def usable(right: Expr) -> bool:
        stat = stats[right.name]
        return not (skip_zero and stat.all_zero) and not (op == "div" and stat.zeros > 0)

    children = [
        Binary(op, left, right)
        for i, left in enumerate(current)
        for right in current[i if with_self else i + 1:]
        if usable(right)
    ]
    children += [Binary(op, left, right) for left in current for right in previous if usable(right)]
    return children


def pair_catalog(spark: SparkSession, current: Sequence[str], previous: Sequence[str] = ()) -> DataFrame:
    """Names of every candidate pair per operator: (op, left, right, name).

    Metadata only. Every left name explodes into the names after it, so no join is needed;
    names are spread over the cluster because their pairs grow with the square.
    """
    names = list(dict.fromkeys([*current, *previous]))
    lefts = spark.createDataFrame([(i, name) for i, name in enumerate(current)], "pos int, left string")
    rights = F.slice(F.array(*[F.lit(name) for name in names]), F.col("pos") + 2, len(names))
    ops = F.array(*[F.struct(F.lit(o.name).alias("op"), F.lit(o.symbol).alias("symbol")) for o in BINARY.values()])
    pairs = lefts.select("left", F.explode(rights).alias("right"))
    return pairs.select("left", "right", F.explode(ops).alias("o")).select(
        F.col("o.op").alias("op"), "left", "right", F.concat(F.lit("("), "left", "o.symbol", "right", F.lit(")")).alias("name")
    )
