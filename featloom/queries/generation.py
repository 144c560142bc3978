"""Queries over the unary and binary operators, validity, candidates and univariate ranking."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from featloom.dataset import Dataset
from featloom.functions.scalar import BINARY, OPERATOR_NAMES, OPTIONAL_UNARY, RBF, UNARY
from featloom.operators.binary import fit_binary, pair_catalog
from featloom.operators.expr import Binary, Ref
from featloom.operators.generate import append, children, fit_operator
from featloom.operators.moments import base_exprs, moments_frame, stats_of
from featloom.operators.unary import fit_unary, fourier_weights
from featloom.operators.univariate import anova_scores, univariate_scores
from featloom.session import materialise
from featloom.queries.base import (
    LINE_FEATURES,
    LINE_SQL,
    by_flag,
    by_flag_sql,
    empty_summary,
    labelled_line_items,
    line_items,
    load,
    priced_line_items,
    query,
    single,
    single_sql,
    summary,
    summary_sql,
    text,
)

NEAR_ZERO_OK = "count_if(abs(x) < 0.0001) <= 0.8 * count(*) AND count(x) = count(*)"

# SQL of each operator: child expression and gate on the parent.
UNARY_SQL = {
    "abs": ("abs({c})", "min({c}) < 0"),
    "adde": ("{c} + exp(1.0::DOUBLE)", None),
    "cos": ("cos({c})", None),
    "degree": ("degrees({c})", None),
    "exp": ("exp({c})", "max({c}) < 1"),
    "ln": ("CASE WHEN {c} > 0 THEN ln({c}) END", "min({c}) > 1e-9"),
    "negative": ("-{c}", None),
    "radian": ("radians({c})", None),
    "reciprocal": (
        "CASE WHEN (SELECT count_if({c} = 0) FROM base) > 0 THEN {c} WHEN {c} <> 0 THEN 1.0 / {c} END", None),
    "sin": ("sin({c})", None),
    "sigmoid": ("1.0 / (1.0 + exp(-{c}))", "min({c}) > -1"),
    "square": ("{c} * {c}", NEAR_ZERO_OK),
    "tanh": ("tanh({c})", None),
    "relu": ("CASE WHEN {c} > 0 THEN {c} ELSE 0.0 END", None),
    "mmnorm": ("({c} - (SELECT min({c}) FROM base)) / (SELECT max({c}) - min({c}) FROM base)", None),
    "zscore": ("({c} - (SELECT avg({c}) FROM base)) / (SELECT stddev_pop({c}) FROM base)", None),
}
OPTIONAL_SQL = {
    "sqrt": ("CASE WHEN {c} >= 0 THEN sqrt({c}) END", None),
    "ln_positive": ("CASE WHEN {c} > 0 THEN ln({c}) END", "min({c}) > 0"),
    "reciprocal_each": ("CASE WHEN {c} <> 0 THEN 1.0 / {c} ELSE {c} END", None),
    "sigmoid_any": ("1.0 / (1.0 + exp(-{c}))", None),
}


def _unary_sql(op: str, table: dict[str, tuple[str, str | None]]) -> str:
    suffix = (UNARY.get(op) or OPTIONAL_UNARY[op]).suffix
    expression, gate = table[op]
    items = [
        (f"{c}_{suffix}", expression.format(c=c), gate.format(c=c) if gate else None) for c in LINE_FEATURES
    ]
    return summary_sql(LINE_SQL, items)


def _unary_query(op: str):
    def run(spark, sf_dir):
        ds = line_items(spark, sf_dir)
        made, _ = children(ds, op)
        return summary(ds, made) if made else empty_summary(spark)

    return run


for _op in UNARY:
    query(f"unary_{_op}", _unary_sql(_op, UNARY_SQL))(_unary_query(_op))
for _op in OPTIONAL_UNARY:
    query(f"unary_{_op}", _unary_sql(_op, OPTIONAL_SQL))(_unary_query(_op))


def _rbf_sql() -> str:
    d = len(LINE_FEATURES)
    weights, bias = fourier_weights(d, d, 1.0, 0)
    items = []
    for j, name in enumerate(LINE_FEATURES):
        terms = " + ".join(f"{c} * ({float(weights[i, j])!r}::DOUBLE)" for i, c in enumerate(LINE_FEATURES))
        items.append((f"{name}_rbfFeature", f"sqrt(2.0 / {d}) * cos(({float(bias[j])!r}::DOUBLE) + {terms})", None))
    return summary_sql(LINE_SQL, items)


@query("unary_kernelapproxrbf", _rbf_sql())
def random_features(spark, sf_dir):
    ds = line_items(spark, sf_dir)
    return summary(ds, fit_unary(RBF, base_exprs(ds), {}, seed=0))


def _signed_sql() -> str:
    source = "base AS (SELECT c_acctbal FROM customer)"
    items = []
    for op in ("abs", "relu", "sigmoid", "exp", "ln", "tanh"):
        expression, gate = UNARY_SQL[op]
        items.append((f"c_acctbal_{UNARY[op].suffix}", expression.format(c="c_acctbal"), gate and gate.format(c="c_acctbal")))
    return summary_sql(source, items)


@query("unary_sign_gates", _signed_sql())
def signed_balance(spark, sf_dir):
    """Gates on a column of both signs: abs, relu and tanh give a child, sigmoid, exp and ln do not."""
    ds = Dataset.of(load(spark, sf_dir, "customer"), ["c_acctbal"])
    stats = stats_of(ds)
    made = [e for op in ("abs", "relu", "sigmoid", "exp", "ln", "tanh") for e in fit_unary(op, base_exprs(ds), stats)]
    return summary(ds, made)


def _binary_sql_expr(op: str, a: str, b: str) -> str:
    return f"CASE WHEN {b} <> 0 THEN {a} / {b} END" if op == "div" else f"{a} {BINARY[op].symbol} {b}"


def _binary_sql(op: str) -> str:
    items = []
    for a, b in combinations(LINE_FEATURES, 2):
        expression = _binary_sql_expr(op, a, b)
        items.append((f"({a}{BINARY[op].symbol}{b})", expression, f"{NEAR_ZERO_OK} AND count_if({b} <> 0) > 0"))
    return summary_sql(LINE_SQL, items)


def _binary_query(op: str):
    def run(spark, sf_dir):
        ds = line_items(spark, sf_dir)
        made, _ = children(ds, op)
        return summary(ds, made) if made else empty_summary(spark)

    return run


for _op in BINARY:
    query(f"binary_{_op}", _binary_sql(_op))(_binary_query(_op))


def _history_sql() -> str:
    items = []
    for op in BINARY:
        pairs = [("l_quantity", "l_discount")] + [(a, b) for a in ("l_quantity", "l_discount") for b in ("l_extendedprice", "net")]
        for a, b in pairs:
            items.append((f"({a}{BINARY[op].symbol}{b})", _binary_sql_expr(op, a, b), f"{NEAR_ZERO_OK} AND count_if({b} <> 0) > 0"))
    return summary_sql(LINE_SQL, items)


@query("binary_with_previous", _history_sql())
def with_previous(spark, sf_dir):
    """Pairs inside the current generation and pairs current x previous, all four operators."""
    ds = line_items(spark, sf_dir, ["l_quantity", "l_discount", "l_extendedprice", "net"])
    made = [e for op in BINARY for e in children(ds, op, previous=["l_extendedprice", "net"])[0]]
    return summary(ds, made)


def _self_sql() -> str:
    names = ["l_quantity", "l_discount", "l_tax"]
    items = [(f"({a}+{b})", f"{a} + {b}", NEAR_ZERO_OK) for i, a in enumerate(names) for b in names[i:]]
    return summary_sql(LINE_SQL, items)


@query("binary_add_with_self", _self_sql())
def add_with_self(spark, sf_dir):
    ds = line_items(spark, sf_dir, ["l_quantity", "l_discount", "l_tax"])
    stats = stats_of(ds)
    made = fit_binary("add", base_exprs(ds), stats, with_self=True, skip_zero=False)
    return summary(ds, made)


def _validity_sql() -> str:
    parts = []
    for op in BINARY:
        for a, b in combinations(LINE_FEATURES, 2):
            parts.append(
                f"SELECT {text(op)} AS op, {text(f'({a}{BINARY[op].symbol}{b})')} AS feature, "
                f"count(*) - count(x) AS nulls, {single_sql('count_if(abs(x) < 0.0001) / count(*)')} AS near_zero_share, "
                f"{NEAR_ZERO_OK} AS valid FROM (SELECT CAST({_binary_sql_expr(op, a, b)} AS DOUBLE) AS x FROM base) t"
            )
    return f"WITH {LINE_SQL} " + " UNION ALL ".join(parts)


@query("candidate_validity", _validity_sql())
def validity(spark, sf_dir):
    """Validity of every candidate pair, judged without making it a column."""
    ds = line_items(spark, sf_dir)
    pairs = pair_catalog(spark, ds.names).select("op", F.col("name").alias("feature"))
    # The catalogue is metadata: four operators for each pair of the given columns.
    made = [Binary(op, Ref(a), Ref(b)) for op in BINARY for a, b in combinations(ds.names, 2)]
    frame = moments_frame(ds, made)
    near = F.col("near_zeros") / F.col("rows")
    judged = frame.select(
        "feature",
        "nulls",
        single(near).alias("near_zero_share"),
        ((F.col("near_zeros") <= 0.8 * F.col("rows")) & (F.col("nulls") == 0)).alias("valid"),
    )
    return pairs.join(judged, "feature").select("op", "feature", "nulls", "near_zero_share", "valid")


def _scores_sql(parts: list[str], extra: str = "") -> str:
    return (
        f"WITH {LINE_SQL}, st AS (SELECT "
        + ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}, count_if({c} = 0) AS z_{c}" for c in LINE_FEATURES)
        + " FROM base), long AS ("
        + " UNION ALL ".join(parts)
        + "), ok AS (SELECT feature FROM long GROUP BY feature HAVING max(checked) = 0 OR "
        "(count_if(abs(x) < 0.0001) <= 0.8 * count(*) AND count(x) = count(*))), "
        "g AS (SELECT feature, y, count(x) AS n, avg(x) AS m, var_pop(x) * count(x) AS ss FROM long "
        "WHERE feature IN (SELECT feature FROM ok) GROUP BY feature, y), "
        "t AS (SELECT feature, sum(n) AS nn, sum(n * m) / sum(n) AS gm, count(*) AS k, sum(ss) AS w FROM g GROUP BY feature), "
        "f AS (SELECT g.feature, " + single_sql("(sum(n * (m - gm) * (m - gm)) / (max(k) - 1)) / nullif(max(w) / (max(nn) - max(k)), 0)") + " AS score "
        "FROM g JOIN t ON g.feature = t.feature GROUP BY g.feature) SELECT feature, score FROM f" + extra
    )


def _long(feature: str, expression: str, gate: str = "TRUE", checked: int = 0) -> str:
    return f"SELECT {text(feature)} AS feature, y, CAST({expression} AS DOUBLE) AS x, {checked} AS checked FROM base, st WHERE {gate}"


_GATES = {"abs": "lo_{c} < 0", "exp": "hi_{c} < 1", "ln": "lo_{c} > 1e-9", "sigmoid": "lo_{c} > -1"}


def _all_children_sql() -> list[str]:
    parts = []
    for op, spec in UNARY.items():
        for c in LINE_FEATURES:
            gate = _GATES.get(op, "TRUE").format(c=c)
            parts.append(_long(f"{c}_{spec.suffix}", UNARY_SQL[op][0].format(c=c), gate, int(op == "square")))
    for op in BINARY:
        for a, b in combinations(LINE_FEATURES, 2):
            gate = f"z_{b} = 0" if op == "div" else "TRUE"
            parts.append(_long(f"({a}{BINARY[op].symbol}{b})", _binary_sql_expr(op, a, b), gate, 1))
    return parts


def ranked_children(spark, sf_dir, size: int = 10):
    """The derived columns that best separate ``l_returnflag``: one pass scores all candidates."""
    ds = labelled_line_items(spark, sf_dir)
    stats = stats_of(ds)
    ds = ds.spread()
    exprs = base_exprs(ds)
    made = [e for op in OPERATOR_NAMES if op != RBF for e in fit_operator(op, exprs, stats)]
    frame = materialise(moments_frame(ds, made, by_label=True), "scores")
    checked = {e.name for op in (*BINARY, "square") for e in fit_operator(op, exprs, stats)}
    totals = frame.groupBy("feature").agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.sum("near_zeros").alias("near"))
    invalid = totals.filter(
        F.col("feature").isin(sorted(checked)) & ((F.col("nulls") > 0) | (F.col("near") > 0.8 * F.col("rows"))))
    scores = anova_scores(frame).join(invalid.select("feature"), "feature", "left_anti")
    ranked = scores.select("feature", single(F.col("score")).alias("score"))
    return ranked.orderBy(F.desc("score"), "feature").limit(size)


query("best_children", _scores_sql(_all_children_sql(), " ORDER BY score DESC, feature LIMIT 10"))(ranked_children)


@query("anova_scores", _scores_sql([_long(c, c) for c in LINE_FEATURES]))
def anova(spark, sf_dir):
    ds = labelled_line_items(spark, sf_dir)
    return univariate_scores(ds).select("feature", single(F.col("score")).alias("score"))


_SHIFTED = "l_quantity + CASE WHEN l_returnflag = 'R' THEN 1700000000.0 ELSE 0.0 END"
_WIDE = {**{c: c for c in LINE_FEATURES}, "l_linenumber": "l_linenumber", "shifted": _SHIFTED}


@query(
    "anova_scores_wide",
    _scores_sql([_long(n, e) for n, e in _WIDE.items()]).replace("l_returnflag FROM lineitem", "l_returnflag, l_linenumber FROM lineitem"),
)
def anova_wide(spark, sf_dir):
    """Seven features, one far from zero in one class only: the per-batch form of the statistics."""
    ds = labelled_line_items(spark, sf_dir)
    wide = ds.df.withColumn("shifted", F.expr(_SHIFTED))
    return univariate_scores(Dataset.of(wide, list(_WIDE), "y")).select("feature", single(F.col("score")).alias("score"))


def _missing_label_sql() -> str:
    parts = []
    for c in [*LINE_FEATURES[2:], "l_linenumber", "l_quantity", "q2", "d2"]:
        r = f"corr({c}, y) ** 2 / (1 - corr({c}, y) ** 2) * (count(*) - 2)"
        parts.append(f"SELECT {text(c)} AS feature, {single_sql(r)} AS score FROM base WHERE y IS NOT NULL AND {c} IS NOT NULL")
    base = (
        "SELECT *, l_discount - l_tax AS net, CASE WHEN l_quantity > 5 THEN l_quantity END AS q2, l_discount + l_linenumber AS d2, "
        "CASE WHEN l_linenumber > 1 THEN l_extendedprice END AS y FROM lineitem"
    )
    return f"WITH base AS ({base}) " + " UNION ALL ".join(parts)


@query("correlation_scores_missing_label", _missing_label_sql())
def correlation_missing(spark, sf_dir):
    """Rows without a label, or without the feature, take no part in that feature's score."""
    df = load(spark, sf_dir, "lineitem").withColumns(
        {
            "net": F.col("l_discount") - F.col("l_tax"),
            "q2": F.when(F.col("l_quantity") > 5, F.col("l_quantity")),
            "d2": F.col("l_discount") + F.col("l_linenumber"),
            "y": F.when(F.col("l_linenumber") > 1, F.col("l_extendedprice")),
        }
    )
    names = [*LINE_FEATURES[2:], "l_linenumber", "l_quantity", "q2", "d2"]
    return univariate_scores(Dataset.of(df, names, "y", "R")).select("feature", single(F.col("score")).alias("score"))


def _correlation_sql() -> str:
    parts = [
        f"SELECT {text(c)} AS feature, {single_sql(f'corr({c}, l_extendedprice) ** 2 / (1 - corr({c}, l_extendedprice) ** 2) * (count(*) - 2)')} AS score FROM base"
        for c in ["l_quantity", "l_discount", "l_tax", "net"]
    ]
    return f"WITH {LINE_SQL} " + " UNION ALL ".join(parts)


@query("correlation_scores", _correlation_sql())
def correlation(spark, sf_dir):
    ds = priced_line_items(spark, sf_dir)
    return univariate_scores(ds).select("feature", single(F.col("score")).alias("score"))


@query(
    "derived_columns",
    by_flag_sql(
        LINE_SQL,
        {"sin_price": "sin(l_extendedprice)", "revenue_net": "l_extendedprice * net", "ln_quantity": "ln(l_quantity)"},
        "l_returnflag",
    ),
)
def derived_columns(spark, sf_dir):
    """Chosen features as columns of the same table: a projection without any join."""
    ds = labelled_line_items(spark, sf_dir)
    stats = stats_of(ds)
    exprs = {e.name: e for op in ("sin", "ln", "product") for e in fit_operator(op, base_exprs(ds), stats)}
    wanted = {"sin_price": "l_extendedprice_sin", "revenue_net": "(l_extendedprice*net)", "ln_quantity": "l_quantity_ln"}
    made = append(Dataset.of(ds.df, ds.names, "l_returnflag"), [exprs[n] for n in wanted.values()])
    return by_flag(made.df, {k: made.value(n) for k, n in wanted.items()}, "l_returnflag")
