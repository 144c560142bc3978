import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from featloom import Dataset
from featloom.operators import cleaning, encoding, ordering, sampling
from featloom.operators.folds import with_folds
from featloom.operators.moments import stats_of
from featloom.operators.univariate import univariate_scores
from featloom.plans.load import LoadOptions, load_data, load_frame, preprocess
from featloom.plans.selection import best_features, drop_correlated
from featloom.sources import tables

@pytest.fixture(scope="module")
def mixed_csv(tmp_path_factory):
    """150 rows: two texts of few values, one of many, a number; a class of 100, one of 40, one of 10."""
    rows = ["shape,edge,town,size,kind"]
    for i in range(150):
        kind = "a" if i < 100 else "b" if i < 140 else "c"
        rows.append(f"{['round', 'flat', 'long'][i % 3]},{'yes' if i % 2 else 'no'},t{i % 9},{i % 7 + 1},{kind}")
    path = tmp_path_factory.mktemp("csv") / "mixed.csv"
    path.write_text("\n".join(rows) + "\n")
    return str(path)


@pytest.fixture(scope="module")
def numbers():
    """600 rows of eight numbers; the second, sixth and eighth tell the two classes apart."""
    rng = np.random.default_rng(5)
    y = (np.arange(600) % 3 == 0).astype(int)
    x = rng.normal(0, 1, (600, 8)) + np.outer(y, [0, 2, 0, 0, 0, 1.5, 0, 1])
    return pd.DataFrame({**{f"_c{i}": x[:, i].round(4) for i in range(8)}, "_c8": y})


@pytest.fixture(scope="module")
def numbers_csv(numbers, tmp_path_factory):
    path = tmp_path_factory.mktemp("csv") / "numbers.csv"
    numbers.to_csv(path, header=False, index=False)
    return str(path)


@pytest.fixture(scope="module")
def mixed(spark, mixed_csv):
    return load_data(spark, mixed_csv)


def test_mixed_table(spark, mixed, mixed_csv):
    raw = preprocess(tables.read_csv(spark, mixed_csv))
    assert set(raw.names) == {"size", "shape_kterm", "edge_kterm", "town_kterm", "shape_long", "shape_round", "edge_yes", "town"}
    # Every count of a shape and of an edge is the same, so those columns are constant.
    assert set(raw.names) - set(mixed.names) == {"shape_kterm", "edge_kterm"}
    assert mixed.df.count() == 150 and sampling.class_sizes(mixed) == {0.0: 100, 1.0: 40, 2.0: 10}


def test_balance_of_the_mixed_table(mixed):
    balanced = sampling.balance(mixed, rows_per_bucket=20)
    assert set(sampling.class_sizes(balanced).values()) == {100}
    assert balanced.df.filter("copy = 0").select("row_id").distinct().count() == 150


def test_numeric_table(spark, numbers, numbers_csv):
    ds = load_data(spark, numbers_csv, options=LoadOptions(header=False))
    assert ds.df.count() == 600 and len(ds.names) == 8
    stats = stats_of(ds)
    assert np.allclose([stats[n].mean for n in ds.names], numbers[ds.names].mean(), atol=1e-6)
    scores = {r["feature"]: r["score"] for r in univariate_scores(ds).collect()}
    assert np.allclose([scores[n] for n in ds.names], [anova(numbers[n], numbers["_c8"]) for n in ds.names], rtol=1e-4)
    assert best_features(ds, 3).names == ["_c1", "_c5", "_c7"]
    assert drop_correlated(ds).names == ds.names


def anova(x, y):
    groups = [x[y == c] for c in sorted(y.unique())]
    between = sum(len(g) * (g.mean() - x.mean()) ** 2 for g in groups) / (len(groups) - 1)
    return between / (sum(((g - g.mean()) ** 2).sum() for g in groups) / (len(x) - len(groups)))


def test_older_order(spark, numbers_csv, mixed_csv):
    ds = load_data(spark, numbers_csv, options=LoadOptions(header=False, order="older"))
    assert set(sampling.class_sizes(ds).values()) == {400}
    ds = load_data(spark, mixed_csv, options=LoadOptions(order="older"))
    assert set(sampling.class_sizes(ds).values()) == {100} and {"town", "edge_yes", "size"} <= set(ds.names)


def test_loading_keeps_all_rows(spark):
    df = spark.range(150_000).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 2).alias("y"))
    assert load_frame(df, "y", "C", "id").df.count() == 150_000
    assert load_frame(df, "y", "C", "id", LoadOptions(row_limit=1000)).df.count() == 1000


def test_no_type_is_left_out(spark):
    df = spark.range(40).selectExpr("id", "array(id) AS a", "id % 2 AS y")
    with pytest.raises(ValueError, match="array"):
        load_frame(df, "y", "C", "id")


def test_six_and_seven_features_agree(spark):
    """Both forms of the statistics, on a feature far from zero in one class and labels that are missing."""
    rng = np.random.default_rng(8)
    far = np.where(np.arange(4000) % 2 == 1, 1.7e9, 0.0) + rng.integers(0, 2, 4000)
    pdf = pd.DataFrame({"far": far, **{f"x{i}": rng.normal(0, 1, 4000) for i in range(6)}})
    pdf["c"], pdf["y"] = np.arange(4000) % 2, pdf["x0"] * 2 + rng.normal(0, 1, 4000)
    df = spark.createDataFrame(pdf).repartition(5).withColumn("y", F.when(F.rand(1) < 0.7, F.col("y")))
    df = df.withColumn("c", F.when(F.rand(2) < 0.9, F.col("c")).cast("double")).cache()
    names = ["far", *[f"x{i}" for i in range(6)]]
    for label, task in (("c", "C"), ("y", "R")):
        few = {r["feature"]: r["score"] for r in univariate_scores(Dataset.of(df, names[:6], label, task)).collect()}
        all_ = {r["feature"]: r["score"] for r in univariate_scores(Dataset.of(df, names, label, task)).collect()}
        assert all(all_[n] == pytest.approx(few[n], rel=1e-5) for n in names[:6])


def test_many_classes(spark):
    df = spark.range(30_000).select((F.col("id") % 12_000).cast("string").alias("c"))
    coded, codes = encoding.encode_label(df, "c")
    assert codes.count() == 12_000
    assert coded.agg(F.max("c"), F.count_distinct("c")).collect()[0][:] == (11_999.0, 12_000)


def test_null_rules(spark):
    rows = [(None, None, 1.0), (None, 2.0, 1.0), (3.0, 4.0, 2.0), (3.5, 6.0, 3.0)]
    ds = Dataset.of(spark.createDataFrame(rows, "p double, q double, r double"))
    assert encoding.drop_null_columns(ds.df, ds.names) == ["q", "r"]
    cleaned = cleaning.clean(ds)
    assert cleaned.names == ["p", "q", "r"]
    assert sorted(r[0] for r in cleaned.df.select("q").collect()) == [2.0, 4.0, 4.0, 6.0]


def test_zero_share_boundary(spark):
    rows = [(0.0, 0.0)] * 7 + [(0.0, 1.0)] + [(1.0, 1.0)] * 2
    ds = Dataset.of(spark.createDataFrame(rows, "eight double, seven double"))
    assert cleaning.clean(ds).names == ["seven"]
    assert cleaning.clean(ds, cleaning.CleanRules(older=True)).names == ["eight", "seven"]


def test_rows_without_a_label_go(spark):
    ds = Dataset.of(spark.createDataFrame([(1.0, 0.0), (2.0, None), (3.0, 1.0)], "x double, y double"), ["x"], "y")
    assert cleaning.clean(ds).df.count() == 2


def test_frequencies(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "c string")
    assert [r["c_kterm"] for r in encoding.count_encode(df, ["c"]).collect()] == [2, 2, 1, 0]


def test_dictionary_join_equals_inline(spark, monkeypatch):
    rng = np.random.default_rng(0)
    values = [None if v == 7 else f"v{v}" for v in np.where(rng.random(3000) < 0.5, 0, rng.integers(0, 300, 3000))]
    df = spark.createDataFrame(list(enumerate(values)), "id long, c string").repartition(4)
    inline = df.toPandas()
    counts = inline["c"].value_counts()
    joined = encoding.count_encode(df, ["c"]).toPandas()
    want = joined["c"].map(counts).fillna(0).astype(int)
    assert (joined["c_kterm"] == want).all() and len(joined) == 3000
    coded = encoding.label_encode(df.select("id", "c"), ["c"]).toPandas().set_index("id")["c"]
    order = {v: float(i) for i, v in enumerate(sorted({"NULL" if v is None else v for v in values}))}
    assert all(coded[i] == order["NULL" if v is None else v] for i, v in enumerate(values))


def test_sorted_codes_over_many_parts(spark):
    df = spark.range(1000).select(F.format_string("k%04d", F.col("id")).alias("v"))
    codes = ordering.sorted_codes(df, "v", small=100).toPandas().sort_values("v")
    assert (codes["code"].to_numpy() == np.arange(1000)).all()


@pytest.mark.parametrize("literal_buckets", [4096, 5])
def test_positions_and_fill_over_many_buckets(spark, monkeypatch, literal_buckets):
    monkeypatch.setattr(ordering, "MAX_BUCKETS", literal_buckets)
    rng = np.random.default_rng(2)
    n = 4000
    pdf = pd.DataFrame({"id": rng.permutation(n) * 3 - 1000, "g": rng.choice(["a", "b", None], n, p=[0.7, 0.2, 0.1]),
                        "v": np.where(rng.random(n) < 0.7, np.nan, rng.random(n))})
    df = spark.createDataFrame(pdf).withColumn("v", F.nullif("v", F.lit(float("nan")))).repartition(6)
    placed = ordering.with_position(df, "id", ["g"], rows_per_bucket=150, group_rows="size").toPandas()
    want = pdf.assign(position=pdf.groupby("g", dropna=False)["id"].rank().astype(int) - 1)
    both = placed.merge(want, on="id")
    assert len(both) == n and (both["position_x"] == both["position_y"]).all()
    assert (placed["size"] == placed.groupby("g", dropna=False)["id"].transform("size")).all()
    filled = ordering.forward_fill(df, ["v"], "id", rows_per_bucket=150).toPandas().sort_values("id")
    assert np.allclose(filled["v"], pdf.sort_values("id")["v"].ffill(), equal_nan=True)


def test_fold_sizes(spark):
    df = spark.range(7).withColumn("y", F.col("id").cast("double"))
    ds = with_folds(Dataset.of(df, [], "y", "R", "id"), rows_per_bucket=2)
    assert [r["fold"] for r in ds.df.orderBy("id").collect()] == [0, 0, 1, 1, 2, 3, 4]
    few = with_folds(Dataset.of(df.limit(3), [], "y", "R", "id"))
    assert few.df.count() == 3


def test_subsample_is_exact_and_repeatable(spark):
    ds = Dataset.of(spark.range(20000).withColumn("x", F.col("id") * 1.0), ["x"], row_id="id")
    first, second = (sorted(r["id"] for r in sampling.subsample(ds, 500, 1).df.collect()) for _ in range(2))
    assert first == second and len(set(first)) == 500
    hashes = {r["id"]: r["h"] for r in ds.df.select("id", sampling.row_hash("id", 1).alias("h")).collect()}
    assert first == sorted(sorted(hashes, key=lambda i: hashes[i])[:500])
    assert sampling.subsample(ds, 30000).df.count() == 20000


def test_balanced_classes_stay(spark):
    df = spark.range(10).select("id", (F.col("id") % 2).cast("double").alias("y"), F.lit(1.0).alias("x"))
    assert sampling.balance(Dataset.of(df, ["x"], "y", row_id="id")).df.count() == 10
    assert not sampling.is_balanced([5, 2]) and sampling.is_balanced([5, 5])


def test_holdout_is_a_partition(spark):
    ds = Dataset.of(spark.range(4000).withColumn("x", F.lit(1.0)), ["x"], row_id="id")
    train, test = sampling.holdout(ds, seed=4)
    a, b = {r[0] for r in train.df.select("id").collect()}, {r[0] for r in test.df.select("id").collect()}
    assert not a & b and len(a | b) == 4000 and 850 < len(b) < 1150


def test_groups_are_a_partition():
    groups = sampling.random_groups(range(10), 3, seed=1)
    assert sorted(len(g) for g in groups) == [3, 3, 4] and sorted(x for g in groups for x in g) == list(range(10))
    assert sampling.random_groups([1, 2], 3) in ([[1], [2]], [[2], [1]])


def test_donors_permute(spark):
    ds = Dataset.of(spark.range(997).withColumn("x", F.col("id") * 2.0), ["x"], row_id="id")
    paired = sampling.donors(ds, ["x"], "d_", seed=1, rows_per_bucket=100).df.toPandas()
    assert sorted(paired["d_x"]) == sorted(paired["x"]) and (paired["d_x"] != paired["x"]).mean() > 0.9


def test_imputation_equals_the_same_rounds_in_memory(spark):
    rng = np.random.default_rng(3)
    full = rng.normal(0, 1, (400, 3)) @ np.array([[1, 0.5, 0.2], [0, 1, 0.7], [0, 0, 1]])
    holes = full.copy()
    holes[rng.random((400, 3)) < [0.2, 0.1, 0.0]] = np.nan
    rows = [tuple([i, *(None if np.isnan(v) else float(v) for v in r)]) for i, r in enumerate(holes)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double").repartition(3)
    got = encoding.chained_imputation(df, ["a", "b", "c"]).orderBy("id").toPandas()[["a", "b", "c"]].to_numpy()
    mean, std = np.nanmean(holes, axis=0), np.nanstd(holes, axis=0)
    z0 = (holes - mean) / std
    gap = np.isnan(z0)
    z, last = np.where(gap, 0.0, z0), None
    for _ in range(10):
        design, step = np.column_stack([np.ones(len(z)), z]), np.zeros((4, 2))
        for k, i in enumerate((0, 1)):
            cols = [j for j in range(4) if j != i + 1]
            ok = ~gap[:, i]
            step[cols, k] = np.linalg.lstsq(design[ok][:, cols], z[ok, i], rcond=None)[0]
        guess, z = design @ step, z.copy()
        for k, i in enumerate((0, 1)):
            z[gap[:, i], i] = guess[gap[:, i], k]
        if np.abs(step - (0 if last is None else last)).max() < 1e-3:
            break
        last = step
    assert np.allclose(got, np.where(gap, z * std + mean, holes), atol=1e-6)
    assert np.corrcoef(got[gap[:, 0], 0], full[gap[:, 0], 0])[0, 1] > 0.1


def test_sources_and_sinks(spark, tmp_path):
    seq = tables.from_sequence(spark, ["Alice", "Bob"], 2)
    assert seq.count() == 2 and seq.columns == ["value"]
    noise = tables.random_normal(spark, 2000, 2, mean=10.0, std=0.1, partitions=4)
    assert noise.agg(F.avg("v0")).collect()[0][0] == pytest.approx(10.0, abs=0.02)
    ds = Dataset.of(spark.createDataFrame([(1, 0.1, 2.0, 0.0)], "id long, a double, b double, y double"), ["a", "b"], "y", row_id="id")
    made = ds.derived({"(a/b)": ds.value("a") / ds.value("b"), "a": ds.value("a")})
    tables.write_generation(made, str(tmp_path), 2)
    again = tables.read_stored(spark, f"{tmp_path}/gen=2", "y", "C", "id")
    assert again.names == ["(a/b)", "a"] and again.df.select(again.value("(a/b)")).collect()[0][0] == pytest.approx(0.05)
    tables.write_final(again, f"{tmp_path}/final")
    assert spark.read.csv(f"{tmp_path}/final", header=True).columns == ["(a/b)", "a"]
    parquet = tables.read_table(spark, f"{tmp_path}/gen=2")
    assert parquet.count() == 1


def test_quality_report(spark):
    ds = Dataset.of(spark.createDataFrame([(float("inf"), None), (float("nan"), 1.0), (2.0, -float("inf"))], "a double, b double"))
    row = cleaning.quality_report(ds).collect()[0]
    assert (row["n_rows"], row["n_inf"], row["n_missing"]) == (3, 1, 2)
