"""Distributed orderings against plain computation, and score metrics in degenerate cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from propensia.functions.hashing import key_hash
from propensia.operators import evaluation as E, ranking as K, sampling as V


@pytest.mark.parametrize("buckets", [1, 2, 16])
def test_prefix_sums_for_any_bucket_count(spark, buckets):
    rng = random.Random(3)
    rows = [(g, float(v), rng.randint(0, 5)) for g in "ab" for v in rng.sample(range(1000), 100)]
    got = K.prefix_sums(spark.createDataFrame(rows, "g string, o double, n long"), ["g"], "o", ["n"], buckets)
    expect = {}
    for g in "ab":
        total = 0
        for r in sorted(r for r in rows if r[0] == g):
            total += r[2]
            expect[g, r[1]] = total
    assert {(r["g"], r["o"]): r["cum_n"] for r in got.collect()} == expect


@pytest.mark.parametrize("buckets", [1, 7, 64])
def test_hash_rank_is_a_permutation_per_group(spark, buckets):
    df = spark.range(500).withColumn("g", F.when(F.col("id") < 400, "hot").otherwise("cold"))
    got = K.hash_rank(df, ["g"], key_hash("id"), "id", buckets=buckets).collect()
    for g, n in (("hot", 400), ("cold", 100)):
        assert sorted(r["rank"] for r in got if r["g"] == g) == list(range(1, n + 1))
    assert {r["id"]: r["rank"] for r in got} == {
        r["id"]: r["rank"] for r in K.hash_rank(df.repartition(5), ["g"], key_hash("id"), "id", buckets=3).collect()
    }


def test_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 50, 301).astype(float)
    b = rng.normal(size=301)
    rows = [(float(x), None if i % 3 == 0 else float(y)) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "a double, b double")
    kept = [y for _, y in rows if y is not None]
    for q in (0.0, 0.25, 0.5, 1.0):
        got = {r["column"]: r["value"] for r in K.exact_quantiles(df, ["a", "b"], q).collect()}
        assert abs(got["a"] - np.quantile(a, q)) < 1e-12 and abs(got["b"] - np.quantile(kept, q)) < 1e-12


def test_exact_quantiles_with_a_tight_bracket(spark):
    rng = np.random.default_rng(8)
    v = np.round(rng.lognormal(size=4000), 2)
    df = spark.createDataFrame([(float(x),) for x in v], "v double").repartition(6)
    for q in (0.1, 0.5, 0.75):
        got = K.exact_quantiles(df, ["v"], q, k=64).first()["value"]
        assert abs(got - np.quantile(v, q)) < 1e-12


def test_rows_without_a_class_get_no_fold(spark):
    df = spark.range(30).withColumn("label", F.when(F.col("id") < 10, 1).when(F.col("id") < 20, 0))
    got = V.stratified_folds(df, "id", "label", 2).filter("label is null")
    assert got.count() == 10 and got.filter("fold is not null").isEmpty()


def test_folds_and_holdout_are_stratified(spark):
    df = spark.range(1000).withColumn("label", (F.col("id") < 137).cast("int"))
    folds = V.stratified_folds(df, "id", "label", 10).groupBy("fold", "label").count().collect()
    for label, n in ((1, 137), (0, 863)):
        sizes = [r["count"] for r in folds if r["label"] == label]
        assert len(sizes) == 10 and sum(sizes) == n and max(sizes) - min(sizes) <= 1
    test = V.stratified_holdout(df, "id", "label").filter("is_test").groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in test} == {1: 14, 0: 87}


def scored(spark, rows):
    return spark.createDataFrame([(i, y, float(p), float(p > 0.5)) for i, (y, p) in enumerate(rows)], "k long, label int, probability double, prediction double")


def test_auc_of_reversed_scores(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 1), rng.randint(0, 9) / 10) for _ in range(200)]
    up = E.roc_auc(scored(spark, rows)).first()[0]
    down = E.roc_auc(scored(spark, [(y, 1 - p) for y, p in rows])).first()[0]
    assert abs(up + down - 1) < 1e-12
    pairs = [(p > q) + 0.5 * (p == q) for y, p in rows if y for z, q in rows if not z]
    assert abs(up - sum(pairs) / len(pairs)) < 1e-12


def test_curve_ends_in_the_corners(spark):
    got = E.roc_curve(scored(spark, [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1)])).orderBy(F.desc("threshold")).collect()
    assert [(r["fpr"], r["tpr"]) for r in got] == [(0, 0), (0, 0.5), (0.5, 1), (1, 1)]


def test_degenerate_metrics_are_zero_not_errors(spark):
    none = E.binary_metrics(scored(spark, [(1, 0.1), (0, 0.2)])).first()
    assert (none["precision"], none["recall"], none["f1"], none["mcc"], none["kappa"]) == (0, 0, 0, 0, 0)
    one_class = scored(spark, [(1, 0.9), (1, 0.8)])
    m = E.binary_metrics(one_class).first()
    assert (m["accuracy"], m["precision"], m["mcc"], m["kappa"]) == (1, 1, 0, 0)
    assert E.roc_auc(one_class).first()[0] is None
    cells = {(r["actual"], r["predicted"]): r["count"] for r in E.confusion_matrix(one_class).collect()}
    assert cells == {(0, 0): 0, (0, 1): 0, (1, 0): 0, (1, 1): 2}


def test_overlap_matrix(spark):
    rows = [("a", k, 1 - k / 100) for k in range(20)] + [("b", k, 1 - k / 100) for k in range(20)] + [("c", k + 50, 1 - k / 100) for k in range(20)]
    df = spark.createDataFrame(rows, "model string, account_id long, probability double")
    got = {(r["model_a"], r["model_b"]): r["overlap"] for r in K.set_overlap(df, ["a", "b", "c"], 10).collect()}
    assert got["a", "b"] == got["b", "a"] == 1 and got["a", "c"] == got["c", "b"] == 0
    assert all(got[m, m] == 1 for m in "abc") and len(got) == 9


def test_top_n_breaks_ties_by_key(spark):
    df = spark.createDataFrame([(k, 0.5) for k in (5, 3, 9, 1)] + [(7, 0.9)], "k long, p double")
    assert [r["k"] for r in K.top_n(df, 3, "p", "k").collect()] == [7, 1, 3]


def test_best_model_needs_no_particular_list(spark):
    rows = [(m, k, float(v)) for m, v in (("x", 0.5), ("y", 0.7)) for k in E.METRICS]
    long = spark.createDataFrame(rows, "model string, metric string, value double")
    table = E.benchmark_table([long.filter("model = 'x'"), long.filter("model = 'y'")])
    assert E.weighted_best(table).first()["model"] == "y"


@pytest.mark.parametrize("k", [16, 4096])
def test_exact_quantiles_of_odd_columns(spark, k):
    """Hot values, ties at the ends, few values, nulls, NaN and columns without values; small sketches take several passes."""
    rng = np.random.default_rng(5)
    n = 3000
    columns = {
        "hot": np.where(rng.random(n) < 0.4, 7.0, rng.normal(7, 3, n)), "steps": rng.integers(0, 3, n).astype(float), "one": np.full(n, -2.5),
        "skewed": np.exp(rng.normal(0, 4, n)), "half": np.repeat([1.0, 2.0], n // 2), "edge": np.where(np.arange(n) < n // 2 + 1, 0.0, rng.random(n)),
    }
    rows = [(*[float(v[i]) for v in columns.values()], None, float("nan") if i % 2 else float(i)) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns) + ", gone double, partly double").repartition(5)
    columns["partly"] = np.arange(0.0, n, 2)
    for q in (0.0, 0.01, 0.5, 0.7501, 1.0):
        got = {r["column"]: r["value"] for r in K.exact_quantiles(df, [*columns, "gone"], q, k).collect()}
        assert got.pop("gone") is None
        for c, v in columns.items():
            assert abs(got[c] - np.quantile(v, q)) <= 1e-12 * max(1, abs(got[c])), (c, q)
    assert K.exact_quantiles(df.limit(0), ["hot"]).first()["value"] is None
