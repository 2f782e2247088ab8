"""Classifiers, selection, storage and explanations on separable data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from propensia.functions.hashing import normal_hash
from propensia.operators import evaluation as E, explain as X, features as R, models as M, quality as Q, sampling as V
from propensia.session import shared_path, stage
from propensia.sources.artifacts import ArtifactStore

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    """The label follows a and b; c is noise."""
    df = spark.range(240).select(
        F.col("id").alias("key"), *[normal_hash("id", seed=10 * (i + 1)).alias(c) for i, c in enumerate(COLS)]
    ).withColumn("label", (F.col("a") + 2 * F.col("b") + 0.3 * normal_hash("key", seed=77) > 0).cast("int"))
    return stage(V.stratified_folds(df, "key", "label", 2))


SPECS = {
    "logistic": lambda n: M.logistic_l2(n, (0.1, 10), 30),
    "forest": lambda n: M.random_forest((10,), (5,)),
    "boosting": lambda n: M.gradient_boosting((10,), (0.1,)),
    "svm": lambda n: M.svm(n, (1,), (0,), 6),
    "svm_rbf": lambda n: M.svm(n, (10,), (64,), 6),
    "tree": lambda n: M.decision_tree((5,), (2,)),
    "adaboost": lambda n: M.adaboost(8),
    "knn": lambda n: M.knn("key", (5,), ("distance",)),
}


@pytest.mark.parametrize("name", SPECS)
def test_models_beat_the_prior_out_of_fold(rows, name):
    done = M.grid_search_cv(rows, SPECS[name](rows.count()), "key", COLS, 2)
    oof = done.oof.collect()
    assert sorted(r["key"] for r in oof) == list(range(240))  # every row scored once
    assert all(0 <= r["probability"] <= 1 for r in oof)
    assert E.roc_auc(done.oof).first()[0] > 0.8
    assert E.binary_metrics(done.oof).first()["accuracy"] > 0.7


def test_full_grids_have_the_stated_sizes(spark):
    specs = M.model_list(1000, "key", COLS)
    assert [len(s.grid) for s in specs] == [4, 4, 5, 9, 9, 6, 6, 9, 1]
    assert sum(len(s.grid) for s in specs) == 53


def test_lasso_drops_noise_and_reduced_model_scores(rows):
    kept = {r["feature"]: r["coefficient"] for r in M.lasso_select(rows, COLS, 2, cs=(0.05, 0.1), max_iter=50).collect()}
    assert "b" in kept and "c" not in kept
    model = M.reduced_model(rows, sorted(kept))
    scored = M.score(model, M.assemble(rows, sorted(kept)), ["key", "label"])
    assert E.roc_auc(scored).first()[0] > 0.8


def test_stored_models_are_not_fitted_again(spark, rows):
    store = ArtifactStore(spark, shared_path(spark, "store"))
    data = M.assemble(rows, COLS)
    for name, estimator in (("knn", M.KnnClassifier(k=3, weights="distance")), ("svm", M.CalibratedSvc(maxIter=3)), ("boosted", M.AdaBoostSamme(maxIter=3))):
        first = store.model(name, lambda: M.as_stored(estimator.fit(data)))
        again = store.model(name, lambda: pytest.fail("fitted twice"))
        a, b = (M.score(m, data, ["key"]).orderBy("key").collect() for m in (first, again))
        np.testing.assert_allclose([r["probability"] for r in a], [r["probability"] for r in b])
    made = []
    for _ in range(2):
        store.predictions("boosted", lambda: made.append(1) or M.score(first, data, ["key", "label"]))
    assert made == [1] and store.all_predictions().filter("model = 'boosted'").count() == 240


def test_shapley_values_add_up_and_agree_with_the_closed_form(spark, rows):
    coef, means = {"a": 1.0, "b": -2.0, "c": 0.5}, {c: m for c, (m, _) in R.fit_standard_scale(rows, COLS).items()}

    def linear(df):
        return df.withColumn("p", F.get("vec", F.lit(0)) * 1.0 + F.get("vec", F.lit(1)) * -2.0 + F.get("vec", F.lit(2)) * 0.5)

    some = Q.sample_n(rows, 12, "key")
    got = X.shap_values(linear, some, rows, "key", COLS, permutations=400).collect()
    exact = {(r["key"], r["feature"]): r["shap"] for r in X.linear_shap(some, "key", coef, means).collect()}
    assert len(got) == 36
    assert max(abs(r["shap"] - exact[r["key"], r["feature"]]) for r in got) < 0.6
    score = {r["key"]: sum(coef[c] * r[c] for c in COLS) for r in some.collect()}
    for key in score:
        parts = [r for r in got if r["key"] == key]
        assert abs(sum(r["shap"] for r in parts) + parts[0]["base"] - score[key]) < 1e-9
    pool = Q.sample_n(rows, 5, "key", 7)
    base = {c: m for c, (m, _) in R.fit_standard_scale(pool, COLS).items()}
    for r in X.shap_values(linear, some, pool, "key", COLS, permutations=10).join(some, "key").collect():
        assert abs(r["shap"] - coef[r["feature"]] * (r[r["feature"]] - base[r["feature"]])) < 1e-9 and r["error"] > 0
    assert all(r["error"] is None for r in X.shap_values(linear, some, pool, "key", COLS, permutations=2).collect())

    def product(df):
        return df.withColumn("p", F.get("vec", F.lit(0)) * F.get("vec", F.lit(1)))

    one = X.shap_values(product, some, Q.sample_n(rows, 1, "key", 7), "key", COLS, permutations=2).join(some, "key")
    start = Q.sample_n(rows, 1, "key", 7).first()
    for r in one.collect():  # a pair of opposite orders gives two features their exact values
        a, b = (start["a"] + r["a"]) / 2, (start["b"] + r["b"]) / 2
        exact = {"a": (r["a"] - start["a"]) * b, "b": (r["b"] - start["b"]) * a, "c": 0.0}
        assert abs(r["shap"] - exact[r["feature"]]) < 1e-9
    top = X.shap_summary(X.linear_shap(rows, "key", coef, means)).first()["feature"]
    assert top == "b"


def test_local_surrogate_recovers_a_linear_score(rows):
    def linear(df):
        return df.withColumn("p", F.get("vec", F.lit(0)) * 0.2 + F.get("vec", F.lit(1)) * -0.4)

    spread = R.fit_standard_scale(rows, COLS)
    got = X.lime_explain(linear, Q.sample_n(rows, 3, "key"), "key", COLS, spread, samples=400, top=2).collect()
    assert len(got) == 6 and all(r["local_r2"] > 0.99 for r in got)
    for r in got:
        if r["feature"] != "c":
            slope = {"a": 0.2, "b": -0.4}[r["feature"]] * spread[r["feature"]][1]
            assert abs(r["weight"] - slope) < 0.03


def test_tasks_of_walks_are_sized_by_steps(spark, rows, monkeypatch):
    """A task sorts a bounded number of steps, however small the rows are before they are walked; the values stay."""
    linear = lambda df: df.withColumn("p", F.aggregate("vec", F.lit(0.0), lambda a, v: a + v))
    pool = Q.sample_n(rows, 5, "key", 7)
    few = X.shap_values(linear, rows, pool, "key", COLS, permutations=4)
    one = {(r["key"], r["feature"]): (r["shap"], r["error"]) for r in few.collect()}
    monkeypatch.setattr(X, "STEP_ROWS", 100)
    wide = X.shap_values(linear, rows, pool, "key", COLS, permutations=4)
    assert "REPARTITION_BY_NUM" in wide._jdf.queryExecution().executedPlan().toString()
    most = -(-rows.count() * 4 * (len(COLS) + 1) // 100)
    assert f", {most})" in wide._jdf.queryExecution().executedPlan().toString()
    for r in wide.collect():
        assert abs(r["shap"] - one[r["key"], r["feature"]][0]) < 1e-12 and abs(r["error"] - one[r["key"], r["feature"]][1]) < 1e-12


def test_fits_of_a_calibrated_machine_and_of_folds_run_beside_each_other(spark, rows, monkeypatch):
    """Margin fits of both halves and of all rows overlap, and with one grid point the folds do; scores are as one by one."""
    import threading
    import time

    now, most, lock, original = [], [], threading.Lock(), M.LinearSVC._fit

    def watched(self, df):
        with lock:
            now.append(1)
            most.append(len(now))
        time.sleep(1)
        try:
            return original(self, df)
        finally:
            with lock:
                now.pop()

    monkeypatch.setattr(M.LinearSVC, "_fit", watched)
    done = M.grid_search_cv(rows, M.svm(240, (1,), (0,), 6), "key", COLS, 2)
    assert max(most) > 3 and len(most) == 9  # three fits in each of two folds, three of the refit
    most.clear()
    alone = M.grid_search_cv(rows, M.svm(240, (1,), (0,), 6), "key", COLS, 2, parallelism=1)
    assert max(most) == 3
    one, other = ({r["key"]: r["probability"] for r in d.oof.collect()} for d in (done, alone))
    assert one.keys() == other.keys() and all(abs(one[k] - other[k]) < 1e-6 for k in one)
