"""Preparation fitted per fold, searches that go on where they stopped, and stored artifacts tied to their data."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from propensia.operators import models as M
from propensia.operators.preprocess import Preprocessor, PreprocessorModel
from propensia.session import shared_path
from propensia.sources.artifacts import ArtifactStore, fingerprint


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    out = []
    for i in range(240):
        x = float(rng.normal())
        out.append((i, int(x + rng.normal() > 0), i % 3, None if i % 7 == 0 else x, float("nan") if i % 11 == 0 else float(i % 5), 3.0, None, ["a", "b.c", None][i // 3 % 3] if i < 200 else "d"))
    return spark.createDataFrame(out, "key long, label int, fold int, x double, y double, same double, gone double, kind string").repartition(4)


NUMERIC = ["x", "y", "same", "gone"]


def test_preparation_like_numpy(spark, rows):
    train, test = rows.filter("fold > 0 and key < 200"), rows.filter("fold = 0 or key >= 200")
    model = Preprocessor(numericCols=NUMERIC, categoricalCols=["kind"]).fit(train)
    plain = {r.key: r for r in train.collect()}
    for c in ("x", "y"):
        seen = np.array([r[c] for r in plain.values() if r[c] is not None and r[c] == r[c]])
        filled = np.array([r[c] if r[c] is not None and r[c] == r[c] else np.median(seen) for r in plain.values()])
        got = next(f for f in model.fitted if f[0] == c)
        assert np.allclose(got[2:5], [np.median(seen), filled.mean(), filled.std()])
    assert list(model.cells()) == [*NUMERIC, "kind_a", "kind_b_c", "kind_missing"]
    named = {r.key: r for r in model.named(test, ["key", "kind"]).collect()}
    assert all(r.same == r.gone == 0 for r in named.values())
    assert {(r.kind, r.kind_b_c, r.kind_missing) for r in named.values()} == {("a", 0, 0), ("b.c", 1, 0), (None, 0, 1), ("d", 0, 0)}
    vectors = {r.key: r.v for r in model.transform(test).select("key", vector_to_array("features").alias("v")).collect()}
    assert all(np.allclose(v, list(named[k])[2:]) for k, v in vectors.items())

    path = shared_path(spark, "model")
    PipelineModel([model]).write().overwrite().save(path)
    loaded = PipelineModel.load(path).stages[0]
    assert isinstance(loaded, PreprocessorModel) and loaded.uid == model.uid and loaded.fitted == [tuple(f) for f in model.fitted]
    assert {r.key: r.v for r in loaded.transform(test).select("key", vector_to_array("features").alias("v")).collect()} == vectors


def spec(n):
    return M.logistic_l2(n, (0.1, 10), 20)


def test_a_fold_does_not_see_its_own_rows(spark, rows):
    """Out-of-fold scores are those of a preparation and a fit made by hand on the other folds."""
    done = M.grid_search_cv(rows, spec(240), "key", NUMERIC, 3, preprocess=Preprocessor(numericCols=NUMERIC, categoricalCols=["kind"]))
    got = {r.key: r.probability for r in done.oof.collect()}
    assert len(got) == 240 and len(done.grid) == 2
    c = done.best["regParam"]
    for fold in range(3):
        train, test = rows.filter(F.col("fold") != fold), rows.filter(F.col("fold") == fold)
        model = Preprocessor(numericCols=NUMERIC, categoricalCols=["kind"]).fit(train)
        lr = LogisticRegression(elasticNetParam=0.0, standardization=False, maxIter=20, regParam=c * 240 / train.count())
        for r in M.score(lr.fit(model.transform(train)), model.transform(test), ["key"]).collect():
            assert abs(got[r.key] - r.probability) < 1e-6
    scored = done.scored(rows, ["key"])
    assert scored.count() == 240 and done.prepares


def test_one_point_out_of_fold(spark, rows):
    """Scores of one estimator are those of a search with that point alone."""
    prepare = Preprocessor(numericCols=NUMERIC)
    lr = LogisticRegression(elasticNetParam=0.0, standardization=False, maxIter=20)
    one = {r.key: r.probability for r in M.oof_predictions(rows, lr, "key", NUMERIC, 3, preprocess=prepare).collect()}
    search = M.grid_search_cv(rows, M.ModelSpec("plain", lr), "key", NUMERIC, 3, preprocess=prepare)
    assert {r.key: r.probability for r in search.oof.collect()}.keys() == one.keys()
    assert all(abs(r.probability - one[r.key]) < 1e-9 for r in search.oof.collect())


def test_residuals_tell_a_minimum_from_other_fits(spark, rows):
    made = Preprocessor(numericCols=["x", "y"]).fit(rows).transform(rows).cache()
    for l1, l2 in ((0.0, 0.05), (0.03, 0.0)):
        lr = LogisticRegression(elasticNetParam=float(l1 > 0), regParam=max(l1, l2), standardization=False, maxIter=500, tol=1e-12)
        residuals = [r.residual for r in M.optimality_residuals(lr.fit(made), made, ["x", "y"], l1, l2).collect()]
        assert len(residuals) == 3 and max(residuals) < 1e-4
        stopped = [r.residual for r in M.optimality_residuals(lr.copy({lr.maxIter: 1}).fit(made), made, ["x", "y"], l1, l2).collect()]
        assert max(stopped) > 10 * max(residuals)


def test_a_search_goes_on_where_it_stopped(spark, rows, monkeypatch):
    path, prepare = shared_path(spark, "search"), Preprocessor(numericCols=NUMERIC)
    fits = []
    original = LogisticRegression._fit
    monkeypatch.setattr(LogisticRegression, "_fit", lambda self, df: fits.append(len(fits)) or (1 / 0 if len(fits) == 4 else original(self, df)))
    with pytest.raises(ZeroDivisionError):
        M.grid_search_cv(rows, spec(240), "key", NUMERIC, 3, parallelism=1, preprocess=prepare, path=path)
    fits.clear()
    monkeypatch.setattr(LogisticRegression, "_fit", lambda self, df: fits.append(1) or original(self, df))
    first = M.grid_search_cv(rows, spec(240), "key", NUMERIC, 3, parallelism=1, preprocess=prepare, path=path)
    assert len(fits) == 3 + 1  # three of six were done; one refit
    again = M.grid_search_cv(rows, spec(240), "key", NUMERIC, 3, preprocess=prepare, path=path)
    assert len(fits) == 4 and again.grid == first.grid
    assert sorted(map(tuple, again.scored(rows, ["key"]).collect())) == sorted(map(tuple, first.scored(rows, ["key"]).collect()))


def test_all_neighbour_points_from_one_join(spark, rows, monkeypatch):
    joins = []
    original = M.knn_join
    monkeypatch.setattr(M, "knn_join", lambda *a, **k: joins.append(1) or original(*a, **k))
    prepare = Preprocessor(numericCols=NUMERIC)
    done = M.grid_search_cv(rows, M.knn("key"), "key", NUMERIC, 3, preprocess=prepare)
    assert len(joins) == 3 and len(done.grid) == 6
    train, test = rows.filter("fold <> 1"), rows.filter("fold = 1")
    model = prepare.fit(train)
    alone = M.KnnClassifier(k=done.best["k"], weights=done.best["weights"], keyCol="key").fit(model.transform(train))
    one = {r.key: r.probability for r in M.score(alone, model.transform(test), ["key"]).collect()}
    got = {r.key: r.probability for r in done.oof.filter("fold = 1").collect()}
    assert got.keys() == one.keys() and all(abs(got[k] - one[k]) < 1e-9 for k in one)


def test_fingerprints_follow_rows_and_parameters(spark, rows):
    one = fingerprint(rows, "a", 1)
    assert one == fingerprint(rows.repartition(9).orderBy("x"), "a", 1)
    others = [fingerprint(rows, "a", 2), fingerprint(rows.filter("key > 0"), "a", 1), fingerprint(rows.union(rows.limit(1)), "a", 1), fingerprint(rows.withColumn("y", F.lit(0.0)), "a", 1), fingerprint(rows.withColumnRenamed("y", "z"), "a", 1)]
    assert len({one, *others}) == 6
    assert fingerprint(rows.limit(0)) == fingerprint(rows.filter("key < 0"))
    swapped = spark.createDataFrame([(None, 1), (2, None)], "a int, b int"), spark.createDataFrame([(1, None), (None, 2)], "a int, b int")
    assert fingerprint(swapped[0]) != fingerprint(swapped[1])


def test_stored_predictions_by_model(spark, rows):
    store = ArtifactStore(spark, shared_path(spark, "store"))
    for name in ("m1", "m2"):
        store.predictions(name, lambda: rows.select("key", "label").withColumn("model", F.lit(name)))
    assert {r["model"]: r["count"] for r in store.all_predictions().groupBy("model").count().collect()} == {"m1": 240, "m2": 240}


def test_a_second_comparison_fits_nothing(spark, rows, monkeypatch):
    from propensia.plans.modelling import TrainTest, compare_models, leads

    fits = []
    original = LogisticRegression._fit
    monkeypatch.setattr(LogisticRegression, "_fit", lambda self, df: fits.append(1) or original(self, df))
    store = ArtifactStore(spark, shared_path(spark, "store"))
    data = TrainTest(rows, rows.limit(20), ["x", "y"], "key")
    first = compare_models(data, [spec(240)], 3, store)
    assert len(fits) == 7
    again = compare_models(TrainTest(rows.repartition(3), data.test, ["x", "y"], "key"), [spec(240)], 3, store)
    assert len(fits) == 7 and again[0].grid == first[0].grid
    assert leads(data, again).count() == 20
    changed = rows.withColumn("x", F.when(F.col("key") == 5, 2.5).otherwise(F.col("x")))
    compare_models(TrainTest(changed, data.test, ["x", "y"], "key"), [spec(240)], 3, store)
    assert len(fits) == 14
