"""Fitted models, their evaluation, storage and explanation (inventory M, V5, E10, X, S3).

Grids and iteration counts are short here; the library's defaults are the full ones.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import bindings as B
from checks.registry import query, rounded, s6
from propensia.operators import evaluation as E, explain as X, features as R, models as M, quality as Q, sampling as V, stumps as T
from propensia.session import shared_path, stage
from propensia.sources.artifacts import ArtifactStore

sql = B.sql
FOLDS, ITER = 3, 20
KEEP = ["vec_id", "label", "fold", "model", "prediction", "probability"]


def _train(spark, sf):
    """Scaled vectors with folds, written once for the many fits reading them."""
    rows = V.stratified_folds(B.vectors(spark, sf), "vec_id", "label", FOLDS)
    return stage(R.standard_scale(rows, B.FEATURES), "train")


def _oof(spark, sf, spec):
    rows = _train(spark, sf)
    return M.grid_search_cv(rows, spec(rows.count()), "vec_id", B.FEATURES, FOLDS).oof.select(*KEEP)


@query("v5_grid_search_cv")
def v5(spark, sf):
    rows = _train(spark, sf)
    specs = [M.logistic_l2(rows.count(), (0.01, 1), ITER), M.decision_tree((3, 5), (2,))]
    return M.grid_frame(spark, [M.grid_search_cv(rows, s, "vec_id", B.FEATURES, FOLDS) for s in specs])


@query("m1_logistic_l2")
def m1(spark, sf):
    return _oof(spark, sf, lambda n: M.logistic_l2(n, (0.01, 1), ITER))


@query("m1_logistic_baseline")
def m1b(spark, sf):
    return _oof(spark, sf, lambda n: M.logistic_l2(n, (0.01, 1), ITER, "baseline_logistic", B.FEATURES[:16]))


@query("m2_random_forest")
def m2(spark, sf):
    return _oof(spark, sf, lambda n: M.random_forest((20,), (5, 10)))


@query("m3_gradient_boosting")
def m3(spark, sf):
    return _oof(spark, sf, lambda n: M.gradient_boosting((10,), (0.1,)))


@query("m4_svm_linear")
def m4(spark, sf):
    return _oof(spark, sf, lambda n: M.svm(n, (1,), (0,), 10))


@query("m5_svm_rbf_approx")
def m5(spark, sf):
    return _oof(spark, sf, lambda n: M.svm(n, (1,), (128,), 10))


@query("m6_decision_tree")
def m6(spark, sf):
    return _oof(spark, sf, lambda n: M.decision_tree((5,), (2, 10)))


@query("m7_adaboost_samme")
def m7(spark, sf):
    return _oof(spark, sf, lambda n: M.adaboost(5))


@query("v6_knn_model")
def knn_model(spark, sf):
    return _oof(spark, sf, lambda n: M.knn("vec_id", (5,), ("distance",)))


@query("m8_lasso_select")
def m8(spark, sf):
    return M.lasso_select(_train(spark, sf), B.FEATURES, FOLDS, "vec_id", cs=(0.3, 1), max_iter=ITER)


def _split(spark, sf):
    rows = stage(V.stratified_holdout(B.vectors(spark, sf), "vec_id", "label"), "split")
    train, test = rows.filter("not is_test"), rows.filter("is_test")
    scale = R.fit_standard_scale(train, B.FEATURES)
    return R.apply_standard_scale(train, scale), R.apply_standard_scale(test, scale)


@query("m9_reduced_model")
def m9(spark, sf):
    train, test = _split(spark, sf)
    folded = stage(V.stratified_folds(train, "vec_id", "label", FOLDS), "train")
    kept = [r["feature"] for r in M.lasso_select(folded, B.FEATURES, FOLDS, "vec_id", cs=(0.3, 1), max_iter=ITER).collect()]
    if not kept:
        raise ValueError("the selection keeps no feature")
    scored = M.score(M.reduced_model(train, kept, max_iter=ITER), M.assemble(test, kept), ["vec_id", "label"])
    return E.binary_metrics(scored)


_ZERO = sql("select name as feature, 0.0::double as residual from (unpivot (select " + ", ".join(B.FEATURES) + " from vectors) on "
            + ", ".join(B.FEATURES) + " into name name value v) group by 1 union all select '(intercept)', 0.0::double")


def _residuals(spark, sf, c, elastic):
    """Residuals of a fit to convergence on all rows, rounded to what the solver's tolerance leaves."""
    rows = M.assemble(R.standard_scale(B.vectors(spark, sf), B.FEATURES), B.FEATURES)
    rows = stage(rows.select("label", "features"), "training")
    penalty = M.ridge_strength(c, rows.count())
    lr = M.LogisticRegression(elasticNetParam=elastic, standardization=False, maxIter=1000, tol=1e-12, regParam=penalty)
    l1, l2 = (penalty, 0.0) if elastic else (0.0, penalty)
    return rounded(M.optimality_residuals(lr.fit(rows), rows, B.FEATURES, l1, l2), "residual", places=4)


@query("m1_logistic_optimality", _ZERO)
def m1o(spark, sf):
    return _residuals(spark, sf, 1.0, 0.0)


@query("m8_lasso_optimality", _ZERO)
def m8o(spark, sf):
    return _residuals(spark, sf, 0.3, 1.0)


_F = ", ".join(B.FEATURES)
_CELLS = f"select vec_id, label, cast(substr(name, 2) as int) as j, v from (unpivot (select vec_id, label, {_F} from vectors) on {_F} into name name value v)"


def _priced(cells: str) -> str:
    """Every cut of every column with its impurity, votes and error; ``cells`` has label, j, v and a weight w."""
    return f"""
      select j, (v + later) / 2 as threshold, v, cast(lb > la as int) as below, cast(tb - lb > ta - la as int) as above,
             (2 * la * lb / (la + lb) + 2 * (ta - la) * (tb - lb) / (ta + tb - la - lb)) / (ta + tb) as impurity,
             (least(la, lb) + least(ta - la, tb - lb)) / (ta + tb) as error
      from (select j, v, sum(a) over c as la, sum(b) over c as lb, sum(a) over (partition by j) as ta, sum(b) over (partition by j) as tb,
                   lead(v) over (partition by j order by v) as later
            from (select j, v, sum(case when label = 0 then w else 0 end) as a, sum(case when label = 1 then w else 0 end) as b from {cells} group by 1, 2)
            window c as (partition by j order by v rows unbounded preceding))
      where later is not null"""


def _samme(rounds: int) -> str:
    """The first rounds of boosting, unrolled: a cut, then the weights it leaves."""
    steps = {"cells": f"select vec_id, label, j, floor(4 * v) as v from ({_CELLS})", "w1": "select vec_id, 1.0::double as w from vectors"}
    for r in range(1, rounds + 1):
        steps[f"s{r}"] = f"{_priced(f'(select * from cells join w{r} using (vec_id))')} order by round(impurity, 12), j, v limit 1"
        steps[f"w{r + 1}"] = (f"select vec_id, w * case when (case when c.v <= s.threshold then below else above end) = label then 1.0 "
                              f"else (1 - error) / error end as w from cells c join s{r} s using (j) join w{r} using (vec_id)")
    found = " union all ".join(
        f"select {r} as round, j as feature, threshold, below, above, {s6('ln((1 - error) / error)', 'weight')} from s{r}" for r in range(1, rounds + 1))
    return sql(found, **steps)


@query("m6_first_splits", sql(
    f"select j as feature, {s6('threshold', places=9)}, below, above, {s6('impurity', places=9)}, {s6('error', places=9)} "
    f"from ({_priced(f'(select *, 1.0::double as w from ({_CELLS}))')}) qualify row_number() over (partition by j order by round(impurity, 12), v) = 1"))
def m6s(spark, sf):
    """The best first cut of a tree along every column, over all values."""
    rows = B.vectors(spark, sf)
    return rounded(T.best_splits(rows, F.array(*B.FEATURES), F.col("label")), "threshold", "impurity", "error", places=9)


@query("m7_samme_rounds", _samme(3))
def m7r(spark, sf):
    """The first rounds of boosting with exact cuts, on columns of few values."""
    rows = B.vectors(spark, sf).select("label", *[F.floor(F.col(c) * 4).cast("double").alias(c) for c in B.FEATURES])
    model = M.AdaBoostSamme(maxIter=3, exactSplits=True).fit(M.assemble(rows, B.FEATURES))
    found = [(i + 1, int(s[0]), s[1], int(s[2]), int(s[3]), s[4]) for i, s in enumerate(model.rounds())]
    return rounded(spark.createDataFrame(found, "round int, feature int, threshold double, below int, above int, weight double"), "weight")


@query("m10_oof_predictions")
def m10(spark, sf):
    lr = M.logistic_l2(500, (1,), ITER).estimator
    return M.oof_predictions(_train(spark, sf), lr, "vec_id", B.FEATURES, FOLDS)


@query("e10_final_assessment")
def e10(spark, sf):
    train, test = _split(spark, sf)
    folded = stage(V.stratified_folds(train, "vec_id", "label", FOLDS), "train")
    specs = [M.logistic_l2(folded.count(), (0.1,), ITER), M.decision_tree((5,), (2,))]
    best = M.pick_best([M.grid_search_cv(folded, s, "vec_id", B.FEATURES, FOLDS) for s in specs])
    scored = M.score(best.model, M.assemble(test, B.FEATURES), ["vec_id", "label"])
    return E.metrics_long(
        E.binary_metrics(scored).withColumn("roc_auc", E.roc_auc(scored).scalar()).withColumn("model", F.lit(best.name))
    )


@query("s3_artifact_sink")
def s3(spark, sf):
    rows = _train(spark, sf)
    store = ArtifactStore(spark, shared_path(spark, "artifacts"))
    done = M.grid_search_cv(rows, M.logistic_l2(rows.count(), (0.1,), ITER), "vec_id", B.FEATURES, FOLDS)
    store.predictions(done.name, lambda: done.oof)

    def again():
        raise AssertionError("a stored model must not be fitted again")

    store.model(done.name, lambda: M.as_stored(done.model))
    stored = store.model(done.name, again)
    return M.score(stored, M.assemble(rows, B.FEATURES), ["vec_id", "label"])


@query("s3_predictions_by_model", sql("select model, doc_id, label, probability from scores"))
def s3_predictions(spark, sf):
    """Given scores of three models through the store, read back with the model's name."""
    given, store = B.scores(spark, sf), ArtifactStore(spark, shared_path(spark, "artifacts"))
    for name in ("m1", "m2", "m3"):
        store.predictions(name, lambda: given.filter(F.col("model") == name))
    return store.all_predictions().select("model", "doc_id", "label", "probability")


# ---- X -----------------------------------------------------------------------------------


def _reduced(spark, sf):
    train, test = _split(spark, sf)
    return M.reduced_model(train, B.FEATURES, max_iter=ITER), train, test


@query("x1_lime_explain")
def x1(spark, sf):
    model, train, test = _reduced(spark, sf)
    spread = R.fit_standard_scale(train, B.FEATURES)
    return X.lime_explain(X.scorer(model), Q.sample_n(test, 15, "vec_id"), "vec_id", B.FEATURES, spread, samples=1000)


@query("x2_shap_values")
def x2(spark, sf):
    model, train, test = _reduced(spark, sf)
    return X.shap_values(X.scorer(model), test, X.background_sample(train, "vec_id"), "vec_id", B.FEATURES, permutations=4)


_COEF = {c: round((i + 1) / 64 - 0.5, 6) for i, c in enumerate(B.FEATURES)}
_LINEAR = " union all ".join(
    f"select vec_id, '{c}' as feature, ({c} - avg({c}) over ()) * ({b}) as shap from vectors" for c, b in _COEF.items()
)


def _linear(spark, sf):
    rows = B.vectors(spark, sf)
    means = {c: m for c, (m, _) in R.fit_standard_scale(rows, B.FEATURES).items()}
    return X.linear_shap(rows, "vec_id", _COEF, means)


@query("x2_shap_linear", sql("select vec_id, feature, " + s6("shap", places=9) + f" from ({_LINEAR})"))
def x2l(spark, sf):
    return rounded(_linear(spark, sf), "shap", places=9)


_POOL, _POOL_ORDER = 3, "(vec_id * 7919 + 43) % 1000003"
_WALKED = f"""
select vec_id, feature, (v - m) * b as shap, s * abs(b) / sqrt({_POOL}) as error
from (unpivot (select vec_id, {_F} from vectors) on {_F} into name feature value v)
join (
  select feature, avg(v) as m, stddev_samp(v) as s, (cast(substr(feature, 2) as int) + 1) / 64.0 - 0.5 as b
  from (unpivot (select {_F} from vectors order by {_POOL_ORDER}, vec_id limit {_POOL}) on {_F} into name feature value v)
  group by feature
) using (feature)
"""


def _linear_score(df):
    weights = F.lit([_COEF[c] for c in B.FEATURES])
    return df.withColumn("p", F.aggregate(F.zip_with("vec", weights, lambda v, b: v * b), F.lit(0.0), lambda a, v: a + v))


@query("x2_shap_walks", sql("select vec_id, feature, " + s6("shap", places=6) + ", " + s6("error", places=6) + f" from ({_WALKED})"))
def x2w(spark, sf):
    """Walks under a linear score: a pair from each background row makes the sampled values exact."""
    rows = B.vectors(spark, sf)
    pool = X.background_sample(rows, "vec_id", _POOL, order=F.expr(_POOL_ORDER))
    got = X.shap_values(_linear_score, rows, pool, "vec_id", B.FEATURES, permutations=2 * _POOL)
    return rounded(got.drop("base"), "shap", "error", places=6)


@query("x3_shap_summary", sql("select feature, " + s6("avg(abs(shap))", "mean_abs_shap", 9) + f" from ({_LINEAR}) group by 1"))
def x3(spark, sf):
    return rounded(X.shap_summary(_linear(spark, sf)), "mean_abs_shap", places=9)


@query("x4_background_sample", sql("select vec_id, label from vectors order by (vec_id * 7919 + 43) % 1000003, vec_id limit 100"))
def x4(spark, sf):
    order = (F.col("vec_id") * 7919 + 43) % 1_000_003
    return X.background_sample(B.vectors(spark, sf).select("vec_id", "label"), "vec_id", order=order)
