"""Window statistics, indicators, scaling and imputation."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from propensia.operators import features as R
from propensia.operators.aggregates import ols_fit, ols_impute


def wide(spark, values):
    cols = [f"{m}_{k}" for m in R.FEATURE_MEASURES for k in range(1, 14)]
    return spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "id long, " + ", ".join(f"{c} double" for c in cols))


def test_window_features_match_pandas_and_skip_nulls(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(6, 4, 13)) * 100
    x[1, :, 4] = np.nan
    x[2, :, :3] = np.nan  # no first periods at all
    rows = [[None if np.isnan(v) else float(v) for v in r.ravel()] for r in x]
    got = R.window_features(wide(spark, rows)).orderBy("id").toPandas()
    for j, m in enumerate(R.FEATURE_MEASURES):
        p = pd.DataFrame(x[:, j, :12])  # the 13th period takes no part
        expect = {
            "mean": p.mean(axis=1), "min": p.min(axis=1), "max": p.max(axis=1),
            "mad": p.sub(p.mean(axis=1), axis=0).abs().mean(axis=1),
            "mean_ratio_last3_first3": p[[9, 10, 11]].mean(axis=1) / (p[[0, 1, 2]].mean(axis=1) + 1e-7),
        }
        if m in ("credit", "withdrawal"):
            expect["sum"] = p.sum(axis=1)
        if m in ("balance", "credit"):
            expect["std"] = p.std(axis=1)
        for name, e in expect.items():
            np.testing.assert_allclose(got[f"{m}_{name}"].astype(float), e, rtol=1e-9, equal_nan=True)
    assert len([c for c in got.columns if c not in wide(spark, rows).columns]) == 24


def test_indicators(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "z")], "k int, c string")
    first = R.one_hot_drop_first(df, {"c": ["a", "b", "none"]}).orderBy("k").collect()
    assert [(r["c_b"], r["c_none"]) for r in first] == [(1, 0), (0, 0), (0, 0), (0, 0)]
    assert R.one_hot_drop_first(df, {"c": ["a", "Hl.m. x"]}).columns == ["k", "c_Hl_m_ x"]
    domains = R.fit_domains(df.filter("k < 4"), ["c"])
    assert domains == {"c": ["a", "b", "missing"]}
    every = R.one_hot_ignore(df, domains).orderBy("k").collect()
    assert [(r["c_a"], r["c_b"], r["c_missing"]) for r in every] == [(0, 1, 0), (1, 0, 0), (0, 0, 1), (0, 0, 0)]


def test_scaling_uses_population_deviation_and_keeps_constants_at_zero(spark):
    df = spark.createDataFrame([(1.0, 7.0, None), (2.0, 7.0, 1.0), (6.0, 7.0, 3.0)], "a double, b double, c double")
    got = R.standard_scale(df, ["a", "b", "c"]).collect()
    a = np.array([1.0, 2.0, 6.0])
    np.testing.assert_allclose([r["a"] for r in got], (a - 3) / a.std())
    assert [r["b"] for r in got] == [0, 0, 0]
    assert [r["c"] for r in got] == [None, -1, 1]


def test_transform_is_fitted_on_training_rows_only(spark):
    train = spark.createDataFrame([(1.0, "x"), (3.0, "y"), (None, None)], "n double, c string")
    test = spark.createDataFrame([(None, "new"), (5.0, "x")], "n double, c string")
    t = R.ColumnTransform(["n"], ["c"]).fit(train)
    assert t.feature_names() == ["n", "c_missing", "c_x", "c_y"]
    got = t.transform(test).collect()
    assert [(r["n"], r["c_missing"], r["c_x"], r["c_y"]) for r in got][0] == (0, 0, 0, 0)
    assert got[1]["c_x"] == 1 and got[1]["n"] > 3


def test_line_through_complete_rows(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 7.0), (3.0, None), (4.0, 11.0)], "x double, y double")
    fit = ols_fit(df, "y", "x").first()
    assert (round(fit["slope"], 9), round(fit["intercept"], 9), round(fit["r2"], 9), fit["n"]) == (2, 3, 1, 3)
    assert [round(r["y"], 9) for r in ols_impute(df, "y", "x").orderBy("x").collect()] == [5, 7, 9, 11]


def test_melt(spark):
    df = spark.createDataFrame([(1, 10.0, 20.0)], "id int, balance_1 double, balance_2 double")
    assert [tuple(r) for r in R.melt_windows(df, "id", "balance", 2).collect()] == [(1, 1, 10.0), (1, 2, 20.0)]
