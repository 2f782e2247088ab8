"""Many columns in one pass: pair correlations and descriptions."""

import numpy as np

from propensia.operators import quality as Q


def test_correlations_of_columns_with_gaps(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(1e6, 1, (400, 30)) + rng.normal(size=(400, 1))
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 29] = 4.0
    names = [f"v{i}" for i in range(30)]
    rows = [tuple(None if v != v else float(v) for v in r) for r in x]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(7)
    got = {(r.column_a, r.column_b): r["corr"] for r in Q.corr_matrix(df, names).collect()}
    assert len(got) == 900
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            if 29 in (i, j):
                assert got[a, b] is None
            else:
                assert abs(got[a, b] - np.corrcoef(x[both, i], x[both, j])[0, 1]) < 1e-6 and got[a, b] == got[b, a]


def test_correlations_without_rows(spark):
    df = spark.createDataFrame([(1.0, None), (None, 2.0)], "a double, b double")
    for rows in (df, df.limit(0), spark.createDataFrame([], df.schema)):
        assert {(r.column_a, r.column_b, r["corr"]) for r in Q.corr_matrix(rows, ["a", "b"]).collect()} == {(p, q, None) for p in "ab" for q in "ab"}


def test_description_in_plain_aggregates(spark):
    df = spark.createDataFrame([(float(i % 7), None if i % 3 else i) for i in range(100)], "a double, b int")
    got = {r["column"]: r for r in Q.describe(df, ["a", "b"]).collect()}
    b = np.arange(0, 100, 3)
    assert (got["b"]["count"], got["b"]["min"], got["b"]["median"]) == (34, 0, np.median(b)) and abs(got["b"]["stddev"] - b.std(ddof=1)) < 1e-9
    plan = Q.describe(df, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "Python" not in plan
