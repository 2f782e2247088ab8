"""The neighbour join, imputation and balancing against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from propensia.operators import neighbors as N, sampling as V


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    rows = [(int(i), [None if np.isnan(v) else float(v) for v in r]) for i, r in zip(ids, x)]
    return spark.createDataFrame(rows, "id long, vec array<double>")


def brute(q, d, k, exclude=False):
    out = {}
    for i, a in enumerate(q):
        dist = []
        for j, b in enumerate(d):
            known = ~np.isnan(a) & ~np.isnan(b)
            if known.any() and not (exclude and i == j):
                dist.append((np.sqrt(((a - b)[known] ** 2).sum() * len(a) / known.sum()), j))
        out[i] = [j for _, j in sorted(dist)[:k]]
    return out


def result(df):
    out = {}
    for r in df.orderBy("id", "rank").collect():
        out.setdefault(r["id"], []).append(r["neighbor_id"])
    return out


@pytest.mark.parametrize("gaps", [0.0, 0.15])
def test_join_is_exact_over_cells_and_blocks(spark, gaps):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(5, 3)) * 10
    d = centers[rng.choice(5, 300, p=[0.6, 0.1, 0.1, 0.1, 0.1])] + rng.normal(size=(300, 3))
    q = centers[rng.integers(0, 5, 60)] + rng.normal(size=(60, 3))
    d[rng.random(d.shape) < gaps] = np.nan
    q[rng.random(q.shape) < gaps] = np.nan
    got = result(N.knn_join(frame(spark, q), frame(spark, d), 4, pivots=8, block_rows=20))
    assert got == {i: v for i, v in brute(q, d, 4).items() if v}


def test_self_join_and_ties(spark):
    x = np.array([[0.0], [1.0], [1.0], [2.0], [10.0]])
    got = result(N.knn_join(frame(spark, x), frame(spark, x), 2, exclude_self=True, pivots=2, block_rows=2))
    assert got == {0: [1, 2], 1: [2, 0], 2: [1, 0], 3: [1, 2], 4: [3, 1]}


def test_fewer_donors_than_neighbours(spark):
    x = np.array([[0.0], [1.0]])
    assert result(N.knn_join(frame(spark, x), frame(spark, x), 5)) == {0: [0, 1], 1: [1, 0]}


def test_votes(spark):
    train = spark.createDataFrame([(0, 0.0, 1), (1, 1.0, 0), (2, 3.0, 0)], "k long, x double, label int")
    test = spark.createDataFrame([(10, 0.0), (11, 1.5)], "k long, x double")
    even = {r["k"]: r["probability"] for r in N.knn_classify(test, train, ["x"], "k", "label", 3).collect()}
    near = {r["k"]: r["probability"] for r in N.knn_classify(test, train, ["x"], "k", "label", 3, "distance").collect()}
    assert abs(even[10] - 1 / 3) < 1e-12
    assert near[10] == 1.0  # a neighbour at distance 0 decides
    w = np.array([1 / 1.5, 1 / 0.5, 1 / 1.5])
    assert abs(near[11] - w[0] / w.sum()) < 1e-12


def test_imputation_uses_rows_that_have_the_value(spark):
    rows = [(0, None, 0.0), (1, 4.0, 0.1), (2, 6.0, 0.2), (3, None, 0.05), (4, 100.0, 50.0), (5, None, None)]
    df = spark.createDataFrame(rows, "k long, a double, b double")
    got = {r["k"]: (r["a"], r["b"]) for r in N.knn_impute(df, "k", ["a", "b"], 2).collect()}
    assert got[0][0] == 5.0 and got[3][0] == 5.0 and got[1] == (4.0, 0.1)
    assert abs(got[5][0] - np.mean([4, 6, 100])) < 1e-9  # shares no element with any donor


def test_synthetic_rows_lie_between_minority_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 2))
    rows = [(i, int(i < 12), float(a), float(b)) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "k long, label int, a double, b double")
    out = V.smote(df, "k", "label", ["a", "b"])
    assert {r["label"]: r["count"] for r in V.class_balance(out, "label").collect()} == {0: 48, 1: 48}
    made = out.filter("synthetic").collect()
    assert len(made) == 36 and len({r["k"] for r in made}) == 36 and all(r["k"] < 0 for r in made)
    near = brute(x[:12], x[:12], 5, exclude=True)
    for r in made:
        p = np.array([r["a"], r["b"]])
        gaps = [np.linalg.norm(p - x[i]) + np.linalg.norm(p - x[j]) - np.linalg.norm(x[i] - x[j]) for i in near for j in near[i]]
        assert min(gaps) < 1e-9
    again = V.smote(df.repartition(5), "k", "label", ["a", "b"])
    assert again.exceptAll(out).isEmpty()


def test_block_search_equals_all_pairs():
    """Bounds in single precision leave out no neighbour: copies, near ties, gaps, shifted and outlying rows."""
    import pandas as pd

    rng = np.random.default_rng(6)
    d = rng.normal(size=(5000, 12))
    d = np.concatenate([d, np.repeat(d[:1], 200, axis=0), d[:40] + 1e-9, d[:1] * 1e9, np.zeros((3, 12))])
    for move, gaps in ((0.0, 0.0), (1e6, 0.0), (0.0, 0.1)):
        y, x = d + move, np.concatenate([d[:20], rng.normal(size=(30, 12))]) + move
        y[rng.random(y.shape) < gaps] = np.nan
        x[rng.random(x.shape) < gaps] = np.nan
        queries = pd.DataFrame({"id": range(len(x)), "vec": list(x), "target": 0})
        donors = pd.DataFrame({"id": range(len(y)), "vec": list(y), "payload": 0.0})
        got = N._block_top_k(4, True, False)(queries, donors).sort_values(["id", "distance", "neighbor_id"])
        assert got.groupby("id")["neighbor_id"].apply(list).to_dict() == {i: v for i, v in brute(x, y, 4, True).items() if v}


def test_queries_are_copied_to_few_cells(spark, monkeypatch):
    """Without structure every cell is near: a query then meets one cell per block of donors, not one per root of their number."""
    x = np.random.default_rng(7).normal(size=(3000, 24))
    staged, stage = [], N.stage
    monkeypatch.setattr(N, "stage", lambda df, name="stage": staged.append(stage(df, name)) or staged[-1])
    N.knn_join(frame(spark, x[:100], range(5000, 5100)), frame(spark, x), 3, block_rows=1000)
    cells = next(s for s in staged if "cells" in s.columns)
    assert cells.agg(F.max(F.size("cells"))).first()[0] <= 3
