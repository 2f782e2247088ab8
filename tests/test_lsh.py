"""Hashed neighbours next to exact ones: recall, completeness, gaps, and how many rows are compared."""

import math
from functools import partial

import numpy as np
import pytest

from propensia.operators import lsh, neighbors as N, sampling as V


def clustered(n, dims=16, size=50, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (max(1, n // size), dims))
    return centres[rng.integers(len(centres), size=n)] + rng.normal(0, 0.15, (n, dims))


def frame(spark, x, start=0):
    rows = [(start + i, [None if math.isnan(v) else float(v) for v in r], float(i)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, vec array<double>, payload double").repartition(4)


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.id, r.target), {})[r["rank"]] = (r.neighbor_id, r.distance, r.value)
    return out


def recall(a, b):
    return sum(len({n for n, _, _ in a[k].values()} & {n for n, _, _ in b[k].values()}) for k in b) / sum(len(v) for v in b.values())


def test_recall_against_the_exact_join(spark):
    x = clustered(3000)
    queries, donors = frame(spark, x[:300], 10_000), frame(spark, x)
    exact, hashed = found(N.knn_join(queries, donors, 5)), found(lsh.lsh_knn_join(queries, donors, 5))
    assert exact.keys() == hashed.keys() and all(sorted(v) == [1, 2, 3, 4, 5] for v in hashed.values())
    assert recall(hashed, exact) >= 0.9
    distances = {(k, n): d for k, v in exact.items() for n, d, _ in v.values()}
    assert all(abs(distances[k, n] - d) < 1e-9 for k, v in hashed.items() for n, d, _ in v.values() if (k, n) in distances)


def test_comparisons_grow_far_slower_than_the_square(spark, monkeypatch):
    """Pairs that share a bucket, over the same density of clusters."""
    pairs = []
    for n in (1000, 2000, 4000):
        x = clustered(n)
        functions = max(1, round(math.log2(n / lsh.BUCKET)))
        width = lsh._sampled_width(frame(spark, x), 5, np.zeros(16))
        c = lsh.projections(16, 12, functions)
        keys = np.floor(np.einsum("nd,tfd->ntf", x, c[:, :, :-1]) / width + c[:, :, -1])
        pairs.append(sum(int((np.unique(keys[:, t], axis=0, return_counts=True)[1] ** 2).sum()) for t in range(12)))
    assert pairs[1] < 3 * pairs[0] and pairs[2] < 3 * pairs[1]
    assert pairs[2] < 12 * 4000**2 / 4


def test_every_query_gets_its_neighbours(spark):
    """Queries alone in their buckets, repeated vectors, hot buckets in blocks, self excluded, few donors."""
    x = np.concatenate([clustered(200), np.tile(clustered(1, seed=5), (150, 1)), np.full((3, 16), 900.0) + np.arange(3)[:, None] * 40])
    rows = frame(spark, x)
    for block_rows in (20, 4096):
        got = found(lsh.lsh_knn_join(rows, rows, 4, exclude_self=True, functions=3, width=2.0, block_rows=block_rows))
        assert len(got) == len(x) and all(len(v) == 4 and k[0] not in {n for n, _, _ in v.values()} for k, v in got.items())
        copies = [got[i, 0] for i in range(200, 350)]
        assert all([n for n, _, _ in (v[1], v[2], v[3], v[4])] == [j for j in range(200, 206) if j != 200 + i][:4] for i, v in enumerate(copies))
    few = found(lsh.lsh_knn_join(rows.filter("id < 10"), rows.filter("id in (3, 4)"), 5))
    assert all(len(v) == 2 for v in few.values()) and len(few) == 10
    assert lsh.lsh_knn_join(rows, rows.limit(0), 2).count() == 0 and lsh.lsh_knn_join(rows.limit(0), rows, 2).count() == 0


@pytest.mark.parametrize("join", [partial(lsh.lsh_knn_join, tables=16)])
def test_uses_with_hashed_neighbours(spark, join):
    x = clustered(600)
    rng = np.random.default_rng(1)
    holes = np.where(rng.random(x.shape) < 0.02, np.nan, x)
    names = [f"v{j}" for j in range(16)]
    rows = [(i, *[None if v != v else float(v) for v in r], int(r[0] > 0) if r[0] == r[0] else 0) for i, r in enumerate(holes)]
    df = spark.createDataFrame(rows, "key long, " + ", ".join(f"{n} double" for n in names) + ", label int")
    filled = {r.key: r for r in N.knn_impute(df, "key", names, 5, join=join).collect()}
    exact = {r.key: r for r in N.knn_impute(df, "key", names, 5).collect()}
    gaps = [(i, j) for i, j in zip(*np.nonzero(np.isnan(holes)))]
    same = sum(abs(filled[i][names[j]] - exact[i][names[j]]) < 1e-9 for i, j in gaps)
    assert gaps and all(filled[i][names[j]] is not None for i, j in gaps) and same >= 0.6 * len(gaps)
    complete = spark.createDataFrame([(i, *map(float, r), int(i < 100)) for i, r in enumerate(x)], df.schema)
    made = V.smote(complete, "key", "label", names, join=join)
    assert {r["label"]: r["count"] for r in made.groupBy("label").count().collect()} == {0: 500, 1: 500}
