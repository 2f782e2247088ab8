"""Nearest neighbours by p-stable hashing (Datar, Immorlica, Indyk, Mirrokni 2004) with exact re-ranking.

Beside the exact join of ``neighbors`` for sets where that join's bounds do not prune. A vector gets one bucket in each of
some tables: the floors of a few random projections over a width. Vectors near each other share a bucket in some
table with high probability. Only rows that share a bucket are compared, by exact distance; queries that meet fewer
donors than asked go through the exact join. What can be lost is a neighbour that shares no bucket with its query.

More rows take more projections per table, so buckets stay about equally full and comparisons grow about in proportion to
rows where these lie in clusters, not with their square. Hot buckets are cut into blocks on both sides.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from propensia.functions.hashing import key_hash
from propensia.operators.neighbors import _block_top_k, knn_join
from propensia.session import stage

#: rows of the bounded sample that the width is taken from
SAMPLE = 1000
#: widths of a bucket in distances to the k-th neighbour, as found in the sample
WIDTHS = 4.0
#: rows that a bucket should hold when projections split rows evenly
BUCKET = 64


def projections(dims: int, tables: int, functions: int, seed: int = 1) -> np.ndarray:
    """(tables, functions, dims + 1): coefficients of mean 0 and deviation 1, and an offset in widths.

    Sums of twelve draws of a linear congruence, rounded to six places: the same numbers anywhere.
    """
    x, draws = seed, []
    for _ in range(tables * functions * (dims * 12 + 1)):
        x = x * 48271 % 2147483647
        draws.append(x / 2147483647)
    rows = np.array(draws).reshape(tables, functions, dims * 12 + 1)
    normal = rows[:, :, :-1].reshape(tables, functions, dims, 12).sum(axis=3) - 6
    return np.round(np.concatenate([normal, rows[:, :, -1:]], axis=2), 6)


def _bucket_keys(coefficients: np.ndarray, width: float, fill: np.ndarray):
    tables, functions, _ = coefficients.shape
    flat, offsets = coefficients[:, :, :-1].reshape(tables * functions, -1).T, coefficients[:, :, -1].reshape(-1)
    odd = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(functions)], np.uint64)

    @F.pandas_udf("array<long>")
    def keys(vec: pd.Series) -> pd.Series:
        x = np.stack([np.asarray(v, dtype=float) for v in vec])
        x = np.where(np.isnan(x), fill, x)
        cells = np.floor(x @ flat / width + offsets).astype(np.int64).reshape(len(x), tables, functions)
        return pd.Series(list((cells.view(np.uint64) * odd).sum(axis=2, dtype=np.uint64).view(np.int64)))

    return keys


def _means(donors: DataFrame, dims: int) -> np.ndarray:
    """Column means; what gaps count as when a vector is hashed."""
    row = donors.agg(*[F.avg(F.nanvl(F.get("vec", F.lit(j)), F.lit(None).cast("double"))) for j in range(dims)]).first()
    return np.array([0.0 if m is None else m for m in row])


def _sampled_width(donors: DataFrame, k: int, fill: np.ndarray) -> float:
    """From at most ``SAMPLE`` donors: ``WIDTHS`` median distances to the k-th neighbour."""
    rows = donors.orderBy(key_hash("id", seed=5), "id").limit(SAMPLE).select("vec").collect()
    x = np.array([[np.nan if v is None else v for v in r["vec"]] for r in rows], dtype=float)
    x = np.where(np.isnan(x), fill, x)
    squares = (x**2).sum(axis=1)
    d = np.sqrt(np.maximum(squares[:, None] + squares[None, :] - 2 * x @ x.T, 0))
    near = np.sort(d, axis=1)[:, min(k, len(x) - 1)]
    spread = near[near > 0]
    return WIDTHS * float(np.median(spread)) if len(spread) else 1.0


def lsh_knn_join(
    queries: DataFrame, donors: DataFrame, k: int, exclude_self: bool = False, tables: int = 12, functions: int | None = None,
    width: float | None = None, block_rows: int = 4096, seed: int = 1,
) -> DataFrame:
    """(id, target, rank, neighbor_id, distance, value): k near donors of every query; takes and returns what ``knn_join`` does.

    ``functions`` is the number of projections per table (default: grows with the logarithm of the donors), ``width`` that of
    a bucket (default: from a bounded sample of ``SAMPLE`` donors). Distances and ranks are exact among the donors met, ties
    by smaller id; every query gets its k. Gaps count as the column mean in hashing, not in distances. Rows are moved once per table.
    """
    targeted = "target" in queries.columns
    if not targeted:
        queries = queries.withColumn("target", F.lit(0))
    if "payload" not in donors.columns:
        donors = donors.withColumn("payload", F.lit(None).cast("double"))
    queries = stage(queries.select("id", "vec", F.col("target").cast("int").alias("target")), "queries")
    donors = stage(donors.select("id", "vec", "payload"), "donors")
    n, dims = donors.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    if not n or not dims:
        return knn_join(queries if targeted else queries.drop("target"), donors, k, exclude_self)
    fill = _means(donors, dims)
    width = width or _sampled_width(donors, k, fill)
    functions = functions or max(1, round(math.log2(max(1.0, n / BUCKET))))
    keys = _bucket_keys(projections(dims, tables, functions, seed), width, fill)

    on = ["table", "key"]
    left = queries.withColumn("_keys", keys("vec")).select("id", "vec", "target", F.posexplode("_keys").alias(*on))
    right = donors.withColumn("_keys", keys("vec")).select("id", "vec", "payload", F.posexplode("_keys").alias(*on))
    left, right = stage(left, "query_keys"), stage(right, "donor_keys")
    blocks = lambda rows, name: rows.groupBy(*on).agg(F.ceil(F.count("*") / block_rows).cast("int").alias(name))
    sizes = stage(blocks(left, "nq").join(blocks(right, "nd"), on), "sizes")
    own = lambda n: F.pmod(F.xxhash64("id", F.lit(11)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = left.join(sizes, on).withColumn("qb", own(F.col("nq"))).withColumn("db", every("nd")).drop("nq", "nd")
    right = right.join(sizes, on).withColumn("db", own(F.col("nd"))).withColumn("qb", every("nq")).drop("nq", "nd")
    cell = [*on, "qb", "db"]
    met = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(
        _block_top_k(k, exclude_self, targeted), "id long, target int, neighbor_id long, distance double, value double"
    )
    met = met.groupBy("id", "target", "neighbor_id").agg(F.min("distance").alias("distance"), F.first("value").alias("value"))  # met in several tables
    best = W.partitionBy("id", "target").orderBy("distance", "neighbor_id")
    met = stage(met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), "met")
    full = met.filter(F.col("rank") == k).select("id", "target")
    short = queries.join(full, ["id", "target"], "left_anti")
    rest = knn_join(short if targeted else short.drop("target"), donors, k, exclude_self)
    names = ["id", "target", "neighbor_id", "distance", "value", "rank"]
    return met.join(full, ["id", "target"], "left_semi").select(*names).unionByName(rest.select(*names))
