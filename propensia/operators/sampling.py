"""Class balance, hold-out and fold assignment, synthetic minority rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from propensia.functions.hashing import MODULUS, key_hash, unit_hash
from propensia.operators.neighbors import _vectors, knn_join
from propensia.operators.ranking import hash_cuts, hash_rank, rank_section


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Rows per class."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))


def stratified_holdout(df: DataFrame, key: str, label: str, share: float = 0.1, seed: int = 42, hash_value: Column | None = None, modulus: int = MODULUS, out: str = "is_test") -> DataFrame:
    """Mark ceil(share x class size) rows of every class as test rows.

    The rows with the smallest key hashes of a class are taken; the cut is found first and then
    applied in place, so wide rows are not shuffled. The side depends on the key alone: feature sets
    over the same keys split alike.
    """
    value = key_hash(key, seed=seed) if hash_value is None else hash_value
    cuts = hash_cuts(df, label, value, key, lambda n: [math.ceil(share * n)], modulus)
    return df.withColumn(out, rank_section(label, value, key, cuts) == 0)


def stratified_folds(df: DataFrame, key: str, label: str, folds: int = 10, seed: int = 42, hash_value: Column | None = None, modulus: int = MODULUS, out: str = "fold") -> DataFrame:
    """Fold number 0..folds-1 per row; the folds of a class differ by at most one row.

    A fold is a section of the class in key-hash order, assigned in place like the hold-out.
    """
    value = key_hash(key, seed=seed) if hash_value is None else hash_value
    cuts = hash_cuts(df, label, value, key, lambda n: [n * f // folds for f in range(1, folds)], modulus)
    return df.withColumn(out, rank_section(label, value, key, cuts))


def smote(
    df: DataFrame,
    key: str,
    label: str,
    features: Sequence[str],
    k: int = 5,
    seed: int = 43,
    rank_hash: Column | None = None,
    modulus: int = MODULUS,
    draw: Callable[[Column, int], Column] | None = None,
    step: Callable[[Column], Column] | None = None,
    join: Callable[..., DataFrame] = knn_join,
) -> DataFrame:
    """Synthetic minority rows that balance the two classes (Chawla et al. 2002), appended.

    Each synthetic row i draws a (minority row, neighbour) pair uniformly and a point on the segment
    between them, all as functions of i. The key takes no part in distances. Added rows have the key
    -(i + 1) and ``synthetic`` true. ``draw(i, n)`` and ``step(i)`` replace the default hash draws, ``join``
    the exact neighbour join.
    """
    spark = df.sparkSession
    sizes = {r[label]: r["count"] for r in class_balance(df, label).collect()}
    values = [F.col(c).cast("double").alias(c) for c in features]
    marked = df.select(key, label, *values).withColumn("synthetic", F.lit(False))
    if len(sizes) != 2:
        raise ValueError("balancing needs exactly two classes")
    minority, n_min = min(sizes.items(), key=lambda kv: kv[1])
    missing, k = max(sizes.values()) - n_min, min(k, n_min - 1)
    if missing == 0:
        return marked
    if k < 1:
        raise ValueError("a class of one row has no neighbours to balance it with")
    rows = _vectors(df.filter(F.col(label) == F.lit(minority)), key, features)
    ranked = hash_rank(rows, [], key_hash("id", seed=seed) if rank_hash is None else rank_hash, "id", "base", modulus)
    near = join(rows, rows, k, exclude_self=True).select(
        F.col("id").alias("base_id"), F.col("rank").cast("long").alias("nth"), "neighbor_id"
    )
    i = F.col("i")
    pair = draw(i, n_min * k) if draw else F.pmod(F.xxhash64(i, F.lit(seed)), F.lit(n_min * k))
    u = step(i) if step else unit_hash(i, seed=seed + 1)
    draws = spark.range(missing).withColumnRenamed("id", "i").select("i", pair.alias("pair"), u.alias("u")).select(
        "i", "u",
        (F.floor(F.col("pair") / F.lit(k)) + 1).cast("long").alias("base"),
        (F.pmod("pair", F.lit(k)) + 1).cast("long").alias("nth"),
    )
    points = (
        draws.join(ranked.select("base", F.col("id").alias("base_id"), F.col("vec").alias("a")), "base")
        .join(near, ["base_id", "nth"])
        .join(rows.select(F.col("id").alias("neighbor_id"), F.col("vec").alias("b")), "neighbor_id")
        .withColumn("_x", F.zip_with("a", "b", lambda a, b: a + F.col("u") * (b - a)))
    )
    made = points.select(
        (-(i + 1)).cast(df.schema[key].dataType).alias(key),
        F.lit(minority).cast(df.schema[label].dataType).alias(label),
        *[F.get("_x", F.lit(j)).alias(c) for j, c in enumerate(features)],
        F.lit(True).alias("synthetic"),
    )
    return marked.unionByName(made)
