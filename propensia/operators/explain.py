"""Feature contributions of single predictions."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window as W, functions as F

from propensia.functions.hashing import key_hash, normal_hash
from propensia.operators.quality import sample_n
from propensia.session import parallel_buckets

Scorer = Callable[[DataFrame], DataFrame]

#: scored steps of walks that one task sorts and sums
STEP_ROWS = 1_000_000


def scorer(model) -> Scorer:
    """Adds ``p``, the model's class-1 probability of the array column ``vec``."""

    def add(df: DataFrame) -> DataFrame:
        scored = model.transform(df.withColumn("features", array_to_vector("vec")))
        return scored.select(*df.columns, vector_to_array("probability")[1].alias("p"))

    return add


def _row(df: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    return df.select(F.col(key).alias("key"), F.expr("array(" + ", ".join(f"cast(`{c}` as double)" for c in features) + ")").alias("x"))


def background_sample(df: DataFrame, key: str, n: int = 100, seed: int = 42, order=None) -> DataFrame:
    """n reproducible random rows."""
    return sample_n(df, n, key, seed, order)


def lime_explain(
    score: Scorer, rows: DataFrame, key: str, features: Sequence[str], spread: Mapping[str, tuple[float, float]],
    samples: int = 5000, top: int = 10, kernel_width: float | None = None, seed: int = 42,
) -> DataFrame:
    """(key, feature, weight, intercept, local_r2) of a local linear surrogate per row (Ribeiro et al. 2016).

    Every row is repeated with seeded normal noise, scored in one distributed pass and weighted by
    closeness. A group is one row's ``samples`` perturbations; only its ridge system is solved in Python.
    """
    width = kernel_width or 0.75 * len(features) ** 0.5
    scale = F.lit([float(spread[c][1] or 0.0) for c in features])
    last = F.lit(len(features) - 1)
    noisy = (
        _row(rows, key, features)
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
        .repartition("key", "i")  # few rows become many; spread them before drawing and scoring
        .withColumn("z", F.transform(F.sequence(F.lit(0), last), lambda j: F.when(
            F.col("i") == 0, F.lit(0.0)).otherwise(normal_hash(F.col("key"), F.col("i"), j, seed=seed))))
        .withColumn("vec", F.transform("x", lambda v, j: v + F.get("z", j) * F.get(scale, j)))
    )
    far = F.aggregate("z", F.lit(0.0), lambda a, v: a + v * v)
    weighted = score(noisy).select("key", "z", "p", F.sqrt(F.exp(-far / F.lit(width * width))).alias("w"))
    names = list(features)

    def surrogate(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        z, y, w = np.stack(pdf["z"].to_numpy()), pdf["p"].to_numpy(), pdf["w"].to_numpy()

        def ridge(cols):
            a = z[:, cols]
            mean_a, mean_y = np.average(a, axis=0, weights=w), np.average(y, weights=w)
            ac, yc = a - mean_a, y - mean_y
            beta = np.linalg.solve((ac * w[:, None]).T @ ac + np.eye(len(cols)), (ac * w[:, None]).T @ yc)
            return beta, mean_y - mean_a @ beta, ac @ beta, yc

        beta = ridge(np.arange(z.shape[1]))[0]
        cols = np.argsort(-np.abs(beta), kind="stable")[:top]
        beta, intercept, fitted, yc = ridge(cols)
        total = (w * yc * yc).sum()
        r2 = 1 - (w * (yc - fitted) ** 2).sum() / total if total > 0 else 0.0
        return pd.DataFrame({"key": pdf["key"].iloc[0], "feature": [names[c] for c in cols], "weight": beta, "intercept": intercept, "local_r2": r2})

    kind = weighted.schema["key"].dataType.simpleString()
    out = weighted.groupBy("key").applyInPandas(surrogate, f"key {kind}, feature string, weight double, intercept double, local_r2 double")
    return out.withColumnRenamed("key", key)


def shap_values(
    score: Scorer, rows: DataFrame, background: DataFrame, key: str, features: Sequence[str], permutations: int = 10, seed: int = 42,
) -> DataFrame:
    """(key, feature, shap, error, base): sampled Shapley values (Strumbelj and Kononenko 2014).

    Each (row, permutation) walks from a background row to the row, one feature at a time in a hashed
    order; a feature's value is the mean change at its step. Walks come in pairs from one background row, the second
    in reverse order (antithetic sampling), and a row's pairs take the background rows in turn from a hashed start. Per row
    the values sum to the row's score minus ``base``, the mean score of its background draws. ``error`` is the standard error over
    pairs, null for a single pair; an odd last walk is a pair of its own. ``background`` is a small sample. ``rows`` are counted
    first: a task gets the rows of about ``STEP_ROWS`` steps, as the plan would size tasks by the rows before they are walked.
    """
    n = len(features)
    explained = rows.count()
    tasks = max(parallel_buckets(rows.sparkSession), math.ceil(explained * permutations * (n + 1) / STEP_ROWS))
    spread = ["key"] if explained >= 16 * tasks else ["key", "pair"]  # a few rows are spread by their pairs of walks
    pool = _row(background, key, features).agg(F.array_sort(F.collect_list("x"))).scalar()
    walks = (
        _row(rows, key, features)
        .withColumn("walk", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
        .withColumn("pair", F.shiftright("walk", 1))
        .repartition(tasks, *spread)  # window and sums per pair need no other exchange
        .withColumn("_pool", pool)
        .withColumn("b", F.get("_pool", F.pmod(key_hash("key", seed=seed) + F.col("pair"), F.size("_pool")).cast("int")))
        .withColumn("order", F.transform(
            F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.struct(
                key_hash(F.col("key"), F.col("pair"), j, seed=seed + 1).alias("h"), j.alias("j")))),
            lambda s: s["j"]))
        .withColumn("order", F.when(F.col("walk") % 2 == 1, F.reverse("order")).otherwise(F.col("order")))
        .withColumn("place", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.array_position("order", j)))
        .withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n))))
        .withColumn("vec", F.transform("x", lambda v, j: F.when(F.get("place", j) <= F.col("step"), v).otherwise(F.get("b", j))))
        .select("key", "pair", "walk", "step", F.get("order", F.col("step") - 1).alias("j"), "vec")
    )
    along = W.partitionBy("key", "pair", "walk").orderBy("step")  # features + 1 rows each
    steps = score(walks).withColumn("change", F.col("p") - F.lag("p").over(along)).withColumn(
        "start", F.first("p").over(along)
    )
    names = F.lit(list(features))
    pairs = steps.filter(F.col("step") > 0).groupBy("key", "pair", "j").agg(F.avg("change").alias("change"), F.avg("start").alias("start"))
    error = F.stddev_samp("change") / F.sqrt(F.count(F.lit(1)))
    return (
        pairs.groupBy("key", "j").agg(F.avg("change").alias("shap"), error.alias("error"), F.avg("start").alias("base"))
        .select(F.col("key").alias(key), F.get(names, F.col("j")).alias("feature"), "shap", "error", "base")
    )


def linear_shap(df: DataFrame, key: str, coefficients: Mapping[str, float], means: Mapping[str, float]) -> DataFrame:
    """Exact contributions ``b_j (x_j - mean_j)`` of a linear score, in its own units."""
    cells = {c: (F.col(c) - F.lit(float(means[c]))) * F.lit(float(b)) for c, b in coefficients.items()}
    return df.select(key, *[e.alias(c) for c, e in cells.items()]).unpivot([key], list(cells), "feature", "shap")


def shap_summary(values: DataFrame) -> DataFrame:
    """Features by mean absolute contribution."""
    return values.groupBy("feature").agg(F.avg(F.abs("shap")).alias("mean_abs_shap")).orderBy(F.desc("mean_abs_shap"), "feature")
