"""Evaluating and comparing scored lists. Input: rows with label, probability and prediction."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from propensia.operators.quality import histogram
from propensia.operators.ranking import prefix_sums, set_overlap, top_n

METRICS = ("roc_auc", "precision", "recall", "accuracy", "f1", "kappa", "mcc")


def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 when undefined."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _counts(label: str, prediction: str) -> dict[str, Column]:
    y, p = F.col(label) == 1, F.col(prediction) == 1
    cells = {"tp": y & p, "fp": ~y & p, "fn": y & ~p, "tn": ~y & ~p}
    return {k: F.count_if(c).cast("double").alias(k) for k, c in cells.items()}


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction", group: Sequence[str] = ()) -> DataFrame:
    """(actual, predicted, count) with all four cells, also empty ones."""
    cells = df.groupBy(*group).agg(*_counts(label, prediction).values())
    layout = [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]
    rows = [
        F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(c).cast("long").alias("count"))
        for a, p, c in layout
    ]
    return cells.select(*group, F.inline(F.array(*rows)))


def binary_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction", group: Sequence[str] = ()) -> DataFrame:
    """accuracy, precision, recall, f1, kappa, mcc from one pass of four conditional counts."""
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    agreed = _ratio(tp + tn, n)
    chance = _ratio((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
    spread = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return df.groupBy(*group).agg(*_counts(label, prediction).values()).select(
        *group,
        agreed.alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _ratio(agreed - chance, 1 - chance).alias("kappa"),
        _ratio(tp * tn - fp * fn, spread).alias("mcc"),
    )


def _score_steps(df: DataFrame, label: str, score: str, group: Sequence[str]) -> DataFrame:
    """Per distinct score: positives and negatives at it, and running sums from the highest score."""
    steps = df.groupBy(*group, F.col(score).alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )
    return prefix_sums(steps.withColumn("_down", -F.col("threshold")), group, "_down", ["pos", "neg"]).drop("_down")


def _totals(df: DataFrame, label: str, group: Sequence[str]) -> DataFrame:
    return df.groupBy(*group).agg(
        F.count_if(F.col(label) == 1).cast("double").alias("_p"), F.count_if(F.col(label) != 1).cast("double").alias("_n")
    )


def _with_totals(steps: DataFrame, totals: DataFrame, group: Sequence[str]) -> DataFrame:
    if group:
        return steps.join(totals, list(group))
    both = totals.select(F.struct("_p", "_n")).scalar()
    return steps.withColumn("_t", both).withColumns({"_p": F.col("_t._p"), "_n": F.col("_t._n")}).drop("_t")


def roc_curve(df: DataFrame, label: str = "label", score: str = "probability", group: Sequence[str] = ()) -> DataFrame:
    """(fpr, tpr, threshold): one point per distinct score and the origin at threshold infinity."""
    totals = _totals(df, label, group)
    points = _with_totals(_score_steps(df, label, score, group), totals, group).select(
        *group,
        F.try_divide(F.col("cum_neg"), F.col("_n")).alias("fpr"),
        F.try_divide(F.col("cum_pos"), F.col("_p")).alias("tpr"),
        F.col("threshold").cast("double").alias("threshold"),
    )
    origin = totals.select(
        *group, F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(float("inf")).alias("threshold")
    )
    return points.unionByName(origin)


def roc_auc(df: DataFrame, label: str = "label", score: str = "probability", group: Sequence[str] = ()) -> DataFrame:
    """Area under the curve, equal scores counting half; null with a single class."""
    steps = _score_steps(df, label, score, group)
    area = F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2.0))
    sums = steps.groupBy(*group).agg(area.alias("_area"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return sums.select(*group, F.try_divide(F.col("_area"), F.col("_p").cast("double") * F.col("_n")).alias("roc_auc"))


def cv_metrics(oof: DataFrame, model: str = "model", fold: str = "fold", label: str = "label", per_fold: bool = False) -> DataFrame:
    """The seven metrics per (model, fold), or their mean over the folds per model."""
    group = [model, fold]
    folds = binary_metrics(oof, label, group=group).join(roc_auc(oof, label, group=group), group)
    if per_fold:
        return folds.select(*group, *METRICS)
    return folds.groupBy(model).agg(*[F.avg(m).alias(m) for m in METRICS])


def benchmark_table(results: Sequence[DataFrame], model: str = "model", metrics: Sequence[str] = METRICS) -> DataFrame:
    """Several evaluators' (model, metric, value) results as one row per model."""
    merged = results[0]
    for more in results[1:]:
        merged = merged.unionByName(more)
    cells = [F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics]
    return merged.groupBy(model).agg(*cells)


def metrics_long(wide: DataFrame, model: str = "model", metrics: Sequence[str] = METRICS) -> DataFrame:
    """One row per model and metric."""
    return wide.unpivot([model], list(metrics), "metric", "value")


BEST_WEIGHTS = {"roc_auc": 0.25, "precision": 0.25, "recall": 0.25, "f1": 0.25}


def weighted_scores(table: DataFrame, weights: Mapping[str, float] = BEST_WEIGHTS, model: str = "model") -> DataFrame:
    """(model, weighted_score)."""
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.lit(weight) * F.col(name)
    return table.select(model, total.alias("weighted_score"))


def weighted_best(table: DataFrame, weights: Mapping[str, float] = BEST_WEIGHTS, model: str = "model") -> DataFrame:
    """The model with the highest weighted score, ties by name."""
    return top_n(weighted_scores(table, weights, model), 1, "weighted_score", model)


def lead_list(scored: DataFrame, model: str = "model", score: str = "probability") -> DataFrame:
    """Every scored row with its rank inside its model; equal scores share the better rank.

    Ranks come from counts per distinct score, so no model's rows are ordered in one task.
    """
    counts = scored.groupBy(model, score).agg(F.count(F.lit(1)).alias("n")).withColumn("_down", -F.col(score))
    ranks = prefix_sums(counts, [model], "_down", ["n"]).select(
        model, score, (F.col("cum_n") - F.col("n") + 1).alias("rank")
    )
    return scored.join(ranks, [model, score])


def lead_histogram(scored: DataFrame, key: str, n: int = 100, bins: int = 20, score: str = "probability") -> DataFrame:
    """Histogram of the probabilities of one model's n best leads."""
    return histogram(top_n(scored, n, score, key), score, bins)


def list_comparison(scored: DataFrame, models: Sequence[str], key: str, sizes: Sequence[int] = (10, 20)) -> DataFrame:
    """Overlap of the lead lists of all model pairs for several list lengths."""
    out = None
    for n in sizes:
        one = set_overlap(scored, models, n, key=key).withColumn("n", F.lit(n))
        out = one if out is None else out.unionByName(one)
    return out
