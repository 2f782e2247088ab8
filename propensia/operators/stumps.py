"""Best one-level splits of weighted rows: every value of every column is tried, by grouped prefix sums.

Rows are first summed per (column, value), map-side, so the sort sees distinct values only. Running sums of the class
weights along a column then price each cut; they come from range partitions (``ranking.prefix_sums``), so one column with
most of the values is the work of many tasks. Per column one row remains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from propensia.operators.ranking import prefix_sums
from propensia.session import stage

#: impurities that agree to so many digits are ties: sums of weights differ in their last bits by the order of rows
DIGITS = 12


def _gini(a: Column, b: Column) -> Column:
    """Weight of a side times its chance of naming the wrong class by lot."""
    return F.when(a + b > 0, 2 * a * b / (a + b)).otherwise(0.0)


def best_splits(rows: DataFrame, values: Column, label: Column, weight: Column | None = None, ranges: int | None = None) -> DataFrame:
    """The cut with the lowest Gini impurity of every column.

    ``values`` is an array with a number per column, ``label`` 0 or 1. Returns feature (position in the array), threshold (midway to the
    next value; rows up to it are below), below and above (the class with more weight on that side, 0 if equal), impurity and
    error (the share of weight with the other class), per feature. Equal impurities go to the smallest value.

    Null and NaN cells take no part in their column, rows without label, array or positive weight in none. A column with fewer than two
    different values has no row; no rows give no rows. ``ranges`` is passed on to ``prefix_sums``.
    """
    w = (F.lit(1.0) if weight is None else weight).cast("double")
    cells = rows.select(label.cast("int").alias("y"), w.alias("w"), F.posexplode(values).alias("feature", "value"))
    cells = cells.filter("y in (0, 1) and w > 0 and value is not null and not isnan(value)")
    sums = cells.groupBy("feature", "value").agg(*[F.sum(F.when(F.col("y") == k, F.col("w")).otherwise(0.0)).alias(f"c{k}") for k in (0, 1)])
    sums = stage(sums, "sums")
    whole = sums.groupBy("feature").agg(F.sum("c0").alias("t0"), F.sum("c1").alias("t1"), F.max("value").alias("last"))
    a, b, t0, t1 = F.col("cum_c0"), F.col("cum_c1"), F.col("t0"), F.col("t1")
    total = t0 + t1
    priced = prefix_sums(sums, ["feature"], "value", ["c0", "c1"], ranges).join(whole, "feature").filter("value < last").select(
        "feature", "value",
        ((_gini(a, b) + _gini(t0 - a, t1 - b)) / total).alias("impurity"),
        (b > a).cast("int").alias("below"), (t1 - b > t0 - a).cast("int").alias("above"),
        ((F.least(a, b) + F.least(t0 - a, t1 - b)) / total).alias("error"),
    )
    best = priced.groupBy("feature").agg(
        F.min(F.struct(F.round("impurity", DIGITS).alias("rounded"), "value", "impurity", "below", "above", "error")).alias("s")
    ).select("feature", "s.value", "s.impurity", "s.below", "s.above", "s.error")
    best = stage(best, "splits")  # one row per column
    after = sums.select("feature", F.col("value").alias("later")).join(best.select("feature", "value"), "feature").filter("later > value")
    return best.join(after.groupBy("feature").agg(F.min("later").alias("later")), "feature").select(
        "feature", ((F.col("value") + F.col("later")) / 2).alias("threshold"), "below", "above", "impurity", "error"
    )


def best_split(rows: DataFrame, values: Column, label: Column, weight: Column | None = None) -> DataFrame:
    """The best cut of all columns (the first of equal ones): at most one row of ``best_splits``."""
    return best_splits(rows, values, label, weight).orderBy(F.round("impurity", DIGITS), "feature").limit(1)
