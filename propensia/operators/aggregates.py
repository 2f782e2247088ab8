"""Grouped sums, row picking, simple regression and its quality figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def pivot_sum(df: DataFrame, key: str, category: str, value: str, domain: Sequence[str]) -> DataFrame:
    """Sum per key and category, one column per domain value, 0 where there is none."""
    zero = F.lit(0).cast(df.schema[value].dataType)
    return df.groupBy(key).agg(
        *[F.coalesce(F.sum(F.when(F.col(category) == v, F.col(value))), zero).alias(v) for v in domain]
    )


def first_row_per_group(df: DataFrame, key: str, order: Sequence[str], where: Column | None = None) -> DataFrame:
    """The first row per key in a stated order, among rows meeting a condition (map-side combined)."""
    rest = [c for c in df.columns if c != key]
    rows = df if where is None else df.filter(where)
    picked = rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def group_size(df: DataFrame, key: str, out: str = "size") -> DataFrame:
    """Rows per key, largest first."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(out)).orderBy(F.desc(out), key)


def ols_fit(df: DataFrame, y: str, x: str) -> DataFrame:
    """One row (slope, intercept, r2, n) of y on x over complete rows."""
    return df.agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.regr_count(y, x).alias("n"),
    )


def ols_predict(df: DataFrame, fit: DataFrame, x: str, out: str = "predicted") -> DataFrame:
    """``intercept + slope * x`` with the one-row fit as a scalar subquery."""
    line = fit.select(F.struct("slope", "intercept")).scalar()
    return df.withColumn("_fit", line).withColumn(
        out, F.col("_fit.intercept") + F.col("_fit.slope") * F.col(x)
    ).drop("_fit")


def ols_impute(df: DataFrame, y: str, x: str) -> DataFrame:
    """Missing y from the line fitted on complete rows; y is left alone elsewhere."""
    guessed = ols_predict(df, ols_fit(df, y, x), x, "_guess")
    return guessed.withColumn(y, F.coalesce(F.col(y), F.col("_guess"))).drop("_guess")


def regression_metrics(df: DataFrame, y: str, predicted: str) -> DataFrame:
    """One row of fit quality; the log error is null when a value lies at or below -1."""
    a, p = F.col(y).cast("double"), F.col(predicted).cast("double")
    err = a - p
    log_err = F.log1p(F.when(a > -1, a)) - F.log1p(F.when(p > -1, p))
    unexplained = F.avg(err * err)
    return df.filter(a.isNotNull() & p.isNotNull()).agg(
        (1 - F.try_divide(F.var_pop(err), F.var_pop(a))).alias("explained_variance"),
        F.when(F.count_if((a <= -1) | (p <= -1)) == 0, F.avg(log_err * log_err)).alias("mean_squared_log_error"),
        (1 - F.try_divide(unexplained, F.var_pop(a))).alias("r2"),
        F.avg(F.abs(err)).alias("mae"),
        unexplained.alias("mse"),
        F.sqrt(unexplained).alias("rmse"),
    )
