"""Profiling and data-quality reports; every report is a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from propensia.functions.clean import columns_by_type
from propensia.functions.hashing import key_hash
from propensia.operators.moments import corr_matrix  # noqa: F401  (one of the reports of this module)
from propensia.operators.ranking import exact_quantiles, running_total_lag


class DataQualityError(Exception):
    """A strict check found violations."""


def _one_row_long(df: DataFrame, cells: dict[str, Column], name: str) -> DataFrame:
    """One aggregation pass, then one output row per aggregate."""
    return df.agg(*[c.alias(k) for k, c in cells.items()]).unpivot([], list(cells), "column", name)


def profile_columns(df: DataFrame) -> DataFrame:
    """(column, type, non_null)."""
    counts = _one_row_long(df, {c: F.count(F.col(c)) for c in df.columns}, "non_null")
    types = [F.lit(x) for f in df.schema for x in (f.name, f.dataType.simpleString())]
    return counts.withColumn("type", F.element_at(F.create_map(*types), F.col("column")))


def missing_counts(df: DataFrame, only_positive: bool = False) -> DataFrame:
    """(column, missing)."""
    out = _one_row_long(
        df, {c: F.count_if(F.col(c).isNull()) for c in df.columns}, "missing"
    )
    return out.filter(F.col("missing") > 0) if only_positive else out


def missing_total(df: DataFrame) -> DataFrame:
    """One row: nulls in all columns together."""
    return missing_counts(df).agg(F.sum("missing").alias("missing"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: how many rows repeat an earlier row (nulls are equal)."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))


def value_counts(df: DataFrame, col: str, by_value: bool = False) -> DataFrame:
    """(value, count) of non-null values, most frequent first or in value order."""
    out = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    return out.orderBy(col) if by_value else out.orderBy(F.desc("count"), col)


def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """(bin, low, high, count) of equal-width bins over [min, max]; the last bin is closed."""
    value = F.col(col).cast("double")
    span = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi")).alias("s")).scalar()
    width = (F.col("_s.hi") - F.col("_s.lo")) / F.lit(float(bins))
    spot = F.when(width > 0, F.least(F.floor((value - F.col("_s.lo")) / width), F.lit(bins - 1)))
    return (
        df.filter(F.col(col).isNotNull())
        .withColumn("_s", span)
        .select(F.coalesce(spot, F.lit(0)).cast("long").alias("bin"), "_s")
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("count"), F.first("_s").alias("_s"))
        .select(
            "bin",
            (F.col("_s.lo") + F.col("bin") * width).alias("low"),
            (F.col("_s.lo") + (F.col("bin") + 1) * width).alias("high"),
            "count",
        )
    )


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42, order: Column | None = None) -> DataFrame:
    """n reproducible random rows: the smallest key hashes, kept by a per-partition top-n."""
    return df.orderBy(order if order is not None else key_hash(key, seed=seed), key).limit(n)


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in a stated order."""
    return df.orderBy(*order).limit(n)


def distinct_count(df: DataFrame, key: str, approximate: bool = False) -> DataFrame:
    """One row: number of distinct keys."""
    count = F.approx_count_distinct(key) if approximate else F.count_distinct(key)
    return df.agg(count.alias("distinct_keys"))


def sentinel_rows(df: DataFrame, sentinel: str = "?") -> DataFrame:
    """Rows where any text column equals the sentinel."""
    hit = F.lit(False)
    for name in columns_by_type(df)[1]:
        hit = hit | F.coalesce(F.col(name) == sentinel, F.lit(False))
    return df.filter(hit)


def join_cardinality(df: DataFrame, *key: str, strict: bool = False) -> DataFrame:
    """(key, count) of keys that are not unique; the strict form raises when there are any."""
    bad = df.groupBy(*key).agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") > 1)
    if strict and not bad.isEmpty():
        raise DataQualityError(f"key {key} is not unique")
    return bad


def opening_entries(ledger: DataFrame, key: str, order: Sequence[str], amount: str = "amount", balance: str = "balance") -> DataFrame:
    """Per account the first row (in the given order) whose signed amount equals its balance."""
    rest = [c for c in ledger.columns if c != key]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return (
        ledger.filter(F.col(amount) == F.col(balance))
        .groupBy(key)
        .agg(first.alias("_r"))
        .select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])
    )


def opening_entry_check(ledger: DataFrame, key: str, order: Sequence[str], amount: str = "amount", balance: str = "balance") -> DataFrame:
    """One row: accounts, accounts with an opening entry, accounts lacking one, entries off balance."""
    opening = F.col(amount) == F.col(balance)
    first = F.min_by(F.struct(F.col(amount).alias("a"), F.col(balance).alias("b")), F.when(opening, F.struct(*order)))
    accounts = ledger.groupBy(key).agg(first.alias("_first"), (F.coalesce(F.bool_or(opening), F.lit(False)) & F.col(key).isNotNull()).alias("_has"))
    return accounts.agg(
        F.count(F.lit(1)).alias("accounts"),
        F.count_if("_has").alias("with_opening"),
        F.count_if(~F.col("_has")).alias("without_opening"),
        F.count_if(F.col("_has") & (F.col("_first.a") != F.col("_first.b"))).alias("off_balance"),
    )


def accounts_without_opening(ledger: DataFrame, key: str, amount: str = "amount", balance: str = "balance") -> DataFrame:
    """Keys that have no row with amount = balance."""
    good = ledger.filter(F.col(amount) == F.col(balance)).select(key).distinct()
    return ledger.select(key).distinct().join(good, key, "left_anti")


def series_corr(left: DataFrame, right: DataFrame, period: str) -> DataFrame:
    """Correlation of two rows-per-period series on their common periods."""
    a = left.groupBy(period).agg(F.count(F.lit(1)).alias("a"))
    b = right.groupBy(period).agg(F.count(F.lit(1)).alias("b"))
    return a.join(b, period).agg(F.corr("a", "b").alias("corr"))


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, count, min, max, mean, stddev, skewness, median) of numeric columns.

    One aggregate of the plain rows for all columns, one row wide, and the passes of the exact median.
    """
    parts = {
        "count": F.count, "min": F.min, "max": F.max, "mean": F.avg, "stddev": F.stddev_samp, "skewness": F.skewness,
    }
    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    row = rows.agg(*[fn(f"c{i}").alias(f"{name}{i}") for i in range(len(cols)) for name, fn in parts.items()])
    cells = [F.struct(F.lit(c).alias("column"), *[F.col(f"{name}{i}").alias(name) for name in parts]) for i, c in enumerate(cols)]
    medians = exact_quantiles(df, cols, 0.5).withColumnRenamed("value", "median")
    return row.select(F.inline(F.array(*cells))).join(medians, "column", "left")


def attrition_waterfall(steps: DataFrame, order: str = "step_no", delta: str = "delta") -> DataFrame:
    """Step deltas with the running base each bar starts from and the total it reaches."""
    based = running_total_lag(steps, order, delta, "base")
    return based.withColumn("total", F.col("base") + F.col(delta))


def group_size_distribution(df: DataFrame, key: str) -> DataFrame:
    """(size, keys): how many keys have each number of rows."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("keys"))


def period_activity(ledger: DataFrame, key: str, period: str) -> DataFrame:
    """(period, rows, accounts)."""
    per_key = ledger.groupBy(period, key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy(period).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("accounts"))


def account_timeline(ledger: DataFrame, key: str, value: object, order: Sequence[str], balance: str = "balance", year: int | None = None, date: str = "date") -> DataFrame:
    """Date-ordered balance of one account, optionally of one calendar year."""
    from propensia.operators.filters import filter_year

    rows = ledger.filter(F.col(key) == F.lit(value))
    if year is not None:
        rows = filter_year(rows, date, year)
    return rows.select(key, *order, balance).orderBy(*order)
