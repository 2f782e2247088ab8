"""Row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from propensia.functions.codes import MIN_AGE_DAYS


def filter_eq(df: DataFrame, col: str, value: object) -> DataFrame:
    """Rows whose column equals a value."""
    return df.filter(F.col(col) == F.lit(value))


def filter_notnull(df: DataFrame, *cols: str) -> DataFrame:
    """Rows complete in the given columns."""
    for c in cols:
        df = df.filter(F.col(c).isNotNull())
    return df


def filter_isnull(df: DataFrame, col: str) -> DataFrame:
    """Rows whose column is missing."""
    return df.filter(F.col(col).isNull())


def filter_not_contains(df: DataFrame, col: str, text: str) -> DataFrame:
    """Rows without the text in any letter case; null counts as not containing it."""
    return df.filter(~F.coalesce(F.lower(col).contains(text.lower()), F.lit(False)))


def filter_in(df: DataFrame, col: str, values: Sequence[object]) -> DataFrame:
    """Rows whose column is in a short list."""
    return df.filter(F.col(col).isin(list(values)))


def filter_range(df: DataFrame, col: str, low: object, high: object) -> DataFrame:
    """Rows with ``low <= column <= high``."""
    return df.filter(F.col(col).between(low, high))


def filter_point(df: DataFrame, **equal: object) -> DataFrame:
    """Rows matching all given column values."""
    for name, value in equal.items():
        df = filter_eq(df, name, value)
    return df


def filter_year(df: DataFrame, col: str, year: int) -> DataFrame:
    """Rows of one calendar year, as a date range that reaches the scan."""
    low, high = F.make_date(F.lit(year), F.lit(1), F.lit(1)), F.make_date(F.lit(year + 1), F.lit(1), F.lit(1))
    return df.filter((F.col(col) >= low) & (F.col(col) < high))


def min_age_at_event(df: DataFrame, event: str, birth: str, days: int = MIN_AGE_DAYS) -> DataFrame:
    """Rows whose event lies at least ``days`` after birth; a missing date drops the row."""
    return df.filter(F.date_diff(F.col(event), F.col(birth)) >= days)


def filter_col_compare(df: DataFrame, left: str, right: str, equal: bool = True) -> DataFrame:
    """Rows where two columns agree (or differ)."""
    return df.filter(F.col(left) == F.col(right)) if equal else df.filter(F.col(left) != F.col(right))


def split_by_flag(df: DataFrame, flag: str | Column) -> tuple[DataFrame, DataFrame]:
    """(rows with the flag, rows without it)."""
    cond = F.col(flag) if isinstance(flag, str) else flag
    return df.filter(cond), df.filter(~cond)
