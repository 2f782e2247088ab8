"""Collects (Spark query, SQL) pairs under their inventory names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return keep


def r6(col: Column | str, places: int = 6) -> Column:
    """Rounded double without a negative zero."""
    return F.round(F.col(col) if isinstance(col, str) else col, places) + F.lit(0.0)


def s6(expr: str, name: str | None = None, places: int = 6) -> str:
    return f"round({expr}, {places}) + 0.0 as {name or expr}"


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, as the SQL side returns them."""
    money = [f.name for f in df.schema if f.dataType.typeName() == "decimal"]
    return df.withColumns({c: F.col(c).cast("double") for c in money})


def rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: r6(c, places) for c in cols})
