"""Joins of the star schema.

No broadcast is forced: dimension sides are files of known size, so the planner broadcasts them
below ``spark.sql.autoBroadcastJoinThreshold`` and AQE re-checks with measured sizes. Above it they
become shuffled joins, whose hot keys AQE splits.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from propensia.functions.clean import add_suffix, fill_const
from propensia.operators.quality import join_cardinality


def left_join_1to1(left: DataFrame, right: DataFrame, on: str, suffixes: tuple[str, str] = ("_x", "_y"), validate: str | None = None) -> DataFrame:
    """Left equi-join; columns both sides have get the suffixes. ``validate``: '1:1' or 'm:1'."""
    if validate:
        join_cardinality(right, on, strict=True)
        if validate == "1:1":
            join_cardinality(left.filter(F.col(on).isNotNull()), on, strict=True)
    shared = [c for c in left.columns if c in right.columns and c != on]
    l = left.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    r = right.withColumnsRenamed({c: c + suffixes[1] for c in shared})
    return l.join(r, on, "left")


def left_join_dim(fact: DataFrame, dim: DataFrame, dim_key: str, suffixes: Sequence[str]) -> DataFrame:
    """Join the same dimension once per suffix: ``<key><suffix>`` to a suffixed copy."""
    for suffix in suffixes:
        fact = fact.join(add_suffix(dim, suffix), dim_key + suffix, "left")
    return fact


def spine_join(spine: DataFrame, rows: DataFrame, on: str, fills: Mapping[str, object]) -> DataFrame:
    """Every key of the spine, with its rows when there are any; listed nulls are then filled."""
    return fill_const(spine.join(rows, on, "left"), fills)


def inner_join(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Inner equi-join on a shared key."""
    return left.join(right, on)


def anti_join(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Rows of the left side whose key is absent on the right."""
    return left.join(right.select(on).distinct(), on, "left_anti")


def semi_join(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Rows of the left side whose key is present on the right."""
    return left.join(right.select(on).distinct(), on, "left_semi")


def first_activity_join(keys: DataFrame, ledger: DataFrame, on: str, period: str = "period", out: str = "first_period") -> DataFrame:
    """Each key with the first period it was active in."""
    return keys.join(ledger.groupBy(on).agg(F.min(period).alias(out)), on, "left")


def event_date_coalesce(rows: DataFrame, surrogates: DataFrame, on: str, issued: str = "issued") -> DataFrame:
    """Fill missing event dates from the surrogate table, matched by key."""
    drawn = surrogates.select(on, F.col(issued).alias("_drawn"))
    return rows.join(drawn, on, "left").withColumn(issued, F.coalesce(issued, "_drawn")).drop("_drawn")
