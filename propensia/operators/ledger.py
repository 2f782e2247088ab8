"""The ledger: per-period sums, running balance, and the fixed window before an event.

Shuffle plan. The raw ledger is only ever aggregated: ``period_ledger`` combines rows map-side, so
what crosses the network is one row per (account, period), also for an account that owns a third of
all entries. Everything after it (running balance, event join, window rollup) is partitioned by
account over at most one row per calendar period, and shares one exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from propensia.functions.clean import period_diff, to_period
from propensia.functions.codes import HORIZON
from propensia.functions.hashing import key_hash

MEASURES = ("balance", "credit", "n_transactions", "volume", "withdrawal")


def period_ledger(trans: DataFrame, key: str = "account_id", date: str = "date", amount: str = "amount", unit: str = "month") -> DataFrame:
    """(key, period, volume, credit, withdrawal, n_transactions); empty sums are 0."""
    a = F.col(amount)
    zero = lambda c: F.coalesce(c, F.lit(0).cast(trans.schema[amount].dataType))
    return trans.groupBy(key, to_period(date, unit).alias("period")).agg(
        zero(F.sum(a)).alias("volume"),
        zero(F.sum(F.when(a > 0, a))).alias("credit"),
        zero(F.sum(F.when(a < 0, a))).alias("withdrawal"),
        F.count(a).alias("n_transactions"),
    )


def running_balance(ledger: DataFrame, key: str = "account_id", period: str = "period", value: str = "volume", out: str = "balance") -> DataFrame:
    """Cumulative value per key in period order (one row per key and period)."""
    upto = W.partitionBy(key).orderBy(period).rowsBetween(W.unboundedPreceding, W.currentRow)
    return ledger.withColumn(out, F.sum(value).over(upto))


def event_distance(ledger: DataFrame, events: DataFrame, key: str = "account_id", unit: str = "month", horizon: int = HORIZON) -> DataFrame:
    """Ledger periods 1..horizon before the key's event, with their distance ``k``."""
    joined = ledger.join(events.select(key, "issued"), key)
    return joined.withColumn("k", period_diff("issued", "period", unit)).filter(F.col("k").between(1, horizon))


def prune_to_events(ledger: DataFrame, events: DataFrame, unit: str = "month", horizon: int = HORIZON) -> DataFrame:
    """Drop periods outside every event's window before a join: two bounds from one small pass.

    Worth it for a stored period ledger, where the bounds reach the scan. Never apply it to raw
    entries whose running balance is still to be computed.
    """
    edge = F.add_months(F.trunc("lo", "month"), -horizon) if unit == "month" else F.date_sub("lo", horizon)
    span = events.agg(F.min("issued").alias("lo"), F.max("issued").alias("hi"))
    low, high = span.select(edge).scalar(), span.select("hi").scalar()
    return ledger.filter((F.col("period") >= low) & (F.col("period") < high))


def group_having_size(df: DataFrame, key: str, size: int) -> DataFrame:
    """Rows of keys that have exactly ``size`` rows.

    The count is aggregated first and joined back, so no group is buffered whole.
    """
    keep = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == size).select(key)
    return df.join(keep, key, "left_semi")


def pivot_wide(df: DataFrame, key: str = "account_id", step: str = "k", horizon: int = HORIZON, measures: Sequence[str] = MEASURES, complete: bool = False) -> DataFrame:
    """``measure_k`` columns, mean per cell; ``complete`` keeps keys with exactly ``horizon`` rows.

    The domain of ``k`` is given, so no discovery job runs, and the completeness test is one more
    aggregate of the same pass.
    """
    kinds = {m: df.schema[m].dataType for m in measures}
    back = {m: f" as {t.simpleString()})" if t.typeName() == "decimal" else " as double)" for m, t in kinds.items()}
    cells = [
        F.expr(f"cast(avg(case when {step} = {k} then {m} end){back[m]}").alias(f"{m}_{k}")
        for m in measures
        for k in range(1, horizon + 1)
    ]
    if not complete:
        return df.groupBy(key).agg(*cells)
    wide = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *cells)
    return wide.filter(F.col("_n") == horizon).drop("_n")


def event_rollup(ledger: DataFrame, events: DataFrame, key: str = "account_id", unit: str = "month", horizon: int = HORIZON, measures: Sequence[str] = MEASURES) -> DataFrame:
    """One row per key: every measure of the ``horizon`` periods before its event.

    ``ledger`` holds one row per (key, period); keys with a gap in the window are left out.
    """
    near = event_distance(ledger, events, key, unit, horizon)
    cells = [
        F.expr(f"max(case when k = {k} then {m} end)").alias(f"{m}_{k}")
        for m in measures
        for k in range(1, horizon + 1)
    ]
    wide = near.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *cells)
    return wide.filter(F.col("_n") == horizon).drop("_n")


def event_rollup_long(ledger: DataFrame, events: DataFrame, key: str = "account_id", unit: str = "month", horizon: int = HORIZON) -> DataFrame:
    """The same windows in long form: (key, k, measures), complete keys only."""
    near = event_distance(ledger, events, key, unit, horizon).drop("issued", "period")
    count = F.count(F.lit(1)).over(W.partitionBy(key))  # at most ``horizon`` rows per key
    return near.withColumn("_n", count).filter(F.col("_n") == horizon).drop("_n")


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct non-null values of a column."""
    return df.select(col).filter(F.col(col).isNotNull()).distinct()


def min_per_group(df: DataFrame, key: str | None, value: str, out: str) -> DataFrame:
    """Smallest value per key, or over everything when no key is given."""
    grouped = df.groupBy(key) if key else df.groupBy()
    return grouped.agg(F.min(value).alias(out))


def draw_event_date(
    rows: DataFrame,
    event_dates: DataFrame,
    key: str = "account_id",
    issued: str = "issued",
    out: str = "_drawn",
    seed: int = 43,
    draw: Callable[[Column, Column], Column] | None = None,
    after_first: str | None = None,
) -> DataFrame:
    """Add a date drawn per key, each distinct event date being equally likely.

    The pool is one sorted array (as long as the calendar allows) fetched by a scalar subquery; the
    pick is a function of the key alone. ``draw(key, size)`` replaces the default hash pick;
    ``after_first`` names a column whose date the pick must lie behind.
    """
    pool = event_dates.agg(F.array_sort(F.collect_set(issued))).scalar()
    rows = rows.withColumn("_pool", pool)
    if after_first:
        rows = rows.withColumn("_pool", F.filter("_pool", lambda d: d > F.col(after_first)))
    size = F.size("_pool")
    index = draw(F.col(key), size) if draw else F.pmod(key_hash(key, seed=seed), size)
    return rows.withColumn(out, F.when(size > 0, F.get("_pool", index.cast("int")))).drop("_pool")


def surrogate_event_date(keys: DataFrame, event_dates: DataFrame, key: str = "account_id", issued: str = "issued", **how) -> DataFrame:
    """(key, issued) of keys without an event; options as in ``draw_event_date``."""
    rows = keys.drop(issued)
    return draw_event_date(rows, event_dates, key, issued, issued, **how).select(key, issued)
