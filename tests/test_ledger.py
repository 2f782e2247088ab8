"""Ledger, windows and joins on handmade edge cases."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from propensia.operators import joins as J, ledger as L, quality as Q
from propensia.operators.aggregates import first_row_per_group, pivot_sum, regression_metrics


def month(i):
    return dt.date(1995 + (i - 1) // 12, (i - 1) % 12 + 1, 15)


def entries(spark, rows):
    return spark.createDataFrame(rows, "account_id long, date date, amount decimal(18,2)")


def test_period_sums_use_zero_for_empty_sides(spark):
    rows = [(1, month(1), Decimal(5)), (1, month(1), Decimal(0)), (1, month(2), Decimal(-3)), (2, month(1), None)]
    got = {(r["account_id"], r["period"].month): r for r in L.period_ledger(entries(spark, rows)).collect()}
    assert (got[1, 1]["credit"], got[1, 1]["withdrawal"], got[1, 1]["n_transactions"]) == (5, 0, 2)
    assert (got[1, 2]["credit"], got[1, 2]["withdrawal"], got[1, 2]["volume"]) == (0, -3, -3)
    assert (got[2, 1]["volume"], got[2, 1]["n_transactions"]) == (0, 0)


def test_running_balance_is_the_sum_of_entries(spark):
    rows = [(150, dt.date(1995, 3, 16), Decimal(1900)), (150, dt.date(1995, 3, 16), Decimal(900)), (150, dt.date(1995, 5, 1), Decimal(-100))]
    got = L.running_balance(L.period_ledger(entries(spark, rows))).orderBy("period").collect()
    assert [r["balance"] for r in got] == [2800, 2700]


def test_only_complete_windows_survive(spark):
    rows = []
    for i in range(1, 15):  # event in month 14
        rows.append((1, month(i), Decimal(i)))  # full, and active in the event month
        if i != 7:
            rows.append((2, month(i), Decimal(i)))  # gap in the middle
        if i > 1:
            rows.append((3, month(i), Decimal(i)))  # 12 periods
    rows += [(4, month(i), Decimal(1)) for i in range(1, 14)]
    dates = spark.createDataFrame([(k, month(14)) for k in (1, 2, 3)] + [(4, None)], "account_id long, issued date")
    ledger = L.running_balance(L.period_ledger(entries(spark, rows)))
    wide = L.event_rollup(ledger, dates).collect()
    assert [r["account_id"] for r in wide] == [1]
    assert wide[0]["volume_1"] == 13 and wide[0]["volume_13"] == 1
    assert wide[0]["balance_1"] == sum(range(1, 14)) and wide[0]["balance_13"] == 1
    assert L.event_rollup_long(ledger, dates).count() == 13
    near = L.event_distance(ledger, dates)
    assert {r["account_id"] for r in L.group_having_size(near, "account_id", 13).collect()} == {1}
    assert [r["account_id"] for r in L.pivot_wide(near, complete=True).collect()] == [1]
    pruned = L.prune_to_events(ledger, dates)
    assert L.event_rollup(pruned, dates).collect() == wide


def test_surrogate_dates_come_from_the_pool(spark):
    pool = spark.createDataFrame([(dt.date(1995, m, 1),) for m in (1, 1, 1, 2, 3)], "issued date")
    keys = spark.range(3000).withColumnRenamed("id", "account_id")
    got = L.surrogate_event_date(keys, pool).groupBy("issued").count().collect()
    assert {r["issued"].month for r in got} == {1, 2, 3}
    assert all(800 < r["count"] < 1200 for r in got)  # distinct dates are equally likely
    again = L.surrogate_event_date(keys.repartition(7), pool)
    assert again.exceptAll(L.surrogate_event_date(keys, pool)).isEmpty()
    late = keys.withColumn("first", F.lit(dt.date(1995, 2, 1)))
    assert {r["issued"].month for r in L.surrogate_event_date(late, pool, after_first="first").collect()} == {3}
    never = keys.withColumn("first", F.lit(dt.date(1999, 2, 1)))
    assert L.surrogate_event_date(never, pool, after_first="first").filter("issued is not null").isEmpty()


def test_opening_entries(spark):
    rows = spark.createDataFrame(
        [(150, 1, Decimal(1900), Decimal(1900)), (150, 2, Decimal(900), Decimal(2800)), (7, 3, Decimal(5), Decimal(9))],
        "account_id long, trans_id long, amount decimal(18,2), balance decimal(18,2)",
    )
    got = Q.opening_entry_check(rows, "account_id", ["trans_id"]).first()
    assert (got["accounts"], got["with_opening"], got["without_opening"], got["off_balance"]) == (2, 1, 1, 0)
    assert [r["account_id"] for r in Q.accounts_without_opening(rows, "account_id").collect()] == [7]
    first = first_row_per_group(rows, "account_id", ["trans_id"], F.col("amount") == F.col("balance"))
    assert [(r["account_id"], r["trans_id"]) for r in first.collect()] == [(150, 1)]


def test_pivot_has_every_domain_value(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "a", 3.0), (2, None, 1.0)], "k int, c string, v double")
    got = {r["k"]: (r["a"], r["never"]) for r in pivot_sum(df, "k", "c", "v", ["a", "never"]).collect()}
    assert got == {1: (5.0, 0.0), 2: (0.0, 0.0)}


def test_strict_join_raises_on_repeated_keys(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y")], "k int, type string")
    right = spark.createDataFrame([(1, "p"), (1, "q")], "k int, type string")
    with pytest.raises(Q.DataQualityError):
        J.left_join_1to1(left, right, "k", validate="1:1")
    joined = J.left_join_1to1(left, right.limit(1), "k", ("_l", "_r"), validate="1:1")
    assert joined.columns == ["k", "type_l", "type_r"] and joined.count() == 2


def test_duplicates_treat_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, "a"), (1, None)], "a int, b string")
    assert Q.duplicate_rows(df).first()["duplicates"] == 2
    assert Q.missing_total(df).first()["missing"] == 3


def test_histogram_of_a_constant_column(spark):
    df = spark.createDataFrame([(3.0,), (3.0,), (None,)], "v double")
    got = Q.histogram(df, "v").collect()
    assert [(r["bin"], r["count"]) for r in got] == [(0, 2)]


def test_log_error_is_null_below_minus_one(spark):
    df = spark.createDataFrame([(1.0, 2.0), (-2.0, 1.0)], "y double, p double")
    got = regression_metrics(df, "y", "p").first()
    assert got["mean_squared_log_error"] is None and got["mae"] == 2.0
