"""Profiling and data-quality reports (inventory Q)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import bindings as B
from checks.registry import plain, query, r6, rounded, s6
from propensia.functions import clean as C
from propensia.operators import ledger as L, quality as Q
from propensia.plans import bank

sql = B.sql
_TRANS = ["trans_id", "account_id", "date", "type", "operation", "amount", "balance", "k_symbol", "bank", "account"]
_TRANS_TYPES = ["bigint", "bigint", "string", "string", "string", "decimal(18,2)", "decimal(18,2)", "string", "string", "bigint"]
_RAW_TRANS = "(select *, cast(null as varchar) as bank, cast(null as bigint) as account from raw_trans)"


@query("q1_profile_columns", sql(" union all ".join(
    f"select '{c}' as \"column\", '{t}' as type, count({c}) as non_null from {_RAW_TRANS}" for c, t in zip(_TRANS, _TRANS_TYPES))))
def q1(spark, sf):
    return Q.profile_columns(B.raw_trans(spark, sf))


@query("q2_missing_counts", sql(" union all ".join(
    f"select '{c}' as \"column\", count(*) - count({c}) as missing from {_RAW_TRANS}" for c in _TRANS)))
def q2(spark, sf):
    return Q.missing_counts(B.raw_trans(spark, sf))


_MISSING = " union all ".join(f"select '{c}' as \"column\", count(*) - count({c}) as missing from gappy" for c in ["vec_id", "label", *B.FEATURES])


@query("q2_missing_positive", sql(f"select * from ({_MISSING}) where missing > 0"))
def q2p(spark, sf):
    return Q.missing_counts(B.gappy_vectors(spark, sf), only_positive=True)


@query("q2_missing_total", sql(f"select cast(sum(missing) as bigint) as missing from ({_MISSING})"))
def q2t(spark, sf):
    return Q.missing_total(B.gappy_vectors(spark, sf))


@query("q3_duplicate_rows_whole", "select (select count(*) from lineitem) - (select count(*) from (select distinct * from lineitem)) as duplicates")
def q3_whole(spark, sf):
    return Q.duplicate_rows(B.table(spark, sf, "lineitem"))


_DUP = "l_orderkey, l_linenumber, l_returnflag, nullif(l_linestatus, 'O') as l_linestatus"


@query("q3_duplicate_rows", f"select (select count(*) from lineitem) - (select count(*) from (select distinct {_DUP} from lineitem)) as duplicates")
def q3(spark, sf):
    rows = B.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", F.nullif("l_linestatus", F.lit("O")).alias("l_linestatus")
    )
    return Q.duplicate_rows(rows)


@query("q4_value_counts", sql("select type, count(*) as count from raw_card group by 1"))
def q4(spark, sf):
    return Q.value_counts(B.raw_card(spark, sf), "type")


@query("q4_value_counts_by_value", sql("select operation, count(*) as count from raw_trans where operation is not null group by 1 order by 1"))
def q4v(spark, sf):
    return Q.value_counts(B.raw_trans(spark, sf), "operation", by_value=True)


@query("q5_histogram", """select bin, """ + s6("mn + bin * w", "low") + ", " + s6("mn + (bin + 1) * w", "high") + """, count(*) as count from
    (select least(cast(floor((o_totalprice - mn) / w) as bigint), 19) as bin, mn, w from orders,
    (select min(o_totalprice) as mn, (max(o_totalprice) - min(o_totalprice)) / cast(20 as double) as w from orders)) group by bin, mn, w""")
def q5(spark, sf):
    return rounded(Q.histogram(B.table(spark, sf, "orders"), "o_totalprice"), "low", "high")


@query("q6_sample_n", "select c_custkey, c_name from customer order by (c_custkey * 7919 + 43) % 1000003, c_custkey limit 5")
def q6(spark, sf):
    rows = B.table(spark, sf, "customer").select("c_custkey", "c_name")
    return Q.sample_n(rows, 5, "c_custkey", order=(F.col("c_custkey") * 7919 + 43) % 1000003)


@query("q6_head", "select * from orders order by o_orderkey limit 5")
def q6h(spark, sf):
    return Q.head(B.table(spark, sf, "orders"), 5, "o_orderkey")


@query("q7_distinct_count", sql("select count(distinct account_id) as distinct_keys from entries"))
def q7(spark, sf):
    return Q.distinct_count(B.entries(spark, sf), "account_id")


@query("q8_sentinel_rows", sql("select * from raw_district where A12 = '?' or A15 = '?'"))
def q8(spark, sf):
    return Q.sentinel_rows(B.raw_district(spark, sf))


@query("q9_join_cardinality", "select l_orderkey, l_linenumber, count(*) as count from lineitem group by 1, 2 having count(*) > 1")
def q9(spark, sf):
    return Q.join_cardinality(B.table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@query("q10_opening_entry_check", sql("""select count(distinct account_id) as accounts, count(distinct case when amount = balance then account_id end) as with_opening,
    count(distinct account_id) - count(distinct case when amount = balance then account_id end) as without_opening, cast(0 as bigint) as off_balance from running_entries"""))
def q10(spark, sf):
    return Q.opening_entry_check(B.running_entries(spark, sf), "account_id", ["ts", "trans_id"])


@query("q10_accounts_without_opening", sql("select distinct account_id from entries where account_id not in (select account_id from entries where amount > 300)"))
def q10w(spark, sf):
    rows = B.entries(spark, sf).withColumn("balance", F.greatest("amount", F.lit(300.01).cast("decimal(18,2)")))
    return Q.accounts_without_opening(rows, "account_id")


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("q11_corr_matrix", " union all ".join(
    f"select '{a}' as column_a, '{b}' as column_b, " + s6(f"corr({a}, {b})", "corr") + " from lineitem" for a in _NUM for b in _NUM))
def q11(spark, sf):
    return rounded(Q.corr_matrix(B.table(spark, sf, "lineitem"), _NUM), "corr")


_WIDE = ", ".join(B.FEATURES)


@query("q11_corr_matrix_wide", sql(f"""select a.name as column_a, b.name as column_b, round(corr(a.v, b.v), 6) + 0.0 as corr
    from (unpivot (select vec_id, {_WIDE} from vectors) on {_WIDE} into name name value v) a
    join (unpivot (select vec_id, {_WIDE} from vectors) on {_WIDE} into name name value v) b using (vec_id) group by 1, 2"""))
def q11w(spark, sf):
    return rounded(Q.corr_matrix(B.vectors(spark, sf), B.FEATURES), "corr")


@query("q12_series_corr", sql("select " + s6("corr(a, b)", "corr") + """ from (select period, count(*) as a from sums group by 1)
    join (select cast(date as date) as period, count(*) as b from entries where amount < 0 group by 1) using (period)"""))
def q12(spark, sf):
    e = B.entries(spark, sf)
    left = L.period_ledger(e, unit="day")
    right = e.filter("amount < 0").withColumnRenamed("date", "period")
    return rounded(Q.series_corr(left, right, "period"), "corr")


_DESC = ["o_totalprice", "o_custkey"]


def _describe_sql(c):
    return (f"select '{c}' as \"column\", count({c}) as count, cast(min({c}) as double) as min, cast(max({c}) as double) as max, "
            f"round(avg({c}), 4) + 0.0 as mean, round(stddev_samp({c}), 4) + 0.0 as stddev, "
            # population skewness, as the moments define it
            f"round(avg(pow({c} - m, 3)) / pow(var_pop({c}), 1.5), 6) + 0.0 as skewness, cast(median({c}) as double) as median "
            f"from orders, (select avg({c}) as m from orders)")


@query("q13_describe", " union all ".join(_describe_sql(c) for c in _DESC))
def q13(spark, sf):
    d = Q.describe(B.table(spark, sf, "orders"), _DESC)
    return rounded(rounded(d, "mean", "stddev", places=4), "skewness")


@query("q15_group_size_distribution", "select size, count(*) as keys from (select o_custkey, count(*) as size from orders group by 1) group by 1")
def q15(spark, sf):
    return Q.group_size_distribution(B.table(spark, sf, "orders"), "o_custkey")


@query("q16_period_activity", sql("select date as period, count(*) as rows, count(distinct account_id) as accounts from entries group by 1"))
def q16(spark, sf):
    return Q.period_activity(B.entries(spark, sf).withColumnRenamed("date", "period"), "account_id", "period")


@query("q17_account_timeline", sql("select account_id, date, ts, trans_id, cast(balance as double) as balance from running_entries where account_id = 19 and year(date) = 2024"))
def q17(spark, sf):
    return plain(Q.account_timeline(B.running_entries(spark, sf), "account_id", 19, ["date", "ts", "trans_id"], year=2024))
