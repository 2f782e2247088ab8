"""Cleaning expressions and filters (inventory P, F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import bindings as B
from checks.registry import plain, query
from propensia.functions import clean as C, codes
from propensia.operators import filters as X, ledger as L
from propensia.plans import bank

sql = B.sql


@query("p1_parse_compact_date", sql(f"select loan_id, {B.sql_date('date')} as date from raw_loan"))
def p1(spark, sf):
    return B.raw_loan(spark, sf).select("loan_id", C.parse_compact_date("date").alias("date"))


@query("p1_parse_card_date", sql("select card_id, issued from c_card"))
def p1c(spark, sf):
    return B.raw_card(spark, sf).select("card_id", C.parse_compact_date("issued").alias("issued"))


@query("p2_to_period", "select o_orderkey, cast(date_trunc('month', o_orderdate) as date) as month from orders")
def p2(spark, sf):
    return B.table(spark, sf, "orders").select("o_orderkey", C.to_period("o_orderdate").alias("month"))


@query("p3_recode_keep", sql("select account_id, frequency from c_account"))
def p3(spark, sf):
    return B.raw_account(spark, sf).select("account_id", C.recode_keep("frequency", codes.FREQUENCY).alias("frequency"))


@query("p3_recode_trans", sql(f"""select trans_id, {B.sql_case('type', codes.TRANS_TYPE, 'type')} as type,
    {B.sql_case('operation', codes.TRANS_OPERATION, 'operation')} as operation, {B.sql_case('k_symbol', codes.TRANS_SYMBOL, 'k_symbol')} as k_symbol,
    {B.sql_date('date')} as date, cast(case when type in ('VYDAJ', 'VYBER') then -amount else amount end as double) as amount from raw_trans"""))
def p3t(spark, sf):
    return plain(bank.clean_trans(B.raw_trans(spark, sf))).select("trans_id", "type", "operation", "k_symbol", "date", "amount")


@query("p4_recode_strict", sql("select loan_id, status from c_loan"))
def p4(spark, sf):
    return B.raw_loan(spark, sf).select("loan_id", C.recode_strict("status", codes.LOAN_STATUS).alias("status"))


@query("p4_recode_default", sql(f"select order_id, coalesce({B.sql_case('k_symbol', codes.ORDER_SYMBOL)}, 'unknown') as k_symbol from raw_order"))
def p4d(spark, sf):
    return B.raw_order(spark, sf).select("order_id", C.recode_strict("k_symbol", codes.ORDER_SYMBOL, "unknown").alias("k_symbol"))


@query("p5_categorize", """select c_custkey, case when c_mktsegment in ('BUILDING', 'FURNITURE', 'MACHINERY') then c_mktsegment end as segment,
    list_position(['BUILDING', 'FURNITURE', 'MACHINERY', 'none'], case when c_mktsegment in ('BUILDING', 'FURNITURE', 'MACHINERY') then c_mktsegment else 'none' end) as code from customer""")
def p5(spark, sf):
    values = C.domain(["MACHINERY", "BUILDING", "FURNITURE"], extra=["none"])
    rows = B.table(spark, sf, "customer").select("c_custkey", C.categorize("c_mktsegment", values[:-1]).alias("segment"))
    listed = F.array(*[F.lit(v) for v in values])
    return rows.withColumn("code", F.array_position(listed, F.coalesce("segment", F.lit("none"))).cast("int"))


@query("p6_decode_birth_number", sql("select client_id, gender, birth_day from c_client"))
def p6(spark, sf):
    gender, birth = C.decode_birth_number("birth_number")
    return B.raw_client(spark, sf).select("client_id", gender.alias("gender"), birth.alias("birth_day"))


@query("p7_age_at", sql("""select client_id, age, cast(date_diff('year', birth_day, date '2024-06-15')
    - case when strftime(birth_day, '%m%d') > '0615' then 1 else 0 end as int) as age_mid from c_client"""))
def p7(spark, sf):
    import datetime as dt

    c = bank.clean_client(B.raw_client(spark, sf))
    return c.select("client_id", "age", C.age_at("birth_day", dt.date(2024, 6, 15)).alias("age_mid"))


@query("p8_rename_select", sql("select " + ", ".join(f"{k} as {v}" for k, v in codes.DISTRICT_COLUMNS.items()) + " from raw_district"))
def p8(spark, sf):
    return C.rename_select(B.raw_district(spark, sf), codes.DISTRICT_COLUMNS)


@query("p8_add_suffix", "select n_nationkey as n_nationkey_client, n_name as n_name_client, n_regionkey as n_regionkey_client from nation")
def p8s(spark, sf):
    return C.add_suffix(B.table(spark, sf, "nation"), "_client")


@query("p9_drop_columns", "select c_custkey, c_nationkey, c_acctbal from customer")
def p9(spark, sf):
    return C.drop_columns(B.table(spark, sf, "customer"), ["c_name", "c_mktsegment", "not_there"])


@query("p10_sentinel_to_null", sql("select district_id, unemploy_rate95, no_of_crimes95 from n_district"))
def p10(spark, sf):
    return B.raw_district(spark, sf).select(
        F.col("A1").alias("district_id"), C.sentinel_to_null("A12").alias("unemploy_rate95"), C.sentinel_to_null("A15").alias("no_of_crimes95")
    )


@query("p11_fill_const", sql("""select disp_id, coalesce(k.type, 'none') as type_card, coalesce(l.duration, 0) as duration, coalesce(l.status, 'none') as status
    from raw_disp d left join raw_card k using (disp_id) left join c_loan l on l.account_id = d.account_id"""))
def p11(spark, sf):
    loans = bank.clean_loan(B.raw_loan(spark, sf)).select("account_id", "duration", "status")
    rows = B.raw_disp(spark, sf).select("disp_id", "account_id").join(
        B.raw_card(spark, sf).select("disp_id", "card_id", "type"), "disp_id", "left"
    ).join(loans, "account_id", "left")
    filled = C.fill_const(rows, {"duration": 0, "status": "none"})
    return filled.select("disp_id", C.overwrite_when_null("type", "card_id", "none").alias("type_card"), "duration", "status")


@query("p12_signed_amount", sql("select trans_id, cast(amount as double) as amount from running_entries"))
def p12(spark, sf):
    rows = bank.clean_trans(B.raw_trans(spark, sf))
    return plain(rows.select("trans_id", "amount"))


@query("p13_presence_flag", sql("""select disp_id, k.card_id is not null as has_card, (k.card_id is not null and l.loan_id is not null) as complete
    from raw_disp d left join raw_card k using (disp_id) left join raw_loan l on l.account_id = d.account_id"""))
def p13(spark, sf):
    rows = B.raw_disp(spark, sf).select("disp_id", "account_id").join(
        B.raw_card(spark, sf).select("disp_id", "card_id"), "disp_id", "left"
    ).join(B.raw_loan(spark, sf).select("account_id", "loan_id"), "account_id", "left")
    return rows.select("disp_id", C.presence_flag("card_id").alias("has_card"), C.complete_row_flag(["card_id", "loan_id"]).alias("complete"))


@query("p14_days_since_min", sql("select account_id, cast(date - (select min(date) from c_account) as int) as date from c_account"))
def p14(spark, sf):
    return C.days_since_min(bank.clean_account(B.raw_account(spark, sf)).select("account_id", "date"), "date")


@query("p15_period_diff", """select o_orderkey, cast(12 * (2001 - year(o_orderdate)) + 8 - month(o_orderdate) as int) as months,
    cast(date '2001-08-01' - cast(o_orderdate as date) as int) as days from orders""")
def p15(spark, sf):
    end, day = F.lit("2001-08-01").cast("date"), F.to_date("o_orderdate")
    return B.table(spark, sf, "orders").select(
        "o_orderkey", C.period_diff(end, day).alias("months"), C.period_diff(end, day, "day").alias("days")
    )


@query("p16_extract_int", "select c_custkey, cast(regexp_extract(c_name, '([0-9]+)', 1) as int) as number from customer")
def p16(spark, sf):
    return B.table(spark, sf, "customer").select("c_custkey", C.extract_int("c_name").alias("number"))


@query("p17_to_numeric_coerce", sql("select A1, cast(A12 as double) as A12, cast(A15 as double) as A15, A3 from raw_district where A12 <> '?'"))
def p17(spark, sf):
    return C.to_numeric_coerce(B.raw_district(spark, sf), ["A12", "A15"]).select("A1", "A12", "A15", "A3")


_PICKED = ["account_id", *[f"{m}_{k}" for m in ("volume", "balance") for k in range(1, 14)]]


@query("p18_select_by_pattern", sql(f"select {', '.join(_PICKED)} from buyer_rolled"))
def p18(spark, sf):
    wide = plain(L.event_rollup(B.ledger(spark, sf), B.buyer_dates(spark, sf), unit="day"))
    return wide.select(C.select_by_pattern(wide, ["account"], {"volume": 13, "balance": 13}))


@query("p19_add_intercept", "select s_suppkey, s_acctbal, cast(1 as double) as const from supplier")
def p19(spark, sf):
    return C.add_intercept(B.table(spark, sf, "supplier").select("s_suppkey", "s_acctbal"))


# ---- F -----------------------------------------------------------------------------------


@query("f1_filter_eq", sql("select * from c_disp"))
def f1(spark, sf):
    return X.filter_eq(B.raw_disp(spark, sf), "type", "OWNER")


@query("f2_filter_notnull", sql("select * from n_district where unemploy_rate95 is not null and no_of_crimes95 is not null"))
def f2(spark, sf):
    d = C.rename_select(B.raw_district(spark, sf), codes.DISTRICT_COLUMNS)
    d = d.withColumns({c: C.sentinel_to_null(c) for c in ("unemploy_rate95", "no_of_crimes95")})
    return X.filter_notnull(d, "unemploy_rate95", "no_of_crimes95")


@query("f2_filter_isnull", sql("select district_id, no_of_crimes96 from n_district where no_of_crimes95 is null"))
def f2n(spark, sf):
    d = C.rename_select(B.raw_district(spark, sf), codes.DISTRICT_COLUMNS)
    d = d.withColumn("no_of_crimes95", C.sentinel_to_null("no_of_crimes95"))
    return X.filter_isnull(d, "no_of_crimes95").select("district_id", "no_of_crimes96")


@query("f3_filter_not_contains", sql("select d.disp_id, k.type from raw_disp d left join raw_card k using (disp_id) where k.type is null or lower(k.type) not like '%junior%'"))
def f3(spark, sf):
    rows = B.raw_disp(spark, sf).select("disp_id").join(B.raw_card(spark, sf).select("disp_id", "type"), "disp_id", "left")
    return X.filter_not_contains(rows, "type", "JUNIOR")


@query("f4_filter_in", sql("select account_id, period, cast(balance as double) as balance from ledger where account_id in (14, 18)"))
def f4(spark, sf):
    return plain(X.filter_in(B.ledger(spark, sf), "account_id", [14, 18]).select("account_id", "period", "balance"))


@query("f5_filter_range", sql("select account_id, period, k from (select l.*, cast(issued - period as int) as k from ledger l join buyer_dates using (account_id)) where k > 0 and k <= 13"))
def f5(spark, sf):
    rows = B.ledger(spark, sf).join(B.buyer_dates(spark, sf), "account_id")
    rows = rows.withColumn("k", C.period_diff("issued", "period", "day"))
    return X.filter_range(rows, "k", 1, 13).select("account_id", "period", "k")


@query("f6_filter_point", sql("select trans_id, account_id, date, cast(amount as double) as amount from entries where date = date '2024-01-16' and account_id = 15"))
def f6(spark, sf):
    import datetime as dt

    return plain(X.filter_point(B.entries(spark, sf), date=dt.date(2024, 1, 16), account_id=15))


@query("f6_filter_year", "select o_orderkey, cast(o_orderdate as date) as date from orders where year(o_orderdate) = 1995")
def f6y(spark, sf):
    rows = B.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    return X.filter_year(rows, "date", 1995)


@query("f7_min_age_at_event", sql(f"select a.account_id, d.issued, a.birth_day from adults a join dates d using (account_id) where date_diff('day', a.birth_day, d.issued) >= {B.MIN_AGE}"))
def f7(spark, sf):
    rows = B.dates(spark, sf).select("account_id", "issued").join(bank.clean_client(B.raw_client(spark, sf)).select(F.col("client_id").alias("account_id"), "birth_day"), "account_id")
    return X.min_age_at_event(rows, "issued", "birth_day", B.MIN_AGE)


@query("f8_filter_col_compare", sql("select trans_id, account_id, cast(balance as double) as balance from running_entries where amount = balance"))
def f8(spark, sf):
    rows = X.filter_col_compare(B.running_entries(spark, sf), "amount", "balance")
    return plain(rows.select("trans_id", "account_id", "balance"))


@query("f8_filter_col_differs", sql("select count(*) as n from running_entries where amount <> balance"))
def f8n(spark, sf):
    rows = X.filter_col_compare(B.running_entries(spark, sf), "amount", "balance", equal=False)
    return rows.agg(F.count(F.lit(1)).alias("n"))


@query("f9_filter_flag", sql("select account_id, type_card, has_card from master where has_card"))
def f9(spark, sf):
    return X.split_by_flag(B.master(spark, sf), "has_card")[0].select("account_id", "type_card", "has_card")


@query("f9_filter_flag_not", sql("select account_id, type_card, has_card from master where not has_card"))
def f9n(spark, sf):
    return X.split_by_flag(B.master(spark, sf), "has_card")[1].select("account_id", "type_card", "has_card")
