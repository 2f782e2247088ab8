"""Sources, ledger, windows, joins and aggregates (inventory S, A, G, J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import bindings as B
from checks.registry import plain, query, rounded, s6
from propensia.functions import clean as C, codes
from propensia.operators import aggregates as A, features as R, joins as J, ledger as L, quality as Q, ranking as K
from propensia.plans import bank
from propensia.session import shared_path, stage_by_key
from propensia.sources.schemas import ORDER
from propensia.sources.tables import Catalog, csv_scan

sql = B.sql

# ---- S -----------------------------------------------------------------------------------


@query("s1_csv_scan", sql("select * replace (cast(amount as double) as amount) from raw_order"))
def s1(spark, sf):
    path = shared_path(spark, "orders-csv")
    B.raw_order(spark, sf).write.option("sep", ";").option("header", True).option("quoteAll", True).csv(
        path, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    return plain(csv_scan(spark, path, ORDER))


@query("s2_catalog", sql("select * from c_account"))
def s2(spark, sf):
    catalog = Catalog(spark, "check_")
    catalog.register_all({"account": bank.clean_account(B.raw_account(spark, sf))})
    return catalog.fetch("account")


# ---- A -----------------------------------------------------------------------------------

_SUMS = "account_id, period, cast(volume as double) as volume, cast(credit as double) as credit, cast(withdrawal as double) as withdrawal, n_transactions"


@query("a1_period_ledger", sql(f"select {_SUMS} from sums"))
def a1(spark, sf):
    return plain(L.period_ledger(B.entries(spark, sf), unit="day"))


@query("a1_period_ledger_month", sql(f"select {_SUMS} from supplier_sums"))
def a1m(spark, sf):
    return plain(L.period_ledger(B.supplier_entries(spark, sf)))


@query("a2_pivot_sum", sql("select account_id, " + ", ".join(f"cast({v} as double) as {v}" for v in bank.ORDER_DOMAIN) + " from c_order"))
def a2(spark, sf):
    return plain(bank.clean_order(B.raw_account(spark, sf), B.raw_order(spark, sf)))


def supplier_near(spark, sf):
    ledger = L.running_balance(L.period_ledger(B.supplier_entries(spark, sf)))
    return L.event_distance(ledger, B.supplier_dates(spark, sf))


@query("a3_pivot_wide", sql(f"select account_id, {B.sql_wide(agg='avg')} from supplier_near group by 1"))
def a3(spark, sf):
    return plain(L.pivot_wide(supplier_near(spark, sf)))


@query("a4_group_having_size", sql("""select account_id, period, k from buyer_near
    where account_id in (select account_id from buyer_near group by 1 having count(*) = 13)"""))
def a4(spark, sf):
    near = L.event_distance(B.ledger(spark, sf), B.buyer_dates(spark, sf), unit="day")
    return L.group_having_size(near, "account_id", 13).select("account_id", "period", F.col("k").cast("long").alias("k"))


@query("a5_min_per_group", sql("select account_id, min(date) as first_date from entries group by 1"))
def a5(spark, sf):
    return L.min_per_group(B.entries(spark, sf), "account_id", "date", "first_date")


@query("a5_min_overall", sql("select min(date) as first_date from c_account"))
def a5g(spark, sf):
    return L.min_per_group(bank.clean_account(B.raw_account(spark, sf)), None, "date", "first_date")


@query("a6_distinct_values", sql("select distinct issued from c_card"))
def a6(spark, sf):
    return L.distinct_values(bank.clean_card(B.raw_card(spark, sf), "day"), "issued")


@query("a7_first_row_per_group", sql("""select account_id, trans_id, cast(amount as double) as amount, cast(balance as double) as balance
    from running_entries where amount = balance qualify row_number() over (partition by account_id order by ts, trans_id) = 1"""))
def a7(spark, sf):
    rows = A.first_row_per_group(
        B.running_entries(spark, sf), "account_id", ["ts", "trans_id"], F.col("amount") == F.col("balance")
    )
    return plain(rows.select("account_id", "trans_id", "amount", "balance"))


@query("a8_group_size", sql("select account_id, count(*) as num_of_loan from raw_loan group by 1"))
def a8(spark, sf):
    return A.group_size(B.raw_loan(spark, sf), "account_id", "num_of_loan")


_OLS = "count(*) filter (y is not null) as n from (select l_quantity as x, l_extendedprice as y from lineitem)"


@query("a9_ols_fit", f"select {s6('regr_slope(y, x)', 'slope')}, {s6('regr_intercept(y, x)', 'intercept', 4)}, {s6('regr_r2(y, x)', 'r2')}, {_OLS}")
def a9(spark, sf):
    fit = A.ols_fit(B.table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity")
    return rounded(rounded(fit, "slope", "r2"), "intercept", places=4)


_METRICS = ["explained_variance", "mean_squared_log_error", "r2", "mae", "mse", "rmse"]


@query("a10_regression_metrics", """with f as (select regr_slope(l_extendedprice, l_quantity) as s, regr_intercept(l_extendedprice, l_quantity) as i from lineitem),
    p as (select l_extendedprice as y, i + s * l_quantity as g from lineitem, f)
    select round(1 - var_pop(y - g) / var_pop(y), 4) + 0.0 as explained_variance,
    round(avg(pow(ln(1 + y) - ln(1 + g), 2)), 4) + 0.0 as mean_squared_log_error,
    round(1 - avg(pow(y - g, 2)) / var_pop(y), 4) + 0.0 as r2, round(avg(abs(y - g)), 4) + 0.0 as mae,
    round(avg(pow(y - g, 2)), 2) + 0.0 as mse, round(sqrt(avg(pow(y - g, 2))), 4) + 0.0 as rmse from p""")
def a10(spark, sf):
    rows = B.table(spark, sf, "lineitem").select("l_extendedprice", "l_quantity")
    predicted = A.ols_predict(rows, A.ols_fit(rows, "l_extendedprice", "l_quantity"), "l_quantity")
    m = A.regression_metrics(predicted, "l_extendedprice", "predicted")
    return rounded(rounded(m, *[c for c in _METRICS if c != "mse"], places=4), "mse", places=2)


# ---- G -----------------------------------------------------------------------------------


@query("g1_running_balance", sql("select account_id, period, cast(volume as double) as volume, cast(balance as double) as balance from ledger"))
def g1(spark, sf):
    return plain(B.ledger(spark, sf).select("account_id", "period", "volume", "balance"))


@query("g2_event_rollup", sql("select * from buyer_rolled"))
def g2(spark, sf):
    return plain(L.event_rollup(B.ledger(spark, sf), B.buyer_dates(spark, sf), unit="day"))


@query("g2_event_rollup_stored", sql("select * from buyer_rolled"))
def g2s(spark, sf):
    """The same windows from a period ledger stored by account."""
    stored = stage_by_key(L.period_ledger(B.entries(spark, sf), unit="day"), "account_id", "period")
    return plain(L.event_rollup(L.running_balance(stored), B.buyer_dates(spark, sf), unit="day"))


@query("g2_event_rollup_month", sql(f"select account_id, {B.sql_wide()} from supplier_near group by 1 having count(*) = 13"))
def g2m(spark, sf):
    ledger = L.running_balance(L.period_ledger(B.supplier_entries(spark, sf)))
    return plain(L.event_rollup(ledger, B.supplier_dates(spark, sf)))


@query("g3_surrogate_event_date", sql("select account_id, issued from dates where not has_card"))
def g3(spark, sf):
    rows = B.holders(spark, sf)
    return L.surrogate_event_date(rows.filter(~F.col("has_card")), rows.filter("has_card"), draw=B.draw)


@query("g4_running_total_lag", """select month, n, cast(coalesce(sum(n) over (order by month rows between unbounded preceding and 1 preceding), 0) as bigint) as base
    from (select cast(date_trunc('month', o_orderdate) as date) as month, count(*) as n from orders group by 1)""")
def g4(spark, sf):
    months = B.table(spark, sf, "orders").groupBy(C.to_period("o_orderdate").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return K.running_total_lag(months, "month", "n")


@query("g5_top_n", sql("select doc_id, probability from scores where model = 'm1' order by probability desc, doc_id limit 100"))
def g5(spark, sf):
    one = B.scores(spark, sf).filter("model = 'm1'")
    return K.top_n(one, 100, "probability", "doc_id").select("doc_id", "probability")


@query("g5_top_n_per_model", sql("""select model, doc_id, probability, cast(row_number() over (partition by model order by probability desc, doc_id) as int) as rank
    from scores qualify rank <= 20"""))
def g5m(spark, sf):
    return K.top_n(B.scores(spark, sf), 20, "probability", "doc_id", ["model"], "rank").drop("label")


@query("g6_sort", "select o_custkey, o_orderdate, o_orderkey from orders")
def g6(spark, sf):
    return B.table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey").orderBy(
        F.asc("o_custkey"), F.desc("o_orderdate"), "o_orderkey"
    )


@query("g7_union_all", sql("select account_id, has_card, balance_1, withdrawal_13 from windows"))
def g7(spark, sf):
    ledger, dates = B.ledger(spark, sf), B.dates(spark, sf)
    parts = [
        L.event_rollup(ledger, dates.filter(F.col("has_card") == flag), unit="day").withColumn("has_card", F.lit(flag))
        for flag in (True, False)
    ]
    return plain(parts[0].unionByName(parts[1]).select("account_id", "has_card", "balance_1", "withdrawal_13"))


_OVERLAP = """top as (select model, doc_id from scores qualify row_number() over (partition by model order by probability desc, doc_id) <= {n}),
    names as (select distinct model from scores)"""
_OVERLAP_BODY = """select a.model as model_a, b.model as model_b, (select count(*) from top x join top y using (doc_id)
    where x.model = a.model and y.model = b.model) / {n}.0 as overlap from names a, names b"""


def _overlap_sql(n):
    base = sql("select 1 from scores").rsplit("\n", 1)[0]
    return base + ",\n" + _OVERLAP.format(n=n) + "\n" + _OVERLAP_BODY.format(n=n).replace(f"/ {n}.0", f"/ cast({n} as double)")


@query("g8_set_overlap", _overlap_sql(10))
def g8(spark, sf):
    return K.set_overlap(B.scores(spark, sf), B.MODELS, 10, key="doc_id")


@query("g9_melt", sql("select account_id, cast(k as int) as month, cast(balance as double) as value from buyer_near where account_id in (select account_id from buyer_rolled)"))
def g9(spark, sf):
    wide = plain(L.event_rollup(B.ledger(spark, sf), B.buyer_dates(spark, sf), unit="day"))
    return R.melt_windows(wide, "account_id", "balance", 13)


@query("g10_append_features", sql(
    "select account_id, has_card, balance_1, " + s6("(" + " + ".join(f"credit_{k}" for k in range(1, 13)) + ")", "credit_sum", 2) + " from windows"))
def g10(spark, sf):
    rows = R.window_features(plain(B.windows(spark, sf)))
    return rounded(rows.select("account_id", "has_card", "balance_1", "credit_sum"), "credit_sum", places=2)


_ADULT = f"date_diff('day', birth_day, event) >= {B.MIN_AGE}"
_STEPS = """flags as (select m.account_id, m.has_card, lower(type_card) like '%junior%' as junior, birth_day,
    d.issued as event, r.account_id is not null as rolled_up from master m left join dates d using (account_id) left join rolled r using (account_id))"""


def _steps_sql(body):
    base = sql("select 1 from master, dates, rolled").rsplit("\n", 1)[0]
    return base + ",\n" + _STEPS + ",\n" + f"""steps as (
    select 0 as step_no, 'Initial' as step, count(*) as delta from flags
    union all select 1, 'Junior Card Holders', -count(*) from flags where junior
    union all select 2, 'Lost Buyers', -count(*) from flags where not junior and has_card and not rolled_up
    union all select 3, 'Non-Buyers', -count(*) from flags where not junior and not has_card and not rolled_up
    union all select 4, 'Underage Clients', -count(*) from flags where not junior and rolled_up and not coalesce({_ADULT}, false)
    union all select 5, 'Final', count(*) from flags where not junior and rolled_up and {_ADULT})""" + "\n" + body


def steps(spark, sf):
    m = B.master(spark, sf)
    dates = B.dates(spark, sf)
    rolled = L.event_rollup(B.ledger(spark, sf), dates, unit="day", measures=["n_transactions"])
    return bank.attrition_steps(m, dates, rolled, B.MIN_AGE)


@query("g11_waterfall_final", _steps_sql("select cast(step_no as int) as step_no, step, cast(delta as bigint) as delta from steps"))
def g11(spark, sf):
    return steps(spark, sf)


@query("q14_attrition_waterfall", _steps_sql("""select cast(step_no as int) as step_no, step, cast(delta as bigint) as delta,
    cast(coalesce(sum(delta) over (order by step_no rows between unbounded preceding and 1 preceding), 0) as bigint) as base,
    cast(sum(delta) over (order by step_no rows unbounded preceding) as bigint) as total from steps where step <> 'Final'"""))
def q14(spark, sf):
    return Q.attrition_waterfall(steps(spark, sf).filter("step <> 'Final'"))


# ---- J -----------------------------------------------------------------------------------


@query("j1_left_join_1to1", sql("""select d.disp_id, d.client_id, d.account_id, d.type as type_disp, k.card_id, k.type as type_card, k.issued
    from c_disp d left join c_card k on k.disp_id = d.disp_id"""))
def j1(spark, sf):
    disp, card = bank.clean_disp(B.raw_disp(spark, sf)), bank.clean_card(B.raw_card(spark, sf), "day")
    return J.left_join_1to1(disp, card, "disp_id", ("_disp", "_card"), validate="1:1")


@query("j2_left_join_dim", sql("""select a.account_id, a.district_id as district_id_account, c.district_id as district_id_client,
    da.region as region_account, da.num_of_habitat as num_of_habitat_account, dc.region as region_client, dc.num_of_habitat as num_of_habitat_client
    from c_account a join c_client c on a.account_id = c.client_id left join n_district da on da.district_id = a.district_id
    left join n_district dc on dc.district_id = c.district_id"""))
def j2(spark, sf):
    a = B.raw_account(spark, sf).select("account_id", F.col("district_id").alias("district_id_account"))
    c = B.raw_client(spark, sf).select(F.col("client_id").alias("account_id"), F.col("district_id").alias("district_id_client"))
    dim = C.rename_select(B.raw_district(spark, sf), codes.DISTRICT_COLUMNS).select("district_id", "region", "num_of_habitat")
    return J.left_join_dim(a.join(c, "account_id"), dim, "district_id", ["_account", "_client"])


@query("j3_spine_join", sql("""select a.account_id, o.order_id, coalesce(o.k_symbol, 'unknown') as k_symbol, coalesce(cast(o.amount as double), 0) as amount
    from raw_account a left join (select * from raw_order where bank_to = 'P' and k_symbol = 'SIPO') o using (account_id)"""))
def j3(spark, sf):
    some = plain(B.raw_order(spark, sf).filter("bank_to = 'P' and k_symbol = 'SIPO'")).select("account_id", "order_id", "k_symbol", "amount")
    return J.spine_join(B.raw_account(spark, sf).select("account_id"), some, "account_id", {"k_symbol": "unknown", "amount": 0})


@query("j4_inner_join", sql("select account_id, period, issued from ledger join buyer_dates using (account_id)"))
def j4(spark, sf):
    return J.inner_join(B.ledger(spark, sf), B.buyer_dates(spark, sf), "account_id").select("account_id", "period", "issued")


@query("j5_anti_join", sql("select account_id, issued from buyer_dates where account_id not in (select account_id from buyer_rolled)"))
def j5(spark, sf):
    dates = B.buyer_dates(spark, sf)
    return J.anti_join(dates, L.event_rollup(B.ledger(spark, sf), dates, unit="day"), "account_id")


@query("j5_semi_join", sql("select account_id, issued from buyer_dates where account_id in (select account_id from buyer_rolled)"))
def j5s(spark, sf):
    dates = B.buyer_dates(spark, sf)
    return J.semi_join(dates, L.event_rollup(B.ledger(spark, sf), dates, unit="day"), "account_id")


@query("j6_first_activity_join", sql("select a.account_id, f.first_period from raw_account a left join (select account_id, min(period) as first_period from sums group by 1) f using (account_id)"))
def j6(spark, sf):
    return J.first_activity_join(B.raw_account(spark, sf).select("account_id"), L.period_ledger(B.entries(spark, sf), unit="day"), "account_id")


@query("j7_event_date_coalesce", sql("select a.account_id, d.issued, a.has_card from adults a join dates d using (account_id)"))
def j7(spark, sf):
    rows = B.holders(spark, sf).select("account_id", "issued", "has_card")
    drawn = L.surrogate_event_date(rows.filter(~F.col("has_card")), rows.filter("has_card"), draw=B.draw)
    return J.event_date_coalesce(rows, drawn, "account_id")


_MASTER_MONEY = ["payments", *bank.ORDER_DOMAIN]
_IMPUTED = [f"{c}_{s}" for c in ("unemploy_rate95", "no_of_crimes95") for s in ("account", "client")]
_MASTER_SQL = "select * replace (" + ", ".join(
    [f"cast({c} as double) as {c}" for c in _MASTER_MONEY] + [f"round({c}, 6) + 0.0 as {c}" for c in _IMPUTED]
) + ") from "


@query("j8_master_record", sql(_MASTER_SQL + "master"))
def j8(spark, sf):
    return rounded(plain(B.master(spark, sf)), *_IMPUTED)


@query("j9_event_window_join", sql("select account_id, period, issued, k, cast(volume as double) as volume from (select l.*, d.issued, cast(d.issued - l.period as bigint) as k from ledger l join dates d using (account_id)) where k between 1 and 13"))
def j9(spark, sf):
    dates = B.dates(spark, sf)
    near = L.event_distance(L.prune_to_events(B.ledger(spark, sf), dates, "day"), dates, unit="day")
    return plain(near.select("account_id", "period", "issued", F.col("k").cast("long").alias("k"), "volume"))
