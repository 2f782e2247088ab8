"""The bank roles played by the given test tables: once as Spark frames, once as SQL.

Roles cover the whole table they are built from, save where the role is a part by meaning: cards (three of five customer
segments), loans (urgent orders) and suppliers with a date. The SQL text is the independent side of the
comparison: it is written against the parquet views alone.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from pyspark.sql.types import StructType

from propensia.functions import codes
from propensia.functions.clean import signed_amount
from propensia.plans import bank

HORIZON = 13
MIN_AGE = 12_000  # days; splits the test customers, whose events lie in 2024
SEGMENT_CARD = {"BUILDING": "classic", "MACHINERY": "gold", "FURNITURE": "junior"}


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    path = f"{sf}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _case(col: Column, values: dict[str, str], other: Column) -> Column:
    out = F.when(F.lit(False), other)
    for k, v in values.items():
        out = out.when(col == k, F.lit(v))
    return out.otherwise(other)


def compact(col: str) -> Column:
    return F.date_format(F.to_date(col), "yyMMdd")


# ---- raw bank tables ---------------------------------------------------------------------

SEGMENT_FREQUENCY = {
    "BUILDING": "POPLATEK MESICNE", "MACHINERY": "POPLATEK TYDNE", "FURNITURE": "POPLATEK PO OBRATU",
}
PRIORITY_SYMBOL = {
    "1-URGENT": "POJISTNE", "2-HIGH": "SIPO", "3-MEDIUM": "UVER", "5-LOW": "LEASING", "4-NOT SPECIFIED": " ",
}
EVENT_OPERATION = {
    "view": "VKLAD", "purchase": "VYBER KARTOU", "error": "OTHER", "signup": "PREVOD Z UCTU",
}
EVENT_SYMBOL = {"view": " ", "purchase": "SIPO", "error": "OTHER", "signup": "UROK"}


def raw_account(spark, sf):
    first = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("account_id")).agg(F.min("o_orderdate").alias("d"))
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("account_id"), F.col("c_nationkey").cast("long").alias("district_id"),
        _case(F.col("c_mktsegment"), SEGMENT_FREQUENCY, F.col("c_mktsegment")).alias("frequency"),
    )
    return c.join(first, "account_id", "left").select("account_id", "district_id", "frequency", compact("d").alias("date"))


def raw_client(spark, sf):
    k = F.col("c_custkey")
    number = (35 + k % 65) * 10000 + (k % 12 + 1 + 50 * (k % 2)) * 100 + k % 28 + 1
    return table(spark, sf, "customer").select(
        k.alias("client_id"), number.cast("string").alias("birth_number"),
        ((F.col("c_nationkey") + 7) % 25).cast("long").alias("district_id"),
    )


def raw_disp(spark, sf):
    k = F.col("c_custkey")
    kind = F.when(F.col("c_acctbal") < 0, "DISPONENT").otherwise("OWNER")
    return table(spark, sf, "customer").select(k.alias("disp_id"), k.alias("client_id"), k.alias("account_id"), kind.alias("type"))


def raw_card(spark, sf):
    last = (
        table(spark, sf, "events").filter(F.col("event_type") == "purchase")
        .groupBy(F.col("user_id").alias("disp_id")).agg(F.max("ts").alias("ts"))
    )
    c = table(spark, sf, "customer").filter(F.col("c_mktsegment").isin(list(SEGMENT_CARD))).select(
        F.col("c_custkey").alias("disp_id"), _case(F.col("c_mktsegment"), SEGMENT_CARD, F.lit(None)).alias("type")
    )
    return last.join(c, "disp_id").select(
        (F.col("disp_id") + 1_000_000).alias("card_id"), "disp_id", "type",
        F.concat(compact("ts"), F.lit(" 00:00:00")).alias("issued"),
    )


def raw_loan(spark, sf):
    o = table(spark, sf, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
    row = F.min_by(F.struct("o_orderdate", "o_totalprice", "o_orderstatus"), "o_orderkey")
    one = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("loan_id"), row.alias("r"))
    return one.select(
        "loan_id", F.col("o_custkey").alias("account_id"), compact("r.o_orderdate").alias("date"),
        F.floor("r.o_totalprice").cast("long").alias("amount"), (12 * (1 + F.col("loan_id") % 5)).alias("duration"),
        F.col("r.o_totalprice").cast("decimal(18,2)").alias("payments"),
        _case(F.col("r.o_orderstatus"), {"F": "A", "O": "C", "P": "D"}, F.lit(None)).alias("status"),
    )


def raw_order(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("account_id"),
        F.col("o_orderstatus").alias("bank_to"), F.col("o_custkey").alias("account_to"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
        _case(F.col("o_orderpriority"), PRIORITY_SYMBOL, F.lit(None)).alias("k_symbol"),
    )


def raw_district(spark, sf):
    seg = lambda s: F.count_if(F.col("c_mktsegment") == s)
    people = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(
        F.count(F.lit(1)).alias("n"), seg("BUILDING").alias("b"), seg("MACHINERY").alias("m"),
        seg("FURNITURE").alias("f"), seg("AUTOMOBILE").alias("a"), seg("HOUSEHOLD").alias("h"),
        F.count_if(F.col("c_acctbal") < 5000).alias("low"),
    )
    nation = table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).join(people, "n_nationkey", "left")
    text = lambda c: F.when(F.col("n_name") == "NATION_3", "?").otherwise(F.col(c).cast("string"))
    n = F.col("n_nationkey").cast("long")
    return nation.select(
        n.alias("A1"), F.col("n_name").alias("A2"), F.col("r_name").alias("A3"), F.col("n").alias("A4"),
        F.col("b").alias("A5"), F.col("m").alias("A6"), F.col("f").alias("A7"), F.col("a").alias("A8"),
        F.col("h").alias("A9"), F.col("h").cast("double").alias("A10"), (n * 100 + 8000).alias("A11"),
        text("b").alias("A12"), F.col("m").cast("double").alias("A13"), n.alias("A14"),
        text("low").alias("A15"), F.col("n").alias("A16"),
    )


def running_entries(spark, sf):
    """Signed entries with the balance after each.

    Two levels: the balance before an hour comes from per-hour sums, so a busy account's entries are
    ordered in one task per hour and not per account.
    """
    e = table(spark, sf, "events").select(
        F.col("event_id").alias("trans_id"), F.col("user_id").alias("account_id"), "ts",
        F.to_date("ts").alias("date"), "event_type",
        F.when(F.col("event_type").isin("purchase", "error"), "withdrawal").otherwise("credit").alias("type"),
        F.col("value").cast("decimal(18,2)").alias("gross"),
    ).withColumn("amount", signed_amount("gross", "type")).withColumn("hour", F.date_trunc("hour", "ts"))
    hours = e.groupBy("account_id", "hour").agg(F.sum("amount").alias("s"))
    before = W.partitionBy("account_id").orderBy("hour").rowsBetween(W.unboundedPreceding, -1)
    start = hours.select("account_id", "hour", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("start"))
    inside = W.partitionBy("account_id", "hour").orderBy("ts", "trans_id").rowsBetween(W.unboundedPreceding, 0)
    return (
        e.withColumn("inside", F.sum("amount").over(inside)).join(start, ["account_id", "hour"])
        .withColumn("balance", (F.col("start") + F.col("inside")).cast("decimal(18,2)"))
        .drop("hour", "inside", "start")
    )


def raw_trans(spark, sf):
    kind = F.when(F.col("event_type") == "purchase", "VYBER").when(F.col("event_type") == "error", "VYDAJ").otherwise("PRIJEM")
    return running_entries(spark, sf).select(
        "trans_id", "account_id", compact("ts").alias("date"), kind.alias("type"),
        _case(F.col("event_type"), EVENT_OPERATION, F.lit(None)).alias("operation"),
        F.col("gross").alias("amount"), "balance",
        _case(F.col("event_type"), EVENT_SYMBOL, F.lit(None)).alias("k_symbol"),
        F.lit(None).cast("string").alias("bank"), F.lit(None).cast("long").alias("account"),
    )


RAW = {
    "account": raw_account, "card": raw_card, "client": raw_client, "disp": raw_disp,
    "district": raw_district, "loan": raw_loan, "order": raw_order, "trans": raw_trans,
}


def raw_bank(spark, sf, names=tuple(RAW)):
    return {name: RAW[name](spark, sf) for name in names}


# ---- prepared roles ----------------------------------------------------------------------

def tables(spark, sf, names=tuple(RAW)):
    return bank.prepare(raw_bank(spark, sf, names), unit="day")


def entries(spark, sf):
    """The clean ledger straight from the event rows (date and signed amount)."""
    return table(spark, sf, "events").select(
        F.col("event_id").alias("trans_id"), F.col("user_id").alias("account_id"), F.to_date("ts").alias("date"),
        F.when(F.col("event_type").isin("purchase", "error"), -F.col("value")).otherwise(F.col("value"))
        .cast("decimal(18,2)").alias("amount"),
    )


def buyer_dates(spark, sf):
    return bank.clean_card(raw_card(spark, sf), "day").select(F.col("disp_id").alias("account_id"), "issued")


def ledger(spark, sf):
    return bank.monthly_ledger(entries(spark, sf), unit="day")


def draw(key: Column, size: Column) -> Column:
    """The arithmetic pick both sides use."""
    return F.pmod(key * 7919 + 43, size)


def master(spark, sf):
    return bank.master_record(tables(spark, sf, [n for n in RAW if n != "trans"]))


def adults(spark, sf):
    return bank.without_junior(master(spark, sf))


def holders(spark, sf):
    """Card status of every owner without a junior card."""
    t = {"disp": bank.clean_disp(raw_disp(spark, sf)), "card": bank.clean_card(raw_card(spark, sf), "day")}
    return bank.without_junior(bank.card_status(t))


def dates(spark, sf):
    return bank.event_dates(holders(spark, sf), draw=draw)


def windows(spark, sf):
    return bank.affinity_windows(ledger(spark, sf), dates(spark, sf), unit="day")


def supplier_entries(spark, sf):
    """Monthly ledger role of ``lineitem``."""
    sign = F.when(F.col("l_returnflag") == "R", -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice"))
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("account_id"), F.to_date("l_shipdate").alias("date"),
        sign.cast("decimal(18,2)").alias("amount"),
    )


def supplier_dates(spark, sf):
    """Suppliers in the red have the event in their last month."""
    last = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("account_id")).agg(
        F.trunc(F.max(F.to_date("l_shipdate")), "month").alias("issued")
    )
    red = table(spark, sf, "supplier").filter(F.col("s_acctbal") < 5000).select(F.col("s_suppkey").alias("account_id"))
    return last.join(red, "account_id")


FEATURES = [f"f{i}" for i in range(64)]


def vectors(spark, sf):
    """(vec_id, label, f0..f63): two of the ten classes are the positives."""
    e = table(spark, sf, "embeddings")
    return e.select(
        "vec_id", (F.col("label") < 2).cast("int").alias("label"),
        *[F.get("embedding", F.lit(i)).cast("double").alias(f"f{i}") for i in range(64)],
    )


def gappy_vectors(spark, sf):
    """Vectors with missing elements where a value is extreme."""
    v = vectors(spark, sf)
    return v.withColumns({c: F.when(F.abs(c) <= cut, F.col(c)) for c, cut in GAPS.items()})


GAPS = {"f0": 0.2, "f5": 0.22, "f9": 0.25}


def scores(spark, sf):
    """Labelled rows with two deterministic scores, ties included."""
    base = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    one = base.select("doc_id", F.col("quality").cast("int").alias("label"), F.lit("m1").alias("model"),
                      (((F.col("doc_id") * 7919) % 1000) / 1000.0).alias("probability"))
    two = base.select("doc_id", F.col("quality").cast("int").alias("label"), F.lit("m2").alias("model"),
                      ((F.col("n_chars") % 200) / 200.0).alias("probability"))
    three = base.select("doc_id", F.col("quality").cast("int").alias("label"), F.lit("m3").alias("model"),
                        (((F.col("doc_id") * 104729 + F.col("n_chars")) % 50) / 50.0).alias("probability"))
    return one.unionByName(two).unionByName(three).select("doc_id", "label", "model", F.col("probability").cast("double").alias("probability"))


MODELS = ["m1", "m2", "m3"]

# ---- the same roles in SQL ---------------------------------------------------------------


def sql_case(col: str, values: dict[str, str], other: str = "null") -> str:
    return "case " + col + " ".join(f" when '{k}' then '{v}'" for k, v in values.items()) + f" else {other} end"


def sql_date(text: str) -> str:
    return f"cast(try_strptime(substr({text}, 1, 6), '%y%m%d') as date)"


_MEASURES = ("balance", "credit", "n_transactions", "volume", "withdrawal")


def sql_wide(measures=_MEASURES, horizon: int = HORIZON, agg: str = "max") -> str:
    return ", ".join(
        f"cast({agg}(case when k = {k} then {m} end) as {'bigint' if m == 'n_transactions' and agg == 'max' else 'double'}) as {m}_{k}"
        for m in measures for k in range(1, horizon + 1)
    )


def sql_values(measures=_MEASURES, horizon: int = HORIZON, prefix: str = "") -> str:
    return ", ".join(f"{prefix}{m}_{k}" for m in measures for k in range(1, horizon + 1))


_D = {k: v for k, v in codes.DISTRICT_COLUMNS.items()}
_D_REST = [v for v in _D.values() if v != "district_id"]

CTES = {
    "raw_account": f"""select c_custkey as account_id, cast(c_nationkey as bigint) as district_id,
        {sql_case('c_mktsegment', SEGMENT_FREQUENCY, 'c_mktsegment')} as frequency, strftime(d, '%y%m%d') as date
        from customer left join (select o_custkey, min(o_orderdate) as d from orders group by 1) on o_custkey = c_custkey""",
    "raw_client": """select c_custkey as client_id, cast((35 + c_custkey % 65) * 10000
        + (c_custkey % 12 + 1 + 50 * (c_custkey % 2)) * 100 + c_custkey % 28 + 1 as varchar) as birth_number,
        cast((c_nationkey + 7) % 25 as bigint) as district_id from customer""",
    "raw_disp": """select c_custkey as disp_id, c_custkey as client_id, c_custkey as account_id,
        case when c_acctbal < 0 then 'DISPONENT' else 'OWNER' end as type from customer""",
    "raw_card": f"""select user_id + 1000000 as card_id, user_id as disp_id, {sql_case('c_mktsegment', SEGMENT_CARD)} as type,
        strftime(max(ts), '%y%m%d') || ' 00:00:00' as issued from events join customer on user_id = c_custkey
        where event_type = 'purchase' and c_mktsegment in ('BUILDING', 'MACHINERY', 'FURNITURE') group by user_id, c_mktsegment""",
    "raw_loan": f"""select o_orderkey as loan_id, o_custkey as account_id, strftime(o_orderdate, '%y%m%d') as date,
        cast(floor(o_totalprice) as bigint) as amount, 12 * (1 + o_orderkey % 5) as duration,
        cast(o_totalprice as decimal(18,2)) as payments, {sql_case('o_orderstatus', {'F': 'A', 'O': 'C', 'P': 'D'})} as status
        from orders where o_orderkey in (select min(o_orderkey) from orders where o_orderpriority = '1-URGENT' group by o_custkey)""",
    "raw_order": f"""select o_orderkey as order_id, o_custkey as account_id, o_orderstatus as bank_to, o_custkey as account_to,
        cast(o_totalprice as decimal(18,2)) as amount, {sql_case('o_orderpriority', PRIORITY_SYMBOL)} as k_symbol from orders""",
    "raw_district": """select cast(n_nationkey as bigint) as A1, n_name as A2, r_name as A3, n as A4, b as A5, m as A6, f as A7,
        a as A8, h as A9, cast(h as double) as A10, cast(n_nationkey as bigint) * 100 + 8000 as A11,
        case when n_name = 'NATION_3' then '?' else cast(b as varchar) end as A12, cast(m as double) as A13,
        cast(n_nationkey as bigint) as A14, case when n_name = 'NATION_3' then '?' else cast(low as varchar) end as A15, n as A16
        from nation join region on n_regionkey = r_regionkey left join (select c_nationkey, count(*) as n,
        count(*) filter (c_mktsegment = 'BUILDING') as b, count(*) filter (c_mktsegment = 'MACHINERY') as m,
        count(*) filter (c_mktsegment = 'FURNITURE') as f, count(*) filter (c_mktsegment = 'AUTOMOBILE') as a,
        count(*) filter (c_mktsegment = 'HOUSEHOLD') as h, count(*) filter (c_acctbal < 5000) as low
        from customer group by 1) on c_nationkey = n_nationkey""",
    "running_entries": """select event_id as trans_id, user_id as account_id, ts, cast(ts as date) as date, event_type,
        case when event_type in ('purchase', 'error') then 'withdrawal' else 'credit' end as type,
        cast(value as decimal(18,2)) as gross,
        cast(case when event_type in ('purchase', 'error') then -value else value end as decimal(18,2)) as amount,
        cast(sum(cast(case when event_type in ('purchase', 'error') then -value else value end as decimal(18,2)))
             over (partition by user_id order by ts, event_id rows unbounded preceding) as decimal(18,2)) as balance from events""",
    "raw_trans": f"""select trans_id, account_id, strftime(ts, '%y%m%d') as date,
        case event_type when 'purchase' then 'VYBER' when 'error' then 'VYDAJ' else 'PRIJEM' end as type,
        {sql_case('event_type', EVENT_OPERATION)} as operation, gross as amount, balance,
        {sql_case('event_type', EVENT_SYMBOL)} as k_symbol from running_entries""",
    "c_account": f"""select account_id, district_id, {sql_case('frequency', codes.FREQUENCY, 'frequency')} as frequency,
        {sql_date('date')} as date from raw_account""",
    "c_card": f"select card_id, disp_id, type, {sql_date('issued')} as issued from raw_card",
    "c_client": """select client_id, district_id, case when cast(substr(b, 3, 2) as int) > 12 then 'female' else 'male' end as gender,
        birth_day, cast(1999 - year(birth_day) as int) as age from (select client_id, district_id, lpad(birth_number, 6, '0') as b,
        make_date(cast(1900 + cast(substr(lpad(birth_number, 6, '0'), 1, 2) as int) as bigint),
                  cast((cast(substr(lpad(birth_number, 6, '0'), 3, 2) as int) - 1) % 50 + 1 as bigint),
                  cast(cast(substr(lpad(birth_number, 6, '0'), 5, 2) as int) as bigint)) as birth_day from raw_client)""",
    "c_disp": "select * from raw_disp where type = 'OWNER'",
    "n_district": "select " + ", ".join(
        (f"try_cast(nullif({k}, '?') as double) as {v}" if k in ("A12", "A15") else f"{k} as {v}") for k, v in _D.items()
    ) + " from raw_district",
    "c_district": """select * replace (coalesce(unemploy_rate95, (select regr_intercept(unemploy_rate95, unemploy_rate96)
          + regr_slope(unemploy_rate95, unemploy_rate96) * d.unemploy_rate96 from n_district)) as unemploy_rate95,
        coalesce(no_of_crimes95, (select regr_intercept(no_of_crimes95, no_of_crimes96)
          + regr_slope(no_of_crimes95, no_of_crimes96) * d.no_of_crimes96 from n_district)) as no_of_crimes95) from n_district d""",
    "c_loan": f"""select loan_id, account_id, {sql_date('date')} as date, amount, duration, payments,
        {sql_case('status', codes.LOAN_STATUS)} as status from raw_loan""",
    "c_order": "select a.account_id, " + ", ".join(
        f"coalesce(sum(case when symbol = '{v}' then amount end), 0) as {v}" for v in bank.ORDER_DOMAIN
    ) + f""" from raw_account a left join (select account_id, amount,
        coalesce({sql_case('k_symbol', codes.ORDER_SYMBOL)}, 'unknown') as symbol from raw_order) o using (account_id) group by 1""",
    "master": f"""select d.disp_id, d.client_id, d.account_id, d.type as type_disp, a.district_id as district_id_account, a.frequency,
        a.date as date_account, c.district_id as district_id_client, c.gender, c.birth_day, c.age, k.card_id,
        coalesce(k.type, 'none') as type_card, k.issued, l.loan_id, l.date as date_loan, coalesce(l.amount, 0) as amount,
        coalesce(l.duration, 0) as duration, coalesce(l.payments, 0) as payments, coalesce(l.status, 'none') as status,
        {', '.join('o.' + v for v in bank.ORDER_DOMAIN)},
        {', '.join(f'da.{c} as {c}_account' for c in _D_REST)}, {', '.join(f'dc.{c} as {c}_client' for c in _D_REST)},
        k.card_id is not null as has_card
        from c_disp d left join c_account a using (account_id) left join c_client c on c.client_id = d.client_id
        left join c_card k on k.disp_id = d.disp_id left join c_loan l on l.account_id = d.account_id
        left join c_order o on o.account_id = d.account_id left join c_district da on da.district_id = a.district_id
        left join c_district dc on dc.district_id = c.district_id""",
    "adults": "select * from master where lower(type_card) not like '%junior%'",
    "entries": """select event_id as trans_id, user_id as account_id, cast(ts as date) as date,
        cast(case when event_type in ('purchase', 'error') then -value else value end as decimal(18,2)) as amount from events""",
    "sums": """select account_id, date as period, sum(amount) as volume, coalesce(sum(amount) filter (amount > 0), 0) as credit,
        coalesce(sum(amount) filter (amount < 0), 0) as withdrawal, count(amount) as n_transactions from entries group by 1, 2""",
    "ledger": """select *, sum(volume) over (partition by account_id order by period rows unbounded preceding) as balance from sums""",
    "buyer_dates": "select disp_id as account_id, issued from c_card",
    "pool": "select issued, row_number() over (order by issued) - 1 as i, count(*) over () as n from (select distinct issued from adults where has_card)",
    "dates": """select account_id, issued, true as has_card from adults where has_card union all
        select a.account_id, p.issued, false from adults a join pool p on p.i = (a.account_id * 7919 + 43) % p.n where not has_card""",
    "near": """select l.*, cast(d.issued - l.period as bigint) as k from ledger l join dates d using (account_id)
        where d.issued - l.period between 1 and 13""",
    "rolled": f"select account_id, {sql_wide()} from near group by account_id having count(*) = 13",
    "buyer_near": """select l.*, cast(d.issued - l.period as bigint) as k from ledger l join buyer_dates d using (account_id)
        where d.issued - l.period between 1 and 13""",
    "buyer_rolled": f"select account_id, {sql_wide()} from buyer_near group by account_id having count(*) = 13",
    "windows": "select d.account_id, d.issued, d.has_card, r.* exclude (account_id) from dates d join rolled r using (account_id)",
    "supplier_entries": """select l_suppkey as account_id, cast(l_shipdate as date) as date,
        cast(case when l_returnflag = 'R' then -l_extendedprice else l_extendedprice end as decimal(18,2)) as amount from lineitem""",
    "supplier_sums": """select account_id, cast(date_trunc('month', date) as date) as period, sum(amount) as volume,
        coalesce(sum(amount) filter (amount > 0), 0) as credit, coalesce(sum(amount) filter (amount < 0), 0) as withdrawal,
        count(amount) as n_transactions from supplier_entries group by 1, 2""",
    "supplier_ledger": """select *, sum(volume) over (partition by account_id order by period rows unbounded preceding) as balance
        from supplier_sums""",
    "supplier_dates": """select l_suppkey as account_id, cast(date_trunc('month', max(l_shipdate)) as date) as issued from lineitem
        join supplier on s_suppkey = l_suppkey where s_acctbal < 5000 group by 1""",
    "supplier_near": """select l.*, cast(12 * (year(issued) - year(period)) + month(issued) - month(period) as bigint) as k
        from supplier_ledger l join supplier_dates using (account_id)
        where 12 * (year(issued) - year(period)) + month(issued) - month(period) between 1 and 13""",
    "vectors": "select vec_id, cast(label < 2 as int) as label, "
    + ", ".join(f"cast(embedding[{i + 1}] as double) as f{i}" for i in range(64)) + " from embeddings",
    "gappy": "select * replace (" + ", ".join(f"case when abs({c}) <= {cut} then {c} end as {c}" for c, cut in GAPS.items()) + ") from vectors",
    "scored": """select doc_id, cast(quality as int) as label, n_chars from labels join documents using (doc_id)""",
    "scores": """select doc_id, label, 'm1' as model, cast((doc_id * 7919) % 1000 as double) / 1000.0 as probability from scored
        union all select doc_id, label, 'm2', cast(n_chars % 200 as double) / 200.0 from scored
        union all select doc_id, label, 'm3', cast((doc_id * 104729 + n_chars) % 50 as double) / 50.0 from scored""",
}


def sql(body: str, **extra: str) -> str:
    """``body`` with the common table expressions it needs, dependencies first."""
    ctes = {**CTES, **extra}
    done: list[str] = []

    def need(text: str, seen: tuple[str, ...]) -> None:
        for name in ctes:
            if name not in seen and name not in done and re.search(rf"\b{name}\b", text):
                need(ctes[name], (*seen, name))
                if name not in done:
                    done.append(name)

    need(body, ())
    if not done:
        return body
    return "with " + ",\n".join(f"{n} as ({ctes[n]})" for n in done) + "\n" + body
