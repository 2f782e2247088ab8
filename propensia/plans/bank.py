"""From raw bank tables to the modelling set. Everything here is one lazy plan until it is written."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from propensia.functions import clean as C
from propensia.functions import codes
from propensia.operators import aggregates as A
from propensia.operators import filters as X
from propensia.operators import joins as J
from propensia.operators import ledger as L
from propensia.operators.features import one_hot_drop_first
from propensia.session import stage

ORDER_DOMAIN = C.domain([*codes.ORDER_SYMBOL.values(), "unknown"])
STATUS_DOMAIN = C.domain(codes.LOAN_STATUS.values(), extra=["none"])
FREQUENCY_DOMAIN = C.domain(codes.FREQUENCY.values())
GENDER_DOMAIN = C.domain(["female", "male"])


# ---- cleaning, one function per table ----------------------------------------------------

def clean_account(raw: DataFrame) -> DataFrame:
    return raw.withColumns(
        {"date": C.parse_compact_date("date"), "frequency": C.recode_keep("frequency", codes.FREQUENCY)}
    )


def clean_card(raw: DataFrame, unit: str = "month") -> DataFrame:
    return raw.withColumn("issued", C.to_period(C.parse_compact_date("issued"), unit))


def clean_client(raw: DataFrame) -> DataFrame:
    gender, birth = C.decode_birth_number("birth_number")
    return (
        raw.withColumns({"gender": gender, "birth_day": birth})
        .withColumn("age", C.age_at("birth_day"))
        .drop("birth_number")
    )


def clean_disp(raw: DataFrame) -> DataFrame:
    return X.filter_eq(raw, "type", "OWNER")


def clean_district(raw: DataFrame) -> DataFrame:
    named = C.rename_select(raw, codes.DISTRICT_COLUMNS).withColumns(
        {c: C.sentinel_to_null(c) for c in ("unemploy_rate95", "no_of_crimes95")}
    )
    rates = A.ols_impute(named, "unemploy_rate95", "unemploy_rate96")
    return A.ols_impute(rates, "no_of_crimes95", "no_of_crimes96")


def clean_loan(raw: DataFrame) -> DataFrame:
    return raw.withColumns(
        {"date": C.parse_compact_date("date"), "status": C.recode_strict("status", codes.LOAN_STATUS)}
    )


def clean_order(account: DataFrame, raw: DataFrame) -> DataFrame:
    """One row per account with the summed amount per order symbol, 0 without orders.

    Orders are summed before they meet the account spine, so an account with very many of them
    reaches the join as one row.
    """
    coded = raw.select(
        "account_id", "amount", C.recode_strict("k_symbol", codes.ORDER_SYMBOL, "unknown").alias("k_symbol")
    )
    sums = A.pivot_sum(coded, "account_id", "k_symbol", "amount", ORDER_DOMAIN)
    return J.spine_join(account.select("account_id"), sums, "account_id", {c: 0 for c in ORDER_DOMAIN})


def clean_trans(raw: DataFrame) -> DataFrame:
    typed = raw.withColumns(
        {
            "date": C.parse_compact_date("date"),
            "type": C.recode_keep("type", codes.TRANS_TYPE),
            "operation": C.recode_keep("operation", codes.TRANS_OPERATION),
            "k_symbol": C.recode_keep("k_symbol", codes.TRANS_SYMBOL),
        }
    )
    return typed.withColumn("amount", C.signed_amount("amount", "type"))


def prepare(raw: Mapping[str, DataFrame], unit: str = "month") -> dict[str, DataFrame]:
    """The given raw tables, cleaned; ``order`` becomes the per-account pivot."""
    each = {
        "account": clean_account, "card": lambda t: clean_card(t, unit), "client": clean_client, "disp": clean_disp,
        "district": clean_district, "loan": clean_loan, "trans": clean_trans,
        "order": lambda t: clean_order(raw["account"], t),
    }
    return {name: each[name](table) for name, table in raw.items()}


# ---- master record -----------------------------------------------------------------------

def master_record(t: Mapping[str, DataFrame], validate: bool = False) -> DataFrame:
    """One row per owner account: account, client, card, loan, orders and both districts."""
    one, many = ("1:1", "m:1") if validate else (None, None)
    star = J.left_join_1to1(t["disp"], t["account"], "account_id", validate=one)
    star = J.left_join_1to1(star, t["client"], "client_id", ("_account", "_client"), validate=one)
    star = J.left_join_1to1(star, t["card"], "disp_id", ("_disp", "_card"), validate=one)
    star = J.left_join_1to1(star, t["loan"], "account_id", ("_account", "_loan"), validate=one)
    star = J.left_join_1to1(star, t["order"], "account_id", validate=one)
    if many:
        J.join_cardinality(t["district"], "district_id", strict=True)
    star = J.left_join_dim(star, t["district"], "district_id", ("_account", "_client"))
    return C.fill_const(
        star.withColumns(
            {
                "has_card": C.presence_flag("card_id"),
                "type_card": C.overwrite_when_null("type_card", "card_id", "none"),
            }
        ),
        {"status": "none", "payments": 0, "duration": 0, "amount": 0},
    )


def card_status(t: Mapping[str, DataFrame]) -> DataFrame:
    """(account_id, type_card, issued, has_card) per owner account.

    All that event dates need of the master record; building them from this one join keeps the other
    six out of every plan that only asks when the event was.
    """
    card = t["card"].select("disp_id", "issued", "card_id", F.col("type").alias("type_card"))
    rows = t["disp"].select("account_id", "disp_id").join(card, "disp_id", "left")
    return rows.select(
        "account_id",
        C.overwrite_when_null("type_card", "card_id", "none").alias("type_card"),
        "issued",
        C.presence_flag("card_id").alias("has_card"),
    )


def without_junior(master: DataFrame) -> DataFrame:
    """Accounts without a junior card."""
    return X.filter_not_contains(master, "type_card", "junior")


# ---- windows -----------------------------------------------------------------------------

def monthly_ledger(trans: DataFrame, unit: str = "month") -> DataFrame:
    """Per-period sums with the running balance."""
    return L.running_balance(L.period_ledger(trans, unit=unit))


def event_dates(holders: DataFrame, draw: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(account_id, issued, has_card): real dates of buyers, drawn dates of everybody else.

    ``holders``: master or card-status rows. One pass: the drawn date is computed on the row itself.
    """
    rows = holders.select("account_id", "issued", "has_card")
    buyers = X.filter_eq(rows, "has_card", True)
    drawn = L.draw_event_date(rows, buyers, draw=draw)
    return drawn.withColumn("issued", F.when(F.col("has_card"), F.col("issued")).otherwise(F.col("_drawn"))).drop("_drawn")


def affinity_windows(ledger: DataFrame, dates: DataFrame, unit: str = "month", horizon: int = codes.HORIZON) -> DataFrame:
    """Complete windows of buyers and non-buyers with the label.

    Both groups go through one rollup: the union is taken over the small event table instead of the
    ledger, so the ledger is read, summed and shuffled once.
    """
    wide = L.event_rollup(ledger, dates.select("account_id", "issued"), unit=unit, horizon=horizon)
    return dates.join(wide, "account_id")


DROPPED = (
    "has_card", "card_id", "issued", "type_card", "loan_id", "date_loan", "disp_id", "client_id",
    "district_id_account", "birth_day", "type_disp",
)


def modelling_set(master: DataFrame, windows: DataFrame, min_age_days: int = codes.MIN_AGE_DAYS) -> DataFrame:
    """Master rows with a complete window and of age at the event; ``label`` is the card flag.

    The windows bring the event date along in their one join. The rows are written once, so that the earliest account
    date is a scan of one stored column and not a second run of all joins.
    """
    rolled = windows.drop("has_card").withColumnRenamed("issued", "_event")
    rows = J.inner_join(master, rolled, "account_id")
    dated = rows.withColumn("issued", F.coalesce("issued", "_event")).drop("_event")
    adults = X.min_age_at_event(dated, "issued", "birth_day", min_age_days)
    labelled = adults.withColumn("label", F.col("has_card").cast("int"))
    return C.days_since_min(stage(C.drop_columns(labelled, DROPPED), "modelling_set"), "date_account")


def indicator_domains(regions: Sequence[str], districts: Sequence[str]) -> dict[str, list[str]]:
    """Domains of the modelling set's category columns, first value dropped by the indicators."""
    out = {"frequency": FREQUENCY_DOMAIN, "gender": GENDER_DOMAIN, "status": STATUS_DOMAIN}
    for side in ("_account", "_client"):
        out["district_name" + side] = C.domain(districts)
        out["region" + side] = C.domain(regions)
    return out


def encode(rows: DataFrame, domains: Mapping[str, Sequence[str]]) -> DataFrame:
    """Category columns to 0/1 columns."""
    return one_hot_drop_first(rows, domains)


# ---- attrition ---------------------------------------------------------------------------

def attrition_steps(master: DataFrame, dates: DataFrame, windows: DataFrame, min_age_days: int = codes.MIN_AGE_DAYS) -> DataFrame:
    """(step_no, step, delta): accounts removed by each step, and the final count.

    One pass: every account gets its flags by key joins, one aggregate counts all steps.
    """
    junior = F.coalesce(F.lower("type_card").contains("junior"), F.lit(False))
    flags = (
        master.select("account_id", "has_card", "birth_day", junior.alias("junior"))
        .join(dates.select("account_id", F.col("issued").alias("event")), "account_id", "left")
        .join(windows.select("account_id", F.lit(True).alias("rolled")), "account_id", "left")
        .select(
            "junior", "has_card",
            F.coalesce("rolled", F.lit(False)).alias("rolled"),
            F.coalesce(F.date_diff("event", "birth_day") >= min_age_days, F.lit(False)).alias("adult"),
        )
    )
    kept = ~F.col("junior")
    counts = {
        "Initial": F.count(F.lit(1)),
        "Junior Card Holders": -F.count_if(F.col("junior")),
        "Lost Buyers": -F.count_if(kept & F.col("has_card") & ~F.col("rolled")),
        "Non-Buyers": -F.count_if(kept & ~F.col("has_card") & ~F.col("rolled")),
        "Underage Clients": -F.count_if(kept & F.col("rolled") & ~F.col("adult")),
        "Final": F.count_if(kept & F.col("rolled") & F.col("adult")),
    }
    row = flags.agg(*[c.alias(f"c{i}") for i, c in enumerate(counts.values())])
    cells = [
        F.struct(F.lit(i).alias("step_no"), F.lit(name).alias("step"), F.col(f"c{i}").alias("delta"))
        for i, name in enumerate(counts)
    ]
    return row.select(F.inline(F.array(*cells)))
