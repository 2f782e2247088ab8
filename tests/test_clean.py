"""Cleaning expressions on handmade edge cases."""

import datetime as dt

from pyspark.sql import functions as F

from propensia.functions import clean as C, codes
from propensia.operators import filters as X
from propensia.plans import bank


def values(df, col):
    return [r[col] for r in df.collect()]


def test_compact_dates_follow_the_two_digit_year_rule(spark):
    df = spark.createDataFrame([("930705",), ("000101",), ("690101",), ("681231",), ("931107 00:00:00",), ("9913",), ("991332",), (None,)], "d string")
    got = values(df.select(C.parse_compact_date("d").alias("x")), "x")
    assert got == [
        dt.date(1993, 7, 5), dt.date(2000, 1, 1), dt.date(1969, 1, 1), dt.date(2068, 12, 31), dt.date(1993, 11, 7), None, None, None,
    ]


def test_birth_numbers(spark):
    df = spark.createDataFrame([("706213",), ("450204",), ("50611",), ("520229",), ("530229",)], "b string")
    gender, birth = C.decode_birth_number("b")
    rows = df.select(gender.alias("g"), birth.alias("b")).collect()
    assert [tuple(r) for r in rows] == [
        ("female", dt.date(1970, 12, 13)), ("male", dt.date(1945, 2, 4)), ("male", dt.date(1905, 6, 11)),
        ("male", dt.date(1952, 2, 29)), ("male", None),
    ]


def test_age_counts_full_years(spark):
    df = spark.createDataFrame([(dt.date(1970, 12, 31),), (dt.date(1970, 6, 16),), (dt.date(1970, 6, 15),)], "b date")
    assert values(df.select(C.age_at("b").alias("a")), "a") == [29, 29, 29]
    assert values(df.select(C.age_at("b", dt.date(2000, 6, 15)).alias("a")), "a") == [29, 29, 30]


def test_recodes_keep_or_null(spark):
    df = spark.createDataFrame([("VYBER",), ("new",), (" ",), (None,)], "t string")
    assert values(df.select(C.recode_keep("t", codes.TRANS_TYPE).alias("x")), "x") == ["withdrawal", "new", " ", None]
    orders = spark.createDataFrame([("SIPO",), ("x",), (" ",), (None,)], "t string")
    assert values(orders.select(C.recode_strict("t", codes.ORDER_SYMBOL).alias("x")), "x") == ["household", None, None, None]
    assert values(orders.select(C.recode_strict("t", codes.ORDER_SYMBOL, "unknown").alias("x")), "x") == ["household", "unknown", "unknown", "unknown"]


def test_domains_are_sorted_with_additions_last():
    assert bank.STATUS_DOMAIN == ["client in debt", "contract finished", "finished contract, loan not paid", "running contract", "none"]
    assert bank.ORDER_DOMAIN == ["household", "insurance_payment", "leasing", "loan_payment", "unknown"]


def test_sentinel_and_numeric_text(spark):
    df = spark.createDataFrame([("?", "1.5"), ("0.29", "x"), (None, "2")], "a string, b string")
    assert values(df.select(C.sentinel_to_null("a").alias("x")), "x") == [None, 0.29, None]
    assert [tuple(r) for r in C.to_numeric_coerce(df, ["b"]).orderBy("b").collect()] == [("?", 1.5), (None, 2.0)]


def test_extract_int_and_select_by_pattern(spark):
    df = spark.createDataFrame([("balance_12",), ("none",)], "n string")
    assert values(df.select(C.extract_int("n").alias("x")), "x") == [12, None]
    wide = spark.createDataFrame([(1, 2, 3, 4)], "age int, gender_male int, volume_1 int, other int")
    assert C.select_by_pattern(wide, ["gender"], {"volume": 1}, ["age"]) == ["age", "gender_male", "volume_1"]


def test_period_distance(spark):
    df = spark.createDataFrame([(dt.date(1998, 1, 31), dt.date(1996, 12, 1))], "a date, b date")
    got = df.select(C.period_diff("a", "b").alias("m"), C.period_diff("a", "b", "day").alias("d")).first()
    assert tuple(got) == (13, 426)


def test_not_contains_keeps_nulls(spark):
    df = spark.createDataFrame([("Junior plus",), ("gold",), (None,)], "t string")
    assert values(X.filter_not_contains(df, "t", "junior"), "t") == ["gold", None]


def test_min_age_drops_missing_dates(spark):
    df = spark.createDataFrame(
        [(1, dt.date(1999, 1, 1), dt.date(1979, 12, 2)), (2, dt.date(1999, 1, 1), dt.date(1979, 12, 3)), (3, None, dt.date(1950, 1, 1))],
        "k int, issued date, birth date",
    )
    assert values(X.min_age_at_event(df, "issued", "birth"), "k") == [1]


def test_filter_year_is_a_range(spark):
    df = spark.createDataFrame([(dt.date(1994, 12, 31),), (dt.date(1995, 1, 1),), (dt.date(1995, 12, 31),), (dt.date(1996, 1, 1),)], "d date")
    assert X.filter_year(df, "d", 1995).count() == 2


def test_days_since_min_and_flags(spark):
    df = spark.createDataFrame([(1, dt.date(1993, 1, 1), None), (2, dt.date(1993, 1, 31), 5)], "k int, d date, c int")
    assert values(C.days_since_min(df, "d").orderBy("k"), "d") == [0, 30]
    assert values(df.select("k", C.complete_row_flag(["d", "c"]).alias("f")).orderBy("k"), "f") == [False, True]


def test_signed_amount(spark):
    df = spark.createDataFrame([(5.0, "withdrawal"), (5.0, "credit"), (5.0, None)], "a double, t string")
    assert values(df.select(C.signed_amount("a", "t").alias("x")), "x") == [-5.0, 5.0, 5.0]


def test_district_imputation_uses_complete_rows(spark):
    names = ", ".join(f"{a} {'string' if a in ('A2', 'A3', 'A12', 'A15') else 'double'}" for a in codes.DISTRICT_COLUMNS)

    def row(i, a12, a15):
        return (float(i), f"d{i}", "r", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, a12, float(i), 1.0, a15, float(10 * i))

    df = spark.createDataFrame([row(1, "3", "25"), row(2, "5", "45"), row(3, "?", "?"), row(4, "9", "85")], names)
    got = {r["district_id"]: (r["unemploy_rate95"], r["no_of_crimes95"]) for r in bank.clean_district(df).collect()}
    assert abs(got[3.0][0] - 7) < 1e-9 and abs(got[3.0][1] - 65) < 1e-9
    assert got[1.0] == (3.0, 25.0)
