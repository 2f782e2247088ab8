"""What the plans must not contain, and one run from raw tables to leads."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks import bindings as B
from propensia.operators import explain as X, features as R, ledger as L, models as M, sampling as V
from propensia.plans import bank, modelling
from propensia.session import stage_by_key

SF = "/root/testdata/sf0.001"
NO_PYTHON = [n for n in entry.queries() if re.match(r"(a|g|j|f|p|q)\d|r[1-8]_", n)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NO_PYTHON)
def test_relational_plans_stay_in_the_jvm_and_avoid_pair_joins(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    for bad in ("Python", "InPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in text, bad


def test_raw_ledger_is_shuffled_only_after_partial_sums(spark):
    text = plan(L.running_balance(L.period_ledger(B.supplier_entries(spark, SF))))
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)
    assert len(exchanges) == 2
    below_last = text.rsplit("Exchange hashpartitioning", 1)[1]
    assert "partial_sum" in below_last  # rows are combined before they leave a task


def test_window_rollup_adds_no_exchange_on_the_ledger(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ledger = B.ledger(spark, SF)
        before = plan(ledger).count("Exchange hashpartitioning")
        dates = B.buyer_dates(spark, SF)
        text = plan(L.event_rollup(ledger, dates, unit="day"))
        assert text.count("Exchange hashpartitioning") <= before + plan(dates).count("Exchange hashpartitioning")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(B.entries(spark, SF).filter("account_id = 5").select("account_id", "amount"))
    assert "EqualTo(user_id,5)" in text
    assert "ReadSchema: struct<user_id:bigint,event_type:string,value:double>" in text


def test_top_lists_are_cut_before_their_shuffle(spark):
    assert plan(entry.queries()["g5_top_n_per_model"](spark, SF)).count("WindowGroupLimit") == 2


def test_folds_and_scaling_move_no_rows(spark):
    rows = B.vectors(spark, SF)
    assert "Exchange" not in plan(V.stratified_folds(rows, "vec_id", "label", 5))
    assert "Exchange" not in plan(V.stratified_holdout(rows, "vec_id", "label"))
    assert "Exchange" not in plan(R.standard_scale(rows, B.FEATURES[:3]))


def test_a_stored_ledger_is_rolled_up_without_an_exchange(spark):
    monthly = L.period_ledger(B.supplier_entries(spark, SF))
    dates = B.supplier_dates(spark, SF)
    ledger, events = stage_by_key(monthly, "account_id", "period", buckets=4), stage_by_key(dates, "account_id", buckets=4)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for rolled in (L.event_rollup, L.event_rollup_long):
            got = rolled(L.running_balance(ledger), events)
            assert "Exchange" not in plan(got)
            assert sorted(map(str, got.collect())) == sorted(map(str, rolled(L.running_balance(monthly), dates).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_walks_are_scored_and_differenced_on_one_exchange(spark):
    rows = B.vectors(spark, SF)
    mean = lambda df: df.withColumn("p", F.aggregate("vec", F.lit(0.0), lambda a, v: a + v))
    text = plan(X.shap_values(mean, rows, X.background_sample(rows, "vec_id", 5), "vec_id", B.FEATURES[:4], 3))
    assert text.split("Subquery")[0].count("Exchange hashpartitioning") <= 2  # the walks, and the sums per feature


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["account_id", "issued", "has_card"] and len(df.columns) == 3 + 65
    assert df.count() >= 0


def test_master_has_one_row_per_owner_and_all_columns(spark):
    m = B.master(spark, SF)
    assert len(m.columns) == 56
    assert m.count() == B.table(spark, SF, "customer").filter("c_acctbal >= 0").count()


def test_run_from_raw_tables_to_leads(spark):
    sf = "/root/testdata/sf0.01"
    names = [r[0] for r in B.table(spark, sf, "nation").select("n_name").collect()]
    regions = [r[0] for r in B.table(spark, sf, "region").select("r_name").collect()]
    domains = bank.indicator_domains(regions, names)
    domains["frequency"] = ["monthly", "transactional", "weekly", "AUTOMOBILE", "HOUSEHOLD"]

    def specs(n, key, baseline):
        return [M.logistic_l2(n, (0.1,), 5, "baseline_logistic", baseline[:6]), M.decision_tree((3,), (2,))]

    out = modelling.affinity_run(
        B.raw_bank(spark, sf), domains, unit="day", folds=2, specs=specs, list_sizes=(2,), draw=B.draw, min_age_days=6970
    )
    steps = {r["step"]: r["delta"] for r in out["attrition"].collect()}
    assert sum(v for k, v in steps.items() if k != "Final") == steps["Final"]
    data = out["data"]
    assert data.train.filter("not synthetic").count() + data.test.count() == steps["Final"]
    sizes = {r["label"]: r["count"] for r in data.train.groupBy("label").count().collect()}
    assert sizes[0] == sizes[1]
    assert out["benchmark"].count() == 2 and out["best"] in ("baseline_logistic", "decision_tree")
    leads = out["leads"].collect()
    assert len(leads) == 2 * data.test.count() and min(r["rank"] for r in leads) == 1
    assert out["overlap"].count() == 4
    assert {"confusion", "metrics", "roc_curve", "roc_auc"} == set(out["assessment"])
    before_split = modelling.prepare_train_test(
        data.train.select("account_id", "label", *data.features[:5]), data.features[:5], folds=2, reference_order=True
    )
    assert before_split.train.filter("fold is null").isEmpty()


def test_balancing_sees_base_features_only_and_synthetic_rows_get_their_own_statistics(spark):
    cells = [f"{m}_{k}" for m in R.FEATURE_MEASURES for k in range(1, 14)]
    rows = spark.range(80).select(
        F.col("id").alias("account_id"), F.when(F.col("id") < 20, 1).otherwise(0).alias("label"),
        *[(F.pmod(F.xxhash64("id", F.lit(c)), F.lit(1000)) / 10.0).alias(c) for c in cells],
    )
    seen = []

    def derive(df):
        out = R.window_features(df)
        seen.append((df.columns, out))
        return out

    for order in (False, True):
        seen.clear()
        data = modelling.prepare_train_test(rows, cells, folds=2, reference_order=order, derive=derive)
        assert not any("balance_mean" in columns for columns, _ in seen) and "balance_mean" in data.features
        made = [df.filter("synthetic") for columns, df in seen if "synthetic" in columns]
        assert made and not made[0].isEmpty() and not data.train.filter("synthetic").isEmpty()
        own = F.array(*[F.col(f"balance_{k}") for k in range(1, R.FEATURE_PERIODS + 1)])
        mean = F.aggregate(own, F.lit(0.0), lambda a, x: a + x) / R.FEATURE_PERIODS
        off = (F.col("balance_min") != F.array_min(own)) | (F.col("balance_max") != F.array_max(own)) | (F.abs(F.col("balance_mean") - mean) > 1e-9)
        assert made[0].filter(off).isEmpty()


def test_a_large_amount_is_read(spark, tmp_path):
    from propensia.sources.schemas import ORDER, narrow_money
    from propensia.sources.tables import csv_scan

    (tmp_path / "order.csv").write_text('"order_id";"account_id";"bank_to";"account_to";"amount";"k_symbol"\n1;2;"AB";3;2500000.00;"X"\n')
    assert str(csv_scan(spark, str(tmp_path / "order.csv"), ORDER).first()["amount"]) == "2500000.00"
    assert narrow_money(ORDER)["amount"].dataType.precision == 8


def test_one_row_cannot_be_balanced(spark):
    rows = spark.range(40).select("id", (F.col("id") == 7).cast("int").alias("label"), F.rand(1).alias("x"))
    with pytest.raises(ValueError):
        V.smote(rows, "id", "label", ["x"])
