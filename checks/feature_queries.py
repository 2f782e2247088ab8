"""Features, sampling, neighbours and evaluation of given scores (inventory R, V, E)."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from checks import bindings as B
from checks.registry import ORACLE, plain, query, r6, rounded, s6
from propensia.functions import codes
from propensia.operators import aggregates as A, evaluation as E, features as R, neighbors as N, sampling as V
from propensia.operators.lsh import lsh_knn_join, projections
from propensia.operators.preprocess import Preprocessor, prepared_folds
from propensia.plans import bank

sql = B.sql

# ---- R -----------------------------------------------------------------------------------


def _feature_sql(m):
    c = [f"{m}_{k}" for k in range(1, 13)]
    mean = f"(list_sum([{', '.join(c)}]) / 12)"
    out = [
        s6(mean, f"{m}_mean"), f"cast(least({', '.join(c)}) as double) as {m}_min", f"cast(greatest({', '.join(c)}) as double) as {m}_max",
        s6("(" + " + ".join(f"abs({x} - {mean})" for x in c) + ") / 12", f"{m}_mad"),
        f"round((({' + '.join(c[9:])}) / 3) / (({' + '.join(c[:3])}) / 3 + 1e-7), 4) + 0.0 as {m}_mean_ratio_last3_first3",
    ]
    if m in ("credit", "withdrawal"):
        out.append(s6(" + ".join(c), f"{m}_sum", 2))
    if m in ("balance", "credit"):
        out.append(s6("sqrt((" + " + ".join(f"pow({x} - {mean}, 2)" for x in c) + ") / 11)", f"{m}_std"))
    return ", ".join(out)


_ENGINEERED = [
    f"{m}_{s}" for m in R.FEATURE_MEASURES for s in ("mean", "min", "max", "mad", "mean_ratio_last3_first3")
] + ["credit_sum", "withdrawal_sum", "balance_std", "credit_std"]


def _round_features(df):
    sums = ["credit_sum", "withdrawal_sum"]
    ratios = [c for c in _ENGINEERED if c.endswith("first3")]
    exact = [c for c in _ENGINEERED if c.endswith(("_min", "_max"))]
    rest = [c for c in _ENGINEERED if c not in sums + ratios + exact]
    return rounded(rounded(rounded(df, *rest), *ratios, places=4), *sums, places=2)


@query("r1_window_features", sql("select account_id, " + ", ".join(_feature_sql(m) for m in R.FEATURE_MEASURES) + " from buyer_rolled"))
def r1(spark, sf):
    from propensia.operators import ledger as L

    wide = plain(L.event_rollup(B.ledger(spark, sf), B.buyer_dates(spark, sf), unit="day"))
    return _round_features(R.window_features(wide).select("account_id", *_ENGINEERED))


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _quoted(names):
    return ", ".join(f'"{n}"' for n in names)


_STATUS_CASES = ", ".join(
    f"case when coalesce(l.status, 'none') = '{v}' then 1 else 0 end as \"status_{v}\"" for v in bank.STATUS_DOMAIN[1:]
)


@query("r2_one_hot_drop_first", sql(f"select disp_id, {_STATUS_CASES}, case when d.type = 'OWNER' then 1 else 0 end as type_OWNER from raw_disp d left join c_loan l on l.account_id = d.account_id"))
def r2(spark, sf):
    loans = bank.clean_loan(B.raw_loan(spark, sf)).select("account_id", "status")
    rows = B.raw_disp(spark, sf).select("disp_id", "account_id", "type").join(loans, "account_id", "left").fillna("none", ["status"])
    return R.one_hot_drop_first(rows.drop("account_id"), {"status": bank.STATUS_DOMAIN, "type": ["DISPONENT", "OWNER"]})


_R3_KEEP = [c for c in (
    ["account_id", "frequency", "date_account", "district_id_client", "gender", "age", "amount", "duration", "payments", "status"]
    + bank.ORDER_DOMAIN + [f"{c}_{s}" for s in ("account", "client") for c in B._D_REST])]
_R3_IMPUTED = [f"{c}_{s}" for c in ("unemploy_rate95", "no_of_crimes95") for s in ("account", "client")]


def _r3_cell(c):
    if c == "date_account":
        return "cast(date_account - min(date_account) over () as int) as date_account"
    if c in _R3_IMPUTED:
        return s6(f"m.{c}", c)
    if c in ("payments", *bank.ORDER_DOMAIN):
        return f"cast(m.{c} as double) as {c}"
    return f"m.{c}"


@query("r3_modelling_set", sql(
    f"select {', '.join(_r3_cell(c) for c in _R3_KEEP)}, cast(w.has_card as int) as label, {B.sql_values(prefix='w.')} "
    f"from adults m join windows w on w.account_id = m.account_id where date_diff('day', m.birth_day, w.issued) >= {B.MIN_AGE}"))
def r3(spark, sf):
    rows = bank.modelling_set(B.adults(spark, sf), B.windows(spark, sf), B.MIN_AGE)
    return rounded(plain(rows), *_R3_IMPUTED)


_SCALED = ["c_acctbal", "c_nationkey"]


@query("r4_standard_scale", "select c_custkey, " + ", ".join(
    s6(f"({c} - avg({c}) over ()) / stddev_pop({c}) over ()", c) for c in _SCALED) + ", cast(0 as double) as same from customer")
def r4(spark, sf):
    rows = B.table(spark, sf, "customer").select("c_custkey", *_SCALED).withColumn("same", F.lit(3.0))
    return rounded(R.standard_scale(rows, [*_SCALED, "same"]), *_SCALED, "same")


_SEEN = ["BUILDING", "FURNITURE", "missing"]


@query("r5_one_hot_ignore", "select c_custkey, " + ", ".join(
    f"case when s = '{v}' then 1 else 0 end as segment_{v}" for v in _SEEN)
    + " from (select c_custkey, coalesce(nullif(c_mktsegment, 'MACHINERY'), 'missing') as s from customer)")
def r5(spark, sf):
    rows = B.table(spark, sf, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("segment"))
    train = rows.filter(F.col("segment").isNull() | F.col("segment").isin("BUILDING", "FURNITURE"))
    return R.one_hot_ignore(rows, R.fit_domains(train, ["segment"]))


@query("r6_median_impute", sql("select vec_id, " + ", ".join(
    f"round(coalesce({c}, median({c}) over ()), 9) + 0.0 as {c}" for c in B.GAPS) + " from gappy"))
def r6_(spark, sf):
    return rounded(R.median_impute(B.gappy_vectors(spark, sf).select("vec_id", *B.GAPS), list(B.GAPS)), *B.GAPS, places=9)


@query("r7_const_impute", "select c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'missing') as segment from customer")
def r7(spark, sf):
    rows = B.table(spark, sf, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"))
    return R.const_impute(rows, ["segment"])


@query("r8_ols_impute", sql("select district_id, " + s6("unemploy_rate95") + ", " + s6("no_of_crimes95") + " from c_district"))
def r8(spark, sf):
    return rounded(bank.clean_district(B.raw_district(spark, sf)).select("district_id", "unemploy_rate95", "no_of_crimes95"), "unemploy_rate95", "no_of_crimes95")


_GAP = list(B.GAPS)


def _nan_distance(a, b):
    """Squared nan-aware distance of two rows: gapped columns by case, the others as list distance."""
    rest = [c for c in B.FEATURES if c not in _GAP]
    full = " + ".join(f"pow({a}.{c} - {b}.{c}, 2)" for c in rest)
    part = " + ".join(f"coalesce(pow({a}.{c} - {b}.{c}, 2), 0)" for c in _GAP)
    shared = " + ".join(f"case when {a}.{c} is null or {b}.{c} is null then 0 else 1 end" for c in _GAP)
    return f"({full} + {part}) * 64.0 / ({len(rest)} + {shared})"


_KNN_IMPUTE = ", ".join(
    f"fill_{c} as (select id, avg(v) as v from (select q.vec_id as id, d.{c} as v, row_number() over (partition by q.vec_id order by {_nan_distance('q', 'd')}, d.vec_id) as r "
    f"from gappy q, gappy d where q.{c} is null and d.{c} is not null) where r <= 5 group by 1)" for c in _GAP)


def _knn_impute_sql():
    base = sql("select 1 from gappy").rsplit("\n", 1)[0]
    cells = ", ".join(f"round(coalesce(g.{c}, fill_{c}.v), 6) + 0.0 as {c}" for c in _GAP)
    joins = " ".join(f"left join fill_{c} on fill_{c}.id = g.vec_id" for c in _GAP)
    return f"{base},\n{_KNN_IMPUTE}\nselect vec_id, {cells} from gappy g {joins}"


@query("r9_knn_impute", _knn_impute_sql())
def r9(spark, sf):
    filled = N.knn_impute(B.gappy_vectors(spark, sf), "vec_id", B.FEATURES, 5)
    return rounded(filled.select("vec_id", *_GAP), *_GAP)


@query("r10_column_transform", """select c_custkey, round((b - avg(b) over ()) / stddev_pop(b) over (), 6) + 0.0 as balance,
    case when s = 'BUILDING' then 1 else 0 end as segment_BUILDING, case when s = 'FURNITURE' then 1 else 0 end as segment_FURNITURE,
    case when s = 'HOUSEHOLD' then 1 else 0 end as segment_HOUSEHOLD, case when s = 'MACHINERY' then 1 else 0 end as segment_MACHINERY,
    case when s = 'missing' then 1 else 0 end as segment_missing
    from (select c_custkey, coalesce(nullif(c_mktsegment, 'AUTOMOBILE'), 'missing') as s,
    coalesce(case when c_acctbal >= 0 then c_acctbal end, median(case when c_acctbal >= 0 then c_acctbal end) over ()) as b from customer)""")
def r10(spark, sf):
    rows = B.table(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"),
        F.nullif("c_mktsegment", F.lit("AUTOMOBILE")).alias("segment"),
    )
    return rounded(R.ColumnTransform(["balance"], ["segment"]).fit(rows).transform(rows), "balance")


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "RARE", "missing"]
_FOLDED = """select c_custkey, c_custkey % 4 as fold, case when c_acctbal >= 50 * (c_custkey % 4) then c_acctbal end as balance,
    case when c_custkey % 4 = 1 and c_mktsegment = 'MACHINERY' then 'RARE' else nullif(c_mktsegment, 'MACHINERY') end as segment from customer"""


@query("r10_column_transform_folds", f"""with r as ({_FOLDED}),
    m as (select f.fold as f, median(r.balance) as median from (select distinct fold from r) f join r on r.fold <> f.fold group by 1),
    s as (select f, avg(coalesce(balance, median)) as mean, stddev_pop(coalesce(balance, median)) as deviation from m join r on r.fold <> f group by 1),
    d as (select distinct f, coalesce(segment, 'missing') as seen from m join r on r.fold <> f)
    select c_custkey, fold, round((coalesce(balance, median) - mean) / deviation, 6) + 0.0 as balance, """ + ", ".join(
    f"cast(case when coalesce(segment, 'missing') = '{v}' and exists (select 1 from d where d.f = r.fold and seen = '{v}') then 1 else 0 end as double) as segment_{v}" for v in _SEGMENTS)
    + " from r join m on m.f = r.fold join s on s.f = r.fold")
def r10f(spark, sf):
    B.table(spark, sf, "customer").createOrReplaceTempView("customer")
    rows = spark.sql(_FOLDED).withColumn("balance", F.col("balance").cast("double"))
    parts = prepared_folds(rows, Preprocessor(numericCols=["balance"], categoricalCols=["segment"]), 4)
    out = None
    for fold, (model, _, _) in enumerate(parts):
        part = model.named(rows.filter(F.col("fold") == fold), ["c_custkey", "fold"])
        unseen = {f"segment_{v}": F.lit(0.0) for v in _SEGMENTS if f"segment_{v}" not in part.columns}
        part = part.withColumns(unseen) if unseen else part
        out = part if out is None else out.unionByName(part)
    return rounded(out, "balance")


# ---- V -----------------------------------------------------------------------------------

MODULUS = 1_000_003
_HASH = f"(vec_id * 7919 + 43) % {MODULUS}"


def _fold(rank, size, folds):
    """Number of section ends (size * f // folds) before a rank."""
    return "cast(" + " + ".join(f"case when {rank} > {size} * {f} // {folds} then 1 else 0 end" for f in range(1, folds)) + " as int)"


def _hash(key="vec_id"):
    return (F.col(key) * 7919 + 43) % MODULUS


def _smote_sql():
    base = sql("select 1 from vectors").rsplit("\n", 1)[0]
    diff = " + ".join(f"pow(a.{c} - b.{c}, 2)" for c in B.FEATURES)
    cells = ", ".join(f"round(a.{c} + u * (b.{c} - a.{c}), 6) + 0.0 as {c}" for c in B.FEATURES)
    own = ", ".join(f"round({c}, 6) + 0.0 as {c}" for c in B.FEATURES)
    return f"""{base}, small as (select *, row_number() over (order by {_HASH}, vec_id) as base from vectors where label = 1),
    near as (select a.vec_id as base_id, b.vec_id as neighbor_id, row_number() over (partition by a.vec_id order by {diff}, b.vec_id) as nth
      from small a, small b where a.vec_id <> b.vec_id qualify nth <= 5),
    draws as (select i, ((i * 7919 + 43) % (5 * n)) // 5 + 1 as base, ((i * 7919 + 43) % (5 * n)) % 5 + 1 as nth,
      cast((i * 104729 + 11) % 1000 as double) / 1000.0 as u from (select count(*) filter (label = 1) as n,
      count(*) filter (label = 0) - count(*) filter (label = 1) as need from vectors), range(1000000) t(i) where i < need)
    select -(i + 1) as vec_id, 1 as label, true as synthetic, {cells} from draws d join small a on a.base = d.base
      join near n on n.base_id = a.vec_id and n.nth = d.nth join vectors b on b.vec_id = n.neighbor_id
    union all select vec_id, label, false, {own} from vectors"""


@query("v1_smote", _smote_sql())
def v1(spark, sf):
    made = V.smote(
        B.vectors(spark, sf), "vec_id", "label", B.FEATURES, rank_hash=_hash("id"), modulus=MODULUS,
        draw=lambda i, n: (i * 7919 + 43) % n, step=lambda i: ((i * 104729 + 11) % 1000) / 1000.0,
    )
    return rounded(made, *B.FEATURES)


@query("v2_class_balance", sql("select label, count(*) as count from vectors group by 1"))
def v2(spark, sf):
    return V.class_balance(B.vectors(spark, sf), "label")


@query("v3_stratified_holdout", sql(f"""select vec_id, label, row_number() over (partition by label order by {_HASH}, vec_id)
    <= ceil(0.1 * count(*) over (partition by label)) as is_test from vectors"""))
def v3(spark, sf):
    rows = B.vectors(spark, sf).select("vec_id", "label")
    return V.stratified_holdout(rows, "vec_id", "label", hash_value=_hash(), modulus=MODULUS)


@query("v4_stratified_folds", sql(f"""select vec_id, label, {_fold('row_number() over (partition by label order by ' + _HASH + ', vec_id)', 'count(*) over (partition by label)', 10)} as fold from vectors"""))
def v4(spark, sf):
    rows = B.vectors(spark, sf).select("vec_id", "label")
    return V.stratified_folds(rows, "vec_id", "label", hash_value=_hash(), modulus=MODULUS)


def _knn_sql(k, weights):
    base = sql("select 1 from vectors").rsplit("\n", 1)[0]
    diff = " + ".join(f"pow(a.{c} - b.{c}, 2)" for c in B.FEATURES)
    vote = "avg(label)" if weights == "uniform" else "coalesce(avg(case when d = 0 then label end), sum(label / d) / sum(1 / d))"
    return f"""{base}, parts as (select *, row_number() over (partition by label order by {_HASH}, vec_id) <= ceil(0.1 * count(*) over (partition by label)) as is_test from vectors),
    near as (select a.vec_id, b.label, sqrt({diff}) as d, row_number() over (partition by a.vec_id order by {diff}, b.vec_id) as r
      from parts a, parts b where a.is_test and not b.is_test qualify r <= {k}),
    votes as (select vec_id, {vote} as p from near group by 1)
    select vec_id, round(p, 6) + 0.0 as probability, cast(case when p > 0.5 then 1 else 0 end as double) as prediction from votes"""


def _knn(spark, sf, k, weights, join=None):
    rows = V.stratified_holdout(B.vectors(spark, sf), "vec_id", "label", hash_value=_hash(), modulus=MODULUS)
    votes = N.knn_classify(rows.filter("is_test"), rows.filter("not is_test"), B.FEATURES, "vec_id", "label", k, weights, join)
    return rounded(votes, "probability")


@query("v6_knn_classify", _knn_sql(5, "uniform"))
def v6(spark, sf):
    return _knn(spark, sf, 5, "uniform")


@query("v6_knn_classify_distance", _knn_sql(3, "distance"))
def v6d(spark, sf):
    return _knn(spark, sf, 3, "distance")


_TABLES, _FUNCTIONS, _WIDTH = 4, 4, 0.4


def _lsh_sql(k):
    """Candidates share all floors of a table's projections; rows that meet fewer than k take all donors."""
    coefficients = projections(len(B.FEATURES), _TABLES, _FUNCTIONS)
    floors = lambda t: ", ".join(f"floor(list_inner_product(e, {f[:-1].tolist()}) / {_WIDTH} + {f[-1]})" for f in coefficients[t])
    own = ", ".join(f"[{floors(t)}] as t{t}" for t in range(_TABLES))
    meets = " or ".join(f"a.t{t} = b.t{t}" for t in range(_TABLES))
    return f"""{sql("select 1 from vectors").rsplit(chr(10), 1)[0]}, lists as (select vec_id, label, [{', '.join(B.FEATURES)}] as e,
      row_number() over (partition by label order by {_HASH}, vec_id) <= ceil(0.1 * count(*) over (partition by label)) as is_test from vectors),
    keyed as materialized (select *, {own} from lists),
    pairs as materialized (select a.vec_id, b.vec_id as other, b.label, list_distance(a.e, b.e) as d, ({meets}) as met from keyed a join keyed b on a.is_test and not b.is_test),
    counted as (select vec_id, count(*) filter (met) >= {k} as enough from pairs group by 1),
    near as (select vec_id, label from pairs join counted using (vec_id) where met or not enough qualify row_number() over (partition by vec_id order by d, other) <= {k}),
    votes as (select vec_id, avg(label) as p from near group by 1)
    select vec_id, round(p, 6) + 0.0 as probability, cast(case when p > 0.5 then 1 else 0 end as double) as prediction from votes"""


@query("v6_knn_classify_hashed", _lsh_sql(5))
def v6h(spark, sf):
    return _knn(spark, sf, 5, "uniform", partial(lsh_knn_join, tables=_TABLES, functions=_FUNCTIONS, width=_WIDTH))


# ---- E -----------------------------------------------------------------------------------


def _scored(spark, sf):
    """Scores with the prediction a threshold of one half gives."""
    return B.scores(spark, sf).withColumn("prediction", (F.col("probability") > 0.5).cast("double"))


_CELLS = """select model, cast(count(*) filter (y and p) as double) as tp, cast(count(*) filter (not y and p) as double) as fp,
    cast(count(*) filter (y and not p) as double) as fn, cast(count(*) filter (not y and not p) as double) as tn
    from (select *, label = 1 as y, probability > 0.5 as p from {src}) group by {by}"""
_METRIC_SQL = {
    "accuracy": "(tp + tn) / (tp + fp + fn + tn)",
    "precision": "case when tp + fp = 0 then 0 else tp / (tp + fp) end",
    "recall": "case when tp + fn = 0 then 0 else tp / (tp + fn) end",
    "f1": "case when 2 * tp + fp + fn = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end",
    "kappa": "((tp + tn) / (tp + fp + fn + tn) - pe) / (1 - pe)",
    "mcc": "coalesce((tp * tn - fp * fn) / nullif(sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn), 0), 0)",
}
_PE = "((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / pow(tp + fp + fn + tn, 2)"


def _metric_cells():
    return ", ".join(s6(f"({e})", m) for m, e in _METRIC_SQL.items())


@query("e1_confusion_matrix", sql("""select m.model, a.v as actual, p.v as predicted, count(s.doc_id) as count from (select distinct model from scores) m,
    (values (0), (1)) a(v), (values (0), (1)) p(v) left join scores s on s.model = m.model and s.label = a.v and (s.probability > 0.5) = (p.v = 1) group by all"""))
def e1(spark, sf):
    return E.confusion_matrix(_scored(spark, sf), group=["model"])


@query("e2_binary_metrics", sql(f"select model, {_metric_cells()} from (select *, {_PE} as pe from ({_CELLS.format(src='scores', by='model')}))"))
def e2(spark, sf):
    return rounded(E.binary_metrics(_scored(spark, sf), group=["model"]), *_METRIC_SQL)


@query("e3_roc_curve", sql("""select model, """ + s6("fp / n", "fpr") + ", " + s6("tp / p", "tpr") + """, threshold from (
    select model, probability as threshold, cast(sum(neg) over w as double) as fp, cast(sum(pos) over w as double) as tp,
      cast(sum(neg) over (partition by model) as double) as n, cast(sum(pos) over (partition by model) as double) as p
    from (select model, probability, count(*) filter (label = 1) as pos, count(*) filter (label = 0) as neg from scores group by 1, 2)
    window w as (partition by model order by probability desc rows unbounded preceding))
    union all select distinct model, cast(0 as double), cast(0 as double), cast('inf' as double) from scores"""))
def e3(spark, sf):
    return rounded(E.roc_curve(_scored(spark, sf), group=["model"]), "fpr", "tpr")


_AUC = """select {by}, (sum(case when label = 1 then r end) - n1 * (n1 + 1) / 2.0) / (n1 * n0) as roc_auc from (
    select *, rank() over w + (count(*) over t - 1) / 2.0 as r, cast(sum(label) over g as double) as n1, cast(sum(1 - label) over g as double) as n0
    from {src} window w as (partition by {by} order by probability), t as (partition by {by}, probability), g as (partition by {by})) group by {by}, n1, n0"""


@query("e4_roc_auc", sql("select model, " + s6("roc_auc") + " from (" + _AUC.format(by="model", src="scores") + ")"))
def e4(spark, sf):
    return rounded(E.roc_auc(_scored(spark, sf), group=["model"]), "roc_auc")


_FOLD = f"(select *, {_fold('row_number() over (partition by model, label order by (doc_id * 7919 + 43) % 1000003, doc_id)', 'count(*) over (partition by model, label)', 3)} as fold from scores)"
_ORDER = ["roc_auc", "precision", "recall", "accuracy", "f1", "kappa", "mcc"]


def _cv_sql(select):
    return sql(f"""select {select} from (select c.*, {_PE} as pe, u.roc_auc from ({_CELLS.format(src=_FOLD, by='model, fold').replace('select model,', 'select model, fold,', 1)}) c
    join ({_AUC.format(by='model, fold', src=_FOLD)}) u using (model, fold))""")


def _oof(spark, sf):
    """The fold depends on key and class alone, so it is assigned once for all models."""
    base = B.table(spark, sf, "labels").select("doc_id", F.col("quality").cast("int").alias("label"))
    docs = base.join(B.table(spark, sf, "documents").select("doc_id"), "doc_id")
    folds = V.stratified_folds(docs, "doc_id", "label", 3, hash_value=_hash("doc_id"), modulus=MODULUS)
    return _scored(spark, sf).join(folds.select("doc_id", "fold"), "doc_id")


_MEAN_SQL = "model, " + ", ".join(s6(f"avg({_METRIC_SQL.get(m, m)})", m) for m in _ORDER)


@query("e5_cv_metrics", _cv_sql(_MEAN_SQL) + " group by model")
def e5(spark, sf):
    return rounded(E.cv_metrics(_oof(spark, sf)), *_ORDER)


@query("e5_cv_metrics_per_fold", _cv_sql("model, fold, " + ", ".join(s6(f"({_METRIC_SQL.get(m, m)})", m) for m in _ORDER)))
def e5f(spark, sf):
    return rounded(E.cv_metrics(_oof(spark, sf), per_fold=True), *_ORDER)


_BENCH_SQL = f"(select model, {', '.join(f'{e} as {m}' for m, e in _METRIC_SQL.items())}, roc_auc from (select *, {_PE} as pe from ({_CELLS.format(src='scores', by='model')})) join ({_AUC.format(by='model', src='scores')}) using (model))"


def _benchmark(spark, sf):
    s = _scored(spark, sf)
    parts = []
    for models in (["m1"], ["m2", "m3"]):
        one = s.filter(F.col("model").isin(models))
        wide = E.binary_metrics(one, group=["model"]).join(E.roc_auc(one, group=["model"]), "model")
        parts.append(E.metrics_long(wide))
    return E.benchmark_table(parts)


@query("e6_benchmark_table", sql("select model, " + ", ".join(s6(m) for m in _ORDER) + " from " + _BENCH_SQL))
def e6(spark, sf):
    return rounded(_benchmark(spark, sf), *_ORDER)


@query("e7_weighted_best", sql("select model, " + s6("0.25 * roc_auc + 0.25 * precision + 0.25 * recall + 0.25 * f1", "weighted_score") + f" from {_BENCH_SQL} order by 2 desc, 1 limit 1"))
def e7(spark, sf):
    return rounded(E.weighted_best(_benchmark(spark, sf)), "weighted_score")


@query("e8_lead_list", sql("select model, probability, doc_id, label, rank() over (partition by model order by probability desc) as rank from scores"))
def e8(spark, sf):
    return E.lead_list(B.scores(spark, sf))


@query("e8_lead_histogram_all_models", sql("""select model, bin, """ + s6("mn + bin * w", "low") + ", " + s6("mn + (bin + 1) * w", "high") + """, count(*) as count from
    (select model, least(cast(floor((probability - mn) / w) as bigint), 19) as bin, mn, w from
      (select model, probability, min(probability) over m as mn, (max(probability) over m - min(probability) over m) / cast(20 as double) as w from
        (select * from scores qualify row_number() over (partition by model order by probability desc, doc_id) <= 100) window m as (partition by model))) group by model, bin, mn, w"""))
def e8ha(spark, sf):
    scored, out = B.scores(spark, sf), None
    for model in ("m1", "m2", "m3"):
        part = E.lead_histogram(scored.filter(F.col("model") == model), "doc_id").withColumn("model", F.lit(model))
        out = part if out is None else out.unionByName(part)
    return rounded(out, "low", "high")


@query("e8_lead_histogram", sql("""select bin, """ + s6("mn + bin * w", "low") + ", " + s6("mn + (bin + 1) * w", "high") + """, count(*) as count from
    (select least(cast(floor((probability - mn) / w) as bigint), 19) as bin, mn, w from
      (select probability, min(probability) over () as mn, (max(probability) over () - min(probability) over ()) / cast(20 as double) as w from
        (select * from scores where model = 'm1' order by probability desc, doc_id limit 100))) group by bin, mn, w"""))
def e8h(spark, sf):
    one = B.scores(spark, sf).filter("model = 'm1'")
    return rounded(E.lead_histogram(one, "doc_id"), "low", "high")


from checks.core_queries import _overlap_sql  # noqa: E402


@query("e9_list_comparison", f"select *, 10 as n from ({_overlap_sql(10)}) union all select *, 20 as n from ({_overlap_sql(20)})")
def e9(spark, sf):
    return E.list_comparison(B.scores(spark, sf), B.MODELS, "doc_id")
