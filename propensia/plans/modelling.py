"""From the modelling set to ranked leads and the assessed best model."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from propensia.functions import codes
from propensia.functions.clean import columns_by_type, drop_columns, select_by_pattern
from propensia.operators import evaluation as E, features as R, models as M, sampling as V
from propensia.operators.neighbors import knn_impute
from propensia.operators.preprocess import Preprocessor
from propensia.operators.quality import join_cardinality
from propensia.plans import bank
from propensia.session import stage
from propensia.sources.artifacts import ArtifactStore, fingerprint

NOT_FEATURES = ("label", "account_id", "district_id_client")


@dataclass
class TrainTest:
    """Model-ready rows: balanced, scaled training rows with folds, and untouched hold-out rows."""

    train: DataFrame
    test: DataFrame
    features: list[str]
    key: str = "account_id"
    label: str = "label"


def feature_rows(modelling: DataFrame, domains: Mapping[str, Sequence[str]]) -> tuple[DataFrame, list[str]]:
    """Modelling set with indicators, and the names of its base features (window statistics come after balancing)."""
    rows = bank.encode(modelling, domains)
    numeric = [c for c in columns_by_type(rows)[0] if c not in NOT_FEATURES]
    rows = drop_columns(rows, ["district_id_client"])
    return rows.withColumns({c: F.col(c).cast("double") for c in numeric}), numeric


def baseline_features(rows: DataFrame, horizon: int = codes.HORIZON) -> list[str]:
    """Age, gender, client region, and the volume and balance windows."""
    return select_by_pattern(rows, ["gender", "region_client"], {"volume": horizon, "balance": horizon}, ["age"])


def prepare_train_test(
    rows: DataFrame, features: Sequence[str], key: str = "account_id", label: str = "label",
    test_share: float = 0.1, folds: int = 10, neighbours: int = 5, reference_order: bool = False,
    derive: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> TrainTest:
    """Split, impute, balance on the base features, derive features of all rows, scale.

    ``derive`` adds columns computed from a row's own base features, so synthetic rows get theirs from their own
    values. By default everything is fitted on training rows only and applied to the hold-out rows.
    ``reference_order`` balances, derives, imputes and scales all rows before the split, which lets hold-out
    rows influence the fit.
    """
    rows, base = stage(rows.select(key, label, *features), "rows"), list(features)
    features = [c for c in derive(rows).columns if c not in (key, label)]
    if reference_order:
        balanced = stage(derive(V.smote(rows, key, label, base, neighbours)), "rows")
        scaled = R.standard_scale(stage(_impute(balanced, key, features, neighbours, balanced), "rows"), features)
        split = stage(V.stratified_holdout(scaled, key, label, test_share), "rows")
        train, test = split.filter(~F.col("is_test")), split.filter("is_test")
    else:
        split = stage(V.stratified_holdout(rows, key, label, test_share), "rows")
        train, test = split.filter(~F.col("is_test")), split.filter("is_test")
        filled = stage(_impute(train, key, base, neighbours, train), "rows")
        test = derive(_impute(test, key, base, neighbours, train))
        train = stage(derive(V.smote(filled, key, label, base, neighbours)), "rows")
        scale = R.fit_standard_scale(train, features)
        train, test = R.apply_standard_scale(train, scale), R.apply_standard_scale(test, scale)
    train = V.stratified_folds(stage(train, "train"), key, label, folds)
    return TrainTest(stage(train, "train"), stage(test, "test"), list(features), key, label)


def _impute(rows: DataFrame, key: str, features: Sequence[str], k: int, donors: DataFrame) -> DataFrame:
    """Neighbour imputation, skipped when nothing is missing."""
    gap = F.lit(False)
    for c in features:
        gap = gap | F.col(c).isNull()
    return rows if rows.filter(gap).isEmpty() else knn_impute(rows, key, features, k, donors)


def compare_models(data: TrainTest, specs: Sequence[M.ModelSpec], folds: int = 10, store: ArtifactStore | None = None) -> list[M.Evaluated]:
    """Grid search and out-of-fold scores of every model on the training rows.

    Medians, means, deviations and categories are fitted anew on the training folds of every fold and once more for the
    refitted model. With a ``store``, fits are looked up by the fingerprint of the rows and the parameters, and only
    missing ones are made.
    """
    out = []
    for spec in specs:
        names = spec.features or data.features
        path = None
        if store:
            grid = [sorted((p.name, v) for p, v in point.items()) for point in spec.grid]
            settings = sorted((p.name, repr(v)) for p, v in spec.estimator.extractParamMap().items())
            path = store.grid_path(f"{spec.name}-{fingerprint(data.train.select(data.key, data.label, 'fold', *names), grid, settings, folds)}")
        out.append(M.grid_search_cv(
            data.train, spec, data.key, data.features, folds, label=data.label, preprocess=Preprocessor(numericCols=list(names)), path=path,
        ))
    return out


def leads(data: TrainTest, results: Sequence[M.Evaluated]) -> DataFrame:
    """Scored hold-out rows of every model in one long frame, under their real keys."""
    out = None
    for done in results:
        part = done.scored(data.test, [data.key, data.label]).withColumn("model", F.lit(done.name))
        out = part if out is None else out.unionByName(part)
    return out


def assess(scored: DataFrame, model: str, label: str = "label") -> dict[str, DataFrame]:
    """Confusion matrix, metrics, curve and area of one model's hold-out scores."""
    one = scored.filter(F.col("model") == model)
    return {
        "confusion": E.confusion_matrix(one, label),
        "metrics": E.binary_metrics(one, label),
        "roc_curve": E.roc_curve(one, label),
        "roc_auc": E.roc_auc(one, label),
    }


def affinity_run(
    raw: Mapping[str, DataFrame], domains: Mapping[str, Sequence[str]], unit: str = "month",
    horizon: int = codes.HORIZON, folds: int = 10, specs=None, list_sizes: Sequence[int] = (10, 20),
    min_age_days: int = codes.MIN_AGE_DAYS, draw=None, reference_order: bool = False, store: str | None = None,
) -> dict[str, object]:
    """Raw tables to leads: every report of the analysis as a DataFrame.

    ``specs(n, key, baseline)`` lists the models (default: all of them with full grids). ``reference_order`` is passed
    to ``prepare_train_test``. ``store`` names a folder on shared storage that keeps fitted models and their scores: a second
    run on the same rows and settings fits nothing. A repeated key in a table of the star raises a DataQualityError.
    """
    t = bank.prepare(raw, unit)
    holders = bank.without_junior(bank.card_status(t))
    dates = stage(bank.event_dates(holders, draw), "dates")
    windows = stage(bank.affinity_windows(bank.monthly_ledger(t["trans"], unit), dates, unit, horizon), "windows")
    master = stage(bank.master_record(t), "master")
    join_cardinality(master, "account_id", strict=True)  # a repeated key of any joined table repeats accounts
    rows, features = feature_rows(bank.modelling_set(bank.without_junior(master), windows, min_age_days), domains)
    data = prepare_train_test(rows, features, folds=folds, reference_order=reference_order, derive=R.window_features)
    models = (specs or M.model_list)(data.train.count(), data.key, baseline_features(data.train, horizon))
    results = compare_models(data, models, folds, ArtifactStore(data.train.sparkSession, store) if store else None)
    scored = stage(leads(data, results), "leads")
    best = M.pick_best(results)
    return {
        "master": master, "windows": windows, "data": data, "results": results,
        "attrition": bank.attrition_steps(master, dates, windows, min_age_days),
        "grid": M.grid_frame(master.sparkSession, results),
        "benchmark": M.benchmark(results),
        "leads": E.lead_list(scored),
        "overlap": E.list_comparison(scored, [r.name for r in results], data.key, list_sizes),
        "best": best.name,
        "assessment": assess(scored, best.name),
    }
