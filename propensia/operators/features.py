"""Features: window statistics, indicators, scaling and imputation.

``fit_*`` functions read a frame once and return a few numbers per column; the matching ``apply_*``
puts them into expressions, so a fit on training rows applies unchanged to any other rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from propensia.functions.codes import FEATURE_PERIODS, RATIO_EPSILON
from propensia.operators.ranking import exact_quantiles

FEATURE_MEASURES = ("balance", "credit", "n_transactions", "withdrawal")
_WITH_SUM = ("credit", "withdrawal")
_WITH_STD = ("balance", "credit")


def _row_sum(cells: Sequence[str]) -> str:
    """Sum over expressions of a row, nulls skipped."""
    return "(" + " + ".join(f"coalesce({c}, 0D)" for c in cells) + ")"


def _row_count(cells: Sequence[str]) -> str:
    return "(" + " + ".join(f"if({c} is null, 0, 1)" for c in cells) + ")"


def _row_mean(cells: Sequence[str]) -> str:
    return f"try_divide({_row_sum(cells)}, {_row_count(cells)})"


def window_features(df: DataFrame, measures: Sequence[str] = FEATURE_MEASURES, periods: int = FEATURE_PERIODS) -> DataFrame:
    """Add the per-measure statistics of the wide columns ``measure_1..measure_periods``.

    Plain row arithmetic: no shuffle, and synthetic rows get theirs from their own columns.
    """
    means, out = {}, {}
    for m in measures:
        cells = [f"cast({m}_{k} as double)" for k in range(1, periods + 1)]
        listed, count = ", ".join(cells), _row_count(cells)
        means[f"{m}_mean"] = F.expr(_row_mean(cells))
        out[f"{m}_min"] = F.expr(f"least({listed})")
        out[f"{m}_max"] = F.expr(f"greatest({listed})")
        out[f"{m}_mad"] = F.expr(_row_mean([f"abs({c} - {m}_mean)" for c in cells]))
        out[f"{m}_mean_ratio_last3_first3"] = F.expr(
            f"try_divide({_row_mean(cells[-3:])}, {_row_mean(cells[:3])} + {RATIO_EPSILON!r}D)"
        )
        if m in _WITH_SUM:
            out[f"{m}_sum"] = F.expr(_row_sum(cells))
        if m in _WITH_STD:
            squares = _row_sum([f"({c} - {m}_mean) * ({c} - {m}_mean)" for c in cells])
            out[f"{m}_std"] = F.expr(f"sqrt(try_divide({squares}, nullif({count} - 1, 0)))")
    return df.withColumns(means).withColumns(out)


def melt_windows(df: DataFrame, key: str, measure: str, horizon: int) -> DataFrame:
    """``measure_1..measure_n`` columns to (key, month, value) rows."""
    names = [f"{measure}_{k}" for k in range(1, horizon + 1)]
    long = df.select(key, *names).unpivot([key], names, "name", "value")
    return long.select(key, F.regexp_extract("name", r"(\d+)", 1).cast("int").alias("month"), "value").orderBy(key, "month")


# ---- indicators --------------------------------------------------------------------------

def indicator_name(name: str, value: str) -> str:
    """Column of one category value; dots would read as struct access."""
    return f"{name}_{value}".replace(".", "_")


def one_hot_drop_first(df: DataFrame, domains: Mapping[str, Sequence[str]]) -> DataFrame:
    """Replace category columns by 0/1 columns ``name_value`` for every domain value but the first."""
    cells = {
        indicator_name(name, v): F.coalesce((F.col(name) == v).cast("int"), F.lit(0))
        for name, values in domains.items()
        for v in values[1:]
    }
    return df.withColumns(cells).drop(*domains)


def const_impute(df: DataFrame, cols: Sequence[str], value: str = "missing") -> DataFrame:
    """Missing categories become a category of their own."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(value)) for c in cols})


def fit_domains(df: DataFrame, cols: Sequence[str], missing: str = "missing", most: int = 10_000) -> dict[str, list[str]]:
    """Sorted category domains seen in the frame; a domain above ``most`` values is refused."""
    seen = (
        const_impute(df.select(*cols), cols, missing)
        .unpivot([], list(cols), "column", "value")
        .distinct()
    )
    rows = seen.limit(most * len(cols) + 1).collect()
    if len(rows) > most * len(cols):
        raise ValueError("category domains too large for indicator columns")
    out: dict[str, list[str]] = {c: [] for c in cols}
    for row in rows:
        out[row["column"]].append(row["value"])
    return {c: sorted(v) for c, v in out.items()}


def one_hot_ignore(df: DataFrame, domains: Mapping[str, Sequence[str]], missing: str = "missing") -> DataFrame:
    """Indicators of every fitted category; missing is a category, unseen values are all zero."""
    filled = const_impute(df, list(domains), missing)
    cells = {indicator_name(n, v): (F.col(n) == v).cast("int") for n, values in domains.items() for v in values}
    return filled.withColumns(cells).drop(*domains)


# ---- numeric columns ---------------------------------------------------------------------

def fit_standard_scale(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float | None, float | None]]:
    """(mean, population standard deviation) per column, nulls skipped.

    One vector summary covers any number of columns; columns with gaps, which it cannot skip, get
    plain aggregates in a second pass.
    """
    rows = VectorAssembler(inputCols=list(cols), outputCol="_v", handleInvalid="keep").transform(df)
    s = rows.agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("_v")).alias("s")).first()["s"]
    if not s["count"]:
        return {c: (None, None) for c in cols}
    unbias = (s["count"] - 1) / s["count"]
    fit = {c: (float(m), (float(v) * unbias) ** 0.5) for c, m, v in zip(cols, s["mean"], s["variance"])}
    gappy = [c for c, (m, _) in fit.items() if m != m]
    if gappy:
        row = df.agg(*[F.avg(c) for c in gappy], *[F.stddev_pop(c) for c in gappy]).first()
        fit.update({c: (row[i], row[i + len(gappy)]) for i, c in enumerate(gappy)})
    return fit


def apply_standard_scale(df: DataFrame, fit: Mapping[str, tuple[float, float]]) -> DataFrame:
    """(x - mean) / deviation; a constant column becomes 0."""
    cells = {c: F.expr(f"(`{c}` - {m!r}D) / {(s if s and s > 1e-12 * abs(m) else 1.0)!r}D") for c, (m, s) in fit.items() if m is not None}
    return df.withColumns(cells)


def standard_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fit on the frame and apply to it."""
    return apply_standard_scale(df, fit_standard_scale(df, cols))


def fit_median(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Exact median per column (one number each)."""
    return {r["column"]: r["value"] for r in exact_quantiles(df, cols, 0.5).collect()}


def apply_median(df: DataFrame, fit: Mapping[str, float]) -> DataFrame:
    """Missing values become the fitted median."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fit.items()})


def median_impute(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fit on the frame and apply to it."""
    return apply_median(df, fit_median(df, cols))


class ColumnTransform:
    """Numeric branch (median, scale) and category branch (constant, indicators) fitted together."""

    def __init__(self, numeric: Sequence[str], categorical: Sequence[str]):
        self.numeric, self.categorical = list(numeric), list(categorical)

    def fit(self, df: DataFrame) -> ColumnTransform:
        self.medians = fit_median(df, self.numeric) if self.numeric else {}
        filled = apply_median(df, self.medians)
        self.scales = fit_standard_scale(filled, self.numeric) if self.numeric else {}
        self.domains = fit_domains(df, self.categorical) if self.categorical else {}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        scaled = apply_standard_scale(apply_median(df, self.medians), self.scales)
        return one_hot_ignore(scaled, self.domains) if self.domains else scaled

    def feature_names(self) -> list[str]:
        """Columns the transform produces, in order."""
        return self.numeric + [indicator_name(n, v) for n, values in self.domains.items() for v in values]
