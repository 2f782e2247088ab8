"""Feature preparation as a Spark ML stage, so that it is fitted where a model is: on the training folds only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter,
)
from pyspark.sql import Column, DataFrame, functions as F

from propensia.operators.features import fit_domains, fit_standard_scale, indicator_name
from propensia.operators.ranking import exact_quantiles

_FITTED = "column string, at int, median double, mean double, deviation double, domain array<string>"


def _number(name: str) -> Column:
    """A numeric column as double; NaN is a gap."""
    c = F.col(name).cast("double")
    return F.when(~F.isnan(c), c)


class _Columns(Params):
    numericCols = Param(Params._dummy(), "numericCols", "columns to fill with their median and scale", TypeConverters.toListString)
    categoricalCols = Param(Params._dummy(), "categoricalCols", "columns to turn into indicators", TypeConverters.toListString)
    outputCol = Param(Params._dummy(), "outputCol", "vector of prepared features", TypeConverters.toString)
    missing = Param(Params._dummy(), "missing", "category that gaps become", TypeConverters.toString)


class Preprocessor(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Numeric columns: gaps become the median, then (x - mean) / population deviation. Categories: gaps become a category,
    an indicator per category seen in the fit.

    A column without values in the fit gives 0, a constant one 0, a category not seen in the fit no indicator. The fit takes
    the passes of the exact medians, one for means and deviations and one for the categories, each for all columns.
    """

    @keyword_only
    def __init__(self, *, numericCols=(), categoricalCols=(), outputCol="features", missing="missing"):
        super().__init__()
        self._setDefault(numericCols=[], categoricalCols=[], outputCol="features", missing="missing")
        kwargs = self._input_kwargs
        self._set(**kwargs | {k: list(kwargs[k]) for k in ("numericCols", "categoricalCols") if k in kwargs})

    def _fit(self, df: DataFrame) -> PreprocessorModel:
        numeric, categorical = self.getOrDefault(self.numericCols), self.getOrDefault(self.categoricalCols)
        fitted = []
        if numeric:
            rows = df.select(*[_number(c).alias(c) for c in numeric])
            medians = {r["column"]: r["value"] for r in exact_quantiles(rows, numeric).collect()}
            filled = rows.select(*[F.coalesce(F.col(c), F.lit(0.0 if medians[c] is None else medians[c])).alias(c) for c in numeric])
            scales = fit_standard_scale(filled, numeric)
            fitted += [(c, i, medians[c], *scales[c], None) for i, c in enumerate(numeric)]
        if categorical:
            domains = fit_domains(df, categorical, self.getOrDefault(self.missing))
            fitted += [(c, len(numeric) + i, None, None, None, domains[c]) for i, c in enumerate(categorical)]
        model = PreprocessorModel(fitted)
        return self._copyValues(model)


class PreprocessorModel(Model, _Columns, MLWritable, MLReadable):
    """Adds the vector of prepared features; the columns it reads stay as they are."""

    def __init__(self, fitted: Sequence[tuple] = ()):
        super().__init__()
        self._setDefault(numericCols=[], categoricalCols=[], outputCol="features", missing="missing")
        self.fitted = [tuple(r) for r in fitted]

    def cells(self) -> dict[str, Column]:
        """Every feature as an expression of the raw columns, in the order of the vector."""
        out = {}
        for name, _, median, mean, deviation, domain in self.fitted:
            if domain is not None:
                value = F.coalesce(F.col(name).cast("string"), F.lit(self.getOrDefault(self.missing)))
                out |= {indicator_name(name, v): (value == v).cast("double") for v in domain}
            elif median is None:
                out[name] = F.lit(0.0)
            else:
                spread = deviation if deviation and deviation > 1e-12 * abs(mean) else 1.0
                out[name] = (F.coalesce(_number(name), F.lit(median)) - F.lit(mean)) / F.lit(spread)
        return out

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getOrDefault(self.outputCol), array_to_vector(F.array(*self.cells().values())))

    def named(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """The kept columns and every feature under its name."""
        return df.select(*keep, *[c.alias(name) for name, c in self.cells().items()])

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: PreprocessorModel):
        super().__init__()
        self._model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self._model, path, self.sparkSession)
        self.sparkSession.createDataFrame(self._model.fitted, _FITTED).coalesce(1).write.parquet(f"{path}/fitted")


class _Reader(MLReader):
    def load(self, path: str) -> PreprocessorModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        rows = self.sparkSession.read.schema(_FITTED).parquet(f"{path}/fitted").orderBy("at").collect()  # one row per column
        model = PreprocessorModel(rows)
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


def prepared_folds(df: DataFrame, preprocess: Preprocessor, folds: int, fold_col: str = "fold") -> list[tuple[PreprocessorModel, DataFrame, DataFrame]]:
    """Per fold: the preparation fitted on the other folds, the prepared other folds, and the prepared fold."""
    out = []
    for fold in range(folds):
        inside = F.col(fold_col) == fold
        model = preprocess.fit(df.filter(~inside))
        out.append((model, model.transform(df.filter(~inside)), model.transform(df.filter(inside))))
    return out
