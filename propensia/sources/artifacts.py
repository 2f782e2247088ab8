"""Fitted models and out-of-fold predictions on shared storage; only missing ones are made."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F


def _marker(spark: SparkSession, path: str):
    """A file's place and its file system, whichever Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    place, files = _marker(spark, path)
    return files.exists(place)


def _finish(spark: SparkSession, path: str) -> None:
    place, files = _marker(spark, path)
    files.create(place, True).close()


def fingerprint(df: DataFrame, *parameters: object, places: int = 9) -> str:
    """A name for the rows of a frame in any order, its schema and some parameters.

    Row hashes are added up and combined by exclusive or, so no row is moved and repeated rows count. Floating-point columns are
    rounded to ``places`` first: sums made in another order differ in their last bits.
    """
    real = {f.name for f in df.schema if f.dataType.typeName() in ("double", "float")}
    vectors = {f.name for f in df.schema if f.dataType.typeName() == "vectorudt"}
    if vectors:
        raise ValueError(f"vectors {sorted(vectors)} have no hash; take the columns they were made of")
    cells = [F.round(c, places) + F.lit(0.0) if c in real else F.col(c) for c in df.columns]
    h = F.xxhash64(*[x for c in cells for x in (c, c.isNull())])
    row = df.select(h.alias("h")).agg(F.count("*"), F.sum(F.col("h").cast("decimal(20,0)")), F.bit_xor("h")).first()
    text = repr((df.schema.simpleString(), *map(str, row), *parameters))
    return hashlib.sha256(text.encode()).hexdigest()[:24]


class ArtifactStore:
    """Per-model folders ``<root>/models/<name>`` and ``<root>/oof/model=<name>``; see ``fingerprint`` for names that
    follow the data and the parameters."""

    def __init__(self, spark: SparkSession, root: str):
        self._spark, self._root = spark, root

    def model_path(self, name: str) -> str:
        return f"{self._root}/models/{name}"

    def oof_path(self, name: str) -> str:
        return f"{self._root}/oof/model={name}"

    def model(self, name: str, fit: Callable[[], PipelineModel]) -> PipelineModel:
        """The stored model, or the fitted one after storing it.

        A pipeline is written stage by stage, so only a marker written after all of them makes it a stored one.
        """
        path = self.model_path(name)
        if _exists(self._spark, f"{path}/_COMPLETE"):
            return PipelineModel.load(path)
        fitted = fit()
        fitted.write().overwrite().save(path)
        _finish(self._spark, f"{path}/_COMPLETE")
        return fitted

    def predictions(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The stored out-of-fold predictions of a model, made first when missing."""
        path = self.oof_path(name)
        if not _exists(self._spark, f"{path}/_SUCCESS"):
            make().drop("model").write.mode("overwrite").parquet(path)
        return self._spark.read.parquet(path).withColumn("model", F.lit(name))

    def grid_path(self, name: str) -> str:
        """Where a grid search keeps the scores of its finished fits."""
        return f"{self._root}/grids/{name}"

    def all_predictions(self) -> DataFrame:
        """Predictions of every stored model, with the model's name as a column."""
        return self._spark.read.parquet(f"{self._root}/oof")
