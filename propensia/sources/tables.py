"""Reading the `;`-separated input files and registering cleaned tables by name."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, types as T

from propensia.sources.schemas import TABLES


def csv_scan(spark: SparkSession, path: str, schema: T.StructType, sep: str = ";") -> DataFrame:
    """A headed, double-quoted text table with a declared schema; header names must match it."""
    return (
        spark.read.schema(schema)
        .option("sep", sep)
        .option("header", True)
        .option("quote", '"')
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(path)
    )


def read_bank(spark: SparkSession, folder: str, schemas: Mapping[str, T.StructType] | None = None) -> dict[str, DataFrame]:
    """The eight raw tables of a folder, by name; ``schemas`` replaces the declared ones of some tables."""
    return {name: csv_scan(spark, f"{folder}/{name}.csv", schema) for name, schema in (TABLES | dict(schemas or {})).items()}


class Catalog:
    """Cleaned tables under names; the tables are session temp views."""

    def __init__(self, spark: SparkSession, prefix: str = "bank_"):
        self._spark, self._prefix = spark, prefix

    def register(self, name: str, df: DataFrame) -> DataFrame:
        df.createOrReplaceTempView(self._prefix + name)
        return df

    def register_all(self, tables: Mapping[str, DataFrame]) -> None:
        for name, df in tables.items():
            self.register(name, df)

    def fetch(self, name: str) -> DataFrame:
        return self._spark.table(self._prefix + name)
