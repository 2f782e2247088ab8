"""From raw documents to packed training sequences: each stage's output is written and read by the next."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from propensia.llm import minhash, packing, surrogates, weak_rules, winnowing
from propensia.session import stage

#: keyed surrogates; a deployment sets its own secret
KEY = os.environ.get("CORPUS_SURROGATE_KEY", "surrogates of the registered pipeline").encode()
#: path of the tokenizer file; every executor needs it there
VOCABULARY = os.environ.get("CORPUS_VOCABULARY", public_tokenizers.path("word_bpe_49k.json"))

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak supervision of the quality rules rejects go."""
    return weak_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the smallest id."""
    return minhash.drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat test items go."""
    return winnowing.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gets surrogates; no document goes."""
    return surrogates.with_surrogates(docs, KEY)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences."""
    return packing.pack(docs, VOCABULARY)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("benchmark", benchmark),
    ("private_data", private_data), ("packing", packed),
]

#: The verdict of the quality rules and the surrogates have no SQL form; tests hold the run against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
