"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "propensia", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE, Arrow)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local master may fall back to a temporary folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="propensia-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below this application's part of the shared folder (which can be dropped as one)."""
    return os.path.join(
        shared_dir(spark), "propensia", spark.sparkContext.applicationId, f"{name}-{uuid.uuid4().hex}"
    )


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go when it is written, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def stage(df: DataFrame, name: str = "stage", rebalance: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage of a frame that several jobs read. The written table outlives executors,
    and its size is known to the planner, which then picks broadcast joins by measured size.
    ``rebalance`` evens out the files first (AQE merges small and splits large parts); worth its
    shuffle for rows that an iterative fit reads hundreds of times.
    """
    path = shared_path(df.sparkSession, name)
    if rebalance:
        df = df.hint("rebalance")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_by_key(df: DataFrame, key: str, *order: str, buckets: int | None = None) -> DataFrame:
    """Write ``df`` below the shared folder as a table bucketed by ``key``, one file a bucket, and read it back.

    Joins, windows and aggregates by ``key`` over tables of as many buckets then need no exchange. The rows cross the
    network once, here; store what is aggregated per key, so that no bucket grows with a hot key's raw rows. ``buckets``
    defaults to the number of shuffle partitions.
    """
    spark, n, table = df.sparkSession, buckets or parallel_buckets(df.sparkSession), f"propensia_{uuid.uuid4().hex}"
    written = df.repartition(n, key).write.bucketBy(n, key).sortBy(key, *order)
    written.option("path", shared_path(spark, "keyed")).saveAsTable(table, format="parquet")
    return spark.table(table)


def parallel_buckets(spark: SparkSession) -> int:
    """How many hash or quantile buckets a global ordering is split into: as many as a shuffle has partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
