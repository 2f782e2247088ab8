"""Moments of many column pairs in one pass: sums of products per partition, added up by a tree."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from propensia.session import parallel_buckets

FAN_IN = 32
#: rows taken together in one matrix product
CHUNK = 8192


def _products(shift: list[float]):
    """One row per partition: counts, sums, sums of squares and of products of all pairs, over rows that have both values."""
    width = len(shift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, width, width))
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                x = np.column_stack([c.slice(at, CHUNK).to_numpy(zero_copy_only=False) for c in batch.columns]).astype(np.float64) - shift
                has = np.isfinite(x)
                x = np.where(has, x, 0.0)
                has = has.astype(np.float64)
                total += np.stack([has.T @ has, x.T @ has, (x * x).T @ has, x.T @ x])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["m"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for m in batch.column("m"):
            part = np.frombuffer(m.as_py())
            total = part.copy() if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["m"])


def _correlations(cols: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(4 * len(cols) ** 2)
        for batch in _added(batches):
            total += np.frombuffer(batch.column("m")[0].as_py())
        n, s, q, p = total.reshape(4, len(cols), len(cols))
        with np.errstate(all="ignore"):
            spread = q - s * s / n  # of a's values in rows that have b
            spread = np.where(spread > 1e-14 * q, spread, 0.0)
            corr = (p - s * s.T / n) / np.sqrt(spread * spread.T)
        known = np.isfinite(corr) & (n > 1)
        a, b = np.indices(corr.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array([cols[i] for i in a]), pa.array([cols[i] for i in b]), pa.array(np.clip(corr, -1, 1).ravel(), mask=~known.ravel())],
            ["column_a", "column_b", "corr"],
        )

    return run


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column_a, column_b, corr) of all pairs of the given columns; null where undefined.

    A pair is taken over the rows that have both values (null, NaN and infinite values are gaps). Rows are read for the
    column means, which keep the sums exact enough, and once more for the products: per partition a few matrix products,
    whose sums of 32 columns² bytes are added up by ever fewer tasks until one is left. No rows give null for all pairs.
    """
    cols = list(cols)
    plain = [F.col(c).cast("double") for c in cols]
    sound = [F.when(F.abs(c) < float("inf"), c) for c in plain]
    rows = df.select(*[c.alias(f"c{i}") for i, c in enumerate(sound)])
    means = rows.agg(*[F.coalesce(F.avg(f"c{i}"), F.lit(0.0)) for i in range(len(cols))]).first()
    sums = rows.mapInArrow(_products([float(m) for m in means]), "m binary")
    parts = parallel_buckets(df.sparkSession)
    while parts > 1:
        parts = math.ceil(parts / FAN_IN)
        sums = sums.repartition(parts).mapInArrow(_added, "m binary")
    return sums.repartition(1).mapInArrow(_correlations(cols), "column_a string, column_b string, corr double")
