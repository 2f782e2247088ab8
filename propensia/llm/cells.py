"""Two sides of a search met block by block: a grid of cells, each a bounded number of rows of either side."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

LOWEST = -(1 << 62)
KEYS = ["shard", "grp"]


class Best:
    """The first ``k`` rows by falling score, then rising id, of those within bounds."""

    def __init__(self, k: int, low: int = LOWEST, high: int = -LOWEST):
        self.k, self.low, self.high = k, low, high
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        within = (scores >= self.needed()) & (scores <= self.high)
        if within.any():
            scores, ids = np.concatenate([self.scores, scores[within]]), np.concatenate([self.ids, ids[within]])
            first = np.lexsort((ids, -scores))[: self.k]
            self.scores, self.ids = scores[first], ids[first]

    def needed(self) -> int:
        """A row with a lower score has no place."""
        return max(self.low, int(self.scores[-1])) if len(self.ids) == self.k else self.low


def best_of_each(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each key by falling score, then rising id (null last); rank is their place."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def meet(left: DataFrame, right: DataFrame, parts: int, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Rows of both sides by cell (shard, grp), each cell through ``fn``; a cell is whole in one task's memory."""

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        return fn(a.drop(KEYS), b.drop(KEYS))

    # keys of one type are dealt alike; the two sides may have an origin in common, hence the new names
    left, right = (side.withColumns({k: F.col(k).cast("int") for k in KEYS}).repartition(parts, *KEYS).toDF(*side.columns) for side in (left, right))
    return left.groupBy(*KEYS).cogroup(right.groupBy(*KEYS)).applyInArrow(cell, schema)


def table_of(rows: list[tuple], names: list[str]) -> pa.Table:
    """Rows of longs as an Arrow table."""
    return pa.table([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * len(names))], names)
