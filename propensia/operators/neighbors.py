"""Exact k nearest neighbours as a partitioned Spark join, and its three uses.

Donors are assigned to the cell of their nearest pivot; a query visits only cells that can hold one
of its k nearest by the triangle inequality (after Lu et al. 2012, kNN join on MapReduce). Inside a
cell both sides are cut into hash blocks of bounded size, so a cell that holds most rows is spread
over many tasks. A block pair returns its k best per query, never its pairs; the merge keeps the k
best over all blocks. Pruning only skips cells that cannot matter, so the result is exact. Inside a block pair a matrix
product bounds all distances from below; exact distances are taken of the few pairs that can be among the k best.

Missing vector elements are allowed on both sides: distances use the shared elements and are scaled
by (dimensions / shared elements). Donors with gaps are kept in a cell every query visits.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from propensia.functions.hashing import key_hash
from propensia.session import stage

GAP_CELL = -1


def _pivot_distances(pivots: np.ndarray):
    """Distances of vectors to all pivots over their present elements, with the vectors as a matrix."""

    def distances(vec: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        x = _matrix(vec)
        return np.stack([np.sqrt(np.nansum((x - p) ** 2, axis=1)) for p in pivots], axis=1), x

    return distances


def _assign_cell(pivots: np.ndarray):
    distances = _pivot_distances(pivots)

    @F.pandas_udf("struct<cell:int,dist:double>")
    def assign(vec: pd.Series) -> pd.DataFrame:
        d, x = distances(vec)
        near = d.argmin(axis=1)
        cell = np.where(np.isnan(x).any(axis=1), GAP_CELL, near)
        return pd.DataFrame({"cell": cell.astype("int32"), "dist": d[np.arange(len(d)), near]})

    return assign


def _candidate_cells(pivots: np.ndarray, count: np.ndarray, radius: np.ndarray, need: int, gaps: bool):
    distances = _pivot_distances(pivots)
    gap_cell = [GAP_CELL] if gaps else []
    used = np.flatnonzero(count > 0)

    @F.pandas_udf("array<int>")
    def cells(vec: pd.Series) -> pd.Series:
        d = distances(vec)[0][:, used]
        farthest = d + radius[used]
        order = np.argsort(farthest, axis=1)
        filled = np.cumsum(count[used][order], axis=1) >= need
        bound = np.take_along_axis(farthest, order, axis=1)[np.arange(len(d)), filled.argmax(axis=1)]
        bound = np.where(filled.any(axis=1), bound, np.inf)
        near = d - radius[used] <= bound[:, None] * (1 + 1e-9) + 1e-12
        return pd.Series([used[row].tolist() + gap_cell for row in near])

    return cells


#: queries and donors that one matrix product holds
CHUNK, TILE = 1024, 4096
#: pairs whose exact distance is taken at a time
PAIRS = 65_536
#: above every bound but the infinite one of a pair without a distance
MOST = np.finfo(np.float32).max


def _matrix(vec: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in vec])


def _pair_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of row pairs over their shared elements; NaN without any."""
    gap = x - y
    known = ~np.isnan(gap)
    total = np.cumsum(np.where(known, gap * gap, 0.0), axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.sqrt(total * (x.shape[1] / known.sum(axis=1)))


def _without_spare_copies(y: np.ndarray, keep: int) -> np.ndarray:
    """Rows of ``y`` (in order of their ids) without those that equal ``keep`` rows before them, which win every tie."""
    odd = np.random.default_rng(3).integers(0, 2**63, y.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    mixed = (np.ascontiguousarray(y).view(np.uint64) * odd).sum(axis=1, dtype=np.uint64)
    order = np.argsort(mixed, kind="stable")
    near = np.flatnonzero(mixed[order][1:] == mixed[order][:-1]) + 1
    same = np.zeros(len(y), bool)
    same[near] = [np.array_equal(y[order[i]], y[order[i - 1]], equal_nan=True) for i in near]
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(y))))
    return np.sort(order[np.arange(len(y)) - first < keep])


class _Bounds:
    """Lower bounds of squared distances, a tile of queries and donors by one single-precision matrix product.

    Vectors are moved to the donors' medians and scaled to norm 1 at most. With gaps as zeros, a missing element costs the other
    side's square, which columns of the product take off again; so do the norms, made smaller by all that rounding can add.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x_gap, self.y_gap = np.isnan(x), np.isnan(y)
        middle = np.array([np.median(v[~gap]) if not gap.all() else 0.0 for v, gap in zip(y.T, self.y_gap.T)])
        x0, y0 = np.where(self.x_gap, 0.0, x - middle), np.where(self.y_gap, 0.0, y - middle)
        with np.errstate(over="ignore"):
            self.scale = float(np.sqrt(max((x0 * x0).sum(axis=1).max(), (y0 * y0).sum(axis=1).max())))
        self.usable = 1e-100 < self.scale < 1e100
        if not self.usable:
            return
        x0, y0 = (x0 / self.scale).astype(np.float32), (y0 / self.scale).astype(np.float32)
        xg, yg = np.flatnonzero(self.x_gap.any(axis=0)), np.flatnonzero(self.y_gap.any(axis=0))
        self.both = np.intersect1d(xg, yg)
        self.dims, self.x_known, self.y_known = x.shape[1], (~self.x_gap).sum(axis=1), (~self.y_gap).sum(axis=1)
        self.rounding = 4 * (self.dims + len(xg) + len(yg) + 16) * 2.0**-24
        self.nx, self.ny = ((v.astype(float) ** 2).sum(axis=1) for v in (x0, y0))
        less, one = 1 - self.rounding, np.ones
        left = [-2 * x0, -1.0 * self.x_gap[:, xg], -(x0[:, yg] ** 2), less * self.nx[:, None], one((len(x), 1))]
        right = [y0, y0[:, xg] ** 2, self.y_gap[:, yg], one((len(y), 1)), less * self.ny[:, None]]
        self.left, self.right = (np.concatenate(parts, axis=1).astype(np.float32) for parts in (left, right))
        if not len(yg):  # shared elements are those of the query
            self.left *= (self.dims / np.maximum(self.x_known, 1)).astype(np.float32)[:, None]
        self.gaps = bool(len(yg))

    def tile(self, rows: slice, cols: slice) -> tuple[np.ndarray, np.ndarray]:
        """(lower bounds, what squared distances may lie above them, as a share of the pair's squared norms)."""
        n, m = len(self.x_gap[rows]), len(self.y_gap[cols])
        if not self.usable:
            return np.zeros((n, m), np.float32), np.zeros((n, 1), np.float32)
        low = self.left[rows] @ self.right[cols].T
        most = self.dims / np.maximum(self.x_known[rows], 1)
        if self.gaps:
            shared = self.x_gap[rows][:, self.both].astype(np.float32) @ self.y_gap[cols][:, self.both].T.astype(np.float32)
            shared += (self.x_known[rows, None] - self.dims).astype(np.float32) + self.y_known[cols].astype(np.float32)
            with np.errstate(divide="ignore", invalid="ignore"):
                low *= np.float32(self.dims) / shared
            low[shared < 0.5] = np.inf
            most = self.dims / np.maximum(shared.min(axis=1), 1)
        return low, (4 * self.rounding * most).astype(np.float32)[:, None]

    def kth(self, low: np.ndarray, spare: np.ndarray, rows: slice, cols: slice, k: int) -> np.ndarray:
        """Squared distances per row that at least k donors of the tile do not exceed."""
        if not self.usable:
            return np.zeros(len(low), np.float32)
        above = spare * (self.nx[rows, None].astype(np.float32) + self.ny[cols].astype(np.float32))
        return _kth_least(low + above, k) * np.float32(1 + 1e-6)

    def limit(self, worst: np.ndarray) -> np.ndarray:
        """What the lower bound of a pair nearer than ``worst`` does not exceed."""
        if not self.usable:
            return np.full(len(worst), np.inf, np.float32)
        return ((worst / self.scale) ** 2 * (1 + 1e-6)).clip(max=MOST).astype(np.float32)


def _kth_least(low: np.ndarray, k: int, groups: int = 512) -> np.ndarray:
    """A value per row that at least k elements do not exceed, and few more than k: the k-th of least values of groups."""
    whole = low.shape[1] // groups
    if whole > 1 and k <= groups:
        least = low[:, :groups].copy()
        for g in range(1, whole):
            np.minimum(least, low[:, g * groups : (g + 1) * groups], out=least)
        low = least
    if k > low.shape[1]:
        return np.full(len(low), np.inf, np.float32)
    return np.partition(low, k - 1, axis=1)[:, k - 1]


def _block_top_k(k: int, exclude_self: bool, targeted: bool):
    """The k best donors of every query of a block pair; only pairs that bounds cannot exclude get their exact distance."""

    def top_k(queries: pd.DataFrame, donors: pd.DataFrame) -> pd.DataFrame:
        names = ["id", "target", "neighbor_id", "distance", "value"]
        if queries.empty or donors.empty:
            return pd.DataFrame({n: [] for n in names})
        donors = donors.sort_values("id")  # equal distances go to the smaller id
        y = _matrix(donors["vec"])
        kept = _without_spare_copies(y, k + int(exclude_self))
        y, ids, payload = y[kept], donors["id"].to_numpy()[kept], donors["payload"].to_numpy(dtype=float)[kept]
        x, qid, target = _matrix(queries["vec"]), queries["id"].to_numpy(), queries["target"].to_numpy()
        wanted, best, who = k + int(exclude_self), np.full((len(x), k), np.inf), np.full((len(x), k), -1)

        def judge(r: np.ndarray, c: np.ndarray) -> None:
            dist = _pair_distances(x[r], y[c])
            fit = ~np.isnan(dist) & (dist <= best[r, -1])
            if exclude_self:
                fit &= qid[r] != ids[c]
            if targeted:
                fit &= ~np.isnan(y[c, target[r]])
            _merge(best, who, r[fit], c[fit], dist[fit])

        if len(x) * len(y) <= PAIRS // 4:  # few pairs: nothing to exclude
            judge(*np.divmod(np.arange(len(x) * len(y)), len(y)))
        else:
            bounds = _Bounds(x, y)
            for at in range(0, len(x), CHUNK):
                rows = slice(at, min(at + CHUNK, len(x)))
                for to in range(0, len(y), TILE):
                    cols = slice(to, min(to + TILE, len(y)))
                    low, spare = bounds.tile(rows, cols)
                    if targeted and bounds.y_gap[cols].any():
                        low[bounds.y_gap[cols][:, target[rows]].T] = np.inf
                    limit = bounds.limit(best[rows, -1])
                    if np.isinf(best[rows, -1]).any():
                        limit = np.minimum(limit, bounds.kth(low, spare, rows, cols, wanted))
                    near = np.flatnonzero(low <= np.minimum(limit, MOST)[:, None])
                    for lo in range(0, len(near), PAIRS):
                        r, c = np.divmod(near[lo : lo + PAIRS], cols.stop - to)
                        judge(at + r, to + c)
        r, place = np.nonzero(who >= 0)
        c = who[r, place]
        value = y[c, target[r]] if targeted else payload[c]
        return pd.DataFrame({"id": qid[r], "target": target[r], "neighbor_id": ids[c], "distance": best[r, place], "value": value})

    return top_k


def _merge(best: np.ndarray, who: np.ndarray, r: np.ndarray, c: np.ndarray, dist: np.ndarray) -> None:
    """Put donors ``c`` at distances ``dist`` into the k best of rows ``r``; equal distances go to the smaller donor."""
    if not len(r):
        return
    touched, k = np.unique(r), best.shape[1]
    old_r, old_place = np.nonzero(who[touched] >= 0)
    old_r = touched[old_r]
    r, c, dist = np.concatenate([old_r, r]), np.concatenate([who[old_r, old_place], c]), np.concatenate([best[old_r, old_place], dist])
    order = np.lexsort((c, dist, r))
    r, c, dist = r[order], c[order], dist[order]
    rank = np.arange(len(r)) - np.searchsorted(r, r)
    first = rank < k
    best[r[first], rank[first]], who[r[first], rank[first]] = dist[first], c[first]


def _route(queries: DataFrame, donors: DataFrame, need: int, n_pivots: int, block_rows: int):
    """Donors with their cell, queries with the cells they must visit, and donor blocks per cell."""
    complete = donors.filter(~F.exists("vec", lambda v: v.isNull() | F.isnan(v)))
    picked = complete.orderBy(key_hash("id", seed=7), "id").limit(n_pivots).collect()
    if not picked:  # every donor has gaps: one cell for all of them
        picked = [{"vec": [0.0] * donors.select(F.size("vec").alias("n")).first()["n"]}]
    points = np.array([r["vec"] for r in picked], dtype=float)
    donors = stage(
        donors.withColumn("_a", _assign_cell(points)("vec")).select("id", "vec", "payload", "_a.cell", "_a.dist"),
        "donors",
    )
    stats = donors.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("r")).collect()
    count, radius = np.zeros(len(points)), np.zeros(len(points))
    blocks = {}
    for row in stats:
        blocks[row["cell"]] = math.ceil(row["n"] / block_rows)
        if row["cell"] != GAP_CELL:
            count[row["cell"]], radius[row["cell"]] = row["n"], row["r"]
    cells = _candidate_cells(points, count, radius, need, GAP_CELL in blocks)("vec").alias("cells")
    return donors, stage(queries.select("id", "vec", "target", cells), "queries"), blocks


def knn_join(
    queries: DataFrame,
    donors: DataFrame,
    k: int,
    exclude_self: bool = False,
    pivots: int | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """(id, target, rank, neighbor_id, distance, value): the k nearest donors of every query.

    ``queries``: id long, vec array<double>, optional target int (an element the donor must have).
    ``donors``: id long, vec array<double>, optional payload double.
    ``value`` is the donor's payload, or its target element when queries have a target.
    ``block_rows`` defaults to a sixteenth of the donors between 4096 and 32768, and there are as many ``pivots`` as such
    blocks: a query is copied once per cell it visits, so cells are as large as a task holds well. Driver-held state is the
    pivot vectors and one (count, radius) pair per cell.
    """
    targeted = "target" in queries.columns
    if not targeted:
        queries = queries.withColumn("target", F.lit(0))
    if "payload" not in donors.columns:
        donors = donors.withColumn("payload", F.lit(None).cast("double"))
    queries = queries.select("id", "vec", F.col("target").cast("int").alias("target"))
    donors = stage(donors.select("id", "vec", "payload"), "donors")
    n_donors = donors.count()
    block_rows = block_rows or min(32_768, max(4096, n_donors // 16))
    if n_donors <= block_rows:  # one block holds them all: nothing to prune
        donors, routed = donors.withColumn("cell", F.lit(0)), stage(queries, "queries").withColumn("cells", F.array(F.lit(0)))
        donor_blocks = {0: 1}
    else:
        n_pivots = pivots or math.ceil(n_donors / block_rows)
        donors, routed, donor_blocks = _route(queries, donors, k + int(exclude_self), n_pivots, block_rows)
    visits = routed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()
    query_blocks = {row["cell"]: math.ceil(row["n"] / block_rows) for row in visits} or {0: 1}

    def blocks(of: dict[int, int]) -> Column:
        return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in of.items() for x in kv]), F.col("cell")), F.lit(1))

    nd, nq = blocks(donor_blocks), blocks(query_blocks)
    own = lambda n: F.pmod(F.xxhash64("id", F.lit(11)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = (
        routed.withColumn("cell", F.explode("cells")).drop("cells")
        .withColumn("qb", own(nq)).withColumn("db", every(nd))
    )
    right = (
        donors.select("id", "vec", "payload", "cell").filter(F.col("cell").isin(list(query_blocks)))
        .withColumn("db", own(nd)).withColumn("qb", every(nq))
    )
    on = ["cell", "qb", "db"]
    found = (
        left.groupBy(*on).cogroup(right.groupBy(*on))
        .applyInPandas(
            _block_top_k(k, exclude_self, targeted),
            "id long, target int, neighbor_id long, distance double, value double",
        )
    )
    best = W.partitionBy("id", "target").orderBy("distance", "neighbor_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def knn_classify(
    test: DataFrame, train: DataFrame, features: Sequence[str], key: str, label: str, k: int = 5, weights: str = "uniform",
    join: Callable[..., DataFrame] | None = None,
) -> DataFrame:
    """(key, probability, prediction): vote of the k nearest training rows, by ``knn_join`` or another ``join`` like it.

    ``weights='distance'`` weighs by 1/distance; neighbours at distance 0 then decide alone.
    """
    queries, donors = _vectors(test, key, features), _vectors(train, key, features, label)
    near = (join or knn_join)(queries, donors, k)
    votes = near.groupBy(F.col("id").alias(key)).agg(vote_share(weights).alias("probability"))
    return votes.withColumn("prediction", (F.col("probability") > 0.5).cast("double"))


def vote_share(weights: str) -> Column:
    """Share of class-1 votes in a group of neighbour rows."""
    if weights == "uniform":
        return F.avg("value")
    if weights != "distance":
        raise ValueError(f"weights {weights!r}: use 'uniform' or 'distance'")
    zero = F.col("distance") == 0
    weight = F.when(~zero, 1 / F.col("distance"))
    at_zero = F.avg(F.when(zero, F.col("value")))
    return F.coalesce(at_zero, F.try_divide(F.sum(weight * F.col("value")), F.sum(weight)))


def _vectors(df: DataFrame, key: str, features: Sequence[str], label: str | None = None) -> DataFrame:
    vec = F.expr("array(" + ", ".join(f"cast(`{c}` as double)" for c in features) + ")").alias("vec")
    extra = [F.col(label).cast("double").alias("payload")] if label else []
    return df.select(F.col(key).alias("id"), vec, *extra)


def knn_impute(
    df: DataFrame, key: str, features: Sequence[str], k: int = 5, donors: DataFrame | None = None, join: Callable[..., DataFrame] | None = None,
) -> DataFrame:
    """Missing features become the mean of the k nearest donors that have them.

    Only rows with gaps travel as queries, once per missing element. Where no donor shares an
    element with the row, the column mean is used. ``donors`` (default: the frame) is the fit set, ``join`` the neighbour join (default: ``knn_join``).
    """
    base = donors if donors is not None else df
    vectors = _vectors(df, key, features)
    queries = vectors.withColumn(
        "target",
        F.explode(F.filter(F.sequence(F.lit(0), F.lit(len(features) - 1)), lambda i: F.get("vec", i).isNull())),
    )
    near = (join or knn_join)(queries, _vectors(base, key, features), k)
    guesses = near.groupBy("id", "target").agg(F.avg("value").alias("v"))
    wide = guesses.groupBy(F.col("id").alias(key)).agg(
        F.map_from_entries(F.collect_list(F.struct("target", "v"))).alias("_guess")  # at most one entry per feature
    )
    means = base.agg(F.array(*[F.avg(c).cast("double") for c in features])).scalar()
    filled = {
        c: F.coalesce(F.col(c), F.element_at("_guess", F.lit(i)), F.get("_mean", F.lit(i)))
        for i, c in enumerate(features)
    }
    return df.join(wide, key, "left").withColumn("_mean", means).withColumns(filled).drop("_guess", "_mean")
