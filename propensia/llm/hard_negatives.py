"""Hard negatives of anchor vectors by Fagin's threshold algorithm over blocks of candidates.

Candidates lie in blocks of ``BLOCK_ROWS`` rows in order of label. A block holds, for each dimension, its rows sorted by
that component. For one anchor a block is read by sorted access: the next ``STEP`` rows of each list, from its high end
where the anchor's component is positive and from its low end where it is negative, are scored whole (random access). The
threshold, the anchor's product with the components reached, bounds the score of every row not yet seen; reading stops once it
is strictly below what each of the anchor's windows still needs: the score of its last place, or the window's lower
bound. Ties at the last place are therefore all seen.

Two rounds: anchors meet the blocks that hold their label to find their positives, then all blocks to find
negatives in the positives' windows. Blocks and groups of anchors meet in cells of ``CELL`` by ``CELL``, dealt over tasks; a cell
returns a few rows an anchor, and the best of these are ranked by Spark. Work grows with anchors times candidates where
thresholds do not stop it early; nothing but numbers of blocks passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from propensia.llm.cells import Best, best_of_each, meet, table_of
from propensia.session import parallel_buckets, stage

BLOCK_ROWS = 4096
GROUP_ROWS = 256
CELL = 16
STEP = 32
EXACT = 1 << 53


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256) -> DataFrame:
    """id, label and vec (floor(scale * component) as long) of the rows that take part.

    Rows with a null id, label or vector, or a null or non-finite component, take no part.
    """
    x = F.col(vector_col)
    sound = F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))  # NaN is above all numbers
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull()).where(sound)
    vec = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), vec.alias("vec"))


def _blocks(dims: int, size: int):
    """Rows in order of label to blocks, one row each."""

    def build(table: pa.Table, number: int) -> pa.RecordBatch:
        n = table.num_rows
        lists = table.column("vec").combine_chunks()
        lengths = np.diff(lists.offsets.to_numpy())
        x = np.zeros((n, dims), np.int64)
        x[np.repeat(np.arange(n), lengths), np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = lists.flatten().to_numpy()
        order = np.argsort(x, axis=0, kind="stable").T.astype(np.int32)
        ids, labels = (table.column(c).to_numpy() for c in ("id", "label"))
        key = (TaskContext.get().partitionId() << 32) + number
        row = [key, np.unique(labels).tolist(), ids.astype("<i8").tobytes(), labels.astype("<i8").tobytes(), x.astype("<i8" if np.abs(x).max(initial=0) >= 1 << 31 else "<i4").tobytes(), order.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _BLOCK_TYPES)], ["block", "labels", "ids", "label", "vecs", "lists"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, number = [], 0, 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            while rows >= size:
                table = pa.Table.from_batches(held)
                yield build(table.slice(0, size), number)
                number, held, rows = number + 1, table.slice(size).to_batches(), rows - size
        if rows:
            yield build(pa.Table.from_batches(held), number)

    return run


_BLOCK_TYPES = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4]
_BLOCK_SCHEMA = "block long, labels array<long>, ids binary, label binary, vecs binary, lists binary"


class Lists:
    """A block: vectors, and for each dimension the rows by rising component and these components."""

    def __init__(self, block: int, ids: bytes, label: bytes, vecs: bytes, lists: bytes, dims: int, most: int):
        self.block, self.ids, self.label = block, np.frombuffer(ids, "<i8"), np.frombuffer(label, "<i8")
        n = len(self.ids)
        self.rows = np.frombuffer(lists, np.int32).reshape(dims, n)
        x = np.frombuffer(vecs, "<i4" if len(vecs) == 4 * n * dims else "<i8").reshape(n, dims)
        # whole numbers below 2^53 are exact in doubles, whose products are faster
        bound = dims * most * int(np.abs(x).max(initial=0))
        if bound >= 1 << 62:
            raise ValueError("scores do not fit 64 bits")
        self.vecs = x.astype(np.float64 if bound < EXACT else np.int64)
        self.sorted = np.take_along_axis(self.vecs.T, self.rows, 1)


def sorted_access(lists: Lists, anchor: np.ndarray, needed) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows newly seen with their scores, until the threshold is below ``needed()``."""
    n = len(lists.ids)
    up, down = np.flatnonzero(anchor < 0), np.flatnonzero(anchor > 0)
    a = anchor.astype(lists.vecs.dtype)
    seen = np.zeros(n, bool)
    depth = 0
    while True:
        if depth < n:
            threshold = int(a[up] @ lists.sorted[up, depth]) + int(a[down] @ lists.sorted[down, n - 1 - depth])
            if threshold < needed():
                return
        to = min(n, max(STEP, depth * 2))
        new = np.zeros(n, bool)
        if to == n:
            new[:] = True
        else:
            new[lists.rows[up, depth:to]] = True
            new[lists.rows[down, n - to : n - depth]] = True
        fresh = np.flatnonzero(new & ~seen)
        seen |= new
        if len(fresh):
            yield fresh, (lists.vecs[fresh] @ a).astype(np.int64)
        if to == n:
            return
        depth = to


def _positives(dims: int, most: int, k: int):
    """A cell of the first round: the best rows of an anchor's label, itself left out."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        blocks = [Lists(*b.values(), dims, most) for b in left.select(["block", "ids", "label", "vecs", "lists"]).to_pylist()]
        out = []
        for anchor in right.to_pylist():
            vec, best = np.array(anchor["vec"], np.int64), Best(k)
            vec = np.pad(vec, (0, dims - len(vec)))
            for lists in blocks:
                mine = lists.label == anchor["label"]
                if not mine.any():
                    continue
                if lists.block == anchor["block"]:
                    mine[anchor["row"]] = False
                for rows, scores in sorted_access(lists, vec, best.needed):
                    own = mine[rows]
                    best.add(scores[own], lists.ids[rows[own]])
            out += [(anchor["block"], anchor["row"], i, s) for i, s in zip(best.ids.tolist(), best.scores.tolist())]
        return table_of(out, ["block", "row", "id", "score"])

    return run


def _negatives(dims: int, most: int, k: int, low: int, high: int):
    """A cell of the second round: the best rows of other labels in each positive's window."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        blocks = [Lists(*b.values(), dims, most) for b in left.select(["block", "ids", "label", "vecs", "lists"]).to_pylist()]
        out = []
        for anchor in right.to_pylist():
            vec = np.array(anchor["vec"], np.int64)
            vec = np.pad(vec, (0, dims - len(vec)))
            # low * p <= 100 * s <= high * p
            windows = {p: Best(k, -(-low * p // 100), high * p // 100) for p in set(anchor["scores"])}
            windows = {p: w for p, w in windows.items() if w.low <= w.high}
            if not windows:
                continue
            for lists in blocks:
                other = lists.label != anchor["label"]
                for rows, scores in sorted_access(lists, vec, lambda: min(w.needed() for w in windows.values())):
                    own = other[rows]
                    for w in windows.values():
                        w.add(scores[own], lists.ids[rows[own]])
            out += [(anchor["block"], anchor["row"], p, i, s) for p, w in windows.items() for i, s in zip(w.ids.tolist(), w.scores.tolist())]
        return table_of(out, ["block", "row", "positive_score", "id", "score"])

    return run


def hard_negatives(
    rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
    block_rows: int = BLOCK_ROWS, cell: int = CELL,
) -> DataFrame:
    """Negatives that score close below an anchor's positives.

    ``rows`` has id (long), label (long) and vec (array of long), see ``quantised``; ``anchors`` says by these columns which
    are anchors. A score is the inner product, higher first, ties by smaller id. An anchor's positives are its first
    ``positives`` other rows of its label; for each, the first ``negatives`` rows of other labels with
    low * positive_score <= 100 * score <= high * positive_score are returned: anchor_id, positive_id, rank (from 1),
    negative_id, positive_score, negative_score.

    Rows with a null id, label or vector take no part; shorter vectors count as filled up with zeros. Repeated rows and
    ids are rows of their own, also as anchors. A positive whose window holds no row returns none. No rows give no
    rows. Components of any size are taken as long as scores fit 62 bits (a ValueError otherwise). Other columns are
    ignored. Memory per task: a cell of ``cell`` blocks and their lists, about 100 MB at 64 dimensions.
    """
    spark = rows.sparkSession
    rows = rows.where("id is not null and label is not null and vec is not null")
    rows = rows.select("id", "label", "vec", F.coalesce(anchors, F.lit(False)).alias("anchor"))
    size = F.max(F.size("vec")), F.max(F.array_max(F.transform("vec", F.abs))), F.count("*"), F.count_if("anchor")
    dims, most, n, n_anchors = rows.agg(*size).first()
    dims, most = dims or 0, int(most or 0)
    parts = max(1, -(-n // block_rows))
    # hot labels are spread over as many blocks as they fill
    ordered = rows.repartitionByRange(parts, "label", F.xxhash64("id", "vec")).sortWithinPartitions("label", "id")
    blocks = stage(ordered.select("id", "label", "vec").mapInArrow(_blocks(dims, block_rows), _BLOCK_SCHEMA), "blocks")

    # anchors are found again in the blocks, which fix a row's place
    places = stage(blocks.mapInArrow(_places(dims), "block long, row long, id long, label long, vec array<long>").withColumn("anchor", F.coalesce(anchors, F.lit(False))).where("anchor").drop("anchor"), "anchors")
    n_blocks = blocks.count()
    shards = max(1, -(-n_blocks // cell), min(n_blocks, parallel_buckets(spark)))
    groups = max(1, -(-n_anchors // (GROUP_ROWS * cell)))
    shard, group = F.pmod(F.xxhash64("block"), F.lit(shards)), F.pmod(F.xxhash64("block", "row"), F.lit(groups))
    blocks = blocks.withColumn("shard", shard)
    placed = places.withColumn("grp", group)

    # first round: only the cells whose blocks hold a label of the group
    by_label = blocks.select("shard", F.explode("labels").alias("label")).distinct()
    mine = placed.join(by_label, "label").select("shard", "grp", "block", "row", "label", "vec")
    cells = mine.select("shard", "grp").distinct()
    dealt = blocks.join(cells, "shard").select("shard", "grp", "block", "ids", "label", "vecs", "lists")
    met = meet(dealt, mine, shards * groups, _positives(dims, most, positives), "block long, row long, id long, score long")
    found = stage(best_of_each(met, ["block", "row"], positives), "positives")

    # second round: every cell
    windows = found.groupBy("block", "row").agg(F.collect_set("score").alias("scores"))
    asked = placed.join(windows, ["block", "row"]).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    dealt = blocks.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select("shard", "grp", "block", "ids", "label", "vecs", "lists")
    asked = asked.select("shard", "grp", "block", "row", "label", "vec", "scores")
    met = meet(dealt, asked, shards * groups, _negatives(dims, most, negatives, low, high), "block long, row long, positive_score long, id long, score long")
    best = best_of_each(met, ["block", "row", "positive_score"], negatives).select("block", "row", "positive_score", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = found.select("block", "row", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return places.select("block", "row", F.col("id").alias("anchor_id")).join(named, ["block", "row"]).join(best, ["block", "row", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def _places(dims: int):
    """The rows of blocks with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                ids = np.frombuffer(b["ids"], "<i8")
                n = len(ids)
                x = np.frombuffer(b["vecs"], "<i4" if len(b["vecs"]) == 4 * n * dims else "<i8").astype(np.int64)
                vec = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dims, pa.int32()), pa.array(x))
                columns = [pa.array(np.full(n, b["block"])), pa.array(np.arange(n)), pa.array(ids), pa.array(np.frombuffer(b["label"], "<i8")), vec]
                yield pa.RecordBatch.from_arrays(columns, ["block", "row", "id", "label", "vec"])

    return run
