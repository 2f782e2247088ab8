"""Best-fit packing of tokenized documents into sequences, in bulk-synchronous rounds.

Pieces longer than half a sequence open one each. Then, in rounds, unplaced pieces and open gaps are range-sorted by
size, largest first:

1. Every range is swept from large to small; a piece takes the smallest gap seen that still fits (a stack, since gaps
   arrive in falling order), and what is left of a gap is offered again further down in the same range.
2. Pieces a range could not place and gaps it did not use are ranked; a prefix scan over the ranges' two counts gives
   each unused gap pieces of a later (smaller) range, as many as surely fit, so no two gaps claim a piece.
3. Gaps are updated and the next round begins. If a round places next to nothing, the largest pieces left
   open as many sequences as all of them need at least. Pieces left that fit one range are packed by one more sweep, in which
   a piece without a gap opens a sequence.

The driver sees a few numbers per range and one per length, never rows. The state of each round is a written table.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from propensia.llm.tokenizing import word_ids
from propensia.llm.tokens import blocks
from propensia.session import stage

CAPACITY, END = 4096, 1
RANGE_ROWS = 50_000
LEVELS = (2, 4, 16)  # shares of a sequence at which a level begins
LITTLE, FEW = 0.05, 100
GAP, PIECE, PLACED, FALLEN = 0, 1, 2, 3
SWEPT = "part int, rank long, kind int, size long, key long, bin long, offset long"


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, key = word_ids(path), TaskContext.get().partitionId() << 33
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            for block in blocks(batch.column("text")):
                ids, bounds = vocabulary.block(block)
                raw, rows = ids.tobytes(), []
                for row, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    n = hi - lo + 1
                    for i, at in enumerate(range(0, n, capacity)):
                        size = min(capacity, n - at)
                        crc = zlib.crc32(raw[(lo + at) * 4 : min(lo + at + size, hi) * 4])
                        rows.append((key, row, i, at, size, zlib.crc32(end, crc) if at + size == n else crc))
                        key += 1
                columns = [np.array(c, np.int64) for c in zip(*rows)]
                doc = batch.column("id").slice(block.first, block.rows).take(pa.array(columns[1]))
                rest = [pa.array(columns[0]), doc, pa.array(columns[2], pa.int32()), *[pa.array(c) for c in columns[3:]]]
                yield pa.RecordBatch.from_arrays(rest, ["key", "id", "piece", "start", "length", "ids_crc32"])

    return run


def sweep(sizes: list[int], kinds: list[int], keys: list[int], capacity: int, opens: bool = False) -> list[tuple]:
    """One range, sorted by falling size with gaps before pieces: (kind, size, key, bin, offset) of everything.

    With ``opens`` a piece that finds no gap begins a sequence, named by its key.
    """
    out, stack, later = [], [], []
    low = sizes[-1] if sizes else 0
    for size, kind, key in zip(sizes, kinds, keys):
        while later and -later[0][0] >= size:
            g, b = heapq.heappop(later)
            stack.append((-g, b))
        if kind == GAP:
            stack.append((size, key))
        elif stack or opens:
            g, b = stack.pop() if stack else (capacity, key)
            out.append((PLACED, size, key, b, capacity - g))
            if g - size >= low:
                heapq.heappush(later, (size - g, b))
            elif g > size:
                out.append((FALLEN, g - size, b, b, 0))
        else:
            out.append((PIECE, size, key, 0, 0))
    gaps = sorted(stack + [(-g, b) for g, b in later])
    out.extend((GAP, g, b, b, 0) for g, b in gaps)
    return out


def _swept(capacity: int, opens: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = TaskContext.get().partitionId(), [[], [], []]
        for batch in batches:
            for i, name in enumerate(("size", "kind", "key")):
                rows[i].extend(batch.column(name).to_pylist())
        ranks = {GAP: 0, PIECE: 0}
        out = []
        for kind, size, key, b, offset in sweep(*rows, capacity, opens):
            rank = ranks.get(kind, 0)
            if kind in ranks:
                ranks[kind] += 1
            out.append((part, rank, kind, size, key, b, offset))
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), [pa.int32(), pa.int64(), pa.int32(), *[pa.int64()] * 4])],
                ["part", "rank", "kind", "size", "key", "bin", "offset"],
            )

    return run


class Rest(NamedTuple):
    """What a range left over: numbers of gaps and pieces, its smallest such gap and largest such piece."""

    gaps: int = 0
    pieces: int = 0
    least_gap: int = 0
    most_piece: int = 1


def routes(rest: dict[int, Rest]) -> list[tuple[int, int, int, int, int, int]]:
    """Unused gaps of a range to unplaced pieces of later ones, nearest first.

    Returns (range of the gaps, rank of the first gap, range of the pieces, rank of the first piece, rank after the last
    piece, pieces per gap). As many pieces share a gap as fit into the smallest of them at the size of the largest.
    """
    stack: list[tuple[int, int, int]] = []
    out = []
    for part in sorted(rest):
        r, done = rest[part], 0
        while done < r.pieces and stack:
            source, first, last = stack.pop()
            share = max(1, rest[source].least_gap // r.most_piece)
            n = min(r.pieces - done, (last - first) * share)
            out.append((source, first, part, done, done + n, share))
            done += n
            if first - (-n // share) < last:
                stack.append((source, first - (-n // share), last))
        if r.gaps:
            stack.append((part, 0, r.gaps))
    return out


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Key, sequence_id and offset of every piece; ``pieces`` has a unique long key and a length of 1 to capacity.

    Lengths are taken in levels (half to a quarter of a sequence, and so on), each until all of its pieces have a place, so
    that small pieces remain to fill the gaps of large ones. No rows give no rows. A round moves only the key and
    size of its level's unplaced pieces and of the open gaps.
    """
    everything = pieces.select(F.col("length").cast("long").alias("size"), F.lit(PIECE).alias("kind"), "key")
    lengths = {r["size"]: r["count"] for r in everything.groupBy("size").count().collect()}  # at most one row a length
    opened = everything.where(F.col("size") * 2 > capacity)
    done = [opened.select("key", F.col("key").alias("bin"), F.lit(0).cast("long").alias("offset"))]
    state = opened.where(F.col("size") < capacity).select((capacity - F.col("size")).alias("size"), F.lit(GAP).alias("kind"), "key")
    gaps = sum(n for size, n in lengths.items() if capacity < size * 2 < 2 * capacity)
    for top, floor in zip(LEVELS, [*LEVELS[1:], capacity]):
        mine = (F.col("size") > capacity // floor if floor < capacity else F.col("size") > 0) & (F.col("size") <= capacity // top)
        left = sum(n for size, n in lengths.items() if (size > capacity // floor or floor == capacity) and size <= capacity // top)
        state = state.union(everything.where(mine))
        while left:
            state, gaps, left = _round(state, gaps, left, capacity, done)
    result = done[0]
    for part in done[1:]:
        result = result.union(part)
    return result.select("key", F.col("bin").alias("sequence_id"), "offset")


def _order() -> list:
    return [F.col("size").desc(), F.col("kind"), F.col("key")]


def _round(state: DataFrame, n_gaps: int, n: int, capacity: int, done: list[DataFrame]) -> tuple[DataFrame, int, int]:
    """One sweep over all ranges, the routing of what ranges left over, and new sequences if little was placed.

    Returns the new state with its numbers of gaps and of unplaced pieces.
    """
    spark, order = state.sparkSession, _order()
    swept = state.repartitionByRange(-(-(n + n_gaps) // RANGE_ROWS), *order).sortWithinPartitions(*order)
    swept = stage(swept.mapInArrow(_swept(capacity), SWEPT), "swept")
    rest: dict[int, Rest] = {}
    fallen = 0
    totals = swept.where(F.col("kind") != PLACED).groupBy("part", "kind").agg(F.count("*"), F.min("size"), F.max("size"))
    for part, kind, m, least, most in totals.collect():
        was = rest.get(part, Rest())
        if kind == FALLEN:
            fallen += m
        else:
            rest[part] = was._replace(gaps=m, least_gap=least) if kind == GAP else was._replace(pieces=m, most_piece=most)
    placed = swept.where(F.col("kind") == PLACED).select("key", "bin", "offset")
    ways = routes(rest)
    left = sum(r.pieces for r in rest.values()) - sum(last - first for _, _, _, first, last, _ in ways)
    free, wanting = swept.where(F.col("kind") == GAP), swept.where(F.col("kind") == PIECE)
    columns = [F.col("size"), F.col("kind"), F.col("key")]
    after = swept.where(F.col("kind") == FALLEN).select("size", F.lit(GAP).alias("kind"), "key")
    if ways:  # about two rows a range
        way = spark.createDataFrame(ways, "source int, gap_first long, part int, first long, last long, share long")
        used = [(source, gap, gap - (-(last - first) // share)) for source, gap, _, first, last, share in ways]
        used = spark.createDataFrame(used, "part int, first long, last long")
        within = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last"))
        sent = wanting.drop("bin", "offset").join(way, "part").where(within)
        sent = sent.withColumn("gap_rank", F.col("gap_first") + F.floor((F.col("rank") - F.col("first")) / F.col("share")))
        holes = free.select(F.col("part").alias("source"), F.col("rank").alias("gap_rank"), F.col("size").alias("gap"), F.col("bin").alias("into"))
        met = sent.join(holes, ["source", "gap_rank"])
        before = F.sum("size").over(Window.partitionBy("source", "gap_rank").orderBy("rank")) - F.col("size")
        met = stage(met.select("key", F.col("into").alias("bin"), (capacity - F.col("gap") + before).alias("offset"), "size", "gap"), "routed")
        done.append(met.select("key", "bin", "offset"))
        kept = free.join(used, (free["part"] == used["part"]) & within, "left_anti").select(*columns)
        unserved = wanting.join(way, (wanting["part"] == way["part"]) & within, "left_anti").select(*columns)
        reduced = met.groupBy("bin").agg((F.first("gap") - F.sum("size")).alias("size")).where("size > 0")
        after = after.union(kept).union(unserved).union(reduced.select("size", F.lit(GAP), "bin"))
    else:
        after = after.union(free.select(*columns)).union(wanting.select(*columns))
    done.append(placed)
    gaps = fallen + sum(r.gaps for r in rest.values())
    if left and n - left <= LITTLE * n:
        after = stage(after, "state")
        if left <= RANGE_ROWS:
            after, opened = _finish(after, capacity, done)
            return after, gaps + opened, 0
        after, opened = _open(after, capacity, done)
        return after, gaps + opened, left - opened
    return after, gaps, left


def _finish(state: DataFrame, capacity: int, done: list[DataFrame]) -> tuple[DataFrame, int]:
    """Pieces of one range are packed by best fit into sequences that they open.

    Returns the state of gaps alone and how many of them are new.
    """
    rest = state.where(F.col("kind") == PIECE).repartition(1).sortWithinPartitions(*_order())
    rest = stage(rest.mapInArrow(_swept(capacity, True), SWEPT), "finished")
    done.append(rest.where(F.col("kind") == PLACED).select("key", "bin", "offset"))
    new = rest.where(F.col("kind") != PLACED).select("size", F.lit(GAP).alias("kind"), "key")
    return state.where(F.col("kind") == GAP).union(new), new.count()


def _open(state: DataFrame, capacity: int, done: list[DataFrame]) -> tuple[DataFrame, int]:
    """The largest pieces open as many sequences as the pieces left need at least; of one length a share.

    A large share is drawn by key hash, three standard deviations below the number wanted, so that it does not exceed it;
    a small one is taken by key. Returns the new state and how many were opened.
    """
    lengths = {r["size"]: r["count"] for r in state.where(F.col("kind") == PIECE).groupBy("size").count().collect()}
    want, edge = -(-sum(s * n for s, n in lengths.items()) // capacity), min(lengths)
    for size in sorted(lengths, reverse=True):
        edge = size
        if want <= lengths[size]:
            break
        want -= lengths[size]
    piece, at_edge = F.col("kind") == PIECE, F.col("size") == edge
    if want >= lengths[edge]:
        drawn = F.lit(True)
    elif want < FEW:
        drawn = F.col("key").isin([r["key"] for r in state.where(piece & at_edge).select("key").orderBy("key").limit(want).collect()])
    else:
        steps = 1 << 40
        drawn = F.pmod(F.xxhash64("key"), F.lit(steps)) < int((want - 3 * want**0.5) / lengths[edge] * steps)
    opens = piece & ((F.col("size") > edge) | (at_edge & drawn))
    new = state.where(opens)
    done.append(new.select("key", F.col("key").alias("bin"), F.lit(0).cast("long").alias("offset")))
    new = new.select((capacity - F.col("size")).alias("size"), F.lit(GAP).alias("kind"), "key")
    return state.where(~opens).union(new), state.where(opens).count()


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Documents as token pieces placed in sequences of at most ``capacity`` tokens.

    A document is the ids of its text followed by id 1; only longer ones are cut. Returns doc_id, piece, start, length,
    ids_crc32 (little-endian 32-bit ids), sequence_id and offset. ``vocabulary`` is the path of a tokenizer
    file that every executor can read.

    Null and empty texts are the single id 1. Repeated rows and ids are packed as documents of their own; rows without an
    id are packed too. No rows give no rows. Other columns are ignored. Memory per task: one text's ids, or the
    keys and sizes of one range (about ``RANGE_ROWS`` rows).
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    pieces = rows.mapInArrow(_pieces(vocabulary, capacity), f"key long, id {kind}, piece int, start long, length long, ids_crc32 long")
    pieces = stage(pieces, "pieces")
    placed = pack_pieces(pieces, capacity)
    return pieces.join(placed, "key").select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
