"""Ranked lexical search in the manner of LEMP: impact vectors in buckets by length.

A document is the vector of its terms' impacts, a query the vector of its terms' weights, a score their product.
Documents keep the terms that some query has, and are put in buckets of up to ``BUCKET_ROWS``, longest vectors first. A
query goes through the buckets of a cell in this order with the score of its last place:

1. Cauchy and Schwarz: if the query's length times the bucket's greatest length is below that score, this bucket and all
   shorter ones are left out.
2. Coordinate bounds: a term adds at most its weight times its greatest impact in the bucket. Documents without the terms
   of greatest bound cannot reach the score if all other bounds sum up to less; of the others those are left whose
   score so far, with the rest of both vectors bounded by coordinates and by length, reaches it.
3. The survivors are scored exactly in integers, ties by document id.

Term vectors are made where the texts lie and written once; statistics are aggregates of them. Buckets are made in place
and shuffled once to meet the groups of queries; a cell returns the best rows of each query. Terms are 64-bit hashes; a
bitmap of ``BITS`` bits of the queries' terms, the same size for any number of them, keeps most other terms out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from propensia.llm.cells import Best, best_of_each, meet, table_of
from propensia.llm.tokens import blocks, words
from propensia.session import stage

BITS = 1 << 23
BUCKET_ROWS = 2048
BUCKET_ENTRIES = 1 << 19
CELL = 8
QUERIES = 512
SLACK = 1 + 1e-9
NO_ID = (1 << 63) - 1
TERMS = "id long, n long, terms array<long>, counts array<int>"


def _counted(bitmap: bytes | None):
    """Per text its number of terms, and each of those in the bitmap with its occurrences."""
    bits = None if bitmap is None else np.frombuffer(bitmap, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                found = words(block, "alnum")
                hashes, row = found.hashes, found.row
                if bits is not None:
                    at = hashes & np.uint64(BITS - 1)
                    keep = (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
                    hashes, row = hashes[keep], row[keep]
                order = np.lexsort((hashes, row))
                hashes, row = hashes[order], row[order]
                first = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])])[: len(hashes)])
                counts = np.diff(np.append(first, len(hashes)))
                cuts = pa.array(np.searchsorted(row[first], np.arange(block.rows + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(block.first, block.rows), pa.array(np.diff(found.bounds)),
                    pa.ListArray.from_arrays(cuts, pa.array(hashes[first].view(np.int64))), pa.ListArray.from_arrays(cuts, pa.array(counts, pa.int32())),
                ], ["id", "n", "terms", "counts"])

    return run


def _bitmap(terms: DataFrame) -> bytes:
    """``BITS`` bits, that of each term's low bits set; made by Spark in parts of 4 KB."""
    bit = F.col("term").bitwiseAND(F.lit(BITS - 1)) + 1
    parts = terms.groupBy(F.bitmap_bucket_number(bit).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    out = bytearray(BITS // 8)
    for part, bits in parts.collect():  # BITS / 32768 rows at most
        out[(part - 1) * 4096 : (part - 1) * 4096 + len(bits)] = bits
    return bytes(out)


_PACKED = "part long, bucket long, length double, ids array<long>, terms binary, bounds binary, rows binary, impacts binary, lengths binary"


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors by falling length to buckets, one row each, their entries by term."""
    part, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        lists = batch.column("terms")
        bounds = lists.offsets.to_numpy()
        terms, impacts = lists.values.to_numpy(), batch.column("impacts").values.to_numpy()
        lengths, at = batch.column("length").to_numpy(), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + BUCKET_ENTRIES, "right")) - 1)
            to = min(to, at + BUCKET_ROWS, batch.num_rows)
            own = slice(bounds[at], bounds[to])
            row = np.repeat(np.arange(to - at, dtype=np.int32), np.diff(bounds[at : to + 1]))
            order = np.argsort(terms[own], kind="stable")
            by, first = np.unique(terms[own][order], return_index=True)
            cells = [
                by.tobytes(), np.append(first, len(order)).astype("<i4").tobytes(), row[order].tobytes(),
                impacts[own][order].astype("<i4").tobytes(), lengths[at:to].tobytes(),
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([number]), pa.array([float(lengths[at])]), pa.array([batch.column("id").slice(at, to - at).to_pylist()], pa.list_(pa.int64())), *[pa.array([c], pa.binary()) for c in cells]],
                ["part", "bucket", "length", "ids", "terms", "bounds", "rows", "impacts", "lengths"],
            )
            number, at = number + 1, to


class Bucket:
    """Documents of like length; per term its documents (rising) and impacts, and the greatest of these."""

    def __init__(self, length: float, ids: list, terms: bytes, bounds: bytes, rows: bytes, impacts: bytes, lengths: bytes):
        self.length, self.ids = length, np.array([NO_ID if i is None else i for i in ids], np.int64)
        self.terms, self.bounds = np.frombuffer(terms, np.int64), np.frombuffer(bounds, "<i4")
        self.rows, self.impacts = np.frombuffer(rows, "<i4"), np.frombuffer(impacts, "<i4").astype(np.int64)
        self.squares = np.frombuffer(lengths) ** 2
        self.most = np.maximum.reduceat(self.impacts, self.bounds[:-1]) if len(self.terms) else np.zeros(0, np.int64)

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best) -> None:
        """Adds the documents that have a place to ``best``; lengths have been compared."""
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        there = self.terms[at] == terms
        at, weights = at[there], weights[there]
        bound = weights * self.most[at]
        need = best.needed()
        if bound.sum() < need:
            return
        order = np.argsort(-bound, kind="stable")
        at, weights = at[order], weights[order]
        rest = np.append(np.cumsum(bound[order][::-1])[::-1], 0)  # of the terms from each place on
        focus = int(np.argmax(rest < need))
        scores, squares = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids))
        seen = np.zeros(len(self.ids), bool)
        for i in range(focus):
            own = slice(self.bounds[at[i]], self.bounds[at[i] + 1])
            rows, impacts = self.rows[own], self.impacts[own]
            scores[rows] += weights[i] * impacts
            squares[rows] += impacts.astype(np.float64) ** 2
            seen[rows] = True
        rows = np.flatnonzero(seen)
        left = np.sqrt(np.maximum(self.squares[rows] - squares[rows], 0) * float((weights[focus:].astype(np.float64) ** 2).sum()))
        rows = rows[scores[rows] + np.minimum(left * SLACK + 1, rest[focus]) >= need]
        found = scores[rows]
        for i in range(focus, len(at)):
            own = slice(self.bounds[at[i]], self.bounds[at[i] + 1])
            place = np.searchsorted(self.rows[own], rows)
            place[place == own.stop - own.start] = 0
            found += np.where(self.rows[own][place] == rows, weights[i] * self.impacts[own][place], 0)
        best.add(found, self.ids[rows])


def _search(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = sorted(left.to_pylist(), key=lambda b: -b["length"])
        buckets = [Bucket(*[b[c] for c in ("length", "ids", "terms", "bounds", "rows", "impacts", "lengths")]) for b in rows]
        out = []
        for query in right.to_pylist():
            terms, weights = np.array(query["terms"], np.int64), np.array(query["weights"], np.int64)
            length = float(np.sqrt((weights.astype(np.float64) ** 2).sum())) * SLACK
            best = Best(k, low=1)
            for bucket in buckets:
                if length * bucket.length + 1 < best.needed():
                    break
                bucket.search(terms, weights, best)
            out += [(query["key"], None if i == NO_ID else i, s) for i, s in zip(best.ids.tolist(), best.scores.tolist())]
        return table_of(out, ["key", "id", "score"])

    return run


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", cell: int = CELL,
) -> DataFrame:
    """The ``k`` best documents of every item: item_id, rank (from 1), doc_id, score.

    Terms are runs of ASCII letters, digits and all other characters over 0x7F, A-Z lower-cased. With N the documents that
    have a term, L all terms, n those of a document, df a term's documents and tf its occurrences in one: a term weighs
    floor(1000 ln((2N+2)/(2df+1))), a document's m is 10 + (90 n N) div L, and its score sums weight *
    (10^9 tf div (1000 tf + 8 m)) over the item's terms, once each. Only scores above 0 count; equal ones go by rising id.

    Null and empty texts have no terms: such items return nothing. Every row is a document or an item of its own, repeated
    rows and ids included; a document without an id comes after equals and is returned with a null id. Ids are integers
    (any type for items) below 2^63 - 1. No rows give no rows. Other columns are ignored. Memory per task: one
    text, or a cell of ``cell`` buckets of about half a million entries and the terms of ``QUERIES`` items.
    """
    items = stage(items.select(F.monotonically_increasing_id().alias("key"), F.col(item_col).alias("item"), F.col(item_text_col).alias("text")), "items")
    asked = items.select(F.col("key").alias("id"), "text").mapInArrow(_counted(None), TERMS)
    asked = stage(asked.select(F.col("id").alias("key"), F.explode("terms").alias("term")), "asked")
    bitmap = _bitmap(asked)
    counted = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_counted(bitmap), TERMS)
    counted = stage(counted, "terms")
    n, total = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()

    held = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1)))
    weighted = asked.join(held, "term").select("key", F.struct("term", weight.alias("weight")).alias("entry"))
    queries = weighted.groupBy("key").agg(F.array_sort(F.collect_list("entry")).alias("entries"))
    queries = stage(queries.select("key", F.col("entries.term").alias("terms"), F.col("entries.weight").alias("weights")), "queries")

    m = F.expr(f"10 + (90L * n * {n}L) div {max(total, 1)}L")
    impacts = F.expr("transform(counts, t -> cast((1000000000L * t) div (1000L * t + 8L * m) as int))")
    length = F.sqrt(F.aggregate("impacts", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    vectors = counted.where(F.size("terms") > 0).withColumn("m", m).select("id", "terms", impacts.alias("impacts")).withColumn("length", length)
    packed = stage(vectors.sortWithinPartitions(F.col("length").desc()).mapInArrow(_buckets, _PACKED), "buckets")

    # a shard has whole partitions, and with them all lengths
    n_buckets, n_parts, n_queries = *packed.agg(F.count("*"), F.count_distinct("part")).first(), queries.count()
    shards, groups = max(1, min(n_parts, -(-n_buckets // cell))), max(1, -(-n_queries // QUERIES))
    left = packed.withColumn("shard", F.pmod("part", F.lit(shards)).cast("int")).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = queries.withColumn("grp", F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    met = meet(left.drop("part", "bucket"), right, shards * groups, _search(k), "key long, id long, score long")
    found = best_of_each(met, ["key"], k)
    return found.join(items.select("key", "item"), "key").select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
