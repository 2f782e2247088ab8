"""Near-duplicate documents: universal hash minima, bands, verification on full sets, components.

1. Every text becomes its set of distinct 5-word shingles (64-bit hashes), 128 minima of universal hashes
   ``a*x + b mod 2**64`` and a 128-bit digest of the whole set.
2. Documents with equal sets are one node, the smallest id among them. So copies cost one row each.
3. 32 bands of 4 minima: nodes that agree on a band share a bucket. Each is tied to the smallest node of the
   bucket, never to all of them; components of these ties (a superset of the true ones) are the candidate groups.
   A pair at similarity 0.75 misses all bands with probability (1 - 0.75**4)**32 = 5e-6.
4. The sets of a candidate group meet in blocks of bounded size, every pair of blocks once. Pairs whose minima agree
   in 72 of 128 places (5e-7 of the pairs at 0.75 do not) and which are not yet tied are compared on full sets.
   Only a spanning forest of the links found in a block pair is returned.
5. Components of the links.

A group of near copies that holds a large share of all rows is spread over many block pairs; its rows are
copied once per block of the group, no pair is ever a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from propensia.llm.graph import components
from propensia.llm.tokens import BASE, Block, blocks, grams, mix, words
from propensia.session import stage

SHINGLE = 5
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
AGREE = 72
BLOCK_SHINGLES, BLOCK_ROWS = 1 << 20, 128

_draw = np.random.Generator(np.random.PCG64(1997))
FACTORS = _draw.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _draw.integers(0, 2**63, HASHES, dtype=np.uint64)


def shingle_sets(block: Block, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes per row; a text of 1 to k-1 words is one shingle, one without words has none."""
    w = words(block)
    whole = grams(w.hashes, k)
    sets = []
    for lo, hi in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist()):
        if hi - lo >= k:
            sets.append(np.unique(whole[lo : hi - k + 1]))
        elif hi > lo:
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for x in w.hashes[lo:hi]:
                    h = h * BASE + x
            sets.append(mix(np.array([h]), hi - lo))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """The upper 32 bits of every hash's minimum per set, as signed integers; zeros for an empty set."""
    out = np.zeros((len(sets), HASHES), np.int32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[i] for i in full])
        at = np.cumsum([0] + [len(sets[i]) for i in full[:-1]])
        for j in range(HASHES):
            least = np.minimum.reduceat(flat * FACTORS[j] + SHIFTS[j], at)
            out[full, j] = (least >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column(1)):
            sets = shingle_sets(block)
            sketch = pa.array(minima(sets).reshape(-1))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(block.first, block.rows),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([_digest(s) for s in sets], pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * HASHES, pa.int32()), sketch),
            ], ["id", "n", "digest", "sketch"])


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles, digest_size=16).digest()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column("text")):
            sets = shingle_sets(block)
            yield pa.RecordBatch.from_arrays([
                batch.column("id").slice(block.first, block.rows),
                pa.array([_digest(s) for s in sets], pa.binary()),
                pa.array([s.tobytes() for s in sets], pa.binary()),
            ], ["id", "digest", "shingles"])


def similar(a: np.ndarray, b: np.ndarray, num: int = 75, den: int = 100) -> bool:
    """Whether two sorted sets have den * intersection >= num * union."""
    if len(a) * num > len(b) * den or len(b) * num > len(a) * den:
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int(np.count_nonzero(large[at] == small))
    return den * both >= num * (len(a) + len(b) - both)


def _forest(ids: list, sides: np.ndarray, sketches: np.ndarray, sets: list[np.ndarray]) -> list[tuple]:
    """A spanning forest of the links between rows of side 0 and 1 (all are of side 2: among themselves)."""
    parent = np.arange(len(ids))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    size = np.array([len(s) for s in sets])
    links = []
    for i in range(len(ids) - 1):
        agree = np.count_nonzero(sketches[i + 1 :] == sketches[i], axis=1) >= AGREE
        near = (sides[i + 1 :] != sides[i]) | (sides[i] == 2)
        for j in np.flatnonzero(agree & near & (size[i + 1 :] * 100 >= size[i] * 75) & (size[i] * 100 >= size[i + 1 :] * 75)) + i + 1:
            a, b = find(i), find(int(j))
            if a != b and similar(sets[i], sets[j]):
                parent[max(a, b)] = min(a, b)
                links.append((ids[i], ids[int(j)]))
    return links


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group, left and right block; one pair of blocks is held at a time."""
    key, held = None, []

    def flush() -> Iterator[pa.RecordBatch]:
        if len(held) > 1:
            links = _forest([r[0] for r in held], np.array([r[1] for r in held]), np.stack([r[2] for r in held]), [r[3] for r in held])
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])

    for batch in batches:
        c = {n: batch.column(n) for n in batch.schema.names}
        sketches = np.asarray(c["sketch"].flatten()).reshape(-1, HASHES)
        keys = list(zip(c["grp"].to_pylist(), c["left"].to_pylist(), c["right"].to_pylist()))
        ids, sides = c["id"].to_pylist(), c["side"].to_pylist()
        for i, k in enumerate(keys):
            if k != key:
                yield from flush()
                key, held = k, []
            raw = c["shingles"][i].as_py()
            if held and held[-1][0] == ids[i] and held[-1][4] == raw:
                continue  # a repeated row
            held.append((ids[i], sides[i], sketches[i].copy(), np.frombuffer(raw, np.uint64), raw))
    yield from flush()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Component of near-duplicate documents for every row.

    Returns doc_id, n_shingles, component_id (smallest id reachable over links, itself included) and kept
    (doc_id = component_id). Two documents are linked if 100 * intersection >= 75 * union of their shingle sets.

    Null and empty texts and those without words have no shingle and no link. A row without an id gets a null
    component, is kept and links nothing. Rows are judged by their own text even where they share an id; if that id is
    the smallest of several sets, these sets are one node. Repeated rows come back repeated. No rows give no rows.
    Other columns are ignored. Memory per task: one text, or one pair of blocks (128 documents and about a million
    shingles each, more only where a single set is larger).
    """
    found = _judged(docs, id_col, text_col)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept")


def _judged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n, digest, component and kept of every row; rows of an id are told apart by the digest of their set."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketch = stage(rows.mapInArrow(_sketch, "id long, n long, digest binary, sketch array<int>"), "sketch")
    sets = sketch.where((F.col("n") > 0) & F.col("id").isNotNull()).groupBy("digest").agg(
        F.min("id").alias("node"), F.max("id").alias("last"), F.first("n").alias("n"), F.first("sketch").alias("sketch")
    )
    sets = stage(sets, "sets")

    bands = F.array(*[F.xxhash64(F.lit(b), F.slice("sketch", b * ROWS + 1, ROWS)) for b in range(BANDS)])
    entries = sets.select("node", F.explode(bands).alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most")
    shared = stage(shared.select("bucket", "least"), "buckets")
    ties = entries.join(shared, "bucket").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    groups = components(ties).select("node", F.col("component").alias("grp"))

    members = stage(sets.join(groups, "node").select(F.col("node").alias("id"), "digest", "n", "sketch", "grp"), "members")
    parts = F.ceil(F.greatest(F.sum("n") / F.lit(BLOCK_SHINGLES), F.count("*") / F.lit(BLOCK_ROWS)))
    size = stage(members.groupBy("grp").agg(parts.cast("long").alias("parts")), "size")
    placed = members.join(size, "grp").withColumn("part", F.pmod(F.xxhash64("id", "digest"), "parts"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select(
        "id", "digest", "grp", "sketch", F.least("part", "other").alias("left"), F.greatest("part", "other").alias("right"),
        F.when(F.col("part") == F.col("other"), 2).when(F.col("part") < F.col("other"), 0).otherwise(1).alias("side"),
    )
    texts = rows.join(members.select("id").distinct(), "id").mapInArrow(_sets, "id long, digest binary, shingles binary")
    met = stage(met.join(texts, ["id", "digest"]).select("grp", "left", "right", "side", "id", "sketch", "shingles"), "met")
    met = met.repartitionByRange("grp", "left", "right").sortWithinPartitions("grp", "left", "right", "id")
    joined = components(met.mapInArrow(_links, "a long, b long"))

    reached = sets.select("digest", "node", "last").join(joined, "node", "left")
    reached = reached.where("component is not null or node < last").select("digest", F.coalesce("component", "node").alias("component"))
    found = sketch.select("id", "n", "digest").join(stage(reached, "reached"), "digest", "left")
    component = F.when(F.col("id").isNull(), None).when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id"))
    found = found.select("id", "n", "digest", component.alias("component"))
    return found.withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(True)))


def _with_digest(column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(column)):
                digests = pa.array([_digest(s) for s in shingle_sets(block)], pa.binary())
                rows = batch.slice(block.first, block.rows)
                yield pa.RecordBatch.from_arrays([*rows.columns, digests], [*rows.schema.names, "digest"])

    return run


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component stays, with all columns of ``docs``; see ``near_duplicates``.

    Rows without an id stay. Rows are removed by their own verdict: where rows of one id have different texts, only
    those go whose text is linked to a smaller id. Null and empty texts stay, repeated rows share their verdict, no rows
    give no rows.
    """
    verdicts = stage(_judged(docs, id_col, text_col).where("id is not null").select("id", "digest", "kept").distinct(), "verdicts")
    ids = verdicts.groupBy("id").agg(F.count_if(~F.col("kept")).alias("gone"), F.count_if("kept").alias("stay")).where("gone > 0")
    ids = stage(ids, "gone")
    key = docs[id_col].cast("long")
    gone, split = ids.where("stay = 0"), ids.where("stay > 0").select("id")
    left = docs.join(gone, key == gone["id"], "left_anti")
    if split.isEmpty():
        return left.select(docs.columns)
    judged = verdicts.where(~F.col("kept")).join(split, "id").select("id", "digest")
    odd = left.join(split, key == split["id"], "left_semi")
    schema = T.StructType([*[T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)], T.StructField("digest", T.BinaryType())])
    at = docs.columns.index(id_col)
    odd = odd.toDF(*schema.names[:-1]).mapInArrow(_with_digest(docs.columns.index(text_col)), schema)
    odd = odd.join(judged, (odd[f"c{at}"].cast("long") == judged["id"]) & (odd["digest"] == judged["digest"]), "left_anti")
    even = left.join(split, key == split["id"], "left_anti").select(docs.columns)
    return even.union(odd.drop("digest")).select(docs.columns)
