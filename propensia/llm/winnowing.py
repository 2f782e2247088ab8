"""Benchmark decontamination by winnowing.

A text's fingerprints are the smallest hash of 5 consecutive words in every run of 9 such hashes; so any two
texts that share 13 consecutive words share a fingerprint at the same place of that span (an item of fewer words
is its own single fingerprint). Test items' fingerprints are looked up for every document in its task; a hit is
extended word by word on both sides and counts where it covers a whole window of the item.

The index of test items is sent to the executors in parts of at most ``PART_BYTES`` of text, however large the
benchmark is; documents are scanned once per part and never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from propensia.llm.tokens import Words, blocks, grams, mix, words
from propensia.session import stage

WINDOW, GRAM = 13, 5
PART_BYTES = 32 << 20


def stream(w: Words, seed: int) -> np.ndarray:
    """Word hashes with a value of its own between rows; word i of row r is at i + r + 1."""
    out = mix(np.arange(len(w.hashes) + len(w.bounds), dtype=np.uint64), seed)
    out[np.arange(len(w.hashes)) + w.row + 1] = w.hashes
    return out


def picks(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places of the leftmost minimum of every ``width`` consecutive hashes."""
    if width == 1 or len(hashes) < width:
        return np.arange(len(hashes) if width == 1 else 0)
    rows = np.lib.stride_tricks.sliding_window_view(hashes, width)
    at = np.arange(len(rows)) + rows.argmin(axis=1)
    return at[np.flatnonzero(np.diff(at, prepend=-1))]


class Prints(NamedTuple):
    """Fingerprints of items whose windows have ``window`` words: sorted hashes, place in the item stream, filter."""

    window: int
    gram: int
    hashes: np.ndarray
    places: np.ndarray
    seen: np.ndarray


class Index(NamedTuple):
    """Item ids, the words of all items in one stream, each place's item, and the fingerprints by window length."""

    items: list[str]
    stream: np.ndarray
    owner: np.ndarray
    prints: list[Prints]


def build_index(ids: list, texts: list, window: int = WINDOW, gram: int = GRAM) -> Index:
    """Index of some test items; items without words are left out of the fingerprints."""
    streams, owners, found = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], {}
    base = 0
    for block in blocks(pa.array(texts, pa.string())):
        w = words(block, "alnum")
        s = stream(w, 0x5EED)
        rows, lengths = np.arange(block.rows), np.diff(w.bounds)
        owner = np.repeat(rows, lengths + 1)
        owner = np.append(owner, block.rows - 1) + block.first
        streams.append(s)
        owners.append(owner)
        size = np.minimum(lengths, window)[owner - block.first]
        for length in set(np.minimum(lengths, window).tolist()) - {0}:
            k = gram if length == window else length
            g = grams(s, k)
            at = picks(g, length - k + 1)
            at = at[size[at + k - 1] == length]
            found.setdefault(length, []).append((g[at], at + base))
        base += len(s)
    prints = []
    for length, parts in sorted(found.items()):
        hashes, places = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(hashes, kind="stable")
        seen = np.zeros(1 << 20, bool)
        seen[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        prints.append(Prints(length, gram if length == window else length, hashes[order], places[order], seen))
    return Index([str(i) if i is not None else "" for i in ids], np.concatenate(streams), np.concatenate(owners), prints)


def occurrences(index: Index, s: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first place, place after, item) of document stretches made of whole windows of an item."""
    for p in index.prints:
        g = grams(s, p.gram)
        reach = p.window - p.gram
        at = picks(g, reach + 1)
        at = at[p.seen[(g[at] & np.uint64(len(p.seen) - 1)).astype(np.int64)]]
        lo, hi = np.searchsorted(p.hashes, g[at], "left"), np.searchsorted(p.hashes, g[at], "right")
        n = hi - lo
        mine = np.repeat(at, n)
        theirs = p.places[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
        same = np.ones(len(mine), bool)
        for i in range(p.gram):
            same &= s[mine + i] == index.stream[theirs + i]
        mine, theirs = mine[same], theirs[same]
        reached = []
        for step, start in ((-1, -1), (1, p.gram)):
            far, going = np.zeros(len(mine), np.int64), np.ones(len(mine), bool)
            for i in range(reach):
                a, b = mine + start + step * i, theirs + start + step * i
                inside = (a >= 0) & (a < len(s)) & (b >= 0) & (b < len(index.stream))
                going &= inside & (s[np.where(inside, a, 0)] == index.stream[np.where(inside, b, 0)])
                far += going
            reached.append(far)
        whole = reached[0] + p.gram + reached[1] >= p.window
        yield (mine - reached[0])[whole], (mine + p.gram + reached[1])[whole], index.owner[theirs[whole]]


def _scan(index: Index, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row")
            for block in blocks(rows.field(text)):
                w = words(block, "alnum")
                s = stream(w, 0xD0C5)
                cover, pairs = np.zeros(len(s) + 1, np.int32), set()
                owner = np.append(np.repeat(np.arange(block.rows), np.diff(w.bounds) + 1), 0)
                for start, end, item in occurrences(index, s):
                    np.add.at(cover, start, 1)
                    np.add.at(cover, end, -1)
                    pairs.update(zip(owner[start].tolist(), item.tolist()))
                hit = np.cumsum(cover) > 0
                items: list[set] = [set() for _ in range(block.rows)]
                for row, item in pairs:
                    items[row].add(index.items[item])
                marks, names, counts = [], [], []
                before = batch.column("hits").slice(block.first, block.rows), batch.column("items").slice(block.first, block.rows)
                for row in range(block.rows):
                    lo, hi = int(w.bounds[row]) + row + 1, int(w.bounds[row + 1]) + row + 1
                    own = hit[lo:hi]
                    if before[0][row].is_valid:
                        own = own | np.unpackbits(np.frombuffer(before[0][row].as_py(), np.uint8), count=hi - lo).astype(bool)
                    counts.append((hi - lo, int(own.sum())))
                    marks.append(np.packbits(own).tobytes() if counts[-1][1] else None)
                    names.append(sorted(items[row] | set(before[1][row].as_py() or ())))
                yield pa.RecordBatch.from_arrays([
                    rows.slice(block.first, block.rows), pa.array(marks, pa.binary()), pa.array(names, pa.list_(pa.string())),
                    pa.array([c[0] for c in counts], pa.int64()), pa.array([c[1] for c in counts], pa.int64()),
                    pa.array([hashlib.sha256(",".join(n).encode()).hexdigest() for n in names], pa.string()),
                ], ["row", "hits", "items", "n_words", "n_hit", "items_sha256"])

    return run


def _scanned(docs: DataFrame, items: DataFrame, text_col: str, item_col: str, item_text: str) -> DataFrame:
    spark = docs.sparkSession
    tests = items.select(F.col(item_col).cast("string").alias("id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    parts = -(-(tests.agg(F.sum(F.octet_length("text"))).first()[0] or 1) // PART_BYTES)
    found = docs.select(F.struct("*").alias("row"), F.lit(None).cast("binary").alias("hits"), F.lit(None).cast("array<string>").alias("items"))
    shape = T.StructType(found.schema.fields[:1]).add("hits", "binary").add("items", T.ArrayType(T.StringType()))
    shape = shape.add("n_words", "long").add("n_hit", "long").add("items_sha256", "string")
    for part in range(parts):
        mine = tests if parts == 1 else tests.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part)
        mine = mine.toArrow()
        index = build_index(mine.column("id").to_pylist(), mine.column("text").to_pylist())
        sent = spark.sparkContext.broadcast(index)
        found = found.select("row", "hits", "items").mapInArrow(lambda b, sent=sent: _scan(sent.value, text_col)(b), shape)
        if part < parts - 1:
            found = stage(found, "scanned")
    return found


def _report() -> list:
    n, hit = F.col("n_words"), F.col("n_hit")
    return [n, hit, F.size("items").cast("long").alias("n_items"), F.col("items_sha256"), ((hit > 0) & (20 * hit >= n)).alias("contaminated"), F.col("items")]


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """What each document shares with the test items.

    Returns the id, n_words, n_hit (words inside an occurrence of 13 consecutive item words, or of a whole shorter
    item), n_items, items_sha256 (of the sorted, comma-joined ids), contaminated (at least a twentieth of the words
    are hit) and items. Lower-cases A-Z; words are runs of letters, digits and everything beyond ASCII.

    Null and empty texts have no words and are clean. Repeated rows come back repeated; items of one id count once, an
    item without id is listed as an empty string, one without words matches nothing. No documents give no rows, no
    items make all documents clean. Other columns are ignored. Memory per task: one text and one part of the index.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return _scanned(docs, benchmark, "text", item_col, item_text).select(F.col("row.id").alias(id_col), *_report())


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that are not contaminated, with all their columns (whatever they are called)."""
    found = _scanned(docs, benchmark, text_col, item_col, item_text)
    return found.where(~_report()[4]).select("row.*")
