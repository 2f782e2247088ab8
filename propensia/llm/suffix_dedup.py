"""Removal of long byte strings that occur more than once, by hash-compared suffix sorting.

Two equal strings of ``LENGTH`` bytes have the same smallest hash of ``GRAM`` bytes. So every place of a text belongs to the
bucket of the smallest such hash of the string that starts there, and consecutive places with one hash are a run.

1. Runs whose hash occurs once in the corpus hold unique strings. Runs that are equal as a whole (hash of all their bytes)
   are repeated as a whole.
2. The others' bytes, and those of one of each set of equal runs, are sent to their bucket's task, where all suffixes are sorted: by their first eight bytes, then by a
   mergesort whose comparisons find the common extension of two suffixes by binary search over prefix polynomial hashes.
   Neighbours with a common extension of ``LENGTH`` are equal; that is verified on the bytes.
3. Runs of a bucket of more than ``FINE_STRINGS`` strings are cut once more, by the smallest hash of ``FINE_GRAM`` bytes. A
   bucket that still has more than ``BUCKET_STRINGS`` is not gathered: each of its strings is a row of two hashes, and
   equal rows are counted before and after the shuffle.

Texts are named by 128 bits of their SHA-256; equal texts are looked at once, and wholly removed if long enough.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from propensia.llm.tokens import Block, blocks, mix, powers, prefix_hashes, sliding_min
from propensia.session import stage

LENGTH, GRAM, FINE_GRAM = 400, 200, 380
FINE_STRINGS, BUCKET_STRINGS = 500_000, 1_000_000
PIECE = 16 << 20
TASK_SUFFIXES = 500_000


def runs(data: np.ndarray, bounds: np.ndarray, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, first place, last place, hash, hash of all bytes, again) of the runs of texts laid end to end.

    A place is where a string of ``LENGTH`` bytes starts; places are counted from the start of ``data``. ``again`` marks
    runs that hold their hash more than once, as only these may hold equal strings within.
    """
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none, none, none.astype(bool)
    sums = prefix_hashes(data)
    back = powers(len(data))[1]
    n, window = len(data) - gram + 1, LENGTH - gram + 1
    grams = mix((sums[gram:] - sums[:-gram]) * back[:n])
    least = sliding_min(grams, window)
    row = np.searchsorted(bounds, np.arange(len(least)), "right") - 1
    inside = np.arange(len(least)) + LENGTH <= bounds[np.minimum(row + 1, len(bounds) - 1)]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    if not len(first):
        return none, none, none, none, none, none.astype(bool)
    edge = np.flatnonzero(new | ~inside)
    after = np.append(edge, len(least))[np.searchsorted(edge, first, "right")]
    last = after - 1
    whole = mix((sums[last + LENGTH] - sums[first]) * back[first], 1) ^ mix((last - first).astype(np.uint64), 2)
    view = np.lib.stride_tricks.sliding_window_view(grams, window)
    left = first + (view[first] == least[first, None]).argmax(axis=1)
    right = last + window - 1 - (view[last][:, ::-1] == least[first, None]).argmax(axis=1)
    return row[first], first, last, least[first].view(np.int64), whole.view(np.int64), left != right


def _pieces(block: Block) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Blocks as they are; a very long text in overlapping pieces, so that each place is in one of them."""
    if block.rows > 1 or len(block.data) <= PIECE:
        yield block.data, block.bounds, 0
        return
    for at in range(0, len(block.data) - LENGTH + 1, PIECE):
        part = block.data[at : at + PIECE + LENGTH - 1]
        yield part, np.array([0, len(part)]), at


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.column("tid")
        for block in blocks(batch.column("text")):
            for data, bounds, at in _pieces(block):
                row, first, last, key, whole, again = runs(data, bounds)
                start = first - bounds[row] + at
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(block.first + row)), pa.array(start), pa.array(start + last - first), pa.array(key), pa.array(whole), pa.array(again)],
                    ["tid", "first", "last", "key", "whole", "again"],
                )


class Suffixes:
    """Strings of ``LENGTH`` bytes at places of a byte array, compared through prefix hashes."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at, self.sums = data, at, prefix_hashes(data)
        self.back = powers(len(data))[1]

    def hashes(self, i: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        a = self.at[i]
        return (self.sums[a + n] - self.sums[a]) * self.back[a]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common extension, at most ``LENGTH``."""
        out = np.full(len(i), LENGTH)
        short = np.flatnonzero(self.hashes(i, LENGTH) != self.hashes(j, LENGTH))
        i, j = i[short], j[short]
        low, high = np.zeros(len(i), np.int64), np.full(len(i), LENGTH - 1)
        for _ in range(LENGTH.bit_length()):
            middle = (low + high + 1) >> 1
            same = self.hashes(i, middle) == self.hashes(j, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
            high = np.maximum(low, high)
        out[short] = low
        return out

    def less(self, i: np.ndarray, j: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        n = self.common(i, j)
        end = np.minimum(n, LENGTH - 1)
        return np.where(n >= LENGTH, or_equal, self.data[self.at[i] + end] < self.data[self.at[j] + end])

    def sorted(self, group: np.ndarray) -> np.ndarray:
        """Order of the suffixes within their groups; ``group`` is rising and its members may be in any order."""
        order = np.arange(len(group))
        starts = np.flatnonzero(np.diff(group, prepend=group[0] - 1)) if len(group) else order
        size = np.diff(np.append(starts, len(group)))
        begin, count = np.repeat(starts, size), np.repeat(size, size)
        place = np.arange(len(group)) - begin
        width = 1
        while len(size) and width < size.max():
            run = place // width
            other = (run ^ 1) * width
            n = np.clip(count - other, 0, width)
            # rank of every suffix in its sibling run: those less than it, for the right run those not greater
            active = np.flatnonzero(n > 0)
            low, high = np.zeros(len(group), np.int64), n.copy()
            right = (run & 1).astype(bool)
            for _ in range(width.bit_length()):
                active = active[low[active] < high[active]]
                if not len(active):
                    break
                middle = (low[active] + high[active]) >> 1
                theirs = order[begin[active] + other[active] + middle]
                before = self.less(theirs, order[active], right[active])
                low[active] = np.where(before, middle + 1, low[active])
                high[active] = np.where(before, high[active], middle)
            target = begin + (run >> 1) * 2 * width + place - run * width + low
            merged = np.empty_like(order)
            merged[target] = order
            order = merged
            width *= 2
        return order


def repeated(data: np.ndarray, at: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Which of the strings at places ``at`` are equal to another one of their bucket."""
    out = np.zeros(len(at), bool)
    if not len(at):
        return out
    lead = np.zeros(len(at), np.uint64)
    for k in range(8):
        lead = (lead << np.uint64(8)) | data[at + k].astype(np.uint64)
    order = np.lexsort((lead, bucket))
    same = (bucket[order][1:] == bucket[order][:-1]) & (lead[order][1:] == lead[order][:-1])
    tied = np.zeros(len(at), bool)
    tied[1:] |= same
    tied[:-1] |= same
    group = np.cumsum(np.concatenate([[True], ~same]))[tied]
    which = order[tied]
    if not len(which):
        return out
    suffixes = Suffixes(data, at[which])
    ranked = suffixes.sorted(group)
    a, b = ranked[:-1], ranked[1:]
    equal = group[1:] == group[:-1]
    i = np.flatnonzero(equal)
    i = i[suffixes.hashes(a[i], LENGTH) == suffixes.hashes(b[i], LENGTH)]
    pa_, pb = at[which[a[i]]], at[which[b[i]]]
    # equal pairs on a row need one full comparison; each next one only its last byte
    partner = np.full(len(data) + 1, -1, np.int64)
    partner[pa_] = pb
    chained = (pa_ > 0) & (partner[pa_ - 1] == pb - 1) & (pb > 0)
    true = data[pa_ + LENGTH - 1] == data[pb + LENGTH - 1]
    for lo in range(0, len(heads := np.flatnonzero(~chained)), 50_000):
        h = heads[lo : lo + 50_000, None]
        span = np.arange(LENGTH)
        true[h[:, 0]] = (data[pa_[h] + span] == data[pb[h] + span]).all(axis=1)
    if not true.all():
        raise ArithmeticError("two different strings have one hash")
    out[which[a[i]]] = out[which[b[i]]] = True
    return out


def stretches(places: np.ndarray) -> list[tuple[int, int]]:
    """Sorted places of repeated strings as byte spans (start, end)."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > LENGTH)
    return list(zip(places[np.concatenate([[0], cut + 1])].tolist(), (places[np.append(cut, len(places) - 1)] + LENGTH).tolist()))


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, tid, first, bytes) sorted by key; a few whole buckets are held at a time."""
    held: list[tuple[int, bytes, int, bytes]] = []
    size = 0

    def flush(rows: list) -> Iterator[pa.RecordBatch]:
        data = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
        n = np.array([len(r[3]) - LENGTH + 1 for r in rows])
        base = np.concatenate([[0], np.cumsum([len(r[3]) for r in rows])])[:-1]
        owner = np.repeat(np.arange(len(rows)), n)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        keys = np.array([r[0] for r in rows], np.int64)
        hit = repeated(data, base[owner] + offset, keys[owner])
        out: list[tuple[bytes, int, int]] = []
        owner, offset = owner[hit], offset[hit]
        for i in np.unique(owner).tolist():
            out += [(rows[i][1], rows[i][2] + a, rows[i][2] + b) for a, b in stretches(offset[owner == i] if len(rows) < 64 else offset[slice(*np.searchsorted(owner, [i, i + 1]))])]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.int64()))], ["tid", "start", "end"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("key", "tid", "first", "bytes")]
        for row in zip(*columns):
            if held and row[0] != held[-1][0] and size > TASK_SUFFIXES:
                yield from flush(held)
                held, size = [], 0
            if held and row[:3] == held[-1][:3]:
                continue
            held.append(row)
            size += len(row[3]) - LENGTH + 1
    if held:
        yield from flush(held)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the wanted runs; those of hot buckets cut into finer runs with keys of their own."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.binary(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["key", "tid", "first", "bytes"])

    for batch in batches:
        texts, rows, size = batch.column("text").cast(pa.large_binary()), [], 0
        for tid, text, wanted in zip(batch.column("tid").to_pylist(), texts, batch.column("runs")):
            raw = text.as_buffer()
            for r in wanted.as_py():
                part = raw[r["first"] : r["last"] + LENGTH].to_pybytes()
                if not r["hot"]:
                    rows.append((r["key"], tid, r["first"], part))
                else:
                    _, first, last, key, _, _ = runs(np.frombuffer(part, np.uint8), np.array([0, len(part)]), FINE_GRAM)
                    for f, e, k in zip(first.tolist(), last.tolist(), mix(key.view(np.uint64), 3).view(np.int64).tolist()):
                        rows.append((k, tid, r["first"] + f, part[f : e + LENGTH]))
                        size += LENGTH
                size += len(part)
                if size > 8 << 20:
                    yield batch_of(rows)
                    rows, size = [], 0
        if rows:
            yield batch_of(rows)


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two hashes of every string."""
    for batch in batches:
        for tid, first, part in zip(batch.column("tid").to_pylist(), batch.column("first").to_pylist(), batch.column("bytes")):
            data = np.frombuffer(part.as_buffer(), np.uint8)
            n, twice = len(data) - LENGTH + 1, []
            for d in (data, data ^ np.uint8(0x5A)):
                sums = prefix_hashes(d)
                twice.append(mix((sums[LENGTH:] - sums[:-LENGTH]) * powers(len(d))[1][:n]).view(np.int64))
            columns = [pa.array([tid] * n, pa.binary()), *[pa.array(c) for c in (first + np.arange(n), *twice)]]
            yield pa.RecordBatch.from_arrays(columns, ["tid", "first", "h1", "h2"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("text").cast(pa.large_binary()), batch.column("spans")):
            raw, parts, at = text.as_py(), [], 0
            merged: list[list[int]] = []
            for s in sorted((x["start"], x["end"]) for x in spans.as_py()):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            for start, end in merged:
                parts.append(raw[at:start])
                at = end
            kept = b"".join([*parts, raw[at:]])
            spans = [{"start": a, "end": b} for a, b in merged]
            out.append((len(raw) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore"), spans))
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        columns = list(zip(*out)) if out else [()] * 5
        names = ["tid", "n_removed", "n_spans", "kept_sha256", "left", "spans"]
        yield pa.RecordBatch.from_arrays([batch.column("tid"), *[pa.array(c, t) for c, t in zip(columns, types)]], names)


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What is left of each text without bytes covered by a repeated string of ``LENGTH`` bytes.

    Returns the id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the remaining bytes), the remaining
    text (a character that a cut splits is left out) and spans (start and end in bytes). A string counts as repeated if it also starts anywhere else, in any text or the same one.

    A null text is empty; texts under ``LENGTH`` bytes stay whole. Equal texts of that length or more, repeated rows
    included, go wholly. Rows without an id are handled like others. No rows give no rows. Other columns are
    ignored. Memory per task: one text (16 MB of it while hashing) or the runs of one bucket.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("tid", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    copies = stage(rows.where(F.octet_length("text") >= LENGTH).groupBy("tid").agg(F.min("id").alias("rep"), (F.count("*") > 1).alias("copied")), "copies")
    found = stage(rows.select("tid", "text").mapInArrow(_runs, "tid binary, first long, last long, key long, whole long, again boolean"), "runs")

    place = F.xxhash64("tid", "first")
    equal = found.groupBy("key", "whole").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.max(F.col("last") - F.col("first") + 1).alias("n"), F.max("again").alias("again"))
    equal = stage(equal, "equal")
    shared = equal.groupBy("key").agg(F.min("low").alias("l"), F.max("high").alias("h"), F.sum("n").alias("n"), F.max((F.col("low") == F.col("high")) | F.col("again")).alias("open"), F.max("again").alias("again")).where("l < h or again")
    shared = stage(shared.select("key", "open", (F.col("n") > FINE_STRINGS).alias("hot")), "shared")
    marks = equal.join(shared, "key").select("key", "whole", "hot", (F.col("low") < F.col("high")).alias("done"), F.when(F.col("open"), F.col("low")).alias("sent"))
    # of runs that are equal as a whole one goes to the bucket, for those that share only some of its strings
    marked = found.join(stage(marks, "marks"), ["key", "whole"]).withColumn("sent", ~F.col("done") | F.coalesce(F.col("sent") == place, F.lit(False)))
    marked = marked.groupBy("tid", "first").agg(
        F.min("last").alias("last"), F.min("key").alias("key"), F.max("hot").alias("hot"), F.max("done").alias("done"), F.max("sent").alias("sent")
    )
    marked = stage(marked, "marked")

    texts = marked.groupBy("tid").agg(F.collect_list(F.struct("first", "last", "key", "hot", "sent")).alias("runs"))
    texts = texts.join(copies, "tid")
    held = rows.join(texts, "tid").where(F.col("id").eqNullSafe(F.col("rep"))).select("tid", "text", "copied", "runs")
    held = stage(held, "held")
    open_runs = F.filter("runs", lambda r: r["sent"])
    contexts = held.where(F.size(open_runs) > 0).select("tid", "text", open_runs.alias("runs"))
    contexts = stage(contexts.mapInArrow(_contexts, "key long, tid binary, first long, bytes binary"), "contexts")

    span = "tid binary, start long, end long"
    large = contexts.groupBy("key").agg(F.sum(F.octet_length("bytes") - LENGTH + 1).alias("n")).where(F.col("n") > BUCKET_STRINGS).select("key")
    large = stage(large, "large")
    plain = contexts.join(large, "key", "left_anti")
    judged = plain.repartition("key").sortWithinPartitions("key", "tid", "first").mapInArrow(_judged, span)
    strings = contexts.join(large, "key").select("tid", "first", "bytes").mapInArrow(_strings, "tid binary, first long, h1 long, h2 long")
    twice = strings.groupBy("h1", "h2").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low < high").select("h1", "h2")
    hot = strings.join(stage(twice, "twice"), ["h1", "h2"]).select("tid", F.col("first").alias("start"), (F.col("first") + LENGTH).alias("end"))
    done = marked.where("done").select("tid", F.col("first").alias("start"), (F.col("last") + LENGTH).alias("end"))
    spans = judged.union(hot).union(done).groupBy("tid").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    cut = held.where(~F.col("copied")).select("tid", "text").join(spans, "tid")
    cut = cut.mapInArrow(_cut, "tid binary, n_removed long, n_spans long, kept_sha256 string, left string, spans array<struct<start:long,end:long>>")
    cut = stage(cut, "cut")

    gone = copies.where("copied").select(F.col("tid").alias("copy_tid"))
    out = rows.join(stage(gone, "gone"), F.col("tid") == F.col("copy_tid"), "left").join(cut, "tid", "left")
    copied, zero = F.col("copy_tid").isNotNull(), F.lit(0).cast("long")
    n_bytes = F.octet_length("text").cast("long")
    whole = F.array(F.struct(zero.alias("start"), n_bytes.alias("end")))
    return out.select(
        F.col("id").alias(id_col), n_bytes.alias("n_bytes"), F.when(copied, n_bytes).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(copied, 1).otherwise(F.coalesce("n_spans", zero)).cast("long").alias("n_spans"),
        F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", F.sha2("text", 256))).alias("kept_sha256"),
        F.when(copied, "").otherwise(F.coalesce("left", "text")).alias(text_col),
        F.when(copied, whole).otherwise(F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>"))).alias("spans"),
    )
