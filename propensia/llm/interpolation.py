"""Scores of texts under an interpolated bigram model.

p(w | v) = l2 c(vw)/c(v) + l1 c(w)/N + l0 /(V+1), with weights by how often the context v was seen (one set per power of
two). Counts come from all training texts. The weights are learned by expectation-maximisation on a part of the training
texts held out for it, with the counts of the rest.

Words are 64-bit hashes. Texts are gathered into blocks of some megabytes, each with its own list of distinct words.
A block asks for the counts of its distinct words and bigrams: sorted keys go, as one binary row per slice of the key
space, to the task of that slice, which adds up the blocks' own counts and answers every row in the order of its
keys. So a key travels once per block, not once per occurrence, and an answer carries no keys. A block holds tuning texts
only or none, so one count per key tells both sums: over all training texts, and over those without the tuning texts. The
second is answered to the tuning blocks alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from propensia.llm.tokens import BASE, blocks, mix, words
from propensia.session import parallel_buckets, stage

FOLDS, TEST_FOLD, TUNE_FOLD = 7, 2, 3
BLOCK_TOKENS = 1 << 20
SLICE_BYTES = 8 << 20
TASK_BYTES = 64 << 20
BUCKETS, STEPS, NEVER = 48, 4, -10_000
EM_ROUNDS = 200
START, END = np.uint64(0xA5A5A5A5A5A5A5A5), np.uint64(0x5A5A5A5A5A5A5A5A)
WORD, PAIR = 1, 2


class Weights(NamedTuple):
    """Per bucket of context counts the shares of bigram, word and uniform estimates."""

    table: np.ndarray

    @staticmethod
    def bucket(context: np.ndarray) -> np.ndarray:
        return np.minimum(np.log2(context + 1.0).astype(np.int64), BUCKETS - 1)


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers as bytes by significance, which a shuffle's compression makes use of, up to the highest that is used."""
    planes = x.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return planes[: max(1, -(-int(x.max(initial=0)).bit_length() // 8))].tobytes()


def _unplanes(raw: bytes, n: int) -> np.ndarray:
    planes = np.zeros((8, n), np.uint8)
    used = np.frombuffer(raw, np.uint8).reshape(-1, max(n, 1))
    planes[: len(used)] = used
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


class Tokens(NamedTuple):
    """A block: its distinct words (sorted hashes, END among them) and per token the word's place; bounds of texts."""

    vocabulary: np.ndarray
    word: np.ndarray
    bounds: np.ndarray

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct bigram hashes, and per token its bigram's and its context's place (-1: start of text)."""
        context = np.concatenate([[-1], self.word[:-1]])
        context[self.bounds[:-1]] = -1
        before = np.where(context < 0, START, self.vocabulary[np.maximum(context, 0)])
        keys, at = np.unique(mix(before * BASE + self.vocabulary[self.word], 7), return_inverse=True)
        return keys, at, context


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name = TaskContext.get().partitionId() << 24
    held: dict[bool, list[tuple]] = {False: [], True: []}
    size = {False: 0, True: 0}

    def flush(tune: bool) -> pa.RecordBatch:
        nonlocal name
        name += 1
        rows = held[tune]
        hashes = np.concatenate([x for r in rows for x in (r[2], [END])])
        vocabulary, word = np.unique(hashes, return_inverse=True)
        n = np.array([len(r[2]) + 1 for r in rows], np.int64)
        held[tune], size[tune] = [], 0
        columns = [[name], [tune], [[r[0] for r in rows]], [[r[1] for r in rows]], [n.tobytes()], [vocabulary.tobytes()], [zlib.compress(word.astype(np.uint32), 1)]]
        types = [pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["block", "tune", "ids", "folds", "sizes", "vocabulary", "words"])

    for batch in batches:
        ids, folds = batch.column("id").to_pylist(), batch.column("fold").to_pylist()
        for block in blocks(batch.column("text")):
            w = words(block)
            for r in range(block.rows):
                i = block.first + r
                tune = folds[i] == TUNE_FOLD
                held[tune].append((ids[i], folds[i], w.hashes[w.bounds[r] : w.bounds[r + 1]].copy()))
                size[tune] += int(w.bounds[r + 1] - w.bounds[r]) + 1
                if size[tune] >= BLOCK_TOKENS:
                    yield flush(tune)
    for tune in (False, True):
        if held[tune]:
            yield flush(tune)


def _tokens(row: dict) -> Tokens:
    sizes = np.frombuffer(row["sizes"], np.int64)
    word = np.frombuffer(zlib.decompress(row["words"]), np.uint32).astype(np.int64)
    return Tokens(np.frombuffer(row["vocabulary"], np.uint64), word, np.concatenate([[0], np.cumsum(sizes)]))


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows one at a time; binary values as views of the batch."""
    columns = [(n, batch.column(n), pa.types.is_binary(batch.schema.field(n).type)) for n in batch.schema.names]
    for i in range(batch.num_rows):
        yield {n: (c[i].as_buffer() if raw else c[i].as_py()) if c[i].is_valid else None for n, c, raw in columns}


def _cuts(keys: np.ndarray, slices: int) -> np.ndarray:
    """Where sorted keys pass from one equal slice of the key space to the next."""
    edges = [(i << 64) // slices for i in range(1, slices)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(edges, np.uint64)), [len(keys)]])


def _questions(slices: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                t = _tokens(row)
                fold = np.repeat(np.array(row["folds"]), np.diff(t.bounds))
                pairs, at, _ = t.pairs()
                for kind, keys, place in ((WORD, t.vocabulary, t.word), (PAIR, pairs, at)):
                    times = np.bincount(place[fold != TEST_FOLD], minlength=len(keys))
                    cuts = _cuts(keys, slices)
                    rows = [(kind, s, row["block"], row["tune"], b - a, _planes(keys[a:b]), _planes(times[a:b])) for s, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())) if b > a]
                    types = [pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(zip(*rows), types)], ["kind", "slice", "block", "tune", "n", "keys", "times"])

    return run


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a slice come together; each is answered by the sums of its keys over all blocks."""
    names = ["kind", "slice", "block", "n", "total", "keep", "sums"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    here, held = None, []

    def flush() -> Iterator[pa.RecordBatch]:
        distinct, at = np.unique(np.concatenate([_unplanes(r["keys"], r["n"]) for r in held]), return_inverse=True)
        times = np.concatenate([_unplanes(r["times"], r["n"]) for r in held])
        kept = np.repeat([not r["tune"] for r in held], [r["n"] for r in held])
        # sums of whole numbers in doubles are exact up to 2^53
        total, keep = (np.bincount(at, w, len(distinct)).astype(np.uint64) for w in (times, times * kept))
        edges = np.cumsum([0] + [r["n"] for r in held])
        out = [
            (r["kind"], r["slice"], r["block"], r["n"], _planes(total[at[a:b]]), _planes(keep[at[a:b]]) if r["tune"] else None, None)
            for r, a, b in zip(held, edges, edges[1:])
        ]
        if held[0]["kind"] == WORD:
            stats = [int(x) for s in (total, keep) for x in (s.sum(), np.count_nonzero(s))]
            out.append((WORD, held[0]["slice"], None, None, None, None, stats))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    for batch in batches:
        for row in _rows(batch):
            if here != (row["kind"], row["slice"]):
                if held:
                    yield from flush()
                here, held = (row["kind"], row["slice"]), []
            held.append(row)
    if held:
        yield from flush()


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Tokens, tuple]]:
    """Blocks with the counts of every token's word, context and bigram; a block comes before its answers."""
    here, answers = None, []

    def done() -> tuple[dict, Tokens, tuple]:
        t = _tokens(here)
        _, at, context = t.pairs()
        end = int(np.searchsorted(t.vocabulary, END))
        by = {k: np.concatenate([_unplanes(r["counts"], r["n"]) for r in answers if r["kind"] == k]).astype(np.float64) for k in (WORD, PAIR)}
        # a text's start is a context as often as its end is a word
        return here, t, (by[WORD][t.word], by[WORD][np.where(context < 0, end, context)], by[PAIR][at])

    for batch in batches:
        for row in _rows(batch):
            if row["kind"] == 0:
                if here:
                    yield done()
                here, answers = row, []
            else:
                answers.append(row)
    if here:
        yield done()


def _estimates(counts: tuple, n: int, v: int) -> tuple[np.ndarray, np.ndarray, float]:
    word, context, pair = counts
    return np.divide(pair, context, out=np.zeros(len(pair)), where=context > 0), word / max(n, 1), 1.0 / (v + 1)


def _cells(n: int, v: int):
    """How often which estimates (on a logarithmic grid, relative to the uniform one) meet in texts held out."""

    def level(p: np.ndarray, p0: float) -> np.ndarray:
        return np.where(p > 0, np.round(STEPS * np.log2(np.where(p > 0, p, 1) / p0)), NEVER).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, counts in _looked_up(batches):
            p2, p1, p0 = _estimates(counts, n, v)
            cells, times = np.unique(np.stack([Weights.bucket(counts[1]), level(p2, p0), level(p1, p0)]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*cells, times)], ["bucket", "pair", "word", "times"])

    return run


def learn(cells: list[tuple[int, int, int, int]], rounds: int = EM_ROUNDS) -> Weights:
    """Weights by expectation-maximisation on (bucket, level of the bigram's and of the word's estimate, times).

    A bucket without held-out tokens keeps the starting weights.
    """
    table = np.tile([0.6, 0.3, 0.1], (BUCKETS, 1))
    for b in range(BUCKETS):
        mine = np.array([c[1:] for c in cells if c[0] == b], np.float64)
        if len(mine):
            p = np.column_stack([np.where(mine[:, :2] > NEVER, 2.0 ** (mine[:, :2] / STEPS), 0.0), np.ones(len(mine))])
            for _ in range(rounds):
                share = p * table[b]
                share *= (mine[:, 2] / share.sum(axis=1))[:, None]
                table[b] = (share.sum(axis=0) + 1e-3) / (mine[:, 2].sum() + 3e-3)
    return Weights(table)


def _scores(weights: Weights, n: int, v: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, t, counts in _looked_up(batches):
            word, context, _ = counts
            p2, p1, p0 = _estimates(counts, n, v)
            shares = weights.table[Weights.bucket(context)]
            score = np.log10(shares[:, 0] * p2 + shares[:, 1] * p1 + shares[:, 2] * p0)
            base = np.log10((word + 1) / (n + 1 * (v + 1)))
            at = t.bounds[:-1]
            yield pa.RecordBatch.from_arrays([
                pa.array(row["ids"], pa.int64()), pa.array([f == TEST_FOLD for f in row["folds"]]), pa.array(np.diff(t.bounds)),
                pa.array(np.add.reduceat((word > 0).astype(np.int64), at)), pa.array(np.full(len(at), n)),
                pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(score, at)),
            ], ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Log10 probability of every text under the model and under add-one word counts.

    Returns the id, held_out, n_tokens (words and one end), n_known (those seen in training), train_tokens, base_score and
    score. Learns from texts whose crc32(id as text) mod 7 is not 2; those are held out.

    A null or empty text is its end alone. Repeated rows come back repeated and count each time; rows without an id are
    training texts. No rows give no rows; without training texts all words are unknown. Other columns are
    ignored. Learning sees estimates rounded to quarter powers of two, so a weight is learned from likelihoods within 9 % of
    their own; the scores use the exact estimates. Memory per task: one block (a million tokens, more only where one text is longer) with its counts, or the
    questions of one slice (some ``SLICE_BYTES`` of text).
    """
    fold = F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS, F.lit(0)).cast("int")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), fold.alias("fold"))
    shape = "block long, tune boolean, ids array<long>, folds array<int>, sizes binary, vocabulary binary, words binary"
    made = stage(rows.mapInArrow(_blocks, shape), "blocks")
    size = made.agg(F.sum(F.octet_length("words") * 6)).first()[0] or 0
    slices = max(1, -(-size // SLICE_BYTES))
    tasks = max(parallel_buckets(docs.sparkSession), -(-size // TASK_BYTES))
    asked = made.mapInArrow(_questions(slices), "kind int, slice int, block long, tune boolean, n int, keys binary, times binary")
    asked = asked.repartition(tasks, "kind", "slice").sortWithinPartitions("kind", "slice", "block")
    answered = stage(asked.mapInArrow(_answers, "kind int, slice int, block long, n int, total binary, keep binary, sums array<long>"), "answers")
    n, v, kept_n, kept_v = answered.where("block is null").agg(*[F.coalesce(F.sum(F.col("sums")[i]), F.lit(0)) for i in range(4)]).first()

    def together(part: DataFrame, counts: str) -> DataFrame:
        own = {"ids": "array<long>", "folds": "array<int>", "sizes": "binary", "vocabulary": "binary", "words": "binary"}
        theirs = {"n": "int", "counts": "binary"}
        mine = part.select("block", F.lit(0).alias("kind"), F.lit(0).alias("slice"), *own, *[F.lit(None).cast(t).alias(c) for c, t in theirs.items()])
        replies = answered.where(F.col("block").isNotNull() & F.col(counts).isNotNull())
        replies = replies.select("block", "kind", "slice", *[F.lit(None).cast(t).alias(c) for c, t in own.items()], "n", F.col(counts).alias("counts"))
        return mine.union(replies).repartition(tasks, "block").sortWithinPartitions("block", "kind", "slice")

    cells = together(made.where("tune"), "keep")
    cells = cells.mapInArrow(_cells(kept_n, kept_v), "bucket long, pair long, word long, times long").groupBy("bucket", "pair", "word").agg(F.sum("times"))
    weights = learn([tuple(c) for c in cells.collect()])
    result = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return together(made, "total").mapInArrow(_scores(weights, n, v), result).withColumnRenamed("id", id_col)
