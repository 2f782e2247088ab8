"""Hard negatives and ranked search next to brute force, with all the odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from propensia.llm import hard_negatives, lexical
from propensia.llm.cells import Best
from propensia.llm.hard_negatives import Lists, quantised, sorted_access

NAN, INF = float("nan"), float("inf")


def plain_negatives(rows, scale=256, low=80, high=100, k=5):
    """rows: (id, vector, label) -> sorted result rows."""
    sound = [(i, [math.floor(scale * x) for x in v], y) for i, v, y in rows if None not in (i, v, y) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v, y) in enumerate(sound):
        if i % 100:
            continue
        scored = [(-sum(p * q for p, q in zip(v, w)), j, z) for b, (j, w, z) in enumerate(sound) if b != a]
        for p, j, _ in sorted(s for s in scored if s[2] == y)[:k]:
            near = sorted(s for s in scored if s[2] != y and low * -p <= 100 * -s[0] <= high * -p)[:k]
            out += [(i, j, r, n, -p, -s) for r, (s, n, _) in enumerate(near, 1)]
    return sorted(out)


def vectors(n, dims=6, labels=3, seed=5, spread=1.0):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in np.float32(rng.normal(0.4, spread, dims))], int(rng.integers(labels))) for i in range(n)]


ODD = [
    (None, [1.0] * 6, 1), (1200, None, 1), (1300, [0.5] * 6, None), (1400, [NAN] + [1.0] * 5, 1), (1500, [INF] + [1.0] * 5, 1), (1601, [None] + [1.0] * 5, 1),
    (1700, [], 1), (1800, [0.25, 0.5], 2), (1900, [-1.0] * 6, 0), (2000, [0.0] * 6, 0),
    *[(3000 + i, [0.5, 0.25, 0.5, 0.25, 0.0, 0.125], i % 2) for i in range(60)],  # ties
    *[(3100, [0.5] * 6, 1)] * 3, (3100, [0.75] * 6, 2),  # repeated rows and ids
]


@pytest.mark.parametrize("block_rows, cell", [(16, 2), (4096, 16)])
def test_negatives_like_brute_force(spark, block_rows, cell, monkeypatch):
    monkeypatch.setattr(hard_negatives, "GROUP_ROWS", 2)
    rows = vectors(500) + ODD
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, label int, block string, row string").repartition(3)
    found = hard_negatives.hard_negatives(quantised(df), F.col("id") % 100 == 0, block_rows=block_rows, cell=cell)
    assert sorted(map(tuple, found.collect())) == plain_negatives(rows)


def test_negatives_of_odd_tables(spark):
    df = spark.createDataFrame(ODD[:10], "vec_id long, embedding array<float>, label int")
    every = F.col("id") % 100 == 0
    assert hard_negatives.hard_negatives(quantised(df.limit(0)), every).count() == 0
    assert sorted(map(tuple, hard_negatives.hard_negatives(quantised(df), every).collect())) == plain_negatives(ODD[:10])
    assert hard_negatives.hard_negatives(quantised(spark.createDataFrame([(100, [], 1), (101, [], 1), (102, [], 0)], df.schema)), every).collect() == [(100, 101, 1, 102, 0, 0)]
    wide = [(i, [float(x) * 2.0**k for x in range(1, 5)], i % 2) for i, k in enumerate([9, 10, 9, 18, 18, 19, 4, 4])]
    big = spark.createDataFrame(wide, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, hard_negatives.hard_negatives(quantised(big), every).collect())) == plain_negatives(wide)
    with pytest.raises(Exception, match="64 bits"):
        hard_negatives.hard_negatives(quantised(spark.createDataFrame([(0, [1e15] * 3, 1), (1, [1e15] * 3, 1)], big.schema)), every).collect()


def test_sorted_access_stops_early_and_misses_nothing():
    rng = np.random.default_rng(2)
    x = rng.integers(-100, 100, (3000, 3)).astype("<i4")
    lists = Lists(0, np.arange(3000).astype("<i8").tobytes(), bytes(8 * 3000), x.tobytes(), np.argsort(x, axis=0, kind="stable").T.astype(np.int32).tobytes(), 3, 100)
    for anchor in ([5, -7, 2], [0, 0, 3], [-1, -1, -1]):
        best, read = Best(5), 0
        for rows, scores in sorted_access(lists, np.array(anchor), best.needed):
            best.add(scores, lists.ids[rows])
            read += len(rows)
        scores = x.astype(int) @ anchor
        assert best.ids.tolist() == sorted(range(3000), key=lambda i: (-scores[i], i))[:5]
        assert read < 2000


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_ranking(docs, items, k=10):
    def terms(text):
        return [w.translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))) for w in WORD.findall((text or "").encode())]

    counted = [(i, Counter(terms(t))) for i, t in docs]
    total = sum(sum(c.values()) for _, c in counted)
    n = sum(bool(c) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counted:
            m = 10 + 90 * sum(c.values()) * n // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(str(item), r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("rows, entries, cell, queries", [(7, 300, 3, 4), (2048, 1 << 19, 8, 512)])
def test_ranking_like_brute_force(spark, make, corpus, monkeypatch, rows, entries, cell, queries):
    """Nulls, empty and long texts, ties by copies, repeated rows and ids, clashing names."""
    for name, value in (("BUCKET_ROWS", rows), ("BUCKET_ENTRIES", entries), ("QUERIES", queries)):
        monkeypatch.setattr(lexical, name, value)
    rng = random.Random(3)
    docs = corpus + [(600 + i, "Rare-Word été 日本 the") for i in range(25)] + [(7, "naïve co-op's A_B")]
    texts = [t for _, t in corpus if t]
    items = [(i, " ".join(rng.sample(rng.choice(texts).split(), 4) + rng.choice(texts).split()[:9])) for i in range(12) if (texts := [t for t in texts if len(t.split()) > 9])]
    items += [(50, None), (51, ""), (52, "... !"), (53, "no such words here zzz"), (54, "RARE word"), (54, "été the the"), (54, "été the the"), (None, "日本 a b"), (55, max(texts, key=len))]
    frame = make(items).withColumnRenamed("doc_id", "item_id").withColumnRenamed("id", "doc_id")
    found = lexical.ranked_search(make(docs), frame, cell=cell).collect()
    assert found and sorted(((str(r.item_id), r["rank"], r.doc_id, r.score) for r in found), key=str) == plain_ranking(docs, items)


def test_ranking_of_empty_tables(make):
    docs, items = make([(1, "a b"), (2, None)]), make([(1, "a")]).withColumnRenamed("doc_id", "item_id")
    assert lexical.ranked_search(docs.limit(0), items).count() == 0
    assert lexical.ranked_search(docs, items.limit(0)).count() == 0
    assert lexical.ranked_search(docs.where("doc_id = 2"), items).count() == 0
    assert [tuple(r) for r in lexical.ranked_search(docs, items).collect()] == [(r[0] and 1, *r[1:]) for r in plain_ranking([(1, "a b"), (2, None)], [(1, "a")])]


def test_short_buckets_are_left_out():
    """Length bounds: a bucket that cannot reach the last place is not searched."""
    rng = random.Random(8)
    searched = []
    original = lexical.Bucket.search

    def spy(self, terms, weights, best):
        searched.append(self.length)
        original(self, terms, weights, best)

    buckets = []
    for scale in (1000, 900, 20, 10):
        impacts = np.array([scale + rng.randrange(9) for _ in range(20)], "<i4")
        lengths = impacts.astype(float)
        buckets.append({"length": float(lengths.max()), "ids": list(range(scale, scale + 20)), "terms": np.array([5], "<i8").tobytes(), "bounds": np.array([0, 20], "<i4").tobytes(), "rows": np.arange(20, dtype="<i4").tobytes(), "impacts": impacts.tobytes(), "lengths": lengths.tobytes()})
    import pyarrow as pa

    lexical.Bucket.search = spy
    try:
        got = lexical._search(10)(pa.Table.from_pylist(buckets), pa.Table.from_pylist([{"key": 1, "terms": [5], "weights": [3]}]))
    finally:
        lexical.Bucket.search = original
    assert got.num_rows == 10 and min(got["score"].to_pylist()) >= 3000 and len(searched) == 1
