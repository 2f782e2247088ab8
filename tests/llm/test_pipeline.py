"""The pipeline's stages one by one, against plain versions of their decisions."""

import collections
import re

import corpus_pipeline
import __spark_entry__ as entry
from test_operators import VOCABULARY, multiset, plain_contamination, plain_near, plain_quality

from propensia.llm import queries, weak_rules

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "benchmark", "private_data", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    columns, now, seen = docs.columns, docs, []
    for name, function in corpus_pipeline.STAGES:
        now = corpus_pipeline.stage(function(spark, now, SF), name)
        seen.append(now)
        if name != "packing":
            assert set(now.columns) == set(columns)
    text = [dict((r.doc_id, r.text) for r in x.collect()) for x in (docs, *seen[:4])]
    verdict = {r.doc_id: r.kept for r in weak_rules.assess(docs).collect()}
    assert set(text[1]) == {d for d, k in verdict.items() if k}
    for d in text[1]:
        n, _, _, _, again = plain_quality(text[0][d])
        assert n >= 10 and 100 * again <= 20 * n
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    failed = lambda d: (q := plain_quality(text[0][d]))[0] < 10 or 100 * q[4] > 20 * q[0]
    assert all(d in text[1] for d, q in labels.items() if q == 1 and d in text[0] and not failed(d))
    assert set(text[2]) == {r[0] for r in plain_near(text[1].items()) if r[3]}
    assert set(text[3]) == {r[0] for r in plain_contamination(text[2].items(), items) if not r[-1]}
    assert set(text[4]) == set(text[3])
    changed = [d for d in text[4] if text[4][d] != text[3][d]]
    assert all(re.search(r"@|\d{4}|AKIA|\d\.\d", text[3][d]) for d in changed)
    mails = {m for t in text[3].values() for m in re.findall(r"[\w.]+@[\w.]+\w", t)}
    assert mails and not any(m in t for t in text[4].values() for m in mails)
    packed = seen[4].collect()
    assert {r.doc_id for r in packed} == set(text[4])
    filled = collections.Counter()
    for r in packed:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 4096 and VOCABULARY


def test_queries_are_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert multiset([]) == {}
