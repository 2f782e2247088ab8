"""Encoding and decoding next to the public tokenizer library."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from propensia.llm import bpe, queries
from propensia.llm.tokens import blocks

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
PIECES = ["a", "b", "Th", "in", "é", "́", " ", "\n", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'s", "'", "'l", "l", "'re", "R", "E", "Σ", "İ", "1", "23", "--", "💥", "中", "\x1c", "|", "<|", "\x0b", " ", "Ᲊ", "͸", "\u0085"]


@pytest.fixture(scope="module", params=FILES)
def both(request):
    path = public_tokenizers.path(request.param)
    return bpe.Bpe(path), Tokenizer.from_file(path)


def odd_texts():
    rng = random.Random(4)
    texts = ["", " ", "''s 's's x'lly 'T 'LL", "a" * 5000, "th" * 33 + " " + "in" * 32, "=" * 700]
    texts += ["".join(rng.choice(PIECES) for _ in range(rng.choice([3, 10, 100, 400]))) for _ in range(250)]
    return texts + ["".join(rng.choice("abinther1") for _ in range(rng.choice([63, 64, 65, 70, 900]))) for _ in range(40)]


def test_like_the_library(both):
    own, library = both
    texts = odd_texts()
    for size in (64, 1 << 20):
        got = [x for block in blocks(pa.array(texts), size) for x in own.block(block)]
        for text, raw in zip(texts, got, strict=True):
            ids = library.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(raw, "<u4").tolist() == ids
            assert own.encode(text) == raw
            assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_every_letter_of_many_planes(both):
    own, library = both
    texts = [f"a{chr(c)}b {chr(c)} 1{chr(c)}." for c in (*range(0, 0x3000, 3), *range(0x3000, 0x20000, 97)) if not 0xD800 <= c < 0xE000]
    for text, raw in zip(texts, (x for block in blocks(pa.array(texts)) for x in own.block(block)), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_the_store_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 50)
    own = bpe.Bpe(public_tokenizers.path(FILES[0]))
    texts = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(40)] * 2
    library = Tokenizer.from_file(public_tokenizers.path(FILES[0]))
    for text in texts:
        (raw,) = [x for block in blocks(pa.array([text])) for x in own.block(block)]
        assert np.frombuffer(raw, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(own.new) <= 150 and len(own.old) <= 150


def test_scanned_and_linked_merges_agree(both):
    own, _ = both
    rng = random.Random(9)
    for _ in range(300):
        parts = [own.inner[ord(rng.choice("aabtherin"))] for _ in range(rng.randrange(1, 80))]
        assert own.merge(list(parts)) == own.merge_long(list(parts))


def test_other_files_are_refused(tmp_path):
    import json

    spec = json.load(open(public_tokenizers.path(FILES[0])))
    for change in ({"pre_tokenizer": {"type": "Whitespace"}}, {"decoder": {"type": "Metaspace"}}, {"normalizer": {"type": "Nmt"}}, {"model": spec["model"] | {"byte_fallback": True}}):
        path = tmp_path / "t.json"
        path.write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            bpe.Bpe(str(path))


def test_frames_with_odd_rows(make, corpus):
    """Nulls, empty and long texts, repeated rows, clashing names, arrays and packed ids, empty tables."""
    path = public_tokenizers.path(FILES[0])
    library = Tokenizer.from_file(path)
    docs = make(corpus).withColumnRenamed("n_words", "ids").withColumnRenamed("row", "_text")
    for packed in (False, True):
        rows = bpe.decode(bpe.encode(docs, path, packed=packed), path).collect()
        assert len(rows) == len(corpus) and "key" in rows[0]
        got = sorted((str(r.doc_id), r.text or "", bytes(r.ids) if packed else np.array(r.ids, "<u4").tobytes(), r.decoded) for r in rows)
        plain = [(str(i), t or "", library.encode(t or "", add_special_tokens=False).ids) for i, t in corpus]
        assert got == sorted((i, t, np.array(x, "<u4").tobytes(), library.decode(x, skip_special_tokens=False)) for i, t, x in plain)
    assert bpe.decode(bpe.encode(docs.limit(0), path), path).count() == 0
    spark = docs.sparkSession
    odd = bpe.decode(spark.createDataFrame([(None,), ([],), ([320, None, 10**6, 320],)], "ids array<int>"), path).collect()
    assert [r.decoded for r in odd] == ["", "", library.decode([320, 320])]


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    library = Tokenizer.from_file(public_tokenizers.path(FILES[0]))
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    expected = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        expected.append((r.doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode())))
    assert sorted(map(tuple, queries.QUERIES["op11_bpe_round_trip"](spark, sf).collect())) == sorted(expected)
