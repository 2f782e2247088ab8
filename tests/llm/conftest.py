import random

import pytest
from llm_texts import prose
from pyspark.sql import types as T

@pytest.fixture(scope="session")
def rng():
    return random.Random(11)


#: columns whose names the operators use inside
CLASH = ["id", "row", "key", "items", "hits", "kind", "part", "spans", "n_words", "kept"]


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs, with extra columns of clashing names."""

    def build(pairs, partitions=3):
        schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *[T.StructField(c, T.StringType()) for c in CLASH]])
        return spark.createDataFrame([(i, t, *["x"] * len(CLASH)) for i, t in pairs], schema).repartition(partitions)

    return build


@pytest.fixture(scope="session")
def corpus(rng):
    """Nulls, empty and very long texts, ties, repeated rows, exact and near copies, shared passages."""
    base = [prose(rng, rng.randrange(20, 400)) for _ in range(40)]
    passage = prose(rng, 120)
    pairs = list(enumerate(base))
    pairs += [(100 + i, base[i]) for i in range(6)]
    for i in range(12):
        words = base[3].split()
        words[rng.randrange(len(words))] = "edit%d" % i
        pairs.append((200 + i, " ".join(words)))
    pairs += [(300 + i, prose(rng, 30) + " " + passage + " " + prose(rng, 40)) for i in range(8)]
    pairs += [(400, None), (401, ""), (402, "  \n\t "), (403, "one two"), (404, "One  TWO"), (405, "é ü ß"), (406, "ab " * 700), (None, base[5]), (None, None)]
    pairs += [(500, base[7]), (500, base[7]), (501, prose(rng, 9000))]
    return pairs
