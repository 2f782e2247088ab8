"""Best one-level splits against trying every cut by hand."""

import math
import random

import pytest
from pyspark.sql import functions as F

from propensia.operators import models as M
from propensia.operators.stumps import best_split, best_splits

@pytest.fixture
def rng():
    return random.Random(5)


SCHEMA = "y int, w double, a double, b double"


def by_hand(rows, column):
    cells = [(r[column], r[0], r[1]) for r in rows if r[0] is not None and r[1] > 0 and r[column] is not None and not math.isnan(r[column])]
    values = sorted({v for v, _, _ in cells})
    found = []
    for v, later in zip(values, values[1:]):
        side = [[sum(w for x, y, w in cells if (x > v) == up and y == k) for k in (0, 1)] for up in (False, True)]
        total = sum(map(sum, side))
        impurity = sum(2 * p * q / (p + q) for p, q in side) / total
        found.append((round(impurity, 12), v, (v + later) / 2, int(side[0][1] > side[0][0]), int(side[1][1] > side[1][0]), sum(map(min, side)) / total))
    return min(found) if found else None


def splits(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = best_splits(df, F.array("a", "b"), F.col("y"), F.col("w"), **how).collect()
    return {r.feature: r for r in got}


@pytest.mark.parametrize("ranges", [1, 7])
def test_equal_to_trying_every_cut(spark, rng, ranges):
    rows = [(rng.randrange(2), rng.choice([0.5, 1.0, 3.0]), float(rng.randrange(9)), rng.choice([None, math.nan, rng.random()])) for _ in range(300)]
    rows += [(None, 1.0, 0.0, 0.0), (1, 0.0, 99.0, 99.0)] + rows[:20]
    got = splits(spark, rows, ranges=ranges)
    for i in (0, 1):
        want = by_hand(rows, i + 2)
        assert [got[i].threshold, got[i].below, got[i].above] == list(want[2:5])
        assert got[i].impurity == pytest.approx(want[0]) and got[i].error == pytest.approx(want[5])


def test_constant_columns_and_empty_tables_have_no_split(spark):
    assert splits(spark, []) == {}
    assert splits(spark, [(0, 1.0, 5.0, None), (1, 1.0, 5.0, None)]) == {}


def test_ties_go_to_the_first_column_and_smallest_value(spark):
    rows = [(y, 1.0, float(v), float(v)) for y, v in ((0, 1), (1, 2), (0, 3))]
    got = best_split(spark.createDataFrame(rows, SCHEMA), F.array("a", "b"), F.col("y")).first()
    assert (got.feature, got.threshold) == (0, 1.5)


def test_boosting_with_exact_cuts(spark, rng):
    rows = [(int(abs(x - 4) < 2), 1.0, float(x), rng.random()) for x in (rng.randrange(9) for _ in range(400))]
    df = M.assemble(spark.createDataFrame(rows, SCHEMA).withColumnRenamed("y", "label"), ["a", "b"])
    model = M.AdaBoostSamme(maxIter=6, exactSplits=True).fit(df)
    assert all(s[1] * 2 == int(s[1] * 2) for s in model.rounds() if s[0] == 0)
    assert model.transform(df).filter("prediction = label").count() >= 390
    one = M.assemble(df.drop("features").withColumns({"a": F.lit(1.0), "b": F.lit(2.0)}), ["a", "b"])
    assert len(M.AdaBoostSamme(maxIter=2, exactSplits=True).fit(one).rounds()) == 1
