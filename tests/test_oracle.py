"""Every registered query with an SQL counterpart, compared value by value on the smallest tables."""

import pytest

import __spark_entry__ as entry
from checks.compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    verdict, _ = compare(spark, con, SF, entry.queries()[name], entry.oracle_sql()[name])
    assert verdict == "ok", verdict
