"""Keys of the star join, checked on the one written column that every repeated key shows in."""

import pytest

from checks import bindings as B
from propensia.operators.quality import DataQualityError, join_cardinality
from propensia.plans import bank, modelling
from propensia.session import stage

SF = "/root/testdata/sf0.001"


def test_unique_keys_pass(spark):
    master = stage(bank.master_record(bank.prepare(B.raw_bank(spark, SF), "day")), "master")
    assert join_cardinality(master, "account_id", strict=True) is not None


@pytest.mark.parametrize("name", ["account", "client", "card", "loan", "district", "disp"])
def test_the_run_refuses_a_repeated_key(spark, name):
    raw = B.raw_bank(spark, SF)
    raw[name] = raw[name].union(raw[name])
    with pytest.raises(DataQualityError):
        modelling.affinity_run(raw, {}, unit="day", draw=B.draw)
