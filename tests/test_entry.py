"""Every registered query against its oracle on the small tables."""

import pytest

import __spark_entry__ as contract
from checks.queries import REGISTERED
from checks.compare import difference

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(REGISTERED) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(REGISTERED))
def test_query_equals_oracle(spark, name):
    assert difference(spark, SF, name) is None
