import inspect

import pytest

import __spark_entry__ as contract
from checks import registry
from checks.compare import compare
from tests.conftest import SF


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(registry.QUERIES) <= set(contract.queries())


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


def test_signatures():
    for query in contract.queries().values():
        assert len(inspect.signature(query).parameters) == 2


@pytest.mark.parametrize("part", range(4))
def test_queries_equal_their_sql(spark, part):
    names = sorted(registry.QUERIES)[part::4]
    assert compare(spark, SF, names) == []
