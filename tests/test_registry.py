"""Every registered query against its SQL, over the whole smallest tables."""

import pytest

import __spark_entry__ as contract
from registry import oracle, queries as registered
from compare import compare, duck

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", [query.__name__ for query in registered.ALL])
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, SF_DIR, name) == []


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() == 200


def test_every_query_has_sql():
    assert set(oracle.ORACLE) == {query.__name__ for query in registered.ALL}
    assert set(oracle.ORACLE) <= set(contract.oracle_sql())
