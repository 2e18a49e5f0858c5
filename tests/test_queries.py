"""Every query with SQL against another engine, and all queries for a stable schema."""

import pytest
from compare import same

import __spark_entry__ as entry_module
from tessera.plans import catalog

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_same_as_sql(spark, small, name):
    same(catalog.QUERIES[name](spark, small), SQL[name], small)


def test_entry(spark):
    assert entry_module.entry(spark).count() == 2


def test_every_query_has_sql():
    assert set(SQL) == set(catalog.QUERIES)
