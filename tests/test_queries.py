"""Every registered query that has SQL equals it on the smallest tables; every other one runs."""

import pytest

from graphloom.plans import catalog

from .compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    ok, n, why = compare(spark, con, catalog.QUERIES[name], catalog.ORACLE_SQL.get(name), SF)
    assert ok is not False, why
    assert n >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 307
    assert set(catalog.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
