"""Every query of the library against its SQL, on the small tables."""

import pytest

import __spark_entry__ as entry
from tables import SMALL
from lexloom.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(name, same):
    same(catalog.QUERIES[name], catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_runs(name, spark):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
