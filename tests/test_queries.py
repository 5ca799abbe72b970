"""Every registered query against its SQL, on the smallest tables."""

import pytest

from conftest import SF
from oracle import connection, same
from plexar.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con():
    return connection(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL) and len(QUERIES) > 150


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, con, name):
    cols, ours, theirs = same(QUERIES[name](spark, SF), con, ORACLE_SQL[name])
    assert cols and ours == theirs


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10 and set(QUERIES) <= set(e.queries())
