"""Every registered query gives the rows its SQL twin gives (smallest tables)."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, database

SF_DIR = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con():
    return database(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert compare(spark, con, SF_DIR, QUERIES[name], ORACLES[name]) is None


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
