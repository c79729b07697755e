"""Every registered query with an SQL form returns the SQL's rows on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as registered
from check import compare, connect

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_query_matches_sql(spark, db, name):
    outcome = compare(spark, db, name, SF)
    assert outcome.startswith("ok"), outcome


def test_every_sql_has_a_query():
    assert set(registered.oracle_sql()) <= set(registered.queries())


def test_entry(spark):
    assert registered.entry(spark).count() > 0
