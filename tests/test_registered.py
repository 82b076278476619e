"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from check import compare
from tests.conftest import SMALL

QUERIES = contract.queries()
SQL = contract.oracle_sql()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, db, name):
    result, _ = compare(spark, db, SMALL, name, QUERIES[name], SQL[name])
    assert result.startswith("ok"), result


def test_entry(spark):
    assert contract.entry(spark).count() > 0
