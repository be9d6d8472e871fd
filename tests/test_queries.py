"""Every registered query against its SQL on sf0.01, and the flagship query."""

import compare
import pytest

import __spark_entry__ as entry_point

FOLDER = "/root/testdata/sf0.01"
QUERIES, ORACLES = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, connection, name):
    assert compare.differences(spark, connection, FOLDER, QUERIES[name], ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_returns_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    rows = entry_point.entry(spark).collect()
    assert len(rows) == 10 and rows[0].window_total_activity >= rows[-1].window_total_activity
