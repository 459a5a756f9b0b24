"""Every registered query with a SQL counterpart gives the same rows in DuckDB."""

import pytest

import __spark_entry__ as entry
from tools.compare_sql import difference, duck

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows_as_sql(spark, connection, name):
    frame = entry.queries()[name](spark, SF_DIR)
    assert difference(frame, connection, entry.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_queries_without_sql_return_rows(spark, name):
    assert entry.queries()[name](spark, SF_DIR).count() > 0


def test_every_sql_text_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 30
