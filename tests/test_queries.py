"""Every registered query runs, and those with SQL give the same rows as it."""

from __future__ import annotations

import __spark_entry__ as entry
import pytest

from tests.oracle import connection, rows_of, rows_of_sql

CORE = [name for module in entry._MODULES for name in module.QUERIES]
WITH_SQL = [name for module in entry._MODULES for name in module.ORACLE_SQL]


@pytest.fixture(scope="module")
def con(data):
    return connection(data)


@pytest.mark.parametrize("name", WITH_SQL)
def test_same_rows_as_sql(spark, data, con, name):
    df = entry.queries()[name](spark, data)
    columns = sorted(df.columns)
    assert rows_of(df, columns) == rows_of_sql(con, entry.oracle_sql()[name], columns)


@pytest.mark.parametrize("name", [n for n in CORE if n not in WITH_SQL])
def test_runs(spark, data, name):
    assert entry.queries()[name](spark, data).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_only_for_known_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
