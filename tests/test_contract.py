"""Every contract query against its SQL on DuckDB, at the smallest scale."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows_of

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db(small):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{small}/{table}.parquet'")
    return connection


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, db, name):
    frame = QUERIES[name](spark, small)
    names, rows = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    assert rows
    if name in ORACLES:
        result = db.execute(ORACLES[name])
        expected_names, expected = rows_of([d[0] for d in result.description], result.fetchall())
        assert names == expected_names
        assert rows == expected
