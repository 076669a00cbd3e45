"""Every registered query against its SQL, run by DuckDB on the same files."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as contract
from conftest import SF_DIR
from ledgerline import oracles, registry

QUERIES = registry.queries()
SQL = oracles.oracle_sql()


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for file in os.listdir(SF_DIR):
        table = file.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{file}'")
    return connection


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(tuple(str(r[n]) for n in names) for r in table.to_pylist())


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert QUERIES.keys() <= contract.queries().keys()
    assert SQL.keys() <= contract.oracle_sql().keys()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    ours = QUERIES[name](spark, SF_DIR).toArrow()
    theirs = con.sql(SQL[name]).to_arrow_table()
    assert ours.num_rows > 0
    assert rows(ours) == rows(theirs)
    for field in theirs.schema:
        assert str(ours.schema.field(field.name).type) == str(field.type), field.name


def test_entry(spark):
    assert contract.entry(spark).count() == 1000
