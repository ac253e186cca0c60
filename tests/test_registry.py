"""Every registered query against its SQL equivalent on the smallest driver tables."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from workload.oracles import statements
from workload.queries import registered

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return connection


def plain(value):
    return float(f"{value:.12g}") if isinstance(value, float) else value


def ordered(columns, rows):
    by_name = sorted(columns)
    return sorted(([plain(row[columns.index(c)]) for c in by_name] for row in rows), key=repr)


def test_every_query_has_an_equivalent():
    assert set(registered()) == set(statements())
    assert set(registered()) <= set(contract.queries()) and set(statements()) <= set(contract.oracle_sql())


def test_entry_returns_rows(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(registered()))
def test_query_equals_sql(spark, duck, name):
    df = registered()[name](spark, FOLDER)
    cursor = duck.execute(statements()[name])
    columns = [entry[0] for entry in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert ordered(df.columns, df.collect()) == ordered(columns, cursor.fetchall())
