"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from tidewire import catalogue

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ["orders", "events", "documents", "pages", "labels"]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return connection


def normal(records, columns):
    order = sorted(range(len(columns)), key=lambda place: columns[place])
    return sorted(tuple(str(record[place]) for place in order) for record in records)


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())
    assert set(catalogue.queries()) <= set(entry_points.queries()) and set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry(spark):
    assert entry_points.entry(spark).count() == 1


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    frame = catalogue.queries()[name](spark, FOLDER)
    got = normal([tuple(row) for row in frame.collect()], frame.columns)
    cursor = duck.execute(catalogue.oracle_sql()[name])
    columns = [column[0] for column in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    assert got == normal(cursor.fetchall(), columns)
