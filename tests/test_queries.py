"""Every registered query against its check SQL, at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry_points

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
duckdb = pytest.importorskip("duckdb")

QUERIES, SQL = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def other():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return connection


def plain(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        return "<null>" if v is None else repr(v) if isinstance(v, float) else str(v)

    return sorted(tuple(value(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_check_sql(spark, other, name):
    ours, theirs = QUERIES[name](spark, SF), other.sql(SQL[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours.columns, ours.collect()) == plain(theirs.columns, theirs.fetchall())


def test_entry(spark):
    assert entry_points.entry(spark).columns == ["fault_category", "count", "is_problem"]


def test_check_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
