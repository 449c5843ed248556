"""Every registered query gives the rows of its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_points

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def comparable(row):
    out = []
    for value in row:
        if value is None or (isinstance(value, float) and math.isnan(value)):
            out.append("")
        elif isinstance(value, (bool, str)):
            out.append(str(value))
        else:
            out.append(repr(float(value) + 0.0))
    return tuple(out)


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_query_matches_sql(spark, sql, name):
    frame = entry_points.queries()[name](spark, SF_DIR)
    columns = sorted(frame.columns)
    found = sorted(comparable(r) for r in frame.select(*[f"`{c}`" for c in columns]).collect())
    result = sql.execute(entry_points.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    expected = sorted(comparable([r[i] for i in places]) for r in result.fetchall())
    assert found == expected


def test_every_query_has_sql():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
