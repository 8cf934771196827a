"""Every registered query against its SQL, on the smallest given tables."""

import datetime as dt
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from vesselflow.registry import all_queries

SF_DIR = os.environ.get("VESSELFLOW_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()
OWN = set(all_queries())
QUERIES = {name: query for name, query in entry_points.queries().items() if name in OWN}
ORACLES = {name: sql for name, sql in entry_points.oracle_sql().items() if name in OWN}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the given tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return connection


def plain(rows):
    def value(v):
        return (v is None, str(v) if isinstance(v, dt.date) else repr(v))

    return sorted(tuple(value(v) for v in row) for row in rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    result = QUERIES[name](spark, SF_DIR)
    oracle = duck.sql(ORACLES[name])
    assert sorted(result.columns) == sorted(oracle.columns)
    theirs = oracle.select(", ".join(f'"{c}"' for c in result.columns)).fetchall()
    assert plain(result.collect()) == plain(theirs)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    rows = entry_points.entry(spark)
    assert rows.columns == ["VesselTypeName", "dow", "avg_sog", "sd_sog", "n"] and rows.count() > 0
