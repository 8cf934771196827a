"""Every registered corpus query over the smallest given tables, against SQL where it has any."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry_points
from vesselflow.llm import queries

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the given tables are not here")


def test_all_operators_and_the_pipeline_are_registered():
    names = entry_points.queries()
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES} == set(range(1, 14))
    assert {*queries.QUERIES, "pipeline"} <= set(names)
    assert set(queries.ORACLES) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_covers_its_whole_table(spark, name):
    result = queries.QUERIES[name](spark, SF_DIR).toPandas()
    table = {"op3": "pages", "op11": "embeddings"}.get(name.split("_")[0], "documents")
    whole = spark.read.parquet(f"{SF_DIR}/{table}.parquet")
    if name.startswith("op8_"):
        assert set(result.doc_id) <= {r.doc_id for r in whole.select("doc_id").collect()}
    elif name.startswith(("op11_", "op12_")):
        key = whole.columns[0]
        assert set(result[key]) == {r[key] for r in whole.select(key).collect()}
    else:
        assert len(result) == whole.count()
    if name in queries.ORACLES:
        con = duckdb.connect()
        for view in ("documents", "pages"):
            con.sql(f"create view {view} as select * from '{SF_DIR}/{view}.parquet'")
        columns = list(result.columns)
        theirs = con.sql(queries.ORACLES[name]).select(", ".join(columns)).fetchall()
        ours = result.astype(object).where(result.notna(), None).itertuples(index=False, name=None)
        assert sorted(map(repr, ours)) == sorted(map(repr, theirs))
