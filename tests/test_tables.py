import uuid

import pytest
from pyspark.sql import types as T

from vesselflow.sources.tables import format_from_name, publish_table, read_sample, schema_from_spec

SPEC = [
    {"name": "mmsi", "type": "INTEGER", "mode": "REQUIRED"},
    {"name": "names", "type": "string", "mode": "REPEATED"},
    {"name": "place", "type": "RECORD", "fields": [{"name": "lat", "type": "FLOAT"}]},
    {
        "name": "stops", "type": "STRUCT", "mode": "REPEATED",
        "fields": [{"name": "at", "type": "TIMESTAMP"}, {"name": "day", "type": "DATE", "mode": None}],
    },
]


@pytest.fixture
def name():
    return f"t_{uuid.uuid4().hex}"


def test_schema_from_spec():
    assert schema_from_spec(SPEC) == T.StructType(
        [
            T.StructField("mmsi", T.LongType(), False),
            T.StructField("names", T.ArrayType(T.StringType())),
            T.StructField("place", T.StructType([T.StructField("lat", T.DoubleType())])),
            T.StructField(
                "stops",
                T.ArrayType(
                    T.StructType([T.StructField("at", T.TimestampType()), T.StructField("day", T.DateType())])
                ),
            ),
        ]
    )
    with pytest.raises(ValueError):
        schema_from_spec([{"name": "x", "type": "COLOUR"}])


def test_declared_schema_makes_an_empty_table_once(spark, name):
    first = publish_table(spark, name, schema=SPEC)
    assert (first["ok"], first["exists"], first["action"]) == (True, False, "created")
    assert spark.table(name).count() == 0 and spark.table(name).columns == ["mmsi", "names", "place", "stops"]
    second = publish_table(spark, name, schema=SPEC)
    assert (second["ok"], second["exists"], second["action"]) == (True, True, "none")


@pytest.mark.parametrize("kind", ["parquet", "orc", "json", "csv"])
def test_sample_gives_schema_and_rows(spark, messages, tmp_path, name, kind):
    path = str(tmp_path / f"sample.{kind}")
    messages({"MMSI": 1}, {"MMSI": 2}).coalesce(1).write.format(kind).option("header", "true").save(path)
    outcome = publish_table(spark, name, sample=path)
    assert outcome["action"] == "created (autodetect)" and outcome["ok"]
    assert sorted(r.MMSI for r in spark.table(name).collect()) == [1, 2]
    assert dict(spark.table(name).dtypes)["SOG"] == "double"


def test_given_format_wins_and_an_unknown_one_is_refused(spark, messages, tmp_path, name):
    path = str(tmp_path / "sample.data")
    messages({"MMSI": 5}).write.json(path)
    assert publish_table(spark, name, sample=path, source_format="newline_delimited_json")["ok"]
    assert spark.table(name).first().MMSI == 5
    text = tmp_path / "plain"
    text.write_text("a,b\n1,2\n")
    assert read_sample(spark, str(text), "csv").first().asDict() == {"a": 1, "b": 2}
    for wrong in (None, "cvs"):
        with pytest.raises(ValueError, match="not known"):
            read_sample(spark, str(text), wrong)
    assert not publish_table(spark, name + "_x", sample=str(text))["ok"]


def test_nothing_to_go_by(spark, name):
    outcome = publish_table(spark, name)
    assert (outcome["ok"], outcome["action"]) == (False, "skipped")
    assert publish_table(spark, "")["ok"] is False


def test_failures_are_reported(spark, tmp_path, name):
    missing = publish_table(spark, name, sample=str(tmp_path / "none.parquet"))
    assert (missing["ok"], missing["action"]) == (False, "failed") and missing["error"]
    avro = publish_table(spark, name, sample=str(tmp_path / "x.avro"))
    assert avro["action"] == "failed" and "avro" in avro["error"].lower()
    bad = publish_table(spark, name, schema=[{"name": "x", "type": "COLOUR"}])
    assert bad["action"] == "failed"
    assert not spark.catalog.tableExists(name)


def test_lost_race(spark, name, monkeypatch):
    publish_table(spark, name, schema=SPEC)
    monkeypatch.setattr(type(spark.catalog), "tableExists", lambda self, n: False)
    outcome = publish_table(spark, name, schema=SPEC)
    assert (outcome["ok"], outcome["action"]) == (True, "none (race)")


def test_format_from_name():
    names = ["a.CSV", "a.json.gz", "b.parquet", "c.orc.zst", "d.avro.bz2", "e.txt", "f.gz"]
    assert [format_from_name(n) for n in names] == ["csv", "json", "parquet", "orc", "avro", None, None]


def test_a_table_appears_whole_or_not_at_all(spark, messages, monkeypatch, name):
    from pyspark.sql import functions as F

    from vesselflow.sources import tables

    rows = messages(*[{"MMSI": i} for i in range(40)]).repartition(4)
    broken = rows.withColumn("SOG", F.when(F.col("MMSI") == 39, F.raise_error(F.lit("torn"))).otherwise(F.col("SOG")))
    before = {t.name for t in spark.catalog.listTables()}
    monkeypatch.setattr(tables, "read_sample", lambda *_: broken)
    outcome = publish_table(spark, name, sample="x")
    assert (outcome["ok"], outcome["action"]) == (False, "failed") and "torn" in outcome["error"]
    assert {t.name for t in spark.catalog.listTables()} == before
    monkeypatch.setattr(tables, "read_sample", lambda *_: rows)
    assert publish_table(spark, name, sample="x")["action"] == "created (autodetect)"
    assert spark.table(name).count() == 40
    assert {t.name for t in spark.catalog.listTables()} == {*before, name}


def test_the_first_of_two_publishers_wins(spark, messages, monkeypatch, name):
    from vesselflow.sources import tables

    rows = messages({"MMSI": 1}, {"MMSI": 2})
    publish_table(spark, name, schema=SPEC)
    before = {t.name for t in spark.catalog.listTables()}
    monkeypatch.setattr(tables, "read_sample", lambda *_: rows)
    monkeypatch.setattr(type(spark.catalog), "tableExists", lambda self, n: False)
    assert publish_table(spark, name, sample="x")["action"] == "none (race)"
    assert spark.table(name).columns == ["mmsi", "names", "place", "stops"]
    assert {t.name for t in spark.catalog.listTables()} == before
    quoted = f"`{name}_q`"
    assert publish_table(spark, quoted, sample="x")["ok"] and spark.table(quoted).count() == 2
