import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import largest_method, plan_of
from vesselflow.fixture import raw_messages
from vesselflow.functions import cleaning as rule
from vesselflow.operators.curation import clean, curate, deduplicate
from vesselflow.schema import CURATED_COLUMNS


def test_columns_and_types(messages):
    curated = curate(messages({}))
    assert curated.columns == CURATED_COLUMNS
    row = curated.first()
    assert row.NavStatusInt == 0 and row.MMSI == "366000001"
    assert row.BaseDateTime == dt.datetime(2024, 1, 5, 10, 0)
    assert row.VesselTypeName == "Cargo, all ships of this type" and row.VesselTypeClass == "Cargo"
    assert (row.ym, row.hour, row.dow, row.week) == ("2024-01", 10, "Fri", 1)
    assert abs(row.SOG_ms - 2.57222) < 1e-9 and len(row.geohash9) == 9


def test_ingest_columns_follow(messages):
    raw = messages({}).withColumns(
        {"_source_file": F.lit("f"), "_ingest_ts": F.current_timestamp(), "ymd": F.lit("d"), "ym": F.lit("m")}
    )
    assert curate(raw).columns == [*CURATED_COLUMNS, "_source_file", "_ingest_ts", "ymd"]


def test_bad_text_gives_null_not_an_error(messages):
    row = curate(
        messages({"BaseDateTime": "soon", "VesselType": "x", "Status": "y", "VesselName": None})
    ).first()
    assert row.BaseDateTime is None and row.ym is None and row.VesselTypeInt is None
    assert row.NavStatusName == "Not reported" and row.VesselName is None


def test_rows_without_position_go(messages):
    raw = messages({"MMSI": 1, "LAT": 91.0}, {"MMSI": 2, "LON": None}, {"MMSI": 3, "SOG": 71.0})
    rows = curate(raw).collect()
    assert [(r.MMSI, r.SOG) for r in rows] == [("000000003", None)]


def test_duplicates_keep_the_first_in_column_order(messages):
    raw = messages(
        {"SOG": 6.0}, {"SOG": 5.0}, {"SOG": 5.0}, {"SOG": None, "LAT": 31.0},
        {"MMSI": 7, "BaseDateTime": "bad", "SOG": 2.0}, {"MMSI": 7, "BaseDateTime": None, "SOG": 1.0},
    )
    rows = {r.MMSI: r.SOG for r in curate(raw).collect()}
    assert rows == {"366000001": 5.0, "000000007": 1.0}
    assert curate(raw).count() == 2


def test_result_does_not_depend_on_the_order_of_rows(messages):
    rows = [{"MMSI": i % 5, "SOG": float(i % 7), "COG": float(i % 11)} for i in range(60)]
    first = sorted(map(tuple, curate(messages(*rows)).collect()))
    second = sorted(map(tuple, curate(messages(*rows[::-1]).repartition(3)).collect()))
    assert first == second


def test_a_key_with_most_rows(messages):
    copies = messages({}).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(20000))))
    raw = copies.drop("i").withColumn("SOG", F.rand(3) * 60 + 1)
    least = raw.agg(F.min("SOG")).first()[0]
    assert [r.SOG for r in curate(raw).collect()] == [least]


def test_plan_has_one_shuffle_and_no_python(messages):
    plan = plan_of(curate(messages({})))
    assert "Python" not in plan and "InPandas" not in plan
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("WindowGroupLimit") == 2
    assert "BroadcastHashJoin" in plan


def test_keys_can_be_chosen(messages):
    rows = clean(messages({"SOG": 1.0}, {"SOG": 2.0, "BaseDateTime": "2024-01-06T00:00:00"}))
    assert deduplicate(rows, ["MMSI"], ["BaseDateTime"]).count() == 1


def test_generated_code_is_small_enough_for_the_jit(spark, messages, tmp_path):
    """HotSpot leaves methods above 8,000 bytes to the interpreter."""
    path = str(tmp_path / "raw")
    messages({}).write.parquet(path)
    assert 1000 < largest_method(spark, curate(spark.read.parquet(path))) < 8000


def test_generated_code_is_small_enough_for_the_jit_above_the_view_of_events(spark, tmp_path):
    """The expressions of the view and of the cleaning share a method."""
    spark.sql(
        """SELECT id AS event_id, timestamp_ntz'2024-01-05 10:00:00' AS ts, id AS user_id,
           'view' AS event_type, 8D AS value FROM range(5)"""
    ).write.parquet(str(tmp_path / "events.parquet"))
    curated = curate(raw_messages(spark, str(tmp_path)))
    assert 1000 < largest_method(spark, curated) < 8000


@pytest.mark.parametrize("lat", [None, -90.0, 90.0, 90.000001, -90.000001, 0.0, float("nan"), float("inf")])
def test_rows_go_as_their_cleaned_positions_say(messages, lat):
    places = [None, 180.0, 541.0, -541.0, float("nan"), float("-inf")]
    raw = messages(*[{"LAT": lat, "LON": lon} for lon in places])
    cleaned = raw.select(rule.latitude("LAT").alias("LAT"), rule.longitude("LON").alias("LON"))
    wanted = cleaned.where(rule.has_position()).collect()
    assert sorted(map(str, clean(raw).select("LAT", "LON").collect())) == sorted(map(str, wanted))
