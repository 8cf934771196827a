import datetime as dt

import pytest

from tests.conftest import plan_of
from vesselflow.functions import predicates as P


@pytest.fixture(scope="module")
def table(spark):
    rows = [
        (1, "000000001", dt.datetime(2024, 1, 1, 0, 0, 0), "Sailing", 10.0, 20.0),
        (2, "000000002", dt.datetime(2024, 1, 2, 23, 59, 59), "Tug", -10.0, 179.0),
        (3, "000000003", dt.datetime(2024, 1, 3, 0, 0, 0), None, 0.0, -179.0),
        (4, "000000004", None, "None", 5.0, 5.0),
    ]
    return spark.createDataFrame(
        rows, "i int, MMSI string, BaseDateTime timestamp, VesselTypeName string, LAT double, LON double"
    )


def kept(table, predicate):
    return sorted(r.i for r in table.where(predicate).collect())


def test_days_are_inclusive_and_optional(table):
    assert kept(table, P.date_between("2024-01-01", "2024-01-02")) == [1, 2]
    assert kept(table, P.date_between(dt.date(2024, 1, 2), None)) == [2, 3]
    assert kept(table, P.date_between(None, "2024-01-01")) == [1]
    assert kept(table, P.date_between()) == [1, 2, 3, 4]


def test_lists(table):
    assert kept(table, P.in_list(["Sailing"])) == [1]
    assert kept(table, P.in_list([None])) == [4]
    assert kept(table, P.in_list([])) == kept(table, P.in_list(None)) == [1, 2, 3, 4]
    assert kept(table, P.mmsi_in(["000000002", "x"])) == [2]
    assert kept(table, P.in_list(["it's", "Tug"])) == [2]


def test_box(table):
    assert kept(table, P.in_bbox(0, 10, 5, 20)) == [1, 4]
    assert kept(table, P.in_bbox(lat_max=0)) == [2, 3]
    assert kept(table, P.in_bbox(0, 0, 0, 0, use_bbox=False)) == [1, 2, 3, 4]
    assert kept(table, P.in_bbox(lon_min=170, lon_max=-170)) == []


def test_presence(table):
    assert kept(table, P.all_present("BaseDateTime", "VesselTypeName")) == [1, 2]


def test_days_reach_the_scan_and_prune_months(spark, table, tmp_path):
    from pyspark.sql import functions as F

    path = str(tmp_path / "t")
    table.withColumn("ym", F.date_format("BaseDateTime", "yyyy-MM")).write.partitionBy("ym").parquet(path)
    stored = spark.read.parquet(path)
    assert dict(stored.dtypes)["ym"] == "string"
    plan = plan_of(P.within_days(stored, "2024-01-01", "2024-01-02").select("i"))
    assert "PushedFilters: [IsNotNull(BaseDateTime), GreaterThanOrEqual(BaseDateTime" in plan
    assert "PartitionFilters: [isnotnull(ym" in plan
    assert kept(P.within_days(stored, "2024-01-01", "2024-01-02"), P.all_present()) == [1, 2]
