import datetime as dt
import random
import uuid

import pytest

from tests.conftest import plan_of
from vesselflow.operators.tracks import previous_on_tracks, with_previous, write_tracks

SCHEMA = "MMSI string, BaseDateTime timestamp, COG double"
START = dt.datetime(2024, 1, 1)


def expected(rows):
    last, out = {}, set()
    for mmsi, ts, cog in sorted(rows, key=lambda r: (r[0], r[1])):
        out.add((mmsi, ts, cog, *last.get(mmsi, (None, None))))
        last[mmsi] = (cog, ts)
    return out


def actual(df):
    return {
        (r.MMSI, r.BaseDateTime, r.COG, r.prev_COG, r.prev_BaseDateTime)
        for r in with_previous(df, ["COG"]).collect()
    }


def test_equals_a_sorted_scan(spark):
    pick = random.Random(1)
    seconds = {(v, pick.randrange(40 * 86400)) for v in "abc" for _ in range(300)}
    rows = [
        (v, START + dt.timedelta(seconds=s), None if pick.random() < 0.1 else pick.uniform(0, 360))
        for v, s in sorted(seconds)
    ]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert actual(df) == expected(rows)


def test_days_without_messages_are_bridged(spark):
    rows = [("a", START, 1.0), ("a", START + dt.timedelta(days=9), 2.0), ("b", START, 3.0)]
    assert actual(spark.createDataFrame(rows, SCHEMA)) == expected(rows)


def test_rows_without_time_are_left_out(spark):
    rows = [("a", None, 1.0), ("a", START, 2.0)]
    assert actual(spark.createDataFrame(rows, SCHEMA)) == {("a", START, 2.0, None, None)}


def test_messages_are_split_by_vessel_and_day(spark):
    plan = plan_of(with_previous(spark.createDataFrame([("a", START, 1.0)], SCHEMA), ["COG"]))
    by_vessel_only = [line for line in plan.splitlines() if "hashpartitioning(MMSI" in line and "_day" not in line]
    # Only the one-row-per-vessel-day table is gathered by vessel.
    assert len(by_vessel_only) == 1
    assert plan.count("Exchange hashpartitioning") == 3


@pytest.fixture
def table(spark):
    name = f"tracks_{uuid.uuid4().hex}"
    yield name
    for each in (name, f"{name}_edges"):
        spark.sql(f"DROP TABLE IF EXISTS {each}")


def on_tracks(spark, table, rows, parts):
    write_tracks(spark.createDataFrame(rows, SCHEMA).repartition(5), table, parts)
    found = previous_on_tracks(spark, table, ["COG"])
    assert found.columns == ["MMSI", "BaseDateTime", "COG", "prev_COG", "prev_BaseDateTime"]
    return [tuple(r) for r in found.collect()]


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_a_table_of_tracks_gives_the_same(spark, table, parts):
    pick = random.Random(parts)
    seconds = {(v, pick.randrange(40 * 86400)) for v in "aabcdefg" for _ in range(120)}
    rows = [(v, START + dt.timedelta(seconds=s), None if pick.random() < 0.1 else float(s % 360)) for v, s in seconds]
    found = on_tracks(spark, table, [*rows, ("a", None, 5.0)], parts)
    assert len(found) == len(rows) and set(found) == expected(rows)


def test_a_vessel_without_an_identifier_and_few_rows(spark, table):
    rows = [(None, START + dt.timedelta(hours=h), float(h)) for h in range(6)] + [("a", START, 1.0)]
    found = sorted(on_tracks(spark, table, rows, 7), key=str)
    previous = {(m, t): (c, p) for m, t, _, c, p in found}
    assert previous["a", START] == (None, None) and previous[None, START] == (None, None)
    for h in range(1, 6):
        before = START + dt.timedelta(hours=h - 1)
        assert previous[None, START + dt.timedelta(hours=h)] == (float(h - 1), before)


def test_no_rows(spark, table):
    assert on_tracks(spark, table, [("a", None, 1.0)], 3) == []


def test_one_vessel_fills_many_parts_and_the_lag_moves_no_row(spark, table):
    rows = [("hot", START + dt.timedelta(minutes=m), float(m % 360)) for m in range(4000)] + [(f"v{i}", START, 1.0) for i in range(9)]
    found = on_tracks(spark, table, rows, 12)
    assert set(found) == expected(rows)
    counts = [r["count"] for r in spark.table(table).where("MMSI = 'hot'").groupBy("_part").count().collect()]
    assert len(counts) >= 9 and max(counts) < 1000
    plan = plan_of(previous_on_tracks(spark, table, ["COG"]))
    assert "Exchange hashpartitioning" not in plan and plan.count("FileScan") == 2
