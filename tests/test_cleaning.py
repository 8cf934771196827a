import datetime as dt
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from vesselflow import schema as S
from vesselflow.functions import cleaning as rule
from vesselflow.operators.lookups import with_status_name


def test_mmsi_from_text(evaluate):
    values = ["366000001", "12", "12345678901", "12x", "x77", "", None]
    assert evaluate(rule.mmsi, values) == [
        "366000001", "000000012", "345678901", "000000000", "000000077", "000000000", None,
    ]


def test_mmsi_of_whole_numbers_equals_the_pattern(evaluate):
    values = [0, 5, -5, 366000001, 12345678901, 1000000000, 9000000012, -9223372036854775808, None]
    assert evaluate(lambda c: rule.mmsi(c, True), values, "bigint") == evaluate(rule.mmsi, values, "bigint")


def test_message_time(evaluate):
    values = ["2024-01-05T10:00:59", "2024-01-05 10:00:59", "2024-02-30T00:00:00", "x", "", None]
    assert evaluate(rule.message_time, values) == [dt.datetime(2024, 1, 5, 10, 0, 59)] + [None] * 5


def test_number_of_bad_text_is_null(evaluate):
    assert evaluate(rule.number, ["1.5", "-2", "abc", "", None]) == [1.5, -2.0, None, None, None]


def test_text(evaluate):
    assert evaluate(rule.text, [" a b ", "", None]) == ["a b", "", None]
    assert evaluate(rule.transceiver_class, [" b ", "A"]) == ["B", "A"]


def test_latitude(evaluate):
    values = [-90.0, 90.0, 90.00001, -91.0, 12.3456789, None]
    assert evaluate(rule.latitude, values, "double") == [-90.0, 90.0, None, None, 12.34568, None]


def test_longitude_turns_once(evaluate):
    values = [180.0, 180.5, -180.5, 540.0, 541.0, -541.0, 12.3456789, None]
    assert evaluate(rule.longitude, values, "double") == [
        180.0, -179.5, 179.5, 180.0, 181.0, -181.0, 12.34568, None,
    ]


def test_heading_and_course(evaluate):
    values = [511.0, 360.0, 725.0, -10.0, 0.0, None]
    assert evaluate(rule.heading, values, "double") == [None, 0.0, 5.0, -10.0, 0.0, None]
    assert evaluate(rule.within_turn, [511.0, -370.0], "double") == [151.0, -10.0]


def test_ranges(evaluate):
    def ends(function, low, high):
        values = [low - 0.01, low, high, high + 0.01, None]
        assert evaluate(function, values, "double") == [None, low, high, None, None]

    ends(rule.speed, 0.0, 70.0)
    ends(rule.length, 1.0, 450.0)
    ends(rule.width, 1.0, 70.0)
    ends(rule.draft, 0.0, 25.0)


def test_imo_placeholders(evaluate):
    values = ["IMO0000000", "0", "", "IMO9000001", None]
    assert evaluate(rule.imo, values) == [None, None, None, "IMO9000001", None]


def test_vessel_type(evaluate):
    values = ["70", "070", "7a", "", "5.0", "-1", "99999999999", None]
    codes = [70, 70, None, None, None, None, None, None]
    assert evaluate(rule.vessel_type_int, values) == codes
    numbers = [0, 19, 20, 29, 30, 59, 99, 100, None]
    assert evaluate(rule.vessel_type_name, numbers, "int") == [
        S.VESSEL_TYPE_NAMES.get(n) for n in numbers
    ]
    assert evaluate(rule.vessel_type_class, numbers, "int") == [
        "Unspecified", "Unspecified", "WIG", "WIG", "Small/Leisure", "Service/Special", "Other",
        "Unspecified", "Unspecified",
    ]
    assert len(S.VESSEL_TYPE_NAMES) == 81


def test_status_names(spark, messages):
    statuses = ["0", "1", "9", "13", "15", "16", "-1", "x", "", None]
    rows = with_status_name(messages(*[{"MMSI": i, "Status": s} for i, s in enumerate(statuses)]))
    names = [r.NavStatusName for r in rows.orderBy("MMSI").collect()]
    assert names == [
        "Under way using engine", "At anchor", None, None, "Not defined (default)", "Unknown code",
        "Unknown code", "Not reported", "Not reported", "Not reported",
    ]
    assert rows.columns[0] == "NavStatusInt"


def test_plain_name(evaluate):
    values = ["  m/v  Ship-1 ", "a - b", "a -- - b", "é", "", "x -", "- y", "a\t\tb", None]
    assert evaluate(rule.plain_name, values) == [
        "MV SHIP1", "A B", "A B", "", "", "X ", " Y", "AB", None,
    ]


@given(st.text(alphabet="AB1 -/\té", max_size=14))
@settings(max_examples=500, deadline=None)
def test_one_pass_pattern_equals_two_passes(text):
    two = re.sub(r"\s+", " ", re.sub(r"[^A-Z0-9 ]", "", text))
    one = re.sub(S.NAME_GAPS_PATTERN, lambda m: m.group(1) or "", text)
    assert one == two


def test_time_fields(spark):
    rows = spark.createDataFrame(
        [("2024-01-01T00:00:00",), ("2023-12-31T23:59:59",), ("2024-12-30T12:00:00",)], "t string"
    )
    fields = rows.select(rule.message_time("t").alias("BaseDateTime")).select(
        *[v.alias(k) for k, v in rule.time_fields().items()]
    )
    assert [tuple(r) for r in fields.collect()] == [
        ("2024-01", dt.date(2024, 1, 1), 0, "Mon", 1, 1, 1),
        ("2023-12", dt.date(2023, 12, 31), 23, "Sun", 52, 12, 4),
        ("2024-12", dt.date(2024, 12, 30), 12, "Mon", 1, 12, 4),
    ]


def test_raw_partitions(evaluate):
    values = ["2024-01-05T10:00:00", "2024-1-5", "bad", None]
    assert evaluate(rule.raw_month, values) == ["2024-01", "", "", None]
    assert evaluate(rule.raw_day, values) == ["2024-01-05", "", "", None]
