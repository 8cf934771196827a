import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import plan_of
from vesselflow.functions.geo import geohash_centre, geohash_encode, map_points
from vesselflow.schema import GEOHASH_ALPHABET


def bisect_geohash(lat, lon, precision):
    """Geohash by its definition: halve the ranges in turn, longitude first."""
    ranges = {"lon": [-180.0, 180.0], "lat": [-90.0, 90.0]}
    bits = []
    for i in range(5 * precision):
        axis, value = ("lon", lon) if i % 2 == 0 else ("lat", lat)
        middle = sum(ranges[axis]) / 2
        bits.append(int(value >= middle))
        ranges[axis][1 - bits[-1]] = middle
    digits = [int("".join(map(str, bits[i : i + 5])), 2) for i in range(0, len(bits), 5)]
    return "".join(GEOHASH_ALPHABET[d] for d in digits)


POINTS = [
    (0.0, 0.0), (90.0, 180.0), (-90.0, -180.0), (57.64911, 10.40744), (45.0, -123.75), (42.6, -5.6),
    *[
        (round(random.Random(i).uniform(-90, 90), 5), round(random.Random(-i - 1).uniform(-180, 180), 5))
        for i in range(2000)
    ],
]


@pytest.mark.parametrize("precision", [1, 5, 6, 9, 12])
def test_encode_equals_bisection(spark, precision):
    df = spark.createDataFrame(POINTS, "lat double, lon double")
    rows = df.select("lat", "lon", geohash_encode("lat", "lon", precision).alias("g")).collect()
    assert all(r.g == bisect_geohash(r.lat, r.lon, precision) for r in rows)


def test_encode_known_and_null(spark):
    df = spark.createDataFrame(
        [(57.64911, 10.40744), (None, 1.0), (1.0, None)], "lat double, lon double"
    )
    assert [r[0] for r in df.select(geohash_encode("lat", "lon")).collect()] == ["u4pruydqq", None, None]
    with pytest.raises(ValueError):
        geohash_encode("lat", "lon", 13)


@pytest.mark.parametrize("precision", [1, 4, 9, 12])
def test_decode_is_the_centre(spark, precision):
    df = spark.createDataFrame(POINTS, "la double, lo double")
    lat, lon = geohash_centre("g")
    lat_cell = 180 / 2 ** (5 * precision // 2)
    lon_cell = 360 / 2 ** ((5 * precision + 1) // 2)
    decoded = df.withColumn("g", geohash_encode("la", "lo", precision)).select("*", lat.alias("lat"), lon.alias("lon"))
    for r in decoded.collect():
        assert abs(r.lat - r.la) <= lat_cell / 2 + 1e-9
        assert abs(r.lon - r.lo) <= lon_cell / 2 + 1e-9
        assert bisect_geohash(r.lat, r.lon, precision) == r.g


def test_map_points_drops_what_is_no_geohash(spark):
    df = spark.createDataFrame(
        [("u4pruydqq",), ("U4PRUYDQQ",), ("ail",), ("",), (None,), ("0" * 13,)], "geohash9 string"
    )
    rows = map_points(df.withColumn("LAT", F.lit(1.0))).collect()
    assert len(rows) == 2 and rows[0] == rows[1]
    assert abs(rows[0].lat - 57.64911) < 1e-4 and abs(rows[0].lon - 10.40744) < 1e-4


def test_no_python_worker(spark):
    df = spark.createDataFrame(POINTS, "lat double, lon double")
    plan = plan_of(df.select(geohash_encode("lat", "lon")))
    assert "Python" not in plan and "Arrow" not in plan
