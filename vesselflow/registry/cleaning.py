"""Queries for the cleaning rules and the geohash (CUR1-CUR22, GEO1, GEO2)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from vesselflow.functions import cleaning as rule
from vesselflow.functions.geo import geohash_encode, map_points
from vesselflow.operators.curation import clean, curate, deduplicate
from vesselflow.operators.lookups import with_status_name
from vesselflow.registry.base import Query
from vesselflow.registry.reference_sql import (
    CATALOGUES,
    NAME,
    STATUS_CODE,
    STATUS_NAME,
    TYPE_CLASS,
    TYPE_CODE,
    UNIQUE,
    geohash,
    over_cleaned,
    over_curated,
    over_raw,
)

KEY = "MMSI BaseDateTime"


def _each(shape: str, sql: str, **columns: Callable[[], Column]) -> Query:
    """The raw key columns and the result of one rule per raw message."""
    return Query(
        lambda c: c.raw.select("MMSI", "BaseDateTime", *[v().alias(k) for k, v in columns.items()]),
        f"{KEY} {shape}",
        over_raw(f"SELECT MMSI, BaseDateTime, {sql} FROM raw"),
    )


QUERIES = {
    "cur01_mmsi": _each(
        "mmsi9",
        r"lpad(regexp_extract(CAST(MMSI AS VARCHAR), '(\d{1,9})$', 1), 9, '0') AS mmsi9",
        mmsi9=lambda: rule.mmsi("MMSI"),
    ),
    "cur02_message_time": _each(
        "t:ts",
        "try_strptime(BaseDateTime, '%Y-%m-%dT%H:%M:%S') AS ts",
        ts=lambda: rule.message_time("BaseDateTime"),
    ),
    "cur03_numbers": _each(
        "f:lat f:lon f:sog f:cog f:head f:len f:wid f:dra f:type_number",
        """LAT AS lat, LON AS lon, SOG AS sog, COG AS cog, Heading AS head, Length AS len,
           Width AS wid, Draft AS dra, try_cast(VesselType AS DOUBLE) AS type_number""",
        **{
            name: lambda column=column: rule.number(F.col(column).cast("string"))
            for name, column in {
                "lat": "LAT", "lon": "LON", "sog": "SOG", "cog": "COG", "head": "Heading",
                "len": "Length", "wid": "Width", "dra": "Draft", "type_number": "VesselType",
            }.items()
        },
    ),
    "cur04_text": _each(
        "name imo call_sign vessel_type cargo transceiver",
        """trim(VesselName) AS name, trim(IMO) AS imo, trim(CallSign) AS call_sign,
           trim(VesselType) AS vessel_type, trim(Cargo) AS cargo,
           upper(trim(TransceiverClass)) AS transceiver""",
        name=lambda: rule.text("VesselName"),
        imo=lambda: rule.text("IMO"),
        call_sign=lambda: rule.text("CallSign"),
        vessel_type=lambda: rule.text("VesselType"),
        cargo=lambda: rule.text("Cargo"),
        transceiver=lambda: rule.transceiver_class("TransceiverClass"),
    ),
    "cur05_latitude": _each(
        "f:lat",
        "CASE WHEN LAT >= -90 AND LAT <= 90 THEN round(LAT, 5) END AS lat",
        lat=lambda: rule.latitude("LAT"),
    ),
    "cur06_longitude": _each(
        "f:lon",
        """round(CASE WHEN LON > 180 THEN LON - 360 WHEN LON < -180 THEN LON + 360
           ELSE LON END, 5) AS lon""",
        lon=lambda: rule.longitude("LON"),
    ),
    "cur07_has_position": Query(
        lambda c: clean(c.raw).select("MMSI", "BaseDateTime", "LAT", "LON"),
        "MMSI t:BaseDateTime f:LAT f:LON",
        over_cleaned("SELECT MMSI, BaseDateTime, LAT, LON FROM positioned"),
    ),
    "cur08_known_heading": _each(
        "f:head", "nullif(Heading, 511) AS head", head=lambda: rule.known_heading("Heading")
    ),
    "cur09_within_turn": _each(
        "f:head f:cog f:negative",
        "nullif(Heading, 511) % 360 AS head, COG % 360 AS cog, (0 - COG) % 360 AS negative",
        head=lambda: rule.heading("Heading"),
        cog=lambda: rule.within_turn("COG"),
        negative=lambda: rule.within_turn(0 - F.col("COG")),
    ),
    "cur10_speed": _each(
        "f:sog", "CASE WHEN SOG >= 0 AND SOG <= 70 THEN SOG END AS sog", sog=lambda: rule.speed("SOG")
    ),
    "cur11_imo": _each(
        "imo",
        "CASE WHEN trim(IMO) NOT IN ('IMO0000000', '0', '') THEN trim(IMO) END AS imo",
        imo=lambda: rule.imo(rule.text("IMO")),
    ),
    "cur12_dimensions": _each(
        "f:len f:wid f:dra",
        """CASE WHEN Length BETWEEN 1 AND 450 THEN Length END AS len,
           CASE WHEN Width BETWEEN 1 AND 70 THEN Width END AS wid,
           CASE WHEN Draft BETWEEN 0 AND 25 THEN Draft END AS dra""",
        len=lambda: rule.length("Length"),
        wid=lambda: rule.width("Width"),
        dra=lambda: rule.draft("Draft"),
    ),
    "cur13_vessel_type_int": _each(
        "code", f"{TYPE_CODE} AS code", code=lambda: rule.vessel_type_int("VesselType")
    ),
    "cur14_vessel_type_name": Query(
        lambda c: c.raw.select(
            "MMSI",
            "BaseDateTime",
            rule.vessel_type_name(rule.vessel_type_int("VesselType")).alias("name"),
        ),
        f"{KEY} name",
        over_raw(
            f"""SELECT MMSI, BaseDateTime, type_name AS name
                FROM raw LEFT JOIN types ON ({TYPE_CODE}) = type_code""",
            CATALOGUES,
        ),
    ),
    "cur15_vessel_type_class": _each(
        "class",
        TYPE_CLASS.format(c=f"({TYPE_CODE})") + " AS class",
        **{"class": lambda: rule.vessel_type_class(rule.vessel_type_int("VesselType"))},
    ),
    "cur16_nav_status": Query(
        lambda c: with_status_name(c.raw).select("MMSI", "BaseDateTime", "NavStatusInt"),
        f"{KEY} NavStatusInt",
        over_raw(f"SELECT MMSI, BaseDateTime, {STATUS_CODE} AS NavStatusInt FROM raw"),
    ),
    "cur17_nav_status_name": Query(
        lambda c: with_status_name(c.raw).select("MMSI", "BaseDateTime", "Status", "NavStatusName"),
        f"{KEY} Status NavStatusName",
        over_raw(
            f"""SELECT MMSI, BaseDateTime, Status,
                {STATUS_NAME.format(c=f"({STATUS_CODE})", name="status_name")} AS NavStatusName
                FROM raw LEFT JOIN statuses ON ({STATUS_CODE}) = status_code""",
            CATALOGUES,
        ),
    ),
    "cur18_plain_names": _each(
        "name call_sign",
        f"{NAME.format(c='VesselName')} AS name, {NAME.format(c='CallSign')} AS call_sign",
        name=lambda: rule.plain_name("VesselName"),
        call_sign=lambda: rule.plain_name("CallSign"),
    ),
    "cur19_time_fields": Query(
        lambda c: c.raw.select(
            "MMSI",
            F.col("BaseDateTime").alias("text"),
            rule.message_time("BaseDateTime").alias("BaseDateTime"),
        ).withColumns(rule.time_fields()),
        "MMSI text ym t:date hour dow week month quarter",
        over_raw(
            """SELECT MMSI, BaseDateTime AS text, strftime(ts, '%Y-%m') AS ym,
               CAST(ts AS DATE) AS date, CAST(hour(ts) AS INTEGER) AS hour,
               strftime(ts, '%a') AS dow, CAST(week(ts) AS INTEGER) AS week,
               CAST(month(ts) AS INTEGER) AS month, CAST(quarter(ts) AS INTEGER) AS quarter
               FROM (SELECT *, CAST(replace(BaseDateTime, 'T', ' ') AS TIMESTAMP) AS ts FROM raw)"""
        ),
    ),
    "cur20_speed_ms": _each("f:sog_ms", "SOG * 0.514444 AS sog_ms", sog_ms=lambda: rule.speed_ms("SOG")),
    "cur21_deduplicate": Query(
        lambda c: deduplicate(clean(c.raw)),
        "MMSI t:BaseDateTime f:LAT f:LON f:SOG f:COG f:Heading VesselName IMO CallSign VesselType "
        "Status f:Length f:Width f:Draft Cargo TransceiverClass",
        over_cleaned("SELECT * FROM single", UNIQUE),
    ),
    "cur22_curate": Query(
        lambda c: curate(c.raw),
        "NavStatusInt MMSI t:BaseDateTime f:LAT f:LON f:SOG f:COG f:Heading VesselName IMO CallSign "
        "VesselType Status f:Length f:Width f:Draft Cargo TransceiverClass VesselTypeInt "
        "VesselTypeCode VesselTypeName VesselTypeClass NavStatusName ym t:date hour dow week month "
        "quarter f:SOG_ms geohash9",
        over_curated("SELECT * FROM curated"),
    ),
    "geo1_geohash": Query(
        lambda c: clean(c.raw).select(
            "MMSI",
            "BaseDateTime",
            geohash_encode("LAT", "LON").alias("geohash9"),
            geohash_encode("LAT", "LON", 6).alias("geohash6"),
            geohash_encode("LAT", "LON", 1).alias("geohash1"),
        ),
        "MMSI t:BaseDateTime geohash9 geohash6 geohash1",
        over_cleaned(
            f"""SELECT MMSI, BaseDateTime, {geohash("LAT", "LON")} AS geohash9,
                {geohash("LAT", "LON", 6)} AS geohash6, {geohash("LAT", "LON", 1)} AS geohash1
                FROM positioned"""
        ),
    ),
    "geo2_map_points": Query(
        lambda c: map_points(c.curated),
        "f:lat f:lon",
        over_curated(
            """SELECT (floor((LAT + 90) / 180 * 4194304) + 0.5) / 4194304 * 180 - 90 AS lat,
               (floor((LON + 180) / 360 * 8388608) + 0.5) / 8388608 * 360 - 180 AS lon
               FROM curated"""
        ),
    ),
}
