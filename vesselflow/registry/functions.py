"""Queries for the scalar functions, by family, over all messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from vesselflow import schema as S
from vesselflow.functions import stats
from vesselflow.operators.tracks import with_previous
from vesselflow.registry.base import Query
from vesselflow.registry.reference_sql import over_curated, over_raw

KEY = "MMSI t:BaseDateTime"


def _on_raw(shape: str, sql: str, columns) -> Query:
    return Query(
        lambda c: c.raw.select("MMSI", "BaseDateTime", *[v.alias(k) for k, v in columns().items()]),
        f"MMSI BaseDateTime {shape}",
        over_raw(f"SELECT MMSI, BaseDateTime, {sql} FROM raw"),
    )


def _on_curated(shape: str, sql: str, columns) -> Query:
    return Query(
        lambda c: c.curated.select("MMSI", "BaseDateTime", *[v.alias(k) for k, v in columns().items()]),
        f"{KEY} {shape}",
        over_curated(f"SELECT MMSI, BaseDateTime, {sql} FROM curated"),
    )


def _minutes(c):
    steps = with_previous(c.curated.select("MMSI", "BaseDateTime"), [])
    return steps.select(
        "MMSI",
        "BaseDateTime",
        stats.minutes_between("BaseDateTime", "prev_BaseDateTime").alias("minutes"),
    )


QUERIES = {
    "fn_string": _on_raw(
        "digits letters padded trimmed upper numeric placeholder",
        r"""regexp_extract(CallSign, '(\d+)', 1) AS digits,
            regexp_replace(VesselName, '[^a-z]', '', 'g') AS letters,
            lpad(VesselType, 4, '0') AS padded, trim(VesselName) AS trimmed,
            upper(TransceiverClass) AS upper, regexp_matches(VesselType, '^\d+$') AS numeric,
            IMO IN ('IMO0000000', '0', '') AS placeholder""",
        lambda: {
            "digits": F.regexp_extract("CallSign", r"(\d+)", 1),
            "letters": F.regexp_replace("VesselName", "[^a-z]", ""),
            "padded": F.lpad("VesselType", 4, "0"),
            "trimmed": F.trim("VesselName"),
            "upper": F.upper("TransceiverClass"),
            "numeric": F.col("VesselType").rlike(r"^\d+$"),
            "placeholder": F.col("IMO").isin(*S.IMO_PLACEHOLDERS),
        },
    ),
    "fn_date_fields": _on_curated(
        "day_name sunday_first t:d",
        """dayname(BaseDateTime) AS day_name, CAST(dayofweek(BaseDateTime) + 1 AS INTEGER) AS sunday_first,
           CAST(BaseDateTime AS DATE) AS d""",
        lambda: {
            "day_name": F.date_format("BaseDateTime", "EEEE"),
            "sunday_first": F.dayofweek("BaseDateTime"),
            "d": F.to_date("BaseDateTime"),
        },
    ),
    "fn_date_trunc": _on_curated(
        "t:by_hour t:by_day",
        """date_trunc('hour', BaseDateTime) AS by_hour,
           CAST(date_trunc('day', BaseDateTime) AS TIMESTAMP) AS by_day""",
        lambda: {
            "by_hour": F.date_trunc("HOUR", "BaseDateTime"),
            "by_day": F.date_trunc("DAY", "BaseDateTime"),
        },
    ),
    "fn_date_add": _on_curated(
        "t:next_day t:midnight",
        """CAST(date + 1 AS DATE) AS next_day, CAST(date AS TIMESTAMP) AS midnight""",
        lambda: {
            "next_day": F.date_add("date", 1),
            "midnight": F.col("date").cast("timestamp"),
        },
    ),
    "fn_minutes_between": Query(
        _minutes,
        f"{KEY} minutes",
        over_curated(
            """SELECT MMSI, BaseDateTime, date_sub('minute', lag(BaseDateTime) OVER w, BaseDateTime) AS minutes
               FROM curated WHERE BaseDateTime IS NOT NULL
               WINDOW w AS (PARTITION BY MMSI ORDER BY BaseDateTime)"""
        ),
    ),
    "fn_math": _on_curated(
        "f:distance f:whole f:remainder f:rounded f:nonzero",
        """abs(LON) AS distance, floor(COG / 90) AS whole, (COG - 200) % 90 AS remainder,
           round(LAT, 1) AS rounded, nullif(hour, 0) AS nonzero""",
        lambda: {
            "distance": F.abs("LON"),
            "whole": F.floor(F.col("COG") / 90),
            "remainder": (F.col("COG") - 200) % 90,
            "rounded": F.round("LAT", 1),
            "nonzero": F.nullif("hour", F.lit(0)),
        },
    ),
    "fn_angles": _on_curated(
        "f:plain f:circular",
        """abs(COG - Heading) AS plain,
           least(abs(COG - Heading), 360 - abs(COG - Heading)) AS circular""",
        lambda: {
            "plain": stats.plain_difference("COG", "Heading"),
            "circular": stats.circular_difference("COG", "Heading"),
        },
    ),
    "fn_cast": _on_raw(
        "f:as_double as_int as_text",
        """try_cast(VesselType AS DOUBLE) AS as_double, try_cast(VesselType AS INTEGER) AS as_int,
           CAST(MMSI AS VARCHAR) AS as_text""",
        lambda: {
            "as_double": F.col("VesselType").try_cast("double"),
            "as_int": F.col("VesselType").try_cast("int"),
            "as_text": F.col("MMSI").cast("string"),
        },
    ),
    "fn_conditional": _on_curated(
        "pace status daytime",
        """CASE WHEN SOG < 1 THEN 'still' WHEN SOG < 10 THEN 'slow' ELSE 'other' END AS pace,
           coalesce(NavStatusName, VesselTypeName, 'none') AS status, hour BETWEEN 6 AND 18 AS daytime""",
        lambda: {
            "pace": F.when(F.col("SOG") < 1, "still").when(F.col("SOG") < 10, "slow").otherwise("other"),
            "status": F.coalesce("NavStatusName", "VesselTypeName", F.lit("none")),
            "daytime": F.col("hour").between(6, 18),
        },
    ),
}
