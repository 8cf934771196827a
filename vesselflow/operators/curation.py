"""From raw messages to the curated table (CUR1-CUR22)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from vesselflow.functions import cleaning as rule
from vesselflow.functions.geo import geohash_encode
from vesselflow.operators.lookups import with_status_name
from vesselflow.schema import CURATED_COLUMNS, INGEST_COLUMNS, MESSAGE_KEY, RAW_COLUMNS


def clean(messages: DataFrame) -> DataFrame:
    """CUR1-CUR12 and CUR18: the raw columns, cleaned; rows without a position go.

    These go first, told by the bare numbers, because rounding makes no NULL. Asked of the
    cleaned columns, Spark would write their rounding into the filter as well, and with the
    expressions of a view below the generated method outgrows what HotSpot compiles.
    """
    whole_number = isinstance(messages.schema["MMSI"].dataType, IntegralType)
    located = messages.where(rule.can_be_located(rule.number("LAT"), rule.number("LON")))
    return located.withColumns(
        {
            "MMSI": rule.mmsi("MMSI", whole_number),
            "BaseDateTime": rule.message_time("BaseDateTime"),
            "LAT": rule.latitude(rule.number("LAT")),
            "LON": rule.longitude(rule.number("LON")),
            "SOG": rule.speed(rule.number("SOG")),
            "COG": rule.within_turn(rule.number("COG")),
            "Heading": rule.heading(rule.number("Heading")),
            "VesselName": rule.plain_name("VesselName"),
            "IMO": rule.imo(rule.text("IMO")),
            "CallSign": rule.plain_name("CallSign"),
            "VesselType": rule.text("VesselType"),
            "Length": rule.length(rule.number("Length")),
            "Width": rule.width(rule.number("Width")),
            "Draft": rule.draft(rule.number("Draft")),
            "Cargo": rule.text("Cargo"),
            "TransceiverClass": rule.transceiver_class("TransceiverClass"),
        }
    )


def deduplicate(
    rows: DataFrame, key: Sequence[str] = MESSAGE_KEY, order: Sequence[str] | None = None
) -> DataFrame:
    """CUR21: one row per key, the first in the order of all other columns.

    NULL keys count as equal. Spark limits each key to one row before the shuffle
    too (WindowGroupLimit), so a key with very many copies stays cheap.
    """
    others = [c for c in rows.columns if c not in key] if order is None else order
    window = Window.partitionBy(*key).orderBy(*[F.col(c).asc_nulls_first() for c in others])
    numbered = rows.withColumn("_copy", F.row_number().over(window))
    return numbered.where("_copy = 1").drop("_copy")


def enrich(messages: DataFrame) -> DataFrame:
    """CUR13-CUR17, CUR19, CUR20 and GEO1: columns derived from the cleaned ones."""
    typed = messages.withColumns(
        {
            "VesselTypeInt": rule.vessel_type_int("VesselType"),
            "VesselTypeCode": F.col("VesselType"),
            **rule.time_fields("BaseDateTime"),
            "SOG_ms": rule.speed_ms("SOG"),
            "geohash9": geohash_encode("LAT", "LON"),
        }
    )
    named = typed.withColumns(
        {
            "VesselTypeName": rule.vessel_type_name("VesselTypeInt"),
            "VesselTypeClass": rule.vessel_type_class("VesselTypeInt"),
        }
    )
    return with_status_name(named)


def curate(messages: DataFrame) -> DataFrame:
    """CUR22: cleaned, deduplicated and enriched messages.

    Every derived column is a function of the cleaned ones, so the duplicates go
    first and the shuffle carries the narrow rows only.
    """
    ingested = [c for c in INGEST_COLUMNS if c in messages.columns]
    cleaned = clean(messages.select(*RAW_COLUMNS, *ingested))
    return enrich(deduplicate(cleaned)).select(*CURATED_COLUMNS, *ingested)
