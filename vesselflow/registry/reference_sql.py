"""The message views in plain SQL, on which the checks are written.

They follow the rules of the data in their own way (joins and bit sums instead of
maps and permuted alphabets), so that equal results mean something.
"""

from __future__ import annotations

from vesselflow import schema as S
from vesselflow.fixture import MESSAGES_SQL

RAW = f"raw AS ({MESSAGES_SQL.format(events='events')})"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def code_rows(codes: dict[int, str]) -> str:
    return ", ".join(f"({code}, {_quoted(name)})" for code, name in codes.items())


def geohash(lat: str, lon: str, precision: int = 9) -> str:
    """Bit by bit: bit number b belongs to longitude if b is even."""
    bits = 5 * precision
    lon_bits, lat_bits = (bits + 1) // 2, bits // 2
    x = f"least(CAST(floor(({lon} + 180) / 360 * {2**lon_bits}) AS BIGINT), {2**lon_bits - 1})"
    y = f"least(CAST(floor(({lat} + 90) / 180 * {2**lat_bits}) AS BIGINT), {2**lat_bits - 1})"
    characters = []
    for p in range(precision):
        terms = []
        for k in range(5):
            b = 5 * p + k
            cell, shift = (x, lon_bits - 1 - b // 2) if b % 2 == 0 else (y, lat_bits - 1 - b // 2)
            terms.append(f"(({cell} >> {shift}) & 1) * {16 >> k}")
        characters.append(f"substr('{S.GEOHASH_ALPHABET}', CAST({' + '.join(terms)} AS INTEGER) + 1, 1)")
    return " || ".join(characters)


NAME = r"regexp_replace(regexp_replace(upper(trim({c})), '[^A-Z0-9 ]', '', 'g'), '\s+', ' ', 'g')"

CLEANED = rf"""
cleaned AS (
  SELECT
    lpad(regexp_extract(CAST(MMSI AS VARCHAR), '(\d{{1,9}})$', 1), 9, '0') AS MMSI,
    try_strptime(BaseDateTime, '%Y-%m-%dT%H:%M:%S') AS BaseDateTime,
    CASE WHEN LAT >= -90 AND LAT <= 90 THEN round(LAT, 5) END AS LAT,
    round(CASE WHEN LON > 180 THEN LON - 360 WHEN LON < -180 THEN LON + 360 ELSE LON END, 5) AS LON,
    CASE WHEN SOG >= 0 AND SOG <= 70 THEN SOG END AS SOG,
    COG % 360 AS COG,
    CASE WHEN Heading <> 511 THEN Heading % 360 END AS Heading,
    {NAME.format(c="VesselName")} AS VesselName,
    CASE WHEN trim(IMO) IN ('IMO0000000', '0', '') THEN NULL ELSE trim(IMO) END AS IMO,
    {NAME.format(c="CallSign")} AS CallSign,
    trim(VesselType) AS VesselType,
    Status,
    CASE WHEN Length >= 1 AND Length <= 450 THEN Length END AS Length,
    CASE WHEN Width >= 1 AND Width <= 70 THEN Width END AS Width,
    CASE WHEN Draft >= 0 AND Draft <= 25 THEN Draft END AS Draft,
    trim(Cargo) AS Cargo,
    upper(trim(TransceiverClass)) AS TransceiverClass
  FROM raw
),
positioned AS (SELECT * FROM cleaned WHERE LAT IS NOT NULL AND LON IS NOT NULL)"""

_TIE_BREAK = ", ".join(
    f"{c} NULLS FIRST" for c in S.RAW_COLUMNS if c not in ("MMSI", "BaseDateTime")
)

UNIQUE = f"""
single AS (
  SELECT * EXCLUDE (copy) FROM (
    SELECT *, row_number() OVER (PARTITION BY MMSI, BaseDateTime ORDER BY {_TIE_BREAK}) AS copy
    FROM positioned
  ) WHERE copy = 1
)"""

STATUS_CODE = r"CASE WHEN regexp_matches(trim(Status), '^[+-]?\d+(\.\d*)?$') THEN try_cast(split_part(trim(Status), '.', 1) AS INTEGER) END"
TYPE_CODE = r"CASE WHEN regexp_matches(VesselType, '^\d+$') THEN try_cast(VesselType AS INTEGER) END"
TYPE_CLASS = """CASE
      WHEN {c} BETWEEN 20 AND 29 THEN 'WIG'
      WHEN {c} BETWEEN 30 AND 39 THEN 'Small/Leisure'
      WHEN {c} BETWEEN 40 AND 49 THEN 'HSC'
      WHEN {c} BETWEEN 50 AND 59 THEN 'Service/Special'
      WHEN {c} BETWEEN 60 AND 69 THEN 'Passenger'
      WHEN {c} BETWEEN 70 AND 79 THEN 'Cargo'
      WHEN {c} BETWEEN 80 AND 89 THEN 'Tanker'
      WHEN {c} BETWEEN 90 AND 99 THEN 'Other'
      ELSE 'Unspecified' END"""
STATUS_NAME = """CASE WHEN {c} IS NULL THEN 'Not reported'
      WHEN {c} < 0 OR {c} > 15 THEN 'Unknown code' ELSE {name} END"""

CATALOGUES = f"""
types(type_code, type_name) AS (VALUES {code_rows(S.VESSEL_TYPE_NAMES)}),
statuses(status_code, status_name) AS (VALUES {code_rows(S.NAV_STATUS_NAMES)})"""

CURATED = f"""
coded AS (
  SELECT *, {STATUS_CODE} AS NavStatusInt, {TYPE_CODE} AS VesselTypeInt FROM single
),
curated AS (
  SELECT coded.*,
    VesselType AS VesselTypeCode,
    type_name AS VesselTypeName,
    {TYPE_CLASS.format(c="VesselTypeInt")} AS VesselTypeClass,
    {STATUS_NAME.format(c="NavStatusInt", name="status_name")} AS NavStatusName,
    strftime(BaseDateTime, '%Y-%m') AS ym,
    CAST(BaseDateTime AS DATE) AS date,
    CAST(hour(BaseDateTime) AS INTEGER) AS hour,
    strftime(BaseDateTime, '%a') AS dow,
    CAST(week(BaseDateTime) AS INTEGER) AS week,
    CAST(month(BaseDateTime) AS INTEGER) AS month,
    CAST(quarter(BaseDateTime) AS INTEGER) AS quarter,
    SOG * 0.514444 AS SOG_ms,
    {geohash("LAT", "LON")} AS geohash9
  FROM coded
  LEFT JOIN types ON VesselTypeInt = type_code
  LEFT JOIN statuses ON NavStatusInt = status_code
)"""


def over_raw(select: str, *views: str) -> str:
    return "WITH " + ", ".join([RAW, *views]) + " " + select


def over_cleaned(select: str, *views: str) -> str:
    return over_raw(select, CLEANED, *views)


def over_curated(select: str, *views: str) -> str:
    return over_raw(select, CLEANED, UNIQUE, CATALOGUES, CURATED, *views)
