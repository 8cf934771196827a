"""Geohash as column expressions (GEO1, GEO2).

A geohash is the pair (longitude cell number, latitude cell number) written with
alternating bits, five bits per character. A character therefore takes three bits
of one number and two of the other, so each one is a shift, a mask and a
``substring`` of the alphabet; no Python worker is involved.

A point on a cell border belongs to the upper cell: (0, 0) starts with ``s``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vesselflow.functions.cleaning import ColumnLike, _c
from vesselflow.schema import GEOHASH_ALPHABET, GEOHASH_PRECISION

MAX_PRECISION = 12


def _bit_counts(precision: int) -> tuple[int, int]:
    """Bits of (longitude, latitude); longitude takes the first bit."""
    bits = 5 * precision
    return (bits + 1) // 2, bits // 2


def _weave(three: int, two: int) -> int:
    """Bits a2 b1 a1 b0 a0 of the three-bit and the two-bit number."""
    return (
        (three >> 2 & 1) << 4 | (two >> 1 & 1) << 3 | (three >> 1 & 1) << 2 | (two & 1) << 1 | (three & 1)
    )


# Alphabet sorted so that three * 4 + two is the position of the character.
_BY_PARTS = "".join(GEOHASH_ALPHABET[_weave(a, b)] for a in range(8) for b in range(4))


def _cell(value: Column, low: float, span: float, bits: int) -> Column:
    """Number of the cell on one axis; the upper end belongs to the last cell."""
    cells = 1 << bits
    number = F.floor((value - low) / span * float(cells))
    return F.least(F.greatest(number, F.lit(0)), F.lit(cells - 1)).cast("int")


def geohash_encode(
    lat: ColumnLike, lon: ColumnLike, precision: int = GEOHASH_PRECISION
) -> Column:
    """GEO1: geohash text of a point; NULL if a coordinate is NULL."""
    if not 1 <= precision <= MAX_PRECISION:
        raise ValueError(f"precision must be between 1 and {MAX_PRECISION}")
    latitude, longitude = _c(lat), _c(lon)
    lon_left, lat_left = _bit_counts(precision)
    lon_cell = _cell(longitude, -180.0, 360.0, lon_left)
    lat_cell = _cell(latitude, -90.0, 180.0, lat_left)
    characters = []
    for position in range(precision):
        lon_first = position % 2 == 0
        lon_left -= 3 if lon_first else 2
        lat_left -= 2 if lon_first else 3
        lon_bits = F.shiftright(lon_cell, lon_left).bitwiseAND(7 if lon_first else 3)
        lat_bits = F.shiftright(lat_cell, lat_left).bitwiseAND(3 if lon_first else 7)
        three, two = (lon_bits, lat_bits) if lon_first else (lat_bits, lon_bits)
        place = F.shiftleft(three, 2).bitwiseOR(two) + 1
        characters.append(F.substring(F.lit(_BY_PARTS), place, F.lit(1)))
    # NULL for a missing coordinate comes from the last part. A condition around the
    # whole would keep Spark from computing the two cell numbers once only.
    guard = F.when(latitude.isNotNull() & longitude.isNotNull(), F.lit(""))
    return F.concat(*characters, guard)


def geohash_centre(geohash: ColumnLike) -> tuple[Column, Column]:
    """Latitude and longitude of the centre of a cell; NULL if the text is no geohash.

    The text is read as if padded to twelve characters, so that every character
    has its bits at a fixed place; half a cell of the actual length is added.
    """
    code = F.lower(_c(geohash))
    valid = code.rlike(f"^[{GEOHASH_ALPHABET}]{{1,{MAX_PRECISION}}}$")
    padded = F.rpad(code, MAX_PRECISION, GEOHASH_ALPHABET[0])
    lon_bits, lat_bits = _bit_counts(MAX_PRECISION)
    lon_left, lat_left = lon_bits, lat_bits
    lon_cell, lat_cell = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    for position in range(MAX_PRECISION):
        lon_first = position % 2 == 0
        lon_left -= 3 if lon_first else 2
        lat_left -= 2 if lon_first else 3
        character = F.substring(padded, position + 1, 1)
        parts = (F.position(character, F.lit(_BY_PARTS)) - 1).cast("bigint")
        three, two = F.shiftright(parts, 2), parts.bitwiseAND(3)
        lon_part, lat_part = (three, two) if lon_first else (two, three)
        lon_cell = lon_cell + lon_part * (1 << lon_left)
        lat_cell = lat_cell + lat_part * (1 << lat_left)
    length = F.length(code)
    half_lon = F.pow(F.lit(2.0), -F.ceil(length * 5 / 2) - 1)
    half_lat = F.pow(F.lit(2.0), -F.floor(length * 5 / 2) - 1)
    latitude = (lat_cell / float(1 << lat_bits) + half_lat) * 180.0 - 90.0
    longitude = (lon_cell / float(1 << lon_bits) + half_lon) * 360.0 - 180.0
    return F.when(valid, latitude), F.when(valid, longitude)


def map_points(df: DataFrame, geohash: str = "geohash9") -> DataFrame:
    """GEO2: ``lat``, ``lon`` of the decodable rows only."""
    latitude, longitude = geohash_centre(geohash)
    points = df.select(latitude.alias("lat"), longitude.alias("lon"))
    return points.dropna(subset=["lat", "lon"])
