"""Cleaning and enrichment rules, one function per rule (CUR1-CUR20).

Each takes a column (name or ``Column``) and returns a ``Column``. Text that does
not parse gives NULL, never an error, also in ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vesselflow import schema as S

ColumnLike = Column | str


def _c(column: ColumnLike) -> Column:
    return F.col(column) if isinstance(column, str) else column


def _within(column: ColumnLike, bounds: tuple[float, float]) -> Column:
    value = _c(column)
    return F.when(value.between(*bounds), value)


def mmsi(column: ColumnLike, whole_number: bool = False) -> Column:
    """CUR1: the last one to nine digits, padded to nine with zeros.

    A column of an integer type can take the remainder instead of the pattern,
    which gives the same digits without a regular expression.
    """
    if whole_number:
        digits = F.abs(_c(column) % 1_000_000_000).cast("string")
    else:
        digits = F.regexp_extract(_c(column).cast("string"), S.MMSI_PATTERN, 1)
    return F.lpad(digits, 9, "0")


def message_time(column: ColumnLike) -> Column:
    """CUR2: timestamp from the fixed text pattern."""
    return F.try_to_timestamp(_c(column).cast("string"), F.lit(S.TIMESTAMP_FORMAT))


def number(column: ColumnLike) -> Column:
    """CUR3: double, NULL for text that is not a number."""
    return _c(column).try_cast("double")


def text(column: ColumnLike) -> Column:
    """CUR4: trimmed text."""
    return F.trim(_c(column))


def transceiver_class(column: ColumnLike) -> Column:
    """CUR4: trimmed upper-case text."""
    return F.upper(F.trim(_c(column)))


def latitude(column: ColumnLike) -> Column:
    """CUR5: NULL outside the range, else rounded."""
    return F.round(_within(column, S.LAT_RANGE), S.COORDINATE_DIGITS)


def longitude(column: ColumnLike) -> Column:
    """CUR6: moved by one turn if beyond +/-180 (once, not repeatedly), rounded."""
    value = _c(column)
    turn = F.when(value > 180, F.lit(-360.0)).when(value < -180, F.lit(360.0)).otherwise(F.lit(0.0))
    return F.round(value + turn, S.COORDINATE_DIGITS)


def has_position(lat: ColumnLike = "LAT", lon: ColumnLike = "LON") -> Column:
    """CUR7: rows to keep, on the cleaned coordinates."""
    return _c(lat).isNotNull() & _c(lon).isNotNull()


def can_be_located(lat: ColumnLike = "LAT", lon: ColumnLike = "LON") -> Column:
    """CUR7 on numbers not yet cleaned: true where both cleaned coordinates will be present."""
    return _c(lat).between(*S.LAT_RANGE) & _c(lon).isNotNull()


def known_heading(column: ColumnLike) -> Column:
    """CUR8: the "not available" code becomes NULL."""
    return F.nullif(_c(column), F.lit(float(S.HEADING_UNKNOWN)))


def within_turn(column: ColumnLike) -> Column:
    """CUR9: remainder by 360 with the sign of the input (-10 stays -10)."""
    return _c(column) % 360


def heading(column: ColumnLike) -> Column:
    """CUR8 then CUR9."""
    return within_turn(known_heading(column))


def speed(column: ColumnLike) -> Column:
    """CUR10."""
    return _within(column, S.SOG_RANGE)


def imo(column: ColumnLike) -> Column:
    """CUR11 on trimmed text."""
    value = _c(column)
    return F.when(~value.isin(S.IMO_PLACEHOLDERS), value)


def length(column: ColumnLike) -> Column:
    """CUR12."""
    return _within(column, S.LENGTH_RANGE)


def width(column: ColumnLike) -> Column:
    """CUR12."""
    return _within(column, S.WIDTH_RANGE)


def draft(column: ColumnLike) -> Column:
    """CUR12."""
    return _within(column, S.DRAFT_RANGE)


def vessel_type_int(column: ColumnLike) -> Column:
    """CUR13: only text made of digits is a code."""
    value = _c(column)
    return F.when(value.rlike(r"^\d+$"), value.try_cast("int"))


def code_lookup(codes: dict[int, str], column: ColumnLike) -> Column:
    """JN5: look a code up in a literal map; NULL for codes that are not in it."""
    entries = [F.lit(part) for code, name in codes.items() for part in (code, name)]
    return F.create_map(*entries)[_c(column)]


def vessel_type_name(column: ColumnLike) -> Column:
    """CUR14."""
    return code_lookup(S.VESSEL_TYPE_NAMES, column)


def vessel_type_class(column: ColumnLike) -> Column:
    """CUR15: class by decade of the type code."""
    tens = F.floor(_c(column) / 10).cast("int")
    return F.coalesce(code_lookup(S.VESSEL_CLASSES, tens), F.lit(S.VESSEL_CLASS_DEFAULT))


def nav_status_int(column: ColumnLike) -> Column:
    """CUR16: integer code from text; a fraction is cut off, so ``5.0`` and ``5.7`` are 5."""
    whole = F.regexp_extract(_c(column), S.WHOLE_NUMBER_PATTERN, 1)
    return F.nullif(whole, F.lit("")).try_cast("int")


def nav_status_name(code: ColumnLike, catalogue_name: ColumnLike) -> Column:
    """CUR17: codes in range but not in the catalogue keep a NULL name."""
    value = _c(code)
    return (
        F.when(value.isNull(), F.lit(S.NAV_STATUS_MISSING))
        .when(~value.between(*S.NAV_STATUS_RANGE), F.lit(S.NAV_STATUS_UNKNOWN))
        .otherwise(_c(catalogue_name))
    )


def plain_name(column: ColumnLike) -> Column:
    """CUR18: upper case, only letters, digits and single spaces.

    One pass does both steps: from a space up to a later one with no name character
    between them a single space is left, all other foreign characters go.
    """
    return F.regexp_replace(F.upper(F.trim(_c(column))), S.NAME_GAPS_PATTERN, "$1")


def time_fields(column: ColumnLike = "BaseDateTime") -> dict[str, Column]:
    """CUR19: calendar fields of the message time."""
    ts = _c(column)
    return {
        "ym": F.date_format(ts, "yyyy-MM"),
        "date": F.to_date(ts),
        "hour": F.hour(ts),
        "dow": F.date_format(ts, "E"),
        "week": F.weekofyear(ts),
        "month": F.month(ts),
        "quarter": F.quarter(ts),
    }


def speed_ms(column: ColumnLike) -> Column:
    """CUR20: knots to metres per second."""
    return _c(column) * S.KNOTS_TO_MS


def raw_month(column: ColumnLike = "BaseDateTime") -> Column:
    """SRC4: month text of the raw time, empty if the text is not a date."""
    return F.regexp_extract(_c(column), S.YEAR_MONTH_PATTERN, 1)


def raw_day(column: ColumnLike = "BaseDateTime") -> Column:
    """SRC4: day text of the raw time, empty if the text is not a date."""
    return F.regexp_extract(_c(column), S.YEAR_MONTH_DAY_PATTERN, 1)
