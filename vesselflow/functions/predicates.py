"""Filters as ``Column`` predicates (FLT1-FLT8).

An argument that is not set means "no filter" and gives a literal TRUE, which
Catalyst removes. Values are literals, never pasted into SQL text.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVERYTHING = True


def _no_filter() -> Column:
    return F.lit(EVERYTHING)


def as_date(day: date | str) -> date:
    return date.fromisoformat(day) if isinstance(day, str) else day


def date_between(
    start: date | str | None = None, end: date | str | None = None, column: str = "BaseDateTime"
) -> Column:
    """FLT1, FLT6, FLT7: whole UTC days, both inclusive, each side optional.

    Written as a half-open range of the bare column, which reaches the Parquet
    scan as it is.
    """
    keep = _no_filter()
    if start is not None:
        keep = keep & (F.col(column) >= F.lit(as_date(start)).cast("timestamp"))
    if end is not None:
        keep = keep & (F.col(column) < F.lit(as_date(end) + timedelta(days=1)).cast("timestamp"))
    return keep


def month_between(
    start: date | str | None = None, end: date | str | None = None, column: str = "ym"
) -> Column:
    """Months that hold the days of :func:`date_between`; prunes partitions."""
    keep = _no_filter()
    if start is not None:
        keep = keep & (F.col(column) >= as_date(start).strftime("%Y-%m"))
    if end is not None:
        keep = keep & (F.col(column) <= as_date(end).strftime("%Y-%m"))
    return keep


def within_days(df: DataFrame, start: date | str | None = None, end: date | str | None = None) -> DataFrame:
    """Rows of the days, pruning month partitions where the table has them."""
    kept = df.where(date_between(start, end))
    return kept.where(month_between(start, end)) if "ym" in df.columns else kept


def in_list(values: Iterable | None, column: str = "VesselTypeName") -> Column:
    """FLT2, FLT5: text in a list; empty or None keeps all rows.

    A None item stands for the text 'None', so it does not match NULL.
    """
    wanted = [str(value) for value in values or []]
    return F.col(column).isin(wanted) if wanted else _no_filter()


def mmsi_in(values: Iterable | None) -> Column:
    """FLT3: identifiers compared as text."""
    return in_list(values, "MMSI")


def class_in(values: Iterable | None) -> Column:
    """FLT5."""
    return in_list(values, "VesselTypeClass")


def status_in(values: Iterable | None) -> Column:
    """FLT5."""
    return in_list(values, "NavStatusName")


def in_bbox(
    lat_min: float | None = None,
    lat_max: float | None = None,
    lon_min: float | None = None,
    lon_max: float | None = None,
    use_bbox: bool = True,
) -> Column:
    """FLT4, FLT6: inclusive box, each side optional, no wrap at the antimeridian."""
    keep = _no_filter()
    if not use_bbox:
        return keep
    for column, low, high in (("LAT", lat_min, lat_max), ("LON", lon_min, lon_max)):
        if low is not None:
            keep = keep & (F.col(column) >= float(low))
        if high is not None:
            keep = keep & (F.col(column) <= float(high))
    return keep


def all_present(*columns: str) -> Column:
    """FLT8: none of the columns is NULL."""
    keep = _no_filter()
    for column in columns:
        keep = keep & F.col(column).isNotNull()
    return keep
