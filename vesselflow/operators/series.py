"""Time series out of messages (AN18)."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vesselflow.functions import predicates as P

METRICS = {"count": lambda: F.count("*"), "speed": lambda: F.avg("SOG")}
UNITS = {"HOURLY": "HOUR", "DAILY": "DAY"}


def checked(metric: str, freq: str) -> tuple[str, str]:
    """Metric in lower case and frequency in upper case; ValueError if unknown."""
    if freq.upper() not in UNITS:
        raise ValueError(f"freq must be one of {sorted(UNITS)}")
    if metric.lower() not in METRICS:
        raise ValueError(f"metric must be one of {sorted(METRICS)}")
    return metric.lower(), freq.upper()


def slot(freq: str, ts: str = "ts_col") -> Column:
    """Recurring position of a bucket: hour of the day, or day of the week."""
    return F.hour(ts) if freq.upper() == "HOURLY" else F.weekday(ts)


def time_series(
    messages: DataFrame,
    start: date | str | None,
    end: date | str | None,
    vessel_types: Iterable | None = None,
    metric: str = "count",
    freq: str = "HOURLY",
    id_col: str = "geohash9",
    precision: int | None = None,
    fill: bool = False,
) -> DataFrame:
    """AN18: ``series_id, ts_col, value`` per id and hour or day.

    ``precision`` shortens a geohash id, since full cells are a few metres wide.
    Rows with a NULL id form a series; rows without a time are left out. ``fill`` adds
    a 0 for each hour or day without messages, from ``start`` to ``end`` where they are
    given, else from the first to the last point of the series.
    """
    metric, freq = checked(metric, freq)
    if fill and metric != "count":
        raise ValueError("only counts can be filled: there is no mean of no messages")
    series_id = F.col(id_col) if precision is None else F.substring(id_col, 1, precision)
    points = (
        P.within_days(messages, start, end)
        .where(P.in_list(vessel_types) & P.all_present("BaseDateTime"))
        .groupBy(
            series_id.alias("series_id"),
            F.date_trunc(UNITS[freq], "BaseDateTime").alias("ts_col"),
        )
        .agg(METRICS[metric]().alias("value"))
    )
    return _filled(points, start, end, freq) if fill else points


def _filled(points: DataFrame, start, end, freq: str) -> DataFrame:
    """A row for each hour or day of every series; there is one per unit of time, not per message."""
    unit = UNITS[freq]
    first = F.min("ts_col") if start is None else F.lit(str(start)).cast("timestamp")
    last = F.max("ts_col") if end is None else F.timestamp_add(unit, F.lit(-1), F.lit(str(end)).cast("timestamp") + F.expr("INTERVAL 1 DAY"))
    known = F.map_from_entries(F.collect_list(F.struct("ts_col", "value")))
    series = points.groupBy("series_id").agg(known.alias("_known"), first.alias("_first"), last.alias("_last"))
    step = F.expr(f"INTERVAL 1 {unit}")
    rows = series.select("series_id", "_known", F.explode(F.sequence("_first", "_last", step)).alias("ts_col"))
    return rows.select("series_id", "ts_col", F.coalesce(F.col("_known")[F.col("ts_col")], F.lit(0)).alias("value"))
