"""User-level analyses of the curated table (AN1-AN17).

Each takes the curated messages and plain arguments and returns a lazy
DataFrame. ``start`` and ``end`` are inclusive UTC days, either may be None; a
list argument that is None or empty does not filter. Where the data leaves an
order open, ties are settled by further columns so that results repeat.

Messages are combined before they are shuffled: no analysis moves rows by a type,
status or weekday, whose groups may hold a large part of the table.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vesselflow import schema as S
from vesselflow.functions import predicates as P
from vesselflow.functions import stats
from vesselflow.operators.percentiles import percentiles
from vesselflow.operators.ranking import most_frequent, top
from vesselflow.operators.tracks import with_previous
from vesselflow.sources.messages import read_months

Day = date | str | None
DEFAULT_LIMIT = 100


def _order_of_weekday(ts: str = "BaseDateTime") -> Column:
    """OR4: 1 for Monday to 7 for Sunday."""
    return F.weekday(ts) + 1


def draft_outliers(
    messages: DataFrame,
    start: Day = None,
    end: Day = None,
    vessel_types: Iterable | None = None,
    z_min: float = 2.0,
    limit: int | None = DEFAULT_LIMIT,
) -> DataFrame:
    """AN1: vessels whose mean draft is far from the mean of their type."""
    per_vessel = (
        P.within_days(messages, start, end)
        .where(P.in_list(vessel_types) & P.all_present("Draft", "VesselTypeName"))
        .groupBy("VesselTypeName", "MMSI")
        .agg(F.avg("Draft").alias("avg_draft"))
    )
    per_type = (
        per_vessel.groupBy("VesselTypeName")
        .agg(F.avg("avg_draft").alias("mu"), F.stddev_samp("avg_draft").alias("sd"))
        .where("sd > 0")
    )
    # Both sides are small next to the messages; AQE broadcasts by measured size.
    scored = per_vessel.join(per_type, "VesselTypeName").withColumn(
        "z", F.abs(F.col("avg_draft") - F.col("mu")) / F.col("sd")
    )
    outliers = scored.where(F.col("z") >= float(z_min))
    ordered = outliers.select("VesselTypeName", "MMSI", "avg_draft", "mu", "sd", "z")
    return top(ordered, F.desc("z"), ["VesselTypeName", "MMSI"], limit)


def course_changes(
    messages: DataFrame,
    start: Day = None,
    end: Day = None,
    mmsi: Iterable | None = None,
    min_delta: float = 45.0,
    bbox: Column | None = None,
    limit: int | None = DEFAULT_LIMIT,
) -> DataFrame:
    """AN2: largest plain course differences to the previous message.

    All filters, including ``bbox`` (see ``predicates.in_bbox``), apply before the
    previous message is looked up. The difference ignores the turn; use
    :func:`course_changes_circular` for angles.
    """
    kept = P.within_days(messages, start, end).where(P.mmsi_in(mmsi) & P.all_present("COG", "geohash9"))
    if bbox is not None:
        kept = kept.where(bbox)
    steps = with_previous(kept.select("MMSI", "BaseDateTime", "geohash9", "COG"), ["COG"])
    changes = steps.select(
        "MMSI",
        "BaseDateTime",
        "geohash9",
        "COG",
        F.col("prev_COG").alias("prev_cog"),
        stats.plain_difference("COG", "prev_COG").alias("delta_cog"),
    ).where(F.col("delta_cog") >= float(min_delta))
    return top(changes, F.desc("delta_cog"), ["MMSI", "BaseDateTime"], limit)


def course_changes_circular(
    messages: DataFrame,
    start: Day = None,
    end: Day = None,
    max_dt_min: int = 60,
    min_delta: float = 45.0,
    mmsi: Iterable | None = None,
    bbox: Column | None = None,
    limit: int | None = DEFAULT_LIMIT,
) -> DataFrame:
    """AN3: newest turns of at least ``min_delta`` degrees within ``max_dt_min`` minutes.

    Only the day and NULL filters apply before the previous message is looked up;
    a vessel list does not change a vessel's order, so it is applied early too.
    """
    kept = P.within_days(messages, start, end).where(P.mmsi_in(mmsi) & P.all_present("COG"))
    steps = with_previous(kept.select("MMSI", "BaseDateTime", "COG", "LAT", "LON"), ["COG"])
    changes = steps.select(
        "MMSI",
        "BaseDateTime",
        F.col("prev_BaseDateTime").alias("prev_ts"),
        stats.minutes_between("BaseDateTime", "prev_BaseDateTime").alias("dt_min"),
        F.col("prev_COG").alias("prev_cog"),
        "COG",
        stats.circular_difference("COG", "prev_COG").alias("delta_deg"),
        "LAT",
        "LON",
    ).where((F.col("dt_min") <= int(max_dt_min)) & (F.col("delta_deg") >= float(min_delta)))
    if bbox is not None:
        changes = changes.where(bbox)
    return top(changes, F.desc("BaseDateTime"), ["MMSI"], limit)


def _correlations(
    messages: DataFrame,
    group: str,
    x: str,
    y: str,
    min_n: int,
    name: str,
    further: Sequence[Column] = (),
) -> DataFrame:
    """Pairs without NULL, correlated per group; groups of at least ``min_n``."""
    return (
        messages.where(P.all_present(x, y))
        .select(group, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
        .groupBy(group)
        .agg(F.count("*").alias("n"), stats.correlation("x", "y").alias(name), *further)
        .where(F.col("n") >= int(min_n))
    )


def correlation_by_type(
    messages: DataFrame,
    start: Day = None,
    end: Day = None,
    vessel_types: Iterable | None = None,
    col1: str = "SOG",
    col2: str = "Draft",
    min_n: int = 30,
) -> DataFrame:
    """AN4: correlation of two numeric columns per type, strongest first."""
    kept = P.within_days(messages, start, end).where(P.in_list(vessel_types))
    result = _correlations(kept, "VesselTypeName", col1, col2, min_n, "corr_pearson")
    return result.orderBy(F.abs("corr_pearson").desc(), "VesselTypeName")


def speed_draft_correlation(
    messages: DataFrame,
    start: Day = None,
    end: Day = None,
    vessel_types: Iterable | None = None,
    min_n: int = 30,
) -> DataFrame:
    """AN5: correlation of speed and draft per type, ascending."""
    kept = P.within_days(messages, start, end).where(P.in_list(vessel_types))
    result = _correlations(kept, "VesselTypeName", "SOG", "Draft", min_n, "corr_pearson")
    return result.select("VesselTypeName", "corr_pearson", "n").orderBy("corr_pearson", "VesselTypeName")


def _positions(messages: DataFrame, start: Day, end: Day, vessel_types, mmsi) -> DataFrame:
    return P.within_days(messages, start, end).where(
        P.in_list(vessel_types) & P.mmsi_in(mmsi) & P.all_present("geohash9")
    )


def recent_positions(
    messages: DataFrame,
    start: Day = None,
    end: Day = None,
    vessel_types: Iterable | None = None,
    mmsi: Iterable | None = None,
    limit: int | None = DEFAULT_LIMIT,
    additional_columns: Sequence[str] = (),
) -> DataFrame:
    """AN6: newest positions."""
    kept = _positions(messages, start, end, vessel_types, mmsi)
    columns = ["MMSI", "BaseDateTime", "geohash9", "VesselTypeName", *additional_columns]
    return top(kept.select(*columns), F.desc("BaseDateTime"), ["MMSI"], limit)


def recent_positions_by_month(
    spark: SparkSession,
    base: str,
    months: Iterable[str],
    start: Day = None,
    end: Day = None,
    vessel_types: Iterable | None = None,
    mmsi: Iterable | None = None,
    limit: int = DEFAULT_LIMIT,
    additional_columns: Sequence[str] = (),
) -> DataFrame:
    """AN6 over a table of months: the newest positions, without a look at older months.

    Months are read from the newest one on until ``limit`` positions are there; every
    position of a month is newer than all of the months before. A month that has more than
    enough is read only until the limit is reached. The result equals
    :func:`recent_positions` over all months. A month that is missing is an error."""
    vessel_types, mmsi = (None if v is None else list(v) for v in (vessel_types, mmsi))
    wanted: list[str] = []
    found = 0
    first = None if start is None else P.as_date(start).strftime("%Y-%m")
    last = None if end is None else P.as_date(end).strftime("%Y-%m")
    for month in sorted(set(months), reverse=True):
        if first and month < first or last and month > last:
            continue
        wanted.append(month)
        rows = _positions(read_months(spark, base, [month]), start, end, vessel_types, mmsi)
        found += rows.select("MMSI").limit(limit - found).count()
        if found >= limit:
            break
    if not wanted:
        raise FileNotFoundError(f"no month of {base} has these days")
    return recent_positions(
        read_months(spark, base, wanted), start, end, vessel_types, mmsi, limit, additional_columns
    )


def length_width_correlation(
    messages: DataFrame,
    start: Day = None,
    end: Day = None,
    classes: Iterable | None = None,
    min_n: int = 30,
) -> DataFrame:
    """AN7: correlation of length and width per class, strongest first."""
    kept = P.within_days(messages, start, end).where(P.class_in(classes))
    result = _correlations(kept, "VesselTypeClass", "Length", "Width", min_n, "corr_len_width")
    return result.orderBy(F.abs("corr_len_width").desc(), "VesselTypeClass")


def length_width_covariance(
    messages: DataFrame,
    start: Day = None,
    end: Day = None,
    classes: Iterable | None = None,
    min_n: int = 30,
) -> DataFrame:
    """AN8: as AN7 with the covariance, by descending correlation."""
    kept = P.within_days(messages, start, end).where(P.class_in(classes))
    covariance = F.covar_pop("x", "y").alias("covar_len_width")
    result = _correlations(
        kept, "VesselTypeClass", "Length", "Width", min_n, "corr_len_width", [covariance]
    )
    return result.select("VesselTypeClass", "corr_len_width", "covar_len_width", "n").orderBy(
        F.desc("corr_len_width"), "VesselTypeClass"
    )


def status_summary(
    messages: DataFrame, start: Day = None, end: Day = None, statuses: Iterable | None = None
) -> DataFrame:
    """AN9: messages, vessels, mean speed and draft per named status."""
    return (
        P.within_days(messages, start, end)
        .where(P.status_in(statuses) & P.all_present("NavStatusName"))
        .groupBy("NavStatusName")
        .agg(
            F.count("*").alias("total_messages"),
            F.count_distinct("MMSI").alias("unique_vessels"),
            F.avg("SOG").alias("avg_sog"),
            F.avg("Draft").alias("avg_draft"),
        )
        .orderBy(F.desc("total_messages"), "NavStatusName")
    )


def status_by_day(
    messages: DataFrame, start: Day = None, end: Day = None, statuses: Iterable | None = None
) -> DataFrame:
    """AN10: mean draft, top speed and messages per day and status, NULL status too."""
    return (
        P.within_days(messages, start, end)
        .where(P.status_in(statuses))
        .groupBy(F.to_date("BaseDateTime").alias("d"), "NavStatusName")
        .agg(
            F.avg("Draft").alias("avg_draft"),
            F.max("SOG").alias("max_sog"),
            F.count("*").alias("msgs"),
        )
        .orderBy("d", "NavStatusName")
    )


def moving_while_stationary(
    messages: DataFrame,
    start: Day = None,
    end: Day = None,
    sog_thr: float = 1.0,
    limit: int | None = DEFAULT_LIMIT,
    strict_labels: bool = False,
) -> DataFrame:
    """AN11: moored or anchored vessels that move, fastest first.

    ``strict_labels`` takes the label 'At Anchor', which the catalogue spells
    'At anchor', so that anchored vessels are not found.
    """
    labels = S.STATIONARY_STATUSES_STRICT if strict_labels else S.STATIONARY_STATUSES
    moving = (
        P.within_days(messages, start, end)
        .where(P.status_in(labels) & (F.col("SOG") > float(sog_thr)))
        .select("MMSI", "VesselName", "BaseDateTime", "NavStatusName", "SOG")
    )
    return top(moving, F.desc("SOG"), ["MMSI", "BaseDateTime"], limit)


def variability_by_type(
    messages: DataFrame,
    start: Day = None,
    end: Day = None,
    vessel_types: Iterable | None = None,
    min_n: int = 30,
) -> DataFrame:
    """AN12: spread and mean of speed and course per type."""
    return (
        P.within_days(messages, start, end)
        .where(P.in_list(vessel_types) & P.all_present("SOG", "COG"))
        .groupBy("VesselTypeName")
        .agg(
            F.count("*").alias("n"),
            F.stddev_samp("SOG").alias("sd_sog"),
            F.stddev_samp("COG").alias("sd_cog"),
            F.avg("SOG").alias("avg_sog"),
            F.avg("COG").alias("avg_cog"),
        )
        .where(F.col("n") >= int(min_n))
        .orderBy(F.desc("sd_sog"), "VesselTypeName")
    )


def heading_variability_by_type(
    messages: DataFrame,
    start: Day = None,
    end: Day = None,
    vessel_types: Iterable | None = None,
    min_n: int = 30,
) -> DataFrame:
    """AN13: spread of speed and heading per type; ``n`` counts all rows."""
    return (
        P.within_days(messages, start, end)
        .where(P.in_list(vessel_types))
        .groupBy("VesselTypeName")
        .agg(
            F.stddev_samp("SOG").alias("sd_sog"),
            F.stddev_samp("Heading").alias("sd_heading"),
            F.count("*").alias("n"),
        )
        .where(F.col("n") >= int(min_n))
        .orderBy(F.desc("sd_sog"), "VesselTypeName")
    )


def unusual_speeds(
    messages: DataFrame,
    start: Day = None,
    end: Day = None,
    vessel_types: Iterable | None = None,
    percentile: int = 95,
    limit: int | None = DEFAULT_LIMIT,
    accuracy: int | None = None,
) -> DataFrame:
    """AN14: vessels whose top speed exceeds their own percentile, by the excess."""
    kept = P.within_days(messages, start, end).where(P.in_list(vessel_types))
    per_vessel = percentiles(
        kept, ["MMSI", "VesselTypeName"], "SOG", {"sog_p": percentile}, 100, "sog_max", accuracy
    )
    result = per_vessel.where(F.col("sog_max") > F.col("sog_p")).withColumn(
        "exceso", F.col("sog_max") - F.col("sog_p")
    )
    return top(result, F.desc("exceso"), ["MMSI", "VesselTypeName"], limit)


def speeds_above_type_percentile(
    messages: DataFrame,
    start: Day = None,
    end: Day = None,
    vessel_types: Iterable | None = None,
    p: int = 95,
    limit: int | None = DEFAULT_LIMIT,
    accuracy: int | None = None,
) -> DataFrame:
    """AN15: vessels faster than the percentile ``p``/101 of their type.

    The days and types restrict the percentile only; vessels of those types are
    looked for in all messages. The name is that of the vessel's fastest message,
    greatest name first where several are equally fast.

    A vessel qualifies exactly if its top speed is above the percentile, so the
    messages are reduced to one row per vessel before the join, and the percentile
    table meets vessels, not messages.
    """
    kept = P.within_days(messages, start, end).where(
        P.in_list(vessel_types) & P.all_present("VesselTypeName")
    )
    of_type = percentiles(kept, ["VesselTypeName"], "SOG", {"sog_p": p}, 101, accuracy=accuracy)
    # First by name too: that step aggregates numbers only and so uses hashing.
    fastest = (
        messages.where(P.in_list(vessel_types) & P.all_present("SOG", "VesselTypeName"))
        .groupBy("VesselTypeName", "MMSI", "VesselName")
        .agg(F.max("SOG").alias("sog"))
        .groupBy("VesselTypeName", "MMSI")
        .agg(F.max(F.struct("sog", "VesselName")).alias("best"))
    )
    above = fastest.join(of_type, "VesselTypeName").where(F.col("best.sog") > F.col("sog_p"))
    result = above.select(
        "VesselTypeName",
        "MMSI",
        F.col("best.VesselName").alias("VesselName"),
        F.col("best.sog").alias("sog_max"),
        "sog_p",
    )
    return top(result, F.desc("sog_max"), ["VesselTypeName", "MMSI"], limit)


def speed_by_weekday(messages: DataFrame, vessel_types: Iterable | None = None) -> DataFrame:
    """AN16: mean and spread of speed per type and weekday, Monday first."""
    return (
        messages.where(P.in_list(vessel_types) & P.all_present("VesselTypeName"))
        .groupBy("VesselTypeName", _order_of_weekday().alias("_weekday"))
        .agg(
            F.avg("SOG").alias("avg_sog"),
            F.stddev_samp("SOG").alias("sd_sog"),
            F.count("*").alias("n"),
        )
        .orderBy("VesselTypeName", "_weekday")
        .select("VesselTypeName", _weekday_name("_weekday").alias("dow"), "avg_sog", "sd_sog", "n")
    )


def _weekday_name(number: str) -> Column:
    """English name of 1 (Monday) to 7; 2024-01-01 is a Monday."""
    return F.date_format(F.date_add(F.lit(date(2023, 12, 31)), F.col(number)), "EEEE")


def top_status_by_weekday(messages: DataFrame, vessel_types: Iterable | None = None) -> DataFrame:
    """AN17: most frequent status per type and weekday, Monday first."""
    rows = messages.where(
        P.in_list(vessel_types) & P.all_present("VesselTypeName", "NavStatusName")
    ).select("VesselTypeName", "NavStatusName", _order_of_weekday().alias("_weekday"))
    return (
        most_frequent(rows, ["VesselTypeName", "_weekday"], "NavStatusName")
        .orderBy("VesselTypeName", "_weekday")
        .select(
            "VesselTypeName",
            _weekday_name("_weekday").alias("dow"),
            F.col("NavStatusName").alias("most_common_status"),
            "count",
        )
    )
