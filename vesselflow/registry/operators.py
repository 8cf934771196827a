"""Queries for filters, joins, aggregates, windows and orders (FLT, JN, AG, WN, OR)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from vesselflow.functions import cleaning as rule
from vesselflow.functions import predicates as P
from vesselflow.functions import stats
from vesselflow.operators.lookups import with_status_name
from vesselflow.operators.percentiles import percentiles, selected_percentiles
from vesselflow.operators.quality import reconcile_counts
from vesselflow.operators.ranking import most_frequent, top
from vesselflow.operators.series import time_series
from vesselflow.operators.tracks import previous_on_tracks, with_previous, write_tracks
from vesselflow.plans import analyses as A
from vesselflow.plans import anomaly as N
from vesselflow.registry.base import Query
from vesselflow.registry.reference_sql import CATALOGUES, STATUS_CODE, STATUS_NAME, over_curated, over_raw
from vesselflow.registry.sources import QUERIES as SOURCE_QUERIES

KEY = "MMSI t:BaseDateTime"


def _filtered(predicate: Callable[[], Column], condition: str) -> Query:
    return Query(
        lambda c: c.curated.where(predicate()).select("MMSI", "BaseDateTime"),
        KEY,
        over_curated(f"SELECT MMSI, BaseDateTime FROM curated WHERE {condition}"),
    )


def _by_type(shape: str, sql: str, *aggregates: Callable[[], Column]) -> Query:
    return Query(
        lambda c: c.curated.groupBy("VesselTypeName").agg(*[a() for a in aggregates]),
        f"VesselTypeName {shape}",
        over_curated(f"SELECT VesselTypeName, {sql} FROM curated GROUP BY 1"),
    )


def _of_type_mean(c):
    means = (
        c.curated.where(P.all_present("VesselTypeName"))
        .groupBy("VesselTypeName", "MMSI")
        .agg(F.avg("SOG").alias("vessel_sog"))
    )
    by_type = means.groupBy("VesselTypeName").agg(F.avg("vessel_sog").alias("type_sog"))
    return means.join(by_type, "VesselTypeName")


def _model_lookup(c):
    """Series points looked up in a model that does not depend on their slot or the point before."""
    series = time_series(c.curated, None, None, None, "count", "DAILY", "VesselTypeName")
    model = N.fit(series, "DAILY", min_slot=10**9).withColumns({"phi": F.lit(0.0), "sigma": F.lit(1.0)})
    scored = N.score(series, model, "DAILY")
    middle = (F.col("lower_bound") + F.col("upper_bound")) / 2
    return scored.select("series_id", "ts_col", "value", middle.alias("series_mean"))


def _status_catalogue_join(c):
    return with_status_name(c.raw).select("MMSI", "BaseDateTime", "Status", "NavStatusInt", "NavStatusName")


def _plain_lag(c):
    return with_previous(c.curated.select("MMSI", "BaseDateTime", "COG"), ["COG"])


def _lag_on_tracks(c):
    """The table is made, read and dropped again; the result is kept in the shared folder."""
    name, kept = f"tracks_{uuid.uuid4().hex}", c.fresh_dir("tracks")
    write_tracks(c.curated.select("MMSI", "BaseDateTime", "COG"), name)
    previous_on_tracks(c.spark, name, ["COG"]).write.parquet(kept)
    for table in (name, f"{name}_edges"):
        c.spark.sql(f"DROP TABLE {table}")
    return c.spark.read.parquet(kept)


LAG_SQL = over_curated(
    """SELECT MMSI, BaseDateTime, COG, lag(COG) OVER w AS "prev_COG",
         lag(BaseDateTime) OVER w AS "prev_BaseDateTime"
       FROM curated WHERE BaseDateTime IS NOT NULL
       WINDOW w AS (PARTITION BY MMSI ORDER BY BaseDateTime)"""
)

FILTERS = {
    "flt01_date_between": _filtered(
        lambda: P.date_between("2024-01-10", "2024-01-20"),
        "CAST(BaseDateTime AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'",
    ),
    "flt02_in_list": _filtered(
        lambda: P.in_list(["Sailing", "Tanker, Hazardous category A", None]),
        "VesselTypeName IN ('Sailing', 'Tanker, Hazardous category A', 'None')",
    ),
    "flt03_mmsi_in": _filtered(
        lambda: P.mmsi_in([366000003, "366000007"]), "MMSI IN ('366000003', '366000007')"
    ),
    "flt04_in_bbox": _filtered(
        lambda: P.in_bbox(30, 45, -110, -80), "LAT BETWEEN 30 AND 45 AND LON BETWEEN -110 AND -80"
    ),
    "flt05_class_and_status": _filtered(
        lambda: P.class_in(["Cargo", "Tanker"]) & P.status_in(["Moored", "Aground"]),
        "VesselTypeClass IN ('Cargo', 'Tanker') AND NavStatusName IN ('Moored', 'Aground')",
    ),
    "flt06_optional": _filtered(
        lambda: P.date_between(None, "2024-01-15") & P.in_list([]) & P.in_bbox(lat_min=35.5),
        "CAST(BaseDateTime AS DATE) <= DATE '2024-01-15' AND LAT >= 35.5",
    ),
    "flt07_half_open_days": _filtered(
        lambda: P.date_between("2024-01-03", "2024-01-04"),
        """BaseDateTime >= TIMESTAMP '2024-01-03 00:00:00'
           AND BaseDateTime < TIMESTAMP '2024-01-05 00:00:00'""",
    ),
    "flt08_all_present": _filtered(
        lambda: P.all_present("Draft", "COG", "Heading", "Length"),
        "Draft IS NOT NULL AND COG IS NOT NULL AND Heading IS NOT NULL AND Length IS NOT NULL",
    ),
    "flt09_group_filter": Query(
        lambda c: c.curated.groupBy("MMSI").agg(F.count("*").alias("n")).where("n >= 70"),
        "MMSI n",
        over_curated("SELECT MMSI, count(*) AS n FROM curated GROUP BY 1 HAVING count(*) >= 70"),
    ),
    "flt10_window_filter": Query(
        lambda c: _plain_lag(c).where(stats.plain_difference("COG", "prev_COG") >= 180),
        f"{KEY} f:COG f:prev_COG",
        over_curated(
            """SELECT MMSI, BaseDateTime, COG, lag(COG) OVER w AS "prev_COG" FROM curated
               WHERE BaseDateTime IS NOT NULL
               WINDOW w AS (PARTITION BY MMSI ORDER BY BaseDateTime)
               QUALIFY abs(COG - lag(COG) OVER w) >= 180"""
        ),
    ),
}

JOINS = {
    "jn1_broadcast_left": Query(
        _status_catalogue_join,
        "MMSI BaseDateTime Status NavStatusInt NavStatusName",
        over_raw(
            f"""SELECT MMSI, BaseDateTime, Status, {STATUS_CODE} AS NavStatusInt,
                {STATUS_NAME.format(c=f"({STATUS_CODE})", name="status_name")} AS NavStatusName
                FROM raw LEFT JOIN statuses ON ({STATUS_CODE}) = status_code""",
            CATALOGUES,
        ),
    ),
    "jn2_aggregate_to_aggregate": Query(
        _of_type_mean,
        "VesselTypeName MMSI f:vessel_sog f:type_sog",
        over_curated(
            "SELECT * FROM v JOIN (SELECT VesselTypeName, avg(vessel_sog) AS type_sog FROM v GROUP BY 1) "
            "USING (VesselTypeName)",
            """v AS (SELECT VesselTypeName, MMSI, avg(SOG) AS vessel_sog FROM curated
                 WHERE VesselTypeName IS NOT NULL GROUP BY 1, 2)""",
        ),
    ),
    "jn3_inequality_residual": Query(
        lambda c: A.speeds_above_type_percentile(c.curated, p=50, limit=None),
        "VesselTypeName MMSI VesselName f:sog_max f:sog_p",
        over_curated(
            """SELECT a.VesselTypeName, a.MMSI,
                 max(struct_pack(s := SOG, name := VesselName)).name AS VesselName,
                 max(SOG) AS sog_max, sog_p
               FROM curated a JOIN p ON a.VesselTypeName = p.vt
               WHERE a.SOG > p.sog_p GROUP BY 1, 2, sog_p""",
            """p AS (SELECT VesselTypeName AS vt, quantile_disc(SOG, 50 / 101) AS sog_p
                 FROM curated WHERE SOG IS NOT NULL GROUP BY 1)""",
        ),
    ),
    "jn4_full_outer": Query(
        lambda c: reconcile_counts(
            c.curated.where("SOG > 15"), c.curated.where("Draft > 20"), "date", "fast", "deep"
        ),
        "t:date fast deep match",
        over_curated(
            """SELECT coalesce(l.date, r.date) AS date, coalesce(fast, 0) AS fast,
                 coalesce(deep, 0) AS deep, coalesce(fast, 0) = coalesce(deep, 0) AS match
               FROM (SELECT date, count(*) AS fast FROM curated WHERE SOG > 15 GROUP BY 1) l
               FULL JOIN (SELECT date, count(*) AS deep FROM curated WHERE Draft > 20 GROUP BY 1) r
                 ON l.date = r.date"""
        ),
    ),
    "jn5_map_lookup": Query(
        lambda c: c.curated.select(
            "MMSI",
            "BaseDateTime",
            rule.code_lookup({1: "winter", 2: "spring", 3: "summer"}, "quarter").alias("season"),
            rule.code_lookup({1: "Monday", 7: "Sunday"}, F.weekday("BaseDateTime") + 1).alias("edge"),
        ),
        f"{KEY} season edge",
        over_curated(
            """SELECT MMSI, BaseDateTime,
                 CASE quarter WHEN 1 THEN 'winter' WHEN 2 THEN 'spring' WHEN 3 THEN 'summer' END AS season,
                 CASE isodow(BaseDateTime) WHEN 1 THEN 'Monday' WHEN 7 THEN 'Sunday' END AS edge
               FROM curated"""
        ),
    ),
    "jn6_model_lookup": Query(
        _model_lookup,
        "series_id t:ts_col value f:series_mean",
        over_curated(
            """SELECT s.series_id, s.ts_col, s.value, series_mean FROM series s
               LEFT JOIN (SELECT series_id, avg(value) AS series_mean
                          FROM series GROUP BY 1) m
                 ON m.series_id IS NOT DISTINCT FROM s.series_id""",
            """series AS (SELECT VesselTypeName AS series_id, date_trunc('day', BaseDateTime) AS ts_col,
                 count(*) AS value FROM curated WHERE BaseDateTime IS NOT NULL GROUP BY 1, 2)""",
        ),
    ),
    "jn7_left_anti": SOURCE_QUERIES["src08_pending_files"],
}

AGGREGATES = {
    "ag01_count": _by_type("n", "count(*) AS n", lambda: F.count("*").alias("n")),
    "ag02_count_distinct": _by_type(
        "vessels", "count(DISTINCT MMSI) AS vessels", lambda: F.count_distinct("MMSI").alias("vessels")
    ),
    "ag03_avg": _by_type(
        "f:sog f:draft",
        "avg(SOG) AS sog, avg(Draft) AS draft",
        lambda: F.avg("SOG").alias("sog"),
        lambda: F.avg("Draft").alias("draft"),
    ),
    "ag04_stddev": _by_type("f:sd", "stddev_samp(SOG) AS sd", lambda: F.stddev_samp("SOG").alias("sd")),
    "ag05_corr": _by_type(
        "f:corr",
        """CASE WHEN max(SOG) FILTER (Length IS NOT NULL) > min(SOG) FILTER (Length IS NOT NULL)
             AND max(Length) FILTER (SOG IS NOT NULL) > min(Length) FILTER (SOG IS NOT NULL)
           THEN covar_pop(SOG, Length) / (stddev_pop(SOG) FILTER (Length IS NOT NULL)
             * stddev_pop(Length) FILTER (SOG IS NOT NULL)) END AS corr""",
        lambda: stats.correlation("SOG", "Length").alias("corr"),
    ),
    "ag06_covar_pop": _by_type(
        "f:cov", "covar_pop(Length, Width) AS cov", lambda: F.covar_pop("Length", "Width").alias("cov")
    ),
    "ag07_max": _by_type("f:top", "max(SOG) AS top", lambda: F.max("SOG").alias("top")),
    "ag08_percentile_100": Query(
        lambda c: percentiles(
            c.curated, ["MMSI"], "SOG", {f"p{p}": p for p in (0, 25, 50, 90, 100)}
        ),
        "MMSI f:p0 f:p25 f:p50 f:p90 f:p100",
        over_curated(
            "SELECT MMSI, "
            + ", ".join(f"quantile_disc(SOG, {p / 100}) AS p{p}" for p in (0, 25, 50, 90, 100))
            + " FROM curated GROUP BY 1"
        ),
    ),
    "ag08_percentile_selected": Query(
        lambda c: selected_percentiles(
            c.curated, ["VesselTypeName"], "SOG", {f"p{p}": p for p in (0, 25, 50, 90, 100)}, accuracy=200
        ),
        "VesselTypeName f:p0 f:p25 f:p50 f:p90 f:p100",
        over_curated(
            "SELECT VesselTypeName, "
            + ", ".join(f"quantile_disc(SOG, {p / 100}) AS p{p}" for p in (0, 25, 50, 90, 100))
            + " FROM curated WHERE SOG IS NOT NULL GROUP BY 1"
        ),
    ),
    "ag09_percentile_101": Query(
        lambda c: percentiles(c.curated, ["VesselTypeName"], "SOG", {"p25": 25, "p90": 90}, 101),
        "VesselTypeName f:p25 f:p90",
        over_curated(
            """SELECT VesselTypeName, quantile_disc(SOG, 25 / 101) AS p25,
               quantile_disc(SOG, 90 / 101) AS p90 FROM curated GROUP BY 1"""
        ),
    ),
    "ag10_any_value": Query(
        lambda c: c.curated.groupBy("MMSI").agg(F.max("VesselName").alias("name")),
        "MMSI name",
        over_curated("SELECT MMSI, max(VesselName) AS name FROM curated GROUP BY 1"),
    ),
    "ag11_two_level": Query(
        lambda c: c.curated.groupBy("VesselTypeName", "MMSI")
        .agg(F.avg("Draft").alias("d"))
        .groupBy("VesselTypeName")
        .agg(F.avg("d").alias("mu"), F.stddev_samp("d").alias("sd"), F.count("*").alias("vessels")),
        "VesselTypeName f:mu f:sd vessels",
        over_curated(
            """SELECT VesselTypeName, avg(d) AS mu, stddev_samp(d) AS sd, count(*) AS vessels
               FROM (SELECT VesselTypeName, MMSI, avg(Draft) AS d FROM curated GROUP BY 1, 2)
               GROUP BY 1"""
        ),
    ),
    "ag12_derived_key": Query(
        lambda c: c.curated.groupBy(F.date_trunc("hour", "BaseDateTime").alias("bucket")).agg(
            F.count("*").alias("n")
        ),
        "t:bucket n",
        over_curated("SELECT date_trunc('hour', BaseDateTime) AS bucket, count(*) AS n FROM curated GROUP BY 1"),
    ),
    "ag13_distinct": Query(
        lambda c: c.curated.select("VesselTypeClass", "NavStatusName").distinct(),
        "VesselTypeClass NavStatusName",
        over_curated("SELECT DISTINCT VesselTypeClass, NavStatusName FROM curated"),
    ),
    "ag14_most_frequent": Query(
        lambda c: most_frequent(
            c.curated.where(P.all_present("NavStatusName")), ["MMSI"], "NavStatusName", "n"
        ),
        "MMSI NavStatusName n",
        over_curated(
            """SELECT MMSI, NavStatusName, n FROM (
                 SELECT *, row_number() OVER (PARTITION BY MMSI ORDER BY n DESC, NavStatusName) AS rn
                 FROM (SELECT MMSI, NavStatusName, count(*) AS n FROM curated
                       WHERE NavStatusName IS NOT NULL GROUP BY 1, 2))
               WHERE rn = 1"""
        ),
    ),
}

WINDOWS = {
    "wn1_lag_course": Query(_plain_lag, f"{KEY} f:COG f:prev_COG", LAG_SQL),
    "wn1_lag_on_tracks": Query(_lag_on_tracks, f"{KEY} f:COG f:prev_COG t:prev_BaseDateTime", LAG_SQL),
    "wn2_lag_time": Query(_plain_lag, f"{KEY} t:prev_BaseDateTime", LAG_SQL),
    "wn3_row_number": Query(
        lambda c: c.curated.groupBy("VesselTypeClass", F.weekday("BaseDateTime").alias("weekday"))
        .agg(F.count("*").alias("n"))
        .withColumn(
            "rank",
            F.row_number().over(Window.partitionBy("VesselTypeClass").orderBy(F.desc("n"), "weekday")),
        ),
        "VesselTypeClass weekday n rank",
        over_curated(
            """SELECT *, CAST(row_number() OVER (
                 PARTITION BY VesselTypeClass ORDER BY n DESC, weekday) AS INTEGER) AS rank
               FROM (SELECT VesselTypeClass, CAST(isodow(BaseDateTime) - 1 AS INTEGER) AS weekday,
                     count(*) AS n FROM curated GROUP BY 1, 2)"""
        ),
    ),
}

ORDERS = {
    "or1_top": Query(
        lambda c: top(
            c.curated.select("MMSI", "BaseDateTime", "SOG"), F.desc("SOG"), ["MMSI", "BaseDateTime"], 50
        ),
        f"{KEY} f:SOG",
        over_curated(
            """SELECT MMSI, BaseDateTime, SOG FROM curated
               ORDER BY SOG DESC NULLS LAST, MMSI, BaseDateTime LIMIT 50"""
        ),
    ),
    "or2_full_order": Query(
        lambda c: c.curated.groupBy("date").agg(F.count("*").alias("n")).orderBy("date"),
        "t:date n",
        over_curated("SELECT date, count(*) AS n FROM curated GROUP BY 1 ORDER BY 1"),
    ),
    "or3_by_strength": Query(
        lambda c: A.correlation_by_type(c.curated, col1="COG", col2="Heading", min_n=1),
        "VesselTypeName n f:corr_pearson",
        over_curated(
            """SELECT VesselTypeName, count(*) AS n,
                 CASE WHEN max(COG) > min(COG) AND max(Heading) > min(Heading)
                 THEN covar_pop(COG, Heading) / (stddev_pop(COG) * stddev_pop(Heading)) END AS corr_pearson
               FROM curated WHERE COG IS NOT NULL AND Heading IS NOT NULL
               GROUP BY 1 ORDER BY abs(corr_pearson) DESC"""
        ),
    ),
    "or4_monday_first": Query(
        lambda c: c.curated.groupBy((F.weekday("BaseDateTime") + 1).alias("weekday"))
        .agg(F.avg("SOG").alias("sog"))
        .orderBy("weekday"),
        "weekday f:sog",
        over_curated(
            """SELECT CAST((dayofweek(BaseDateTime) + 1 + 5) % 7 + 1 AS INTEGER) AS weekday,
                 avg(SOG) AS sog FROM curated GROUP BY 1 ORDER BY 1"""
        ),
    ),
}

QUERIES = {**FILTERS, **JOINS, **AGGREGATES, **WINDOWS, **ORDERS}
