"""Queries for the analyses (AN1-AN20) and the checks (VAL1, VAL2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vesselflow.functions import predicates as P
from vesselflow.operators.quality import (
    distinct_sketches,
    merged_distinct,
    quality_report,
    reconcile_content,
    reconcile_counts,
)
from vesselflow.operators.series import time_series
from vesselflow.plans import analyses as A
from vesselflow.plans import anomaly as N
from vesselflow.plans.mergeable import update_anomaly
from vesselflow.registry.base import Query
from vesselflow.registry.reference_sql import over_curated, over_raw
from vesselflow.sources.messages import add_raw_partitions, write_raw

# Both months of the messages.
START, END = "2024-01-01", "2024-02-29"
DAYS = "BaseDateTime >= DATE '2024-01-01' AND BaseDateTime < DATE '2024-03-01'"
BOX = (26.0, 48.0, -120.0, -70.0)
IN_BOX = "LAT BETWEEN 26 AND 48 AND LON BETWEEN -120 AND -70"
CORR = """CASE WHEN max({x}) > min({x}) AND max({y}) > min({y})
  THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END"""
ANGLE = "least(abs(COG - prev_cog), 360 - abs(COG - prev_cog))"


def _correlation_sql(group: str, x: str, y: str, name: str, further: str = "") -> str:
    return over_curated(
        f"""SELECT {group}, count(*) AS n, {CORR.format(x=x, y=y)} AS {name} {further}
            FROM curated WHERE {x} IS NOT NULL AND {y} IS NOT NULL AND {DAYS}
            GROUP BY {group} HAVING count(*) >= 50"""
    )


def _series_sql(id_sql: str, unit: str, value: str) -> str:
    return f"""series AS (
      SELECT {id_sql} AS series_id, date_trunc('{unit}', BaseDateTime) AS ts_col, {value} AS value
      FROM curated WHERE BaseDateTime IS NOT NULL AND {DAYS} GROUP BY 1, 2)"""


def _model_sql(slot: str, min_slot: int, unit: str) -> tuple[str, ...]:
    """Steps of the fit, written with joins and plain aggregates."""
    return (
        f"slotted AS (SELECT *, {slot} AS slot FROM series)",
        "whole AS (SELECT series_id, avg(value) AS series_mean FROM slotted GROUP BY series_id)",
        f"""slots AS (SELECT series_id, slot, avg(value) AS slot_mean FROM slotted
             GROUP BY series_id, slot HAVING count(value) >= {min_slot})""",
        """residuals AS (
             SELECT s.series_id, s.ts_col, s.slot, s.value,
               coalesce(m.slot_mean, w.series_mean) AS mean,
               s.value - coalesce(m.slot_mean, w.series_mean) AS r
             FROM slotted s
             JOIN whole w ON w.series_id IS NOT DISTINCT FROM s.series_id
             LEFT JOIN slots m ON m.series_id IS NOT DISTINCT FROM s.series_id AND m.slot = s.slot)""",
        f"""lagged AS (
             SELECT a.*, b.r AS prev_r FROM residuals a LEFT JOIN residuals b
             ON b.series_id IS NOT DISTINCT FROM a.series_id AND b.ts_col = a.ts_col - INTERVAL 1 {unit})""",
        """phis AS (
             SELECT series_id, count(value) AS n, max(ts_col) AS last_ts,
               arg_max(r, ts_col) AS last_residual,
               greatest(least(coalesce(CASE WHEN var_pop(prev_r) FILTER (r IS NOT NULL) > 0
                 THEN covar_pop(r, prev_r) / var_pop(prev_r) FILTER (r IS NOT NULL) END,
                 0), 0.99), -0.99) AS phi
             FROM lagged GROUP BY series_id)""",
        """sigmas AS (
             SELECT l.series_id, stddev_samp(l.r - p.phi * l.prev_r) AS sigma
             FROM lagged l JOIN phis p ON p.series_id IS NOT DISTINCT FROM l.series_id
             GROUP BY l.series_id)""",
        """model AS (
             SELECT p.*, s.sigma, w.series_mean FROM phis p
             JOIN sigmas s ON s.series_id IS NOT DISTINCT FROM p.series_id
             JOIN whole w ON w.series_id IS NOT DISTINCT FROM p.series_id)""",
    )


SCORED = (
    """predicted AS (
         SELECT l.series_id, l.ts_col, l.value,
           l.mean + m.phi * coalesce(l.prev_r, 0) AS predicted,
           CASE WHEN m.sigma > 0 THEN m.sigma END AS spread
         FROM lagged l JOIN model m ON m.series_id IS NOT DISTINCT FROM l.series_id)""",
    """scaled AS (SELECT *, abs(value - predicted) / spread / sqrt(2) AS x,
         1 / (1 + 0.3275911 * (abs(value - predicted) / spread / sqrt(2))) AS t FROM predicted)""",
    """scored AS (SELECT *, 1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t
         - 0.284496736) * t + 0.254829592) * t * exp(-x * x) AS p FROM scaled)""",
)
SCORE_SELECT = """SELECT series_id, ts_col, value, p > 0.95 AS is_anomaly, p AS anomaly_probability,
   predicted - 1.959963984540054 * spread AS lower_bound,
   predicted + 1.959963984540054 * spread AS upper_bound FROM scored"""
SCORE_SHAPE = (
    "series_id t:ts_col f:value is_anomaly f:anomaly_probability f:lower_bound f:upper_bound"
)
MODEL_SHAPE = (
    "series_id slot f:mean f:phi f:sigma n f:last_residual t:last_ts"
)


def _train_then_detect(metric: str, freq: str, id_col: str, precision: int | None = None):
    """Fit on the whole range, store, load again, score the same range."""

    def build(c):
        base = c.fresh_dir("models")
        model = N.train_anomaly(
            c.curated, START, END, None, metric, freq, id_col, precision=precision
        )
        N.save_model(model, base, metric, id_col, freq, precision)
        stored = N.load_model(c.spark, base, metric, id_col, freq, precision)
        return N.detect_anomalies(
            c.curated, stored, START, END, None, metric, freq, id_col, 0.95, precision
        )

    return build


def _model_slots(c):
    model = N.train_anomaly(c.curated, START, END, None, "count", "DAILY", "VesselTypeName")
    return model.select("*", F.explode("slot_means").alias("slot", "mean"))


def _updated_model_slots(c):
    """The model of January, stored and then updated with February alone."""
    base, settings = c.fresh_dir("models"), {"metric": "count", "freq": "DAILY", "id_col": "VesselTypeName"}
    update_anomaly(c.spark, base, c.curated, START, "2024-01-31", **settings)
    model = update_anomaly(c.spark, base, c.curated, "2024-02-01", END, **settings)
    return model.select("*", F.explode("slot_means").alias("slot", "mean"))


MODEL_SLOTS_SQL = """SELECT DISTINCT m.series_id, r.slot, r.mean, m.phi, m.sigma, m.n, m.last_residual, m.last_ts
   FROM model m JOIN residuals r ON r.series_id IS NOT DISTINCT FROM m.series_id"""
def _recent_by_month(c):
    months = [r.ym for r in c.raw_months().collect()]
    return A.recent_positions_by_month(
        c.spark, c.curated_base, months, START, END, None, None, 100, ["SOG", "NavStatusName"]
    )


def _content_check(c):
    """Messages against their written copy, in which the speeds of one vessel were raised."""
    out, messages = c.fresh_dir("raw"), add_raw_partitions(c.raw)
    speed = F.when(F.col("MMSI") == 366000003, F.col("SOG") + 1).otherwise(F.col("SOG"))
    write_raw(messages.withColumn("SOG", speed), out)
    return reconcile_content(messages, c.months(out), "ymd")


def _sketched_keys(c):
    """Stored sketches of the months, merged; the estimate is compared with the exact number."""
    path, keys = c.fresh_dir("sketches"), ["MMSI", "BaseDateTime"]
    distinct_sketches(c.curated, keys).write.parquet(path)
    sketches = c.spark.read.parquet(path)
    per_month = merged_distinct(sketches, "ym")
    whole = merged_distinct(sketches).select(F.lit("all").alias("ym"), "*")
    twice = c.curated.select(F.explode(F.array("ym", F.lit("all"))).alias("ym"), *keys)
    exact = twice.groupBy("ym").agg(F.countDistinct(*keys).alias("exact"))
    met = per_month.unionByName(whole).join(exact, "ym")
    return met.withColumn("close", F.abs(F.col("distinct_keys") - F.col("exact")) <= 0.03 * F.col("exact"))


HOURLY_SLOT = "CAST(hour(ts_col) AS INTEGER)"
DAILY_SLOT = "CAST(isodow(ts_col) - 1 AS INTEGER)"

QUERIES = {
    "an01_draft_outliers": Query(
        lambda c: A.draft_outliers(c.curated, START, END, None, 2.0, 100),
        "VesselTypeName MMSI f:avg_draft f:mu f:sd f:z",
        over_curated(
            """SELECT VesselTypeName, MMSI, avg_draft, mu, sd, abs(avg_draft - mu) / sd AS z
               FROM vessels WHERE VesselTypeName IS NOT NULL AND sd > 0 AND abs(avg_draft - mu) >= 2 * sd
               ORDER BY z DESC, 1, 2 LIMIT 100""",
            f"""vessels AS (
                  SELECT VesselTypeName, MMSI, avg(Draft) AS avg_draft,
                    avg(avg(Draft)) OVER w AS mu, stddev_samp(avg(Draft)) OVER w AS sd
                  FROM curated WHERE Draft IS NOT NULL AND {DAYS} GROUP BY VesselTypeName, MMSI
                  WINDOW w AS (PARTITION BY VesselTypeName))""",
        ),
    ),
    "an02_course_changes": Query(
        lambda c: A.course_changes(c.curated, START, END, None, 90.0, P.in_bbox(*BOX), 100),
        "MMSI t:BaseDateTime geohash9 f:COG f:prev_cog f:delta_cog",
        over_curated(
            """SELECT * FROM steps WHERE delta_cog >= 90
               ORDER BY delta_cog DESC, MMSI, BaseDateTime LIMIT 100""",
            f"""steps AS (
                  SELECT MMSI, BaseDateTime, geohash9, COG,
                    lag(COG) OVER w AS prev_cog, abs(COG - lag(COG) OVER w) AS delta_cog
                  FROM curated
                  WHERE COG IS NOT NULL AND geohash9 IS NOT NULL AND {DAYS} AND {IN_BOX}
                  WINDOW w AS (PARTITION BY MMSI ORDER BY BaseDateTime))""",
        ),
    ),
    "an03_course_changes_circular": Query(
        lambda c: A.course_changes_circular(
            c.curated, START, END, 600, 90.0, None, P.in_bbox(*BOX), 5000
        ),
        "MMSI t:BaseDateTime t:prev_ts dt_min f:prev_cog f:COG f:delta_deg f:LAT f:LON",
        over_curated(
            f"""SELECT MMSI, BaseDateTime, prev_ts, date_sub('minute', prev_ts, BaseDateTime) AS dt_min,
                  prev_cog, COG, {ANGLE} AS delta_deg, LAT, LON
                FROM steps
                WHERE prev_cog IS NOT NULL AND date_sub('minute', prev_ts, BaseDateTime) <= 600
                  AND {ANGLE} >= 90 AND {IN_BOX}
                ORDER BY BaseDateTime DESC, MMSI LIMIT 5000""",
            f"""steps AS (
                  SELECT MMSI, BaseDateTime, COG, LAT, LON,
                    lag(COG) OVER w AS prev_cog, lag(BaseDateTime) OVER w AS prev_ts
                  FROM curated WHERE COG IS NOT NULL AND {DAYS}
                  WINDOW w AS (PARTITION BY MMSI ORDER BY BaseDateTime))""",
        ),
    ),
    "an04_correlation_by_type": Query(
        lambda c: A.correlation_by_type(c.curated, START, END, None, "SOG", "Length", 50),
        "VesselTypeName n f:corr_pearson",
        _correlation_sql("VesselTypeName", "SOG", "Length", "corr_pearson"),
    ),
    "an05_speed_draft_correlation": Query(
        lambda c: A.speed_draft_correlation(c.curated, START, END, None, 50),
        "VesselTypeName f:corr_pearson n",
        _correlation_sql("VesselTypeName", "SOG", "Draft", "corr_pearson"),
    ),
    "an06_recent_positions": Query(
        lambda c: A.recent_positions(c.curated, START, END, None, None, 100, ["SOG", "NavStatusName"]),
        "MMSI t:BaseDateTime geohash9 VesselTypeName f:SOG NavStatusName",
        over_curated(
            f"""SELECT MMSI, BaseDateTime, geohash9, VesselTypeName, SOG, NavStatusName
                FROM curated WHERE geohash9 IS NOT NULL AND {DAYS}
                ORDER BY BaseDateTime DESC, MMSI LIMIT 100"""
        ),
    ),
    "an06_recent_positions_by_month": Query(
        _recent_by_month,
        "MMSI t:BaseDateTime geohash9 VesselTypeName f:SOG NavStatusName",
        over_curated(
            f"""SELECT MMSI, BaseDateTime, geohash9, VesselTypeName, SOG, NavStatusName
                FROM curated WHERE geohash9 IS NOT NULL AND {DAYS}
                ORDER BY BaseDateTime DESC, MMSI LIMIT 100"""
        ),
    ),
    "an07_length_width_correlation": Query(
        lambda c: A.length_width_correlation(c.curated, START, END, None, 50),
        "VesselTypeClass n f:corr_len_width",
        _correlation_sql("VesselTypeClass", "Length", "Width", "corr_len_width"),
    ),
    "an08_length_width_covariance": Query(
        lambda c: A.length_width_covariance(c.curated, START, END, None, 50),
        "VesselTypeClass f:corr_len_width f:covar_len_width n",
        _correlation_sql(
            "VesselTypeClass", "Length", "Width", "corr_len_width",
            ", covar_pop(Length, Width) AS covar_len_width",
        ),
    ),
    "an09_status_summary": Query(
        lambda c: A.status_summary(c.curated, START, END),
        "NavStatusName total_messages unique_vessels f:avg_sog f:avg_draft",
        over_curated(
            f"""SELECT NavStatusName, count(*) AS total_messages,
                  count(DISTINCT MMSI) AS unique_vessels, avg(SOG) AS avg_sog, avg(Draft) AS avg_draft
                FROM curated WHERE NavStatusName IS NOT NULL AND {DAYS} GROUP BY 1"""
        ),
    ),
    "an10_status_by_day": Query(
        lambda c: A.status_by_day(c.curated, START, END),
        "t:d NavStatusName f:avg_draft f:max_sog msgs",
        over_curated(
            f"""SELECT CAST(BaseDateTime AS DATE) AS d, NavStatusName, avg(Draft) AS avg_draft,
                  max(SOG) AS max_sog, count(*) AS msgs
                FROM curated WHERE {DAYS} GROUP BY 1, 2"""
        ),
    ),
    "an11_moving_while_stationary": Query(
        lambda c: A.moving_while_stationary(c.curated, START, END, 5.0, 100),
        "MMSI VesselName t:BaseDateTime NavStatusName f:SOG",
        over_curated(
            f"""SELECT MMSI, VesselName, BaseDateTime, NavStatusName, SOG FROM curated
                WHERE NavStatusName IN ('Moored', 'At anchor') AND SOG > 5 AND {DAYS}
                ORDER BY SOG DESC, MMSI, BaseDateTime LIMIT 100"""
        ),
    ),
    "an11_moving_while_stationary_strict": Query(
        lambda c: A.moving_while_stationary(c.curated, START, END, 5.0, 100, strict_labels=True),
        "MMSI VesselName t:BaseDateTime NavStatusName f:SOG",
        over_curated(
            f"""SELECT MMSI, VesselName, BaseDateTime, NavStatusName, SOG FROM curated
                WHERE NavStatusName IN ('Moored', 'At Anchor') AND SOG > 5 AND {DAYS}
                ORDER BY SOG DESC, MMSI, BaseDateTime LIMIT 100"""
        ),
    ),
    "an12_variability_by_type": Query(
        lambda c: A.variability_by_type(c.curated, START, END, None, 50),
        "VesselTypeName n f:sd_sog f:sd_cog f:avg_sog f:avg_cog",
        over_curated(
            f"""SELECT VesselTypeName, count(*) AS n, stddev_samp(SOG) AS sd_sog,
                  stddev_samp(COG) AS sd_cog, avg(SOG) AS avg_sog, avg(COG) AS avg_cog
                FROM curated WHERE SOG IS NOT NULL AND COG IS NOT NULL AND {DAYS}
                GROUP BY 1 HAVING count(*) >= 50"""
        ),
    ),
    "an13_heading_variability": Query(
        lambda c: A.heading_variability_by_type(c.curated, START, END, None, 50),
        "VesselTypeName f:sd_sog f:sd_heading n",
        over_curated(
            f"""SELECT VesselTypeName, stddev_samp(SOG) AS sd_sog,
                  stddev_samp(Heading) AS sd_heading, count(*) AS n
                FROM curated WHERE {DAYS} GROUP BY 1 HAVING count(*) >= 50"""
        ),
    ),
    "an14_unusual_speeds": Query(
        lambda c: A.unusual_speeds(c.curated, START, END, None, 95, 100),
        "MMSI VesselTypeName f:sog_max f:sog_p f:exceso",
        over_curated(
            f"""SELECT *, sog_max - sog_p AS exceso FROM (
                  SELECT MMSI, VesselTypeName, max(SOG) AS sog_max, quantile_disc(SOG, 0.95) AS sog_p
                  FROM curated WHERE SOG IS NOT NULL AND {DAYS} GROUP BY 1, 2)
                WHERE sog_max > sog_p ORDER BY exceso DESC, 1, 2 LIMIT 100"""
        ),
    ),
    "an15_speeds_above_type_percentile": Query(
        lambda c: A.speeds_above_type_percentile(c.curated, START, END, None, 95, 100),
        "VesselTypeName MMSI VesselName f:sog_max f:sog_p",
        over_curated(
            """SELECT a.VesselTypeName, a.MMSI,
                 max(struct_pack(s := SOG, name := VesselName)).name AS VesselName,
                 max(SOG) AS sog_max, sog_p
               FROM curated a JOIN of_type p ON a.VesselTypeName = p.vt
               WHERE a.SOG > p.sog_p GROUP BY 1, 2, sog_p
               ORDER BY sog_max DESC, 1, 2 LIMIT 100""",
            f"""of_type AS (
                  SELECT VesselTypeName AS vt, quantile_disc(SOG, 95 / 101) AS sog_p
                  FROM curated WHERE SOG IS NOT NULL AND {DAYS} GROUP BY 1)""",
        ),
    ),
    "an16_speed_by_weekday": Query(
        lambda c: A.speed_by_weekday(c.curated),
        "VesselTypeName dow f:avg_sog f:sd_sog n",
        over_curated(
            """SELECT VesselTypeName, dayname(BaseDateTime) AS dow, avg(SOG) AS avg_sog,
                 stddev_samp(SOG) AS sd_sog, count(*) AS n
               FROM curated WHERE VesselTypeName IS NOT NULL GROUP BY 1, 2"""
        ),
    ),
    "an17_top_status_by_weekday": Query(
        lambda c: A.top_status_by_weekday(c.curated),
        "VesselTypeName dow most_common_status count",
        over_curated(
            """SELECT DISTINCT VesselTypeName, dow,
                 first_value(NavStatusName) OVER w AS most_common_status, first_value(n) OVER w AS count
               FROM (SELECT DISTINCT VesselTypeName, dayname(BaseDateTime) AS dow, NavStatusName,
                       count(*) OVER (PARTITION BY VesselTypeName, dayname(BaseDateTime), NavStatusName) AS n
                     FROM curated WHERE VesselTypeName IS NOT NULL AND NavStatusName IS NOT NULL) c
               WINDOW w AS (PARTITION BY VesselTypeName, dow ORDER BY n DESC, NavStatusName)""",
        ),
    ),
    "an18_time_series_count": Query(
        lambda c: time_series(c.curated, START, END, None, "count", "HOURLY", "geohash9"),
        "series_id t:ts_col value",
        over_curated("SELECT * FROM series", _series_sql("geohash9", "hour", "count(*)")),
    ),
    "an18_time_series_speed": Query(
        lambda c: time_series(c.curated, START, END, None, "Speed", "daily", "VesselTypeName"),
        "series_id t:ts_col f:value",
        over_curated("SELECT * FROM series", _series_sql("VesselTypeName", "day", "avg(SOG)")),
    ),
    "an19_train_anomaly": Query(
        _model_slots,
        MODEL_SHAPE,
        over_curated(
            MODEL_SLOTS_SQL, _series_sql("VesselTypeName", "day", "count(*)"), *_model_sql(DAILY_SLOT, 2, "DAY")
        ),
    ),
    "an19_updated_anomaly": Query(
        _updated_model_slots,
        MODEL_SHAPE,
        over_curated(
            MODEL_SLOTS_SQL, _series_sql("VesselTypeName", "day", "count(*)"), *_model_sql(DAILY_SLOT, 2, "DAY")
        ),
    ),
    "an20_detect_anomalies_daily": Query(
        _train_then_detect("count", "DAILY", "VesselTypeName"),
        SCORE_SHAPE,
        over_curated(
            SCORE_SELECT,
            _series_sql("VesselTypeName", "day", "count(*)"),
            *_model_sql(DAILY_SLOT, 2, "DAY"),
            *SCORED,
        ),
    ),
    "an20_detect_anomalies_hourly_speed": Query(
        _train_then_detect("speed", "HOURLY", "geohash9", 2),
        SCORE_SHAPE,
        over_curated(
            SCORE_SELECT,
            _series_sql("substr(geohash9, 1, 2)", "hour", "avg(SOG)"),
            *_model_sql(HOURLY_SLOT, 2, "HOUR"),
            *SCORED,
        ),
    ),
    "val1_reconcile_counts": Query(
        lambda c: reconcile_counts(
            c.raw.select(F.substring("BaseDateTime", 1, 10).alias("ymd")),
            c.curated.select(F.date_format("BaseDateTime", "yyyy-MM-dd").alias("ymd")),
        ),
        "ymd csv_rows parquet_rows match",
        over_curated(
            """SELECT coalesce(l.ymd, r.ymd) AS ymd, coalesce(l.n, 0) AS csv_rows,
                 coalesce(r.n, 0) AS parquet_rows, coalesce(l.n, 0) = coalesce(r.n, 0) AS match
               FROM (SELECT substr(BaseDateTime, 1, 10) AS ymd, count(*) AS n FROM raw GROUP BY 1) l
               FULL JOIN (SELECT strftime(BaseDateTime, '%Y-%m-%d') AS ymd, count(*) AS n
                          FROM curated GROUP BY 1) r ON l.ymd = r.ymd"""
        ),
    ),
    "val1_content_check": Query(
        _content_check,
        "ymd left_rows right_rows match",
        over_raw(
            """SELECT substr(BaseDateTime, 1, 10) AS ymd, count(*) AS left_rows, count(*) AS right_rows,
                 count(*) FILTER (MMSI = 366000003 AND SOG IS NOT NULL) = 0 AS match FROM raw GROUP BY 1"""
        ),
    ),
    "val2_distinct_sketches": Query(
        _sketched_keys,
        "ym rows close",
        over_curated(
            """SELECT ym, count(*) AS rows, true AS close
               FROM (SELECT ym FROM curated UNION ALL SELECT 'all' FROM curated) GROUP BY 1"""
        ),
    ),
    "val2_quality_report": Query(
        lambda c: quality_report(c.raw, c.curated),
        "stage metric f:value",
        over_curated(
            """SELECT 'raw' AS stage, 'rows' AS metric, CAST(n AS DOUBLE) AS value FROM r
               UNION ALL SELECT 'raw', 'without_position', n - kept FROM r
               UNION ALL SELECT 'raw', 'percent_sog_out_of_range', 100.0 * fast / n FROM r
               UNION ALL SELECT 'raw', 'unparseable_time', timeless FROM r
               UNION ALL SELECT 'raw', 'with_position', kept FROM r
               UNION ALL SELECT 'curated', 'rows', n FROM c
               UNION ALL SELECT 'curated', 'distinct_keys', keys FROM c
               UNION ALL SELECT 'curated', 'repeated_keys', n - keys FROM c
               UNION ALL SELECT 'curated', 'sog_out_of_range', bad_sog FROM c
               UNION ALL SELECT 'curated', 'lat_out_of_range', bad_lat FROM c
               UNION ALL SELECT 'curated', 'lon_out_of_range', bad_lon FROM c
               UNION ALL SELECT 'curated', 'hour_out_of_range', bad_hour FROM c
               UNION ALL SELECT 'curated', 'duplicates_removed', r.kept - c.n FROM r, c""",
            """r AS (SELECT count(*) AS n,
                 count(*) FILTER (WHERE abs(LAT) <= 90 AND LON IS NOT NULL) AS kept,
                 count(*) FILTER (WHERE SOG < 0 OR SOG > 70) AS fast,
                 count(*) FILTER (WHERE try_strptime(BaseDateTime, '%Y-%m-%dT%H:%M:%S') IS NULL)
                   AS timeless FROM raw)""",
            """c AS (SELECT count(*) AS n, count(DISTINCT (MMSI, BaseDateTime)) AS keys,
                 count(*) FILTER (WHERE SOG < 0 OR SOG > 70) AS bad_sog,
                 count(*) FILTER (WHERE abs(LAT) > 90) AS bad_lat,
                 count(*) FILTER (WHERE abs(LON) > 180) AS bad_lon,
                 count(*) FILTER (WHERE hour < 0 OR hour > 23) AS bad_hour FROM curated)""",
        ),
    ),
}
