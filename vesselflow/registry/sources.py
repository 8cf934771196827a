"""Queries for sources, sinks and jobs (SRC1-SRC8, SNK1, SNK2, JOB1, PUB1).

The files are written by Spark from the messages, so every query covers all of
them. Each run takes new folders below the shared one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vesselflow.operators.ranking import distinct_values
from vesselflow.plans.jobs import ingest_archives, resume_ingest, run_months
from vesselflow.registry.base import Context, Query
from vesselflow.registry.reference_sql import over_curated, over_raw
from vesselflow.schema import CURATED_COLUMNS
from vesselflow.sources.archives import list_archives, member_counts, read_zip_lines
from vesselflow.sources.layout import in_clustered_box, write_clustered
from vesselflow.sources.links import extract_links
from vesselflow.sources.manifest import pending_files
from vesselflow.sources.messages import (
    add_lineage,
    add_raw_partitions,
    parse_message_lines,
    read_messages_csv,
    read_months,
    write_curated,
    write_raw,
)
from vesselflow.sources.tables import publish_table

MESSAGE_SHAPE = (
    "MMSI BaseDateTime f:LAT f:LON f:SOG f:COG f:Heading VesselName IMO CallSign VesselType Status "
    "f:Length f:Width f:Draft Cargo TransceiverClass"
)
CURATED_SHAPE = (
    "NavStatusInt MMSI t:BaseDateTime f:LAT f:LON f:SOG f:COG f:Heading VesselName VesselTypeName "
    "VesselTypeClass NavStatusName ym geohash9"
)


def _zip_lines(c: Context) -> DataFrame:
    return parse_message_lines(read_zip_lines(c.spark, c.zip_files(), r"^AIS_.*\.zip$"))


def _zip_members(c: Context) -> DataFrame:
    """Archives with a note and a CSV file each; their messages are those of the data."""
    root = c.zip_files()
    per_archive = member_counts(list_archives(c.spark, root, r"^AIS_.*\.zip$"))
    lines = read_zip_lines(c.spark, root, r"^AIS_.*\.zip$").where("line_no > 0").groupBy("source").count()
    return per_archive.join(lines, "source").agg(
        F.min("members").alias("least"), F.max("members").alias("most"), F.sum("count").alias("messages")
    )


def _lineage(c: Context) -> DataFrame:
    stamped = add_lineage(read_messages_csv(c.spark, c.csv_files()))
    return stamped.select(
        "MMSI",
        "BaseDateTime",
        F.col("_source_file").endswith(".csv").alias("from_csv"),
        F.col("_ingest_ts").isNotNull().alias("stamped"),
    )


def _written_raw(c: Context) -> str:
    out = c.fresh_dir("raw")
    write_raw(add_raw_partitions(c.raw), out)
    return out


def _write_raw_twice(c: Context) -> DataFrame:
    """The second write replaces the month instead of adding to it."""
    out = _written_raw(c)
    write_raw(add_raw_partitions(c.raw), out)
    return c.months(out)


def _write_curated(c: Context) -> DataFrame:
    out = c.fresh_dir("curated")
    write_curated(c.curated.select(*CURATED_COLUMNS), out, files=4)
    return c.months(out)


def _write_curated_even(c: Context) -> DataFrame:
    out = c.fresh_dir("curated")
    write_curated(c.curated.select(*CURATED_COLUMNS), out, file_bytes=4 << 20)
    return c.months(out)


def _job(c: Context) -> DataFrame:
    source, out = _written_raw(c), c.fresh_dir("curated")
    months = [r.ym for r in c.raw_months().collect()]
    outcome = run_months(c.spark, months, source, out)
    if outcome.failed:
        raise RuntimeError(str(outcome.failed))
    again = run_months(c.spark, months, source, out)
    if again.processed or again.skipped != sorted(months):
        raise RuntimeError("a finished month was run again")
    return read_months(c.spark, out, months)


def _ingest(c: Context) -> DataFrame:
    return ingest_archives(c.spark, c.zip_files(), c.fresh_dir("raw"))


def _resumed_ingest(c: Context) -> DataFrame:
    """Stopped after the first batch of archives and begun again."""
    root, out, ledger = c.zip_files(), c.fresh_dir("raw"), c.fresh_dir("ledger")
    size = max(1, sum(r.bytes for r in list_archives(c.spark, root).collect()) // 3)
    if resume_ingest(c.spark, root, out, ledger, batch_bytes=size, most_batches=1) is not None:
        raise RuntimeError("all archives were in the first batch")
    return resume_ingest(c.spark, root, out, ledger, batch_bytes=size)


def _clustered_box(c: Context) -> DataFrame:
    out = c.fresh_dir("clustered")
    write_clustered(c.curated.select(*CURATED_COLUMNS), out)
    return c.months(out).where(in_clustered_box(30, 45, -110, -80))


def _zip_options(c: Context) -> DataFrame:
    """Archives with other CSV options: a comment sign, a text for null, no blanks around values."""
    options = {
        "header": True,
        "ignoreLeadingWhiteSpace": True,
        "ignoreTrailingWhiteSpace": True,
        "nullValue": "IMO0000000",
        "comment": "#",
    }
    lines = read_zip_lines(c.spark, c.zip_files(), r"^AIS_.*\.zip$", comment="#")
    return parse_message_lines(lines, options)


def _publish(c: Context) -> DataFrame:
    sample = _written_raw(c)
    name = f"published_{uuid.uuid4().hex}"
    outcome = publish_table(c.spark, name, sample=sample, source_format="parquet")
    if outcome["action"] != "created (autodetect)" or publish_table(c.spark, name)["action"] != "none":
        raise RuntimeError(str(outcome))
    kept = c.fresh_dir("published")
    found = c.spark.table(name).groupBy("MMSI").agg(F.count("*").alias("n"), F.max("SOG").alias("sog"))
    found.write.parquet(kept)
    c.spark.sql(f"DROP TABLE {name}")
    return c.spark.read.parquet(kept)


def _manifest(c: Context) -> DataFrame:
    """A daily file per vessel is due for every vessel-day; its size is the time covered.

    A vessel-day of a single message covers no time: its size is unknown.
    """
    size = F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))
    return _vessel_days(c.table("events")).agg(F.nullif(size, F.lit(0)).alias("size"))


def _landed(c: Context) -> DataFrame:
    """What has arrived lacks the purchases, so some files are short or missing."""
    size = F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))
    arrived = c.table("events").where("event_type <> 'purchase'")
    return _vessel_days(arrived).agg(size.alias("size"))


def _vessel_days(events: DataFrame):
    rows = events.withColumn("ts", F.date_trunc("second", F.col("ts").cast("timestamp")))
    day = F.date_format("ts", "yyyy_MM_dd")
    return rows.groupBy(F.concat_ws("_", F.lit("AIS"), F.col("user_id").cast("string"), day).alias("name"))


_VESSEL_DAYS_SQL = """SELECT 'AIS_' || user_id || '_' || strftime(ts, '%Y_%m_%d') AS name,
  date_diff('second', min(date_trunc('second', ts)), max(date_trunc('second', ts))) AS size
  FROM events {where} GROUP BY 1"""

_LINKS_SQL = """
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY first) - 1 AS INTEGER) AS position, link
FROM (
  SELECT page_id, link, min(place) AS first FROM (
    SELECT page_id, place, regexp_extract(url, '^(https?://[^/?#]*)', 1) || href AS link FROM (
      SELECT page_id, url, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) AS place FROM (
        SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM pages))
    WHERE href <> '' AND lower(href) LIKE '%{suffix}')
  GROUP BY 1, 2)"""

# A CSV file read with default options has no empty text: it comes back as NULL.
_FROM_CSV = over_raw("SELECT * REPLACE (nullif(IMO, '') AS IMO) FROM raw")

QUERIES = {
    "src01_zip_lines": Query(_zip_lines, MESSAGE_SHAPE, _FROM_CSV),
    "src01_zip_members": Query(
        _zip_members,
        "least most messages",
        over_raw("SELECT CAST(2 AS BIGINT) AS least, CAST(2 AS BIGINT) AS most, count(*) AS messages FROM raw"),
    ),
    "src02_messages_csv": Query(
        lambda c: read_messages_csv(c.spark, c.csv_files(), {"header": True}),
        MESSAGE_SHAPE,
        _FROM_CSV,
    ),
    "src02_zip_options": Query(
        _zip_options,
        MESSAGE_SHAPE,
        over_raw(
            """SELECT * REPLACE (trim(VesselName) AS VesselName, trim(CallSign) AS CallSign, trim(Status) AS Status,
                 trim(TransceiverClass) AS TransceiverClass,
                 nullif(trim(IMO), 'IMO0000000') AS IMO) FROM raw"""
        ),
    ),
    "src03_lineage": Query(
        _lineage,
        "MMSI BaseDateTime from_csv stamped",
        over_raw("SELECT MMSI, BaseDateTime, true AS from_csv, true AS stamped FROM raw"),
    ),
    "src04_raw_partitions": Query(
        lambda c: add_raw_partitions(c.raw),
        "MMSI BaseDateTime ym ymd",
        over_raw(
            """SELECT MMSI, BaseDateTime, substr(BaseDateTime, 1, 7) AS ym,
               substr(BaseDateTime, 1, 10) AS ymd FROM raw"""
        ),
    ),
    "snk01_write_raw": Query(
        _write_raw_twice,
        f"{MESSAGE_SHAPE} ym ymd",
        over_raw(
            """SELECT *, substr(BaseDateTime, 1, 7) AS ym, substr(BaseDateTime, 1, 10) AS ymd
               FROM raw"""
        ),
    ),
    "src05_read_months": Query(
        lambda c: read_months(c.spark, _written_raw(c), ["2024-01"]),
        "MMSI BaseDateTime ym",
        over_raw(
            """SELECT MMSI, BaseDateTime, '2024-01' AS ym FROM raw
               WHERE BaseDateTime LIKE '2024-01-%'"""
        ),
    ),
    "snk02_write_curated": Query(_write_curated, CURATED_SHAPE, over_curated("SELECT * FROM curated")),
    "snk02_even_files": Query(_write_curated_even, CURATED_SHAPE, over_curated("SELECT * FROM curated")),
    "job1_run_months": Query(_job, CURATED_SHAPE, over_curated("SELECT * FROM curated")),
    "job1_ingest_archives": Query(
        _ingest,
        "ymd csv_rows parquet_rows match",
        over_raw(
            """SELECT substr(BaseDateTime, 1, 10) AS ymd, count(*) AS csv_rows,
               count(*) AS parquet_rows, true AS match FROM raw GROUP BY 1"""
        ),
    ),
    "job1_resume_ingest": Query(
        _resumed_ingest,
        "ymd csv_rows parquet_rows match",
        over_raw(
            """SELECT substr(BaseDateTime, 1, 10) AS ymd, count(*) AS csv_rows,
               count(*) AS parquet_rows, true AS match FROM raw GROUP BY 1"""
        ),
    ),
    "flt04_clustered_box": Query(
        _clustered_box,
        CURATED_SHAPE,
        over_curated("SELECT * FROM curated WHERE LAT BETWEEN 30 AND 45 AND LON BETWEEN -110 AND -80"),
    ),
    "pub1_publish_table": Query(
        _publish,
        "MMSI n f:sog",
        over_raw("SELECT MMSI, count(*) AS n, max(SOG) AS sog FROM raw GROUP BY 1"),
    ),
    "src06_distinct_values": Query(
        lambda c: distinct_values(c.curated, "MMSI"),
        "MMSI",
        over_curated("SELECT DISTINCT MMSI FROM curated"),
    ),
    "src07_extract_links": Query(
        lambda c: extract_links(c.table("pages"), ""),
        "page_id position link",
        _LINKS_SQL.format(suffix=""),
    ),
    "src07_extract_links_suffix": Query(
        lambda c: extract_links(c.table("pages"), "EN"),
        "page_id position link",
        _LINKS_SQL.format(suffix="en"),
    ),
    "src08_pending_files": Query(
        lambda c: pending_files(_manifest(c), _landed(c)),
        "name size",
        f"""SELECT m.name, m.size
            FROM (SELECT name, nullif(size, 0) AS size FROM
                  ({_VESSEL_DAYS_SQL.format(where="")})) m
            WHERE NOT EXISTS (
              SELECT 1 FROM ({_VESSEL_DAYS_SQL.format(where="WHERE event_type <> 'purchase'")}) l
              WHERE l.name = m.name AND l.size = m.size)""",
    ),
}
