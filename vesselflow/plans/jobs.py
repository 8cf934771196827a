"""Batch jobs: archives to raw months, raw months to curated months (JOB1)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vesselflow.functions import cleaning
from vesselflow.operators.curation import curate
from vesselflow.operators.quality import reconcile_counts, require_match
from vesselflow.session import fresh_dir
from vesselflow.sources.archives import archive_members, expand_members, list_archives, read_zip_lines
from vesselflow.sources.ledger import Ledger
from vesselflow.sources.messages import (
    add_lineage,
    add_raw_partitions,
    parse_message_lines,
    read_months,
    reading,
    write_curated,
    write_raw,
)
from vesselflow.sources.storage import list_months, marker_path, month_path, path_exists, remove_tree, write_marker


def ingest_archives(
    spark: SparkSession,
    root: str,
    out: str,
    name_regex: str = r"(?i)\.zip$",
    options: Mapping | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Archives to raw Parquet by month, then a check of the rows per day.

    Returns the comparison of VAL1; raises if a day differs, which includes
    messages without a readable date. Each archive is unpacked once: its messages
    go to a staging table below the shared folder, and months, counts and later
    readers come from there. The staging table is removed when the check has passed.
    """
    lines = read_zip_lines(spark, root, name_regex, tasks, **reading(options))
    staged, compared = fresh_dir(spark, "staged"), fresh_dir(spark, "compared")
    add_raw_partitions(add_lineage(parse_message_lines(lines, options))).write.partitionBy("ym").parquet(staged)
    months = list_months(spark, staged)
    if not months:
        raise FileNotFoundError(f"no message with a readable month in the archives below {root}")
    messages = spark.read.parquet(staged).withColumn("ym", F.col("ym").cast("string"))
    write_raw(messages, out)
    written = read_months(spark, out, months).withColumn(
        "ymd", F.date_format(F.try_to_timestamp("BaseDateTime"), "yyyy-MM-dd")
    )
    reconcile_counts(messages, written).coalesce(1).write.parquet(compared)
    comparison = spark.read.parquet(compared).orderBy("ymd")
    require_match(comparison)
    remove_tree(spark, staged)
    return comparison


def _batches(archives: list, batch_bytes: int) -> list[list]:
    """Archives in order, as many to a batch as its bytes allow, at least one."""
    batches, size = [], 0
    for archive in archives:
        if not batches or size + archive.bytes > batch_bytes:
            batches.append([])
            size = 0
        batches[-1].append(archive)
        size += archive.bytes
    return batches


def _stage(spark: SparkSession, ledger: Ledger, batch: list, options: Mapping | None, tasks: int | None) -> None:
    """Unpack a batch into the ledger's folder by month, then put its archives into the ledger."""
    staged = ledger.new_batch()
    archives = spark.createDataFrame([(a.source,) for a in batch], "source string")
    members = archive_members(archives).where(F.lower("member").endswith(".csv"))
    counted = members.groupBy("source").agg(F.count("*").alias("members"), F.sum("size").alias("text_bytes"))
    found = {r.source: r for r in counted.collect()}
    if found:
        lines = expand_members(members, tasks, **reading(options))
        messages = add_raw_partitions(add_lineage(parse_message_lines(lines, options)))
        messages.write.partitionBy("ym").parquet(staged)
    ledger.commit_batch(
        staged,
        bool(found),
        [
            {
                "source": a.source,
                "bytes": a.bytes,
                "modified": a.modified,
                "members": found[a.source].members if a.source in found else 0,
                "text_bytes": found[a.source].text_bytes if a.source in found else 0,
            }
            for a in batch
        ],
    )


def resume_ingest(
    spark: SparkSession,
    root: str,
    out: str,
    ledger: str,
    name_regex: str = r"(?i)\.zip$",
    options: Mapping | None = None,
    tasks: int | None = None,
    batch_bytes: int = 256 << 30,
    most_batches: int | None = None,
) -> DataFrame | None:
    """:func:`ingest_archives` for very many archives: begun again, it goes on where it stopped.

    Archives are unpacked in batches of ``batch_bytes``. Each batch is staged by month below
    ``ledger`` and then noted there in one step, with its archives, their sizes and times
    and their members, so a run that is killed loses one batch at most, and no archive
    that is noted is opened again. When all are staged, each month that new batches touch
    is written to ``out`` from all batches and noted, too. Archives that arrive later join
    the same months in a later run. At the end the rows per day are compared (VAL1).

    ``most_batches`` stops after so many batches; the result is None while archives are
    left. An archive that changed after it was staged is an error. The staged messages stay,
    because later archives may belong to the same months, until ``Ledger(...).close()``.
    """
    book = Ledger(spark, ledger)
    pending = book.pending(list_archives(spark, root, name_regex)).orderBy("source").collect()
    batches = _batches(pending, batch_bytes)
    for batch in batches[:most_batches]:
        _stage(spark, book, batch, options, tasks)
    if most_batches is not None and len(batches) > most_batches:
        return None
    finished = sorted(staged for staged in book.batches() if staged)
    if not finished:
        raise FileNotFoundError("the archives hold no CSV file")
    published = book.published()
    months: dict[str, list[str]] = {}
    for staged in finished:
        for ym in list_months(spark, staged):
            months.setdefault(ym, []).append(staged)
    if not months:
        raise FileNotFoundError(f"no message with a readable month in the archives below {root}")
    for ym, folders in sorted(months.items()):
        if published.get(ym) != set(folders):
            write_raw(book.staged([month_path(folder, ym) for folder in folders]), out)
            book.commit_month(ym, folders)
    written = read_months(spark, out, months).withColumn(
        "ymd", F.date_format(F.try_to_timestamp("BaseDateTime"), "yyyy-MM-dd")
    )
    compared = fresh_dir(spark, "compared")
    reconcile_counts(book.staged(finished), written).coalesce(1).write.parquet(compared)
    comparison = spark.read.parquet(compared).orderBy("ymd")
    require_match(comparison)
    return comparison


@dataclass
class MonthsOutcome:
    processed: list[str] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)
    failed: list[tuple[str, str]] = field(default_factory=list)
    # Rows of a month's input whose time lies in another month or is unreadable.
    strays: dict[str, int] = field(default_factory=dict)


def _curate_month(spark: SparkSession, month: str, input_base: str, output_base: str, files: int | None) -> int:
    """Write one month and return the number of input rows that are not of it."""
    raw = read_months(spark, input_base, [month])
    first_day = date.fromisoformat(f"{month}-01")
    next_month = F.add_months(F.lit(first_day), 1).cast("timestamp")
    time = cleaning.message_time("BaseDateTime")
    in_month = F.coalesce(
        (time >= F.lit(first_day).cast("timestamp")) & (time < next_month), F.lit(False)
    )
    write_curated(curate(raw.where(in_month)), output_base, files)
    # Counted by itself, over one column: an observed count grows when a stage is run again.
    return raw.where(~in_month).count()


def run_months(
    spark: SparkSession,
    months: Iterable[str],
    input_base: str,
    output_base: str,
    resume: bool = True,
    skip_existing: bool = False,
    files: int | None = None,
) -> MonthsOutcome:
    """JOB1: curate the months one after the other; a failed one does not stop the rest.

    A month is skipped if it has no input, if its marker exists (``resume``), or if
    its output exists (``skip_existing``). Rows of other months are counted and left
    out, so a run never replaces another month's output.
    """
    outcome = MonthsOutcome()
    for month in sorted(months):
        done = resume and path_exists(spark, marker_path(output_base, month))
        present = skip_existing and path_exists(spark, month_path(output_base, month))
        if done or present or not path_exists(spark, month_path(input_base, month)):
            outcome.skipped.append(month)
            continue
        try:
            outcome.strays[month] = _curate_month(spark, month, input_base, output_base, files)
            write_marker(spark, output_base, month)
            outcome.processed.append(month)
        except Exception as error:  # noqa: BLE001 - recorded, the loop goes on
            outcome.failed.append((month, str(error)))
    return outcome
