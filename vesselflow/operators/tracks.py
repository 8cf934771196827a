"""Previous message of a vessel (WN1, WN2) without one task per vessel, by a shuffle or from a
table of tracks that needs none."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Parts of a table of tracks whose last rows are sent to all executors.
MOST_SENT = 100_000


def with_previous(
    messages: DataFrame, values: Sequence[str], key: str = "MMSI", ts: str = "BaseDateTime"
) -> DataFrame:
    """Add ``prev_<column>`` of the previous message of the same vessel.

    Equals ``lag`` over (key, time order), but the work is split by vessel **and
    day**: the input is unique per (key, second), so one group holds at most
    86,400 rows even if a single vessel holds most of the table. The last message
    of each vessel-day is carried into the vessel's next day with messages; it
    comes from a map-side combined aggregate of one row per vessel-day.

    Rows without a time have no place in the order and are left out.
    """
    columns = list(dict.fromkeys([*values, ts]))
    rows = messages.where(F.col(ts).isNotNull()).withColumns(
        {"_day": F.to_date(ts), "_carried": F.lit(False)}
    )
    last_of_day = rows.groupBy(key, "_day").agg(
        *[F.max_by(c, ts).alias(c) for c in columns if c != ts], F.max(ts).alias(ts)
    )
    carried = last_of_day.withColumns(
        {
            "_day": F.lead("_day").over(Window.partitionBy(key).orderBy("_day")),
            "_carried": F.lit(True),
        }
    ).where(F.col("_day").isNotNull())
    in_order = Window.partitionBy(key, "_day").orderBy(ts)
    lagged = rows.unionByName(carried, allowMissingColumns=True).withColumns(
        {f"prev_{c}": F.lag(c).over(in_order) for c in columns}
    )
    return lagged.where(~F.col("_carried")).drop("_day", "_carried")


def write_tracks(
    messages: DataFrame, name: str, parts: int | None = None, key: str = "MMSI", ts: str = "BaseDateTime"
) -> None:
    """A table of tracks, on which :func:`previous_on_tracks` needs no shuffle, however often it is asked.

    Rows are dealt out by ranges of (vessel, time), so a vessel with a third of all rows fills
    a third of the parts, and the table is bucketed by part. Beside it, in ``<name>_edges``,
    stands one row per part: the last row before the part. Rows without a time have no
    place in the order and are left out. An existing table is an error; a table without its
    edges has not been finished.
    """
    spark = messages.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = messages.where(F.col(ts).isNotNull()).repartitionByRange(parts, key, ts)
    numbered = ranged.withColumn("_part", F.spark_partition_id())
    numbered.write.format("parquet").bucketBy(parts, "_part").sortBy(key, ts).saveAsTable(name)
    row, place = F.struct(*messages.columns), F.struct(key, ts)
    # A row per part: the window over all of them is small.
    ends = spark.table(name).groupBy("_part").agg(F.min(place).alias("first"), F.max_by(row, place).alias("last"))
    before = ends.select("_part", F.lag("last").over(Window.orderBy("first")).alias("before"))
    before.write.format("parquet").saveAsTable(f"{name}_edges")


def previous_on_tracks(
    spark: SparkSession, name: str, values: Sequence[str], key: str = "MMSI", ts: str = "BaseDateTime"
) -> DataFrame:
    """The result of :func:`with_previous` from a table of :func:`write_tracks`, in one scan.

    Within a part the previous row is the one before, if it is of the same vessel; the first
    row of a part looks at the last row before the part. That table has a row per part and
    is sent to all executors up to ``MOST_SENT`` parts, else joined by Spark's own choice.
    """
    columns = list(dict.fromkeys([*values, ts]))
    rows, edges = spark.table(name), spark.table(f"{name}_edges")
    if edges.count() <= MOST_SENT:
        edges = F.broadcast(edges)
    in_part = Window.partitionBy("_part").orderBy(key, ts)
    looked = rows.withColumns({"_key": F.lag(key).over(in_part), "_first": F.row_number().over(in_part) == 1})
    lagged = looked.withColumns({f"_before_{c}": F.lag(c).over(in_part) for c in columns})
    met = lagged.join(edges, "_part", "left")
    same, carried = F.col("_key").eqNullSafe(F.col(key)) & ~F.col("_first"), F.col(f"before.{key}").eqNullSafe(F.col(key)) & F.col("_first")
    # A vessel without an identifier is one vessel; a part without one before it carries nothing.
    carried = carried & F.col(f"before.{ts}").isNotNull()
    previous = {
        f"prev_{c}": F.when(same, F.col(f"_before_{c}")).when(carried, F.col(f"before.{c}")) for c in columns
    }
    return met.withColumns(previous).drop("_part", "_key", "_first", "before", *[f"_before_{c}" for c in columns])
