"""Top rows, most frequent values, distinct values (OR1, AG14, SRC6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(rows: DataFrame, by: Column, ties: Sequence[str], limit: int | None) -> DataFrame:
    """OR1: the first ``limit`` rows in a full, hence repeatable, order; all with None."""
    ordered = rows.orderBy(by, *ties)
    return ordered if limit is None else ordered.limit(limit)


def most_frequent(rows: DataFrame, group: Sequence[str], value: str, count: str = "count") -> DataFrame:
    """AG14, WN3: most frequent value per group, ties by value.

    The window runs over the counts, of which a group has one per distinct value.
    """
    counts = rows.groupBy(*group, value).agg(F.count("*").alias(count))
    window = Window.partitionBy(*group).orderBy(F.col(count).desc(), F.col(value).asc())
    return counts.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def distinct_values(rows: DataFrame, column: str) -> DataFrame:
    """SRC6: sorted distinct values."""
    return rows.select(column).distinct().orderBy(column)
