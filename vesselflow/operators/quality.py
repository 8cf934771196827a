"""Count checks and quality metrics (VAL1, VAL2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vesselflow import schema as S
from vesselflow.functions import cleaning as rule


class CountMismatch(RuntimeError):
    """Two tables differ in their rows per key."""


def reconcile_counts(
    left: DataFrame,
    right: DataFrame,
    key: str = "ymd",
    left_name: str = "csv_rows",
    right_name: str = "parquet_rows",
) -> DataFrame:
    """VAL1, JN4: rows per key on both sides, missing as 0, and whether they match.

    Both sides are counted before they are joined. NULL keys match each other.
    """
    counts_left = left.groupBy(F.col(key).alias("_l")).agg(F.count("*").alias(left_name))
    counts_right = right.groupBy(F.col(key).alias("_r")).agg(F.count("*").alias(right_name))
    joined = counts_left.join(counts_right, F.col("_l").eqNullSafe(F.col("_r")), "full")
    return joined.select(
        F.coalesce("_l", "_r").alias(key),
        F.coalesce(left_name, F.lit(0)).alias(left_name),
        F.coalesce(right_name, F.lit(0)).alias(right_name),
    ).select("*", (F.col(left_name) == F.col(right_name)).alias("match"))


def digest(columns: list[str]) -> Column:
    """Aggregate: a number that tells whether two sets of rows are the same, in any order.

    The sum of 64-bit hashes of whole rows, so it combines before the shuffle, and repeated
    rows do not cancel each other. Which columns are NULL is hashed, too, as ``xxhash64``
    passes over NULL."""
    missing = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns])
    return F.sum(F.xxhash64(*columns, missing).cast("decimal(20,0)"))


def reconcile_content(
    left: DataFrame, right: DataFrame, key: str = "ymd", columns: list[str] | None = None
) -> DataFrame:
    """VAL1 for values: per key the rows of both sides, and whether their rows are the same.

    ``columns`` (default: those that both sides have, without the key) must have the same
    types on both sides, because a hash depends on the type; else ValueError. Each side
    is read once and reduced to a row per key. Two different sets of rows pass as the same
    with a chance of about 2^-64."""
    wanted = columns or [c for c in left.columns if c in right.columns and c != key]
    types = {c: (left.schema[c].dataType, right.schema[c].dataType) for c in wanted}
    unlike = [c for c, (a, b) in types.items() if a != b]
    if unlike or not wanted:
        raise ValueError(f"columns of different types: {', '.join(unlike)}" if unlike else "no common column")

    def side(rows: DataFrame, suffix: str) -> DataFrame:
        counted = F.count("*").alias(f"{suffix}_rows")
        return rows.groupBy(F.col(key).alias(f"_{suffix}")).agg(counted, digest(wanted).alias(f"{suffix}_digest"))

    joined = side(left, "left").join(side(right, "right"), F.col("_left").eqNullSafe(F.col("_right")), "full")
    return joined.select(
        F.coalesce("_left", "_right").alias(key),
        F.coalesce("left_rows", F.lit(0)).alias("left_rows"),
        F.coalesce("right_rows", F.lit(0)).alias("right_rows"),
        "left_digest",
        "right_digest",
        F.col("left_digest").eqNullSafe(F.col("right_digest")).alias("match"),
    )


def distinct_sketches(rows: DataFrame, columns: list[str], by: str = "ym", log_entries: int = 16) -> DataFrame:
    """VAL2: per ``by`` the rows and a theta sketch of the distinct keys, to be kept and merged.

    A sketch holds at most 2^log_entries hashes and is exact up to so many keys; beyond, the
    relative error is about 1 / sqrt(2^log_entries). Sketches combine before the shuffle,
    so no row moves."""
    # The hash of all columns; NULL is a value like any other.
    missing = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns])
    return rows.groupBy(by).agg(
        F.count("*").alias("rows"), F.theta_sketch_agg(F.xxhash64(*columns, missing), log_entries).alias("sketch")
    )


def merged_distinct(sketches: DataFrame, *by: str, log_entries: int = 16) -> DataFrame:
    """Rows and distinct keys over stored sketches, for all of them or per ``by``."""
    return sketches.groupBy(*by).agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.theta_sketch_estimate(F.theta_union_agg("sketch", log_entries)).alias("distinct_keys"),
    )


def require_match(comparison: DataFrame) -> None:
    """Raise if a key does not match; names up to twenty of them."""
    bad = comparison.where(~F.col("match")).limit(20).collect()
    if bad:
        raise CountMismatch("rows differ: " + "; ".join(str(row.asDict()) for row in bad))


def _how_many(condition: Column) -> Column:
    return F.count_if(condition)


def quality_report(raw: DataFrame, curated: DataFrame) -> DataFrame:
    """VAL2: ``stage, metric, value`` about the raw and the curated table.

    The raw side is one aggregate without a shuffle of rows; the curated side is
    counted per message key first, to see whether the key is unique.
    """
    lat = rule.latitude(rule.number("LAT"))
    lon = rule.longitude(rule.number("LON"))
    sog = rule.number("SOG")
    kept = rule.has_position(lat, lon)
    raw_metrics = raw.agg(
        F.count("*").alias("rows"),
        _how_many(~kept).alias("without_position"),
        (100.0 * _how_many(sog.isNotNull() & rule.speed(sog).isNull()) / F.count("*")).alias(
            "percent_sog_out_of_range"
        ),
        _how_many(rule.message_time("BaseDateTime").isNull()).alias("unparseable_time"),
        _how_many(kept).alias("with_position"),
    )

    def bad(column: str, low: float, high: float) -> Column:
        return F.sum(F.when(~F.col(column).between(low, high), 1).otherwise(0)).alias(f"bad_{column}")

    ranges = [("SOG", *S.SOG_RANGE), ("LAT", *S.LAT_RANGE), ("LON", -180, 180), ("hour", 0, 23)]
    per_key = curated.groupBy(*S.MESSAGE_KEY).agg(
        F.count("*").alias("n"), *[bad(*bounds) for bounds in ranges]
    )
    curated_metrics = per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count("*").alias("distinct_keys"),
        _how_many(F.col("n") > 1).alias("repeated_keys"),
        *[
            F.coalesce(F.sum(f"bad_{column}"), F.lit(0)).alias(f"{column.lower()}_out_of_range")
            for column, _, _ in ranges
        ],
    )
    # One wide row of both stages, then one row per metric: each side is read once.
    wide = _staged(raw_metrics, "raw").unionByName(
        _staged(curated_metrics, "curated"), allowMissingColumns=True
    )
    merged = wide.agg(*[F.max(f"`{c}`").alias(c) for c in wide.columns]).withColumn(
        "curated:duplicates_removed", F.col("raw:with_position") - F.col("curated:rows")
    )
    return merged.unpivot([], merged.columns, "name", "value").select(
        F.split_part("name", F.lit(":"), F.lit(1)).alias("stage"),
        F.split_part("name", F.lit(":"), F.lit(2)).alias("metric"),
        "value",
    )


def _staged(metrics: DataFrame, stage: str) -> DataFrame:
    """Counts as doubles, named after their stage."""
    return metrics.select([F.col(c).cast("double").alias(f"{stage}:{c}") for c in metrics.columns])
