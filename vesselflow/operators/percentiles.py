"""Percentiles per group (AG8, AG9), exact by default."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vesselflow.functions import stats

#: Rank errors of a summary by which a bracket reaches beyond the wanted share.
SLACK = 4


def percentiles(
    rows: DataFrame,
    group: Sequence[str],
    value: str,
    wanted: Mapping[str, int],
    parts: int = 100,
    largest: str | None = None,
    accuracy: int | None = None,
    cell_width: float = 1.0,
) -> DataFrame:
    """Values at the shares ``p / parts`` of each group, and its ``largest`` one.

    ``wanted`` maps result names to ``p``: 0 gives the smallest value, ``parts``
    the largest, anything else the first value with at least that share of the
    non-NULL rows up to it.

    No task sees a whole group. Equal values are counted on the map side; the
    distinct values are ranked within cells of ``cell_width``; and the rows before
    each cell come from a running sum over the group's cells, of which there are as
    many as widths in its range (71 for speeds). An ``accuracy`` chooses Spark's
    mergeable summary instead: one pass, a rank error of about n/accuracy, and a
    result that may differ from run to run.
    """
    present = rows.where(F.col(value).isNotNull())
    top = [F.max(value).alias(largest)] if largest else []
    if accuracy is not None:
        approximate = [stats.percentile(value, p / parts, accuracy).alias(n) for n, p in wanted.items()]
        return present.groupBy(*group).agg(*top, *approximate)

    # A NULL group is a group too; text and flag join by plain equality.
    keys = {f"_key{i}": F.coalesce(F.col(g).cast("string"), F.lit("")) for i, g in enumerate(group)}
    flags = {f"_null{i}": F.col(g).isNull() for i, g in enumerate(group)}
    of_group = [*keys, *flags]
    counts = present.groupBy(*group, value).agg(F.count("*").alias("_n"))
    # Stated for both uses of the counts alike: otherwise the join adds it to one of them, and
    # Spark no longer sees that their exchanges are the same.
    in_cells = counts.withColumns({**keys, **flags, "_cell": F.floor(F.col(value) / cell_width)}).where(
        F.col("_cell").isNotNull()
    )

    before = Window.partitionBy(*of_group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        in_cells.groupBy(*of_group, "_cell")
        .agg(F.sum("_n").alias("_in_cell"))
        .withColumns(
            {
                "_before": F.coalesce(F.sum("_in_cell").over(before), F.lit(0)),
                "_total": F.sum("_in_cell").over(Window.partitionBy(*of_group)),
            }
        )
        .drop("_in_cell")
    )
    within = (
        Window.partitionBy(*of_group, "_cell")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = in_cells.withColumn("_rank", F.sum("_n").over(within)).join(cells, [*of_group, "_cell"])
    reached = (F.col("_before") + F.col("_rank")) * parts
    exact = [
        F.min(F.when(reached >= F.col("_total") * int(p), F.col(value))).alias(name)
        for name, p in wanted.items()
    ]
    return ranked.groupBy(*group).agg(*top, *exact)


def selected_percentiles(
    rows: DataFrame,
    group: Sequence[str],
    value: str,
    wanted: Mapping[str, int],
    parts: int = 100,
    largest: str | None = None,
    accuracy: int = 10_000,
) -> DataFrame:
    """The result of :func:`percentiles`, exact, with cells that follow the data.

    A mergeable summary of each group gives, for each wanted share, two values between
    which the answer must lie: the summary's rank error is at most ``rows / accuracy``, so
    the values at the share less and plus a few times that bracket it. One more pass
    counts the rows below each bracket, and only the distinct values inside it, about
    ``2 * SLACK / accuracy`` of a group's rows, are counted and ranked. So no window sees
    more than a sliver of a group, however the values are spread, from 1e-6 to 1e12 or all
    within a hair. A larger ``accuracy`` makes brackets narrower and summaries larger. An
    answer outside of its bracket would be an error, not a wrong value.

    NULL and NaN do not count, a NULL group is a group, one without a value has no row.
    """
    _, counts, of_group = _counts_in_brackets(rows, group, value, wanted, parts, accuracy)
    up_to = (
        Window.partitionBy(*of_group, "_name")
        .orderBy(F.col("_value").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # Rows short of the target stay, so a group whose answers are all missing has a row, too.
    reached = F.col("_rank") >= F.col("_target")
    ranked = counts.withColumn("_rank", F.sum("_n").over(up_to))
    missed = F.raise_error(F.lit("an answer lies outside of its bracket")).cast(rows.schema[value].dataType)
    found = ranked.groupBy(*of_group, "_name").agg(
        F.min(F.when(reached, F.col("_value"))).alias("_value"),
        F.count_if(reached & F.col("_value").isNull()).alias("_below"),
    )
    chosen = found.groupBy(*of_group).agg(
        F.sum("_below").alias("_below"),
        *[F.min(F.when(F.col("_name") == n, F.col("_value"))).alias(n) for n in wanted],
    )
    sure = [
        F.when((F.col("_below") > 0) | F.col(n).isNull(), missed).otherwise(F.col(n)).alias(n) for n in wanted
    ]
    top = [F.col("_most").alias(largest)] if largest else []
    return chosen.select(*group, *top, *sure)


def _counts_in_brackets(rows, group, value, wanted, parts, accuracy):
    """Per group its extremes; per group and bracket the rows below (value NULL) and the values inside.

    The group and its largest value come along with the counts: joined to them again, the
    brackets would be computed twice, with one more read of the rows."""
    present = rows.where(F.col(value).isNotNull() & ~F.isnan(value))
    names = list(wanted)
    # A NULL group joins by plain equality as text and flag.
    keys = {f"_key{i}": F.coalesce(F.col(g).cast("string"), F.lit("")) for i, g in enumerate(group)}
    flags = {f"_null{i}": F.col(g).isNull() for i, g in enumerate(group)}
    joined_by = [*keys, *flags]
    of_group = [*group, "_most"]
    slack = SLACK / accuracy
    ends = [
        end
        for p in wanted.values()
        for end in (max(0.0, p / parts - slack), min(1.0, p / parts + slack))
    ]
    brackets = present.groupBy(*group).agg(
        F.count("*").alias("_total"),
        F.percentile_approx(value, ends, accuracy).alias("_ends"),
        F.min(value).alias("_least"),
        F.max(value).alias("_most"),
    ).withColumns({**keys, **flags})
    # The outermost shares are bracketed by the extremes themselves.
    low = [F.col("_least") if p * accuracy <= SLACK * parts else F.col("_ends")[2 * i] for i, p in enumerate(wanted.values())]
    high = [
        F.col("_most") if (parts - p) * accuracy <= SLACK * parts else F.col("_ends")[2 * i + 1]
        for i, p in enumerate(wanted.values())
    ]
    target = [F.greatest(F.expr(f"(_total * {int(p)} + {parts - 1}) div {parts}"), F.lit(1)) for p in wanted.values()]
    bounds = F.array(
        *[
            F.struct(F.lit(n).alias("name"), lo.alias("low"), hi.alias("high"), t.alias("target"))
            for n, lo, hi, t in zip(names, low, high, target, strict=True)
        ]
    )
    bracketed = brackets.select(*joined_by, "_most", bounds.alias("_bounds"))
    met = present.withColumns({**keys, **flags}).join(bracketed, joined_by)
    # Filtered as rows: a filter of the array would be run uncompiled for each row.
    marked = met.select(*of_group, F.col(value).alias("_value"), F.explode("_bounds").alias("_b")).where(
        F.col("_value") <= F.col("_b.high")
    )
    # Rows below a bracket are only counted, under one value of NULL.
    inside = F.when(F.col("_value") >= F.col("_b.low"), F.col("_value"))
    counts = marked.groupBy(*of_group, F.col("_b.name").alias("_name"), F.col("_b.target").alias("_target"), inside.alias("_value")).agg(
        F.count("*").alias("_n")
    )
    return brackets, counts, of_group
