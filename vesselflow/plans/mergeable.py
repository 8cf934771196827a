"""Anomaly models that a new month updates, without a look at the months before (AN19).

What a model needs of a stretch of time fits into a few numbers per series and slot: counts
and means of the values, and means, squared deviations and their product of each point and
the one before. Such numbers of stretches that do not overlap add up; only the pair across a
border is missing, so the first and last point of each series are kept, too. The result
equals :func:`vesselflow.plans.anomaly.fit` on all stretches together.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vesselflow.operators.series import UNITS, checked, slot, time_series
from vesselflow.plans.anomaly import (
    PHI_LIMIT,
    Day,
    load_model,
    load_version,
    model_name,
    save_model,
    save_version,
    with_settings,
)

#: Per series and slot: values; pairs of a value and the one an hour or day before.
MOMENTS = ["n", "mean", "pairs", "now", "before", "now_2", "before_2", "product"]
EDGES = ["first_ts", "first_value", "last_ts", "last_value"]
SLOTS = {"HOURLY": 24, "DAILY": 7}
#: A variance below this share of the squared mean is rounding.
NO_VARIANCE = 1e-24


def _next(freq: str, ts) -> Column:
    return F.timestamp_add(UNITS[freq.upper()], F.lit(1), ts)


def _or_zero(column) -> Column:
    return F.coalesce(column, F.lit(0.0))


def statistics(series: DataFrame, freq: str) -> DataFrame:
    """One row per series and slot for ``series_id, ts_col, value`` of one stretch of time."""
    whole = Window.partitionBy("series_id")
    in_time = whole.orderBy("ts_col")
    follows = _next(freq, F.lag("ts_col").over(in_time)) == F.col("ts_col")
    value = F.col("value").cast("double")
    points = series.select("series_id", "ts_col", value.alias("value")).withColumns(
        {
            "slot": slot(freq),
            "previous": F.when(follows, F.lag("value").over(in_time)),
            "first_ts": F.min("ts_col").over(whole),
            "first_value": F.min_by("value", "ts_col").over(whole),
            "last_ts": F.max("ts_col").over(whole),
            "last_value": F.max_by("value", "ts_col").over(whole),
        }
    )
    paired = F.col("value").isNotNull() & F.col("previous").isNotNull()
    now, before = F.when(paired, F.col("value")), F.when(paired, F.col("previous"))
    pairs = F.count(now)
    return points.groupBy("series_id", "slot").agg(
        F.count("value").alias("n"),
        _or_zero(F.avg("value")).alias("mean"),
        pairs.alias("pairs"),
        _or_zero(F.avg(now)).alias("now"),
        _or_zero(F.avg(before)).alias("before"),
        _or_zero(F.var_pop(now) * pairs).alias("now_2"),
        _or_zero(F.var_pop(before) * pairs).alias("before_2"),
        _or_zero(F.covar_pop(now, before) * pairs).alias("product"),
        *[F.any_value(c).alias(c) for c in EDGES],
    )


def _border_pairs(parts: DataFrame, freq: str) -> DataFrame:
    """The pairs of a part's last point and the next part's first one, as statistics."""
    ends = parts.select("series_id", *EDGES).distinct()
    in_time = Window.partitionBy("series_id").orderBy("first_ts")
    met = ends.withColumns(
        {"_ts": F.lag("last_ts").over(in_time), "_value": F.lag("last_value").over(in_time)}
    )
    message = F.lit("parts of one series overlap in time")
    apart = F.when(F.col("_ts") >= F.col("first_ts"), F.raise_error(message).cast("boolean")).otherwise(
        _next(freq, F.col("_ts")) == F.col("first_ts")
    )
    touching = met.where(apart & F.col("_value").isNotNull() & F.col("first_value").isNotNull())
    zero = F.lit(0.0)
    return touching.select(
        "series_id",
        slot(freq, "first_ts").alias("slot"),
        F.lit(0).cast("long").alias("n"),
        zero.alias("mean"),
        F.lit(1).cast("long").alias("pairs"),
        F.col("first_value").alias("now"),
        F.col("_value").alias("before"),
        *[zero.alias(c) for c in MOMENTS[5:]],
        *EDGES,
    )


def merge(first: DataFrame, *others: DataFrame, freq: str) -> DataFrame:
    """Statistics of several stretches as those of all together.

    The stretches may come in any order but must not overlap in a series (an error). There
    is a row per series, slot and stretch, so the windows are as small as the number of
    stretches that are merged at once."""
    parts = first
    for other in others:
        parts = parts.unionByName(other)
    rows = parts.unionByName(_border_pairs(parts, freq))
    same = Window.partitionBy("series_id", "slot")
    weight = F.col("pairs")
    centre = {c: _or_zero(F.try_divide(F.sum(weight * F.col(c)).over(same), F.sum(weight).over(same))) for c in ("now", "before")}
    centred = rows.withColumns({f"_{c}": mean for c, mean in centre.items()})
    off = {c: F.col(c) - F.col(f"_{c}") for c in centre}
    per_slot = centred.groupBy("series_id", "slot").agg(
        F.sum("n").alias("n"),
        _or_zero(F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n"))).alias("mean"),
        F.sum(weight).alias("pairs"),
        F.any_value("_now").alias("now"),
        F.any_value("_before").alias("before"),
        F.sum(F.col("now_2") + weight * off["now"] * off["now"]).alias("now_2"),
        F.sum(F.col("before_2") + weight * off["before"] * off["before"]).alias("before_2"),
        F.sum(F.col("product") + weight * off["now"] * off["before"]).alias("product"),
        F.min("first_ts").alias("_first"),
        F.min_by("first_value", "first_ts").alias("first_value"),
        F.max("last_ts").alias("_last"),
        F.max_by("last_value", "last_ts").alias("last_value"),
    )
    # A slot need not occur in every stretch, so the ends are settled over the whole series.
    whole = Window.partitionBy("series_id")
    return per_slot.select(
        "series_id",
        "slot",
        *MOMENTS,
        F.min("_first").over(whole).alias("first_ts"),
        F.min_by("first_value", "_first").over(whole).alias("first_value"),
        F.max("_last").over(whole).alias("last_ts"),
        F.max_by("last_value", "_last").over(whole).alias("last_value"),
    )


def coefficients(
    stats: DataFrame, freq: str, horizon: int | None = None, min_slot: int = 2, min_points: int = 1
) -> DataFrame:
    """The rows of :func:`anomaly.fit` from statistics."""
    slots = SLOTS[freq.upper()]
    whole = Window.partitionBy("series_id")
    points = F.sum("n").over(whole)
    mean = F.try_divide(F.sum(F.col("n") * F.col("mean")).over(whole), points)
    expected = F.when(F.col("n") >= min_slot, F.col("mean")).otherwise(F.col("series_mean"))
    rows = stats.withColumn("series_mean", mean).withColumn("m", expected)
    series = rows.groupBy("series_id").agg(
        F.map_from_entries(F.collect_list(F.struct("slot", "m"))).alias("slot_means"),
        F.any_value("series_mean").alias("series_mean"),
        F.sum("n").alias("n"),
        F.sum("pairs").alias("pairs"),
        F.filter(F.collect_list(F.struct("slot", *MOMENTS)), lambda s: s["pairs"] > 0).alias("slots"),
        *[F.any_value(c).alias(c) for c in EDGES[2:]],
    )

    def over_slots(term) -> Column:
        return F.aggregate("slots", F.lit(0.0), lambda total, s: total + term(s))

    def residual(s) -> Column:
        return s["now"] - F.col("slot_means")[s["slot"]]

    def residual_before(s) -> Column:
        return s["before"] - F.col("slot_means")[(s["slot"] + (slots - 1)) % slots]

    means = series.withColumns(
        {
            "_r": F.try_divide(over_slots(lambda s: s["pairs"] * residual(s)), F.col("pairs")),
            "_p": F.try_divide(over_slots(lambda s: s["pairs"] * residual_before(s)), F.col("pairs")),
        }
    )

    def off_r(s) -> Column:
        return residual(s) - F.col("_r")

    def off_p(s) -> Column:
        return residual_before(s) - F.col("_p")

    spread = means.withColumns(
        {
            "_rr": over_slots(lambda s: s["now_2"] + s["pairs"] * off_r(s) * off_r(s)),
            "_pp": over_slots(lambda s: s["before_2"] + s["pairs"] * off_p(s) * off_p(s)),
            "_rp": over_slots(lambda s: s["product"] + s["pairs"] * off_r(s) * off_p(s)),
        }
    )
    varies = F.col("_pp") > NO_VARIANCE * F.col("pairs") * F.greatest(F.col("series_mean") * F.col("series_mean"), F.lit(0.0))
    slope = F.try_divide(F.col("_rp"), F.when(varies, F.col("_pp")))
    phi = F.greatest(F.least(F.coalesce(slope, F.lit(0.0)), F.lit(PHI_LIMIT)), F.lit(-PHI_LIMIT))
    unexplained = F.col("_rr") - 2 * F.col("phi") * F.col("_rp") + F.col("phi") * F.col("phi") * F.col("_pp")
    sigma = F.when(F.col("pairs") > 1, F.sqrt(F.greatest(unexplained, F.lit(0.0)) / (F.col("pairs") - 1)))
    steps = F.lit(None).cast("int") if horizon is None else F.lit(int(horizon))
    last_mean = F.col("slot_means")[slot(freq, "last_ts")]
    return spread.withColumn("phi", phi).where(F.col("n") >= min_points).select(
        "series_id",
        "slot_means",
        "series_mean",
        "phi",
        sigma.alias("sigma"),
        "n",
        (F.col("last_value") - last_mean).alias("last_residual"),
        "last_ts",
        steps.alias("horizon"),
    )


def update_anomaly(
    spark: SparkSession,
    base: str,
    messages: DataFrame,
    start: Day,
    end: Day,
    vessel_types: Iterable | None = None,
    metric: str = "count",
    freq: str = "HOURLY",
    id_col: str = "geohash9",
    horizon: int | None = None,
    min_slot: int = 2,
    min_points: int = 1,
    precision: int | None = None,
) -> DataFrame:
    """Add the days from ``start`` to ``end`` to a stored model, or begin one; returns it as stored.

    Only messages of these days are read. The statistics are kept beside the model, each
    update as a new version that replaces the older one when it is complete; the days must
    not have been added before (an error)."""
    metric, freq = checked(metric, freq)
    series = time_series(messages, start, end, vessel_types, metric, freq, id_col, precision)
    added = statistics(series, freq)
    folder = f"{base.rstrip('/')}/{model_name(metric, id_col, freq, precision)}_statistics"
    known = load_version(spark, folder)
    stored = save_version(added if known is None else merge(known, added, freq=freq), folder)
    model = coefficients(spark.read.parquet(stored), freq, horizon, min_slot, min_points)
    save_model(with_settings(model, metric, id_col, freq, precision), base, metric, id_col, freq, precision)
    return load_model(spark, base, metric, id_col, freq, precision)
