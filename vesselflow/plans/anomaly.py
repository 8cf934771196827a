"""Anomalies in hourly or daily series (AN18-AN20).

The model is a seasonal mean with a first-order autoregressive residual, fitted
with built-in aggregates; it takes the place of a warehouse's forecasting model.
Input and output columns are those of that service, the numbers are not.

A series has one point per hour or day, so its length is bounded by the time
covered, whatever the number of messages behind it; windows per series are safe.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import date
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vesselflow.functions.stats import erf
from vesselflow.operators.series import UNITS, checked, slot, time_series
from vesselflow.sources.storage import list_files, path_exists, remove_tree

Day = date | str | None
PHI_LIMIT = 0.99


#: What a model was trained for; stored with it and compared before it is used.
SETTINGS = ("metric", "id_col", "freq", "precision")


def model_name(metric: str, id_col: str, freq: str, precision: int | None = None) -> str:
    """Name of a stored model: its settings, joined by underscores."""
    shortened = "" if precision is None else f" p{precision}"
    return re.sub(r"\W", "_", f"anomaly {metric} {id_col} {freq}{shortened}".lower())


def _follows(freq: str, in_time) -> Column:
    """The row before is the hour or day before: over a gap nothing is carried."""
    return F.timestamp_add(UNITS[freq.upper()], F.lit(1), F.lag("ts_col").over(in_time)) == F.col("ts_col")


def fit(
    series: DataFrame, freq: str, horizon: int | None = None, min_slot: int = 2, min_points: int = 1
) -> DataFrame:
    """One row of coefficients per series.

    ``slot_means`` maps hour of day (or weekday) to its mean; slots with fewer
    than ``min_slot`` points use the mean of the series. ``phi`` is the
    autoregressive coefficient of the residuals and ``sigma`` the spread of what
    it leaves unexplained.
    """
    whole = Window.partitionBy("series_id")
    by_slot = Window.partitionBy("series_id", "slot")
    in_time = whole.orderBy("ts_col")
    means = series.withColumn("slot", slot(freq)).withColumns(
        {
            "series_mean": F.avg("value").over(whole),
            "slot_mean": F.when(F.count("value").over(by_slot) >= min_slot, F.avg("value").over(by_slot)),
        }
    )
    expected = F.coalesce("slot_mean", "series_mean")
    residuals = (
        means.withColumn("mean", expected)
        .withColumn("r", F.col("value") - F.col("mean"))
        .withColumn("prev_r", F.when(_follows(freq, in_time), F.lag("r").over(in_time)))
    )
    paired_prev = F.when(F.col("r").isNotNull(), F.col("prev_r"))
    variance = F.var_pop(paired_prev).over(whole)
    slope = F.try_divide(F.covar_pop("r", "prev_r").over(whole), F.when(variance > 0, variance))
    phi = F.greatest(F.least(F.coalesce(slope, F.lit(0.0)), F.lit(PHI_LIMIT)), F.lit(-PHI_LIMIT))
    shocks = residuals.withColumn("phi", phi).withColumn("shock", F.col("r") - F.col("phi") * F.col("prev_r"))
    coefficients = shocks.groupBy("series_id").agg(
        F.map_from_entries(F.collect_set(F.struct("slot", "mean"))).alias("slot_means"),
        F.max("series_mean").alias("series_mean"),
        F.max("phi").alias("phi"),
        F.stddev_samp("shock").alias("sigma"),
        F.count("value").alias("n"),
        F.max_by("r", "ts_col").alias("last_residual"),
        F.max("ts_col").alias("last_ts"),
    )
    steps = F.lit(None).cast("int") if horizon is None else F.lit(int(horizon))
    return coefficients.where(F.col("n") >= min_points).withColumn("horizon", steps)


def train_anomaly(
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
    fill: bool = False,
) -> DataFrame:
    """AN19: coefficients and settings per series, to be kept with :func:`save_model`.

    ``fill`` counts hours or days without messages as 0, so that an outage is a point."""
    series = time_series(messages, start, end, vessel_types, metric, freq, id_col, precision, fill)
    metric, freq = checked(metric, freq)
    return with_settings(fit(series, freq, horizon, min_slot, min_points), metric, id_col, freq, precision)


def with_settings(model: DataFrame, *settings) -> DataFrame:
    """The model with its settings as columns, whose metadata tells them without a job, also
    after the model was stored."""
    columns = [
        F.lit(value).cast("int" if name == "precision" else "string").alias(name, metadata={"setting": value})
        for name, value in zip(SETTINGS, settings, strict=True)
    ]
    return model.select("*", *columns)


def _settings_of(model: DataFrame) -> list[tuple]:
    """The settings in a model; rows are asked only if the schema does not tell."""
    notes = [model.schema[name].metadata for name in SETTINGS]
    if all("setting" in note for note in notes):
        return [tuple(note["setting"] for note in notes)]
    return [tuple(row) for row in model.select(*SETTINGS).distinct().limit(2).collect()]


def require_settings(model: DataFrame, metric: str, freq: str, id_col: str, precision: int | None) -> None:
    """ValueError unless the model was trained for these settings."""
    metric, freq = checked(metric, freq)
    wanted = (metric, id_col, freq, precision)
    missing = [c for c in SETTINGS if c not in model.columns]
    if missing:
        raise ValueError(f"the model does not tell its {', '.join(missing)}")
    for found in _settings_of(model):
        if found != wanted:
            raise ValueError(f"the model is for {dict(zip(SETTINGS, found))}, not {dict(zip(SETTINGS, wanted))}")


def save_model(
    model: DataFrame, base: str, metric: str, id_col: str, freq: str, precision: int | None = None
) -> str:
    """Store a model in place of an older one with the same settings.

    Each is a version of its own; older ones go when the new one is complete."""
    metric, freq = checked(metric, freq)
    path = f"{base.rstrip('/')}/{model_name(metric, id_col, freq, precision)}"
    save_version(model, path)
    return path


def save_version(rows: DataFrame, path: str) -> str:
    """Write a new version of a small table and then remove the older ones; returns its folder."""
    spark = rows.sparkSession
    older = _versions(spark, path)
    version = (int(older[-1].rsplit("=", 1)[-1]) if older else 0) + 1
    written = f"{path}/version={version:09d}"
    rows.write.mode("overwrite").parquet(written)
    for old in older:
        remove_tree(spark, old)
    return written


def load_version(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest complete version, if there is any."""
    versions = _versions(spark, path)
    return spark.read.parquet(versions[-1]) if versions else None


def load_model(
    spark: SparkSession, base: str, metric: str, id_col: str, freq: str, precision: int | None = None
) -> DataFrame:
    """The newest complete version of a model; FileNotFoundError without one."""
    metric, freq = checked(metric, freq)
    path = f"{base.rstrip('/')}/{model_name(metric, id_col, freq, precision)}"
    model = load_version(spark, path)
    if model is None:
        raise FileNotFoundError(f"no model in {path}")
    return model


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Complete versions, oldest first."""
    if not path_exists(spark, path):
        return []
    return sorted(f.rsplit("/", 1)[0] for f, _ in list_files(spark, path) if f.endswith("/_SUCCESS"))


# A NULL id is a series of its own. With these two columns it joins by plain
# equality, and the window after the join needs no further shuffle.
SERIES_KEY = ["_key", "_without_id"]


def _keyed(rows: DataFrame) -> DataFrame:
    series_id = F.col("series_id")
    return rows.withColumns(
        {"_key": F.coalesce(series_id.cast("string"), F.lit("")), "_without_id": series_id.isNull()}
    )


def score(series: DataFrame, model: DataFrame, freq: str, threshold: float = 0.95) -> DataFrame:
    """JN6: series points against their model; NULL where there is nothing to say.

    The residual before a point is that of the hour or day before; for the first one
    that may be the last of the training range. Over a gap it is 0.
    """
    if not 0 < threshold < 1:
        raise ValueError("the threshold must lie between 0 and 1")
    known = _keyed(model).drop("series_id", "n", *SETTINGS)
    looked_up = _keyed(series).join(known, SERIES_KEY, "left").withColumn(
        "mean", F.coalesce(F.col("slot_means")[slot(freq)], F.col("series_mean"))
    )
    in_time = Window.partitionBy(*SERIES_KEY).orderBy("ts_col")
    next_to_training = F.timestamp_add(UNITS[freq.upper()], F.lit(1), F.col("last_ts")) == F.col("ts_col")
    carried_over = F.when(next_to_training, F.col("last_residual"))
    before = F.when(_follows(freq, in_time), F.lag(F.col("value") - F.col("mean")).over(in_time))
    previous = F.coalesce(before, carried_over, F.lit(0.0))
    reach = F.timestamp_add(UNITS[freq.upper()], F.coalesce("horizon", F.lit(0)), F.col("last_ts"))
    in_reach = F.col("horizon").isNull() | (F.col("ts_col") <= reach)
    usable: Column = (F.col("sigma") > 0) & in_reach
    quantile = NormalDist().inv_cdf((1 + threshold) / 2)
    predicted = looked_up.withColumn("predicted", F.col("mean") + F.col("phi") * previous).withColumn(
        "spread", F.when(usable, F.col("sigma"))
    )
    deviation = F.abs(F.col("value") - F.col("predicted")) / F.col("spread")
    result = predicted.withColumn("anomaly_probability", erf(deviation / 2**0.5))
    return result.select(
        "series_id",
        "ts_col",
        "value",
        (F.col("anomaly_probability") > threshold).alias("is_anomaly"),
        "anomaly_probability",
        (F.col("predicted") - F.col("spread") * quantile).alias("lower_bound"),
        (F.col("predicted") + F.col("spread") * quantile).alias("upper_bound"),
    )


def detect_anomalies(
    messages: DataFrame,
    model: DataFrame,
    start: Day,
    end: Day,
    vessel_types: Iterable | None = None,
    metric: str = "count",
    freq: str = "HOURLY",
    id_col: str = "geohash9",
    threshold: float = 0.95,
    precision: int | None = None,
    fill: bool = False,
) -> DataFrame:
    """AN20: points with probability and bounds, most unusual first.

    ValueError if the model was trained for another metric, id, frequency or precision."""
    require_settings(model, metric, freq, id_col, precision)
    series = time_series(messages, start, end, vessel_types, metric, freq, id_col, precision, fill)
    scored = score(series, model, freq, threshold)
    return scored.orderBy(F.col("anomaly_probability").desc_nulls_last(), "series_id", "ts_col")
