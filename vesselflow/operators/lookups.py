"""Dimension lookups (JN1, CUR16, CUR17)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vesselflow.functions import cleaning
from vesselflow.schema import NAV_STATUS_NAMES


def status_catalogue(spark: SparkSession) -> DataFrame:
    """Navigation-status code list as a table of eleven rows."""
    entries = [F.lit(part) for code, name in NAV_STATUS_NAMES.items() for part in (code, name)]
    return spark.range(0, 1, 1, 1).select(
        F.explode(F.create_map(*entries)).alias("NavStatusInt", "NavStatusName")
    )


def with_status_name(messages: DataFrame, status: str = "Status") -> DataFrame:
    """JN1: left join with the status catalogue.

    The hint is safe: the broadcast side is the fixed eleven-entry code list.
    """
    coded = messages.withColumn("NavStatusInt", cleaning.nav_status_int(status))
    named = coded.join(F.broadcast(status_catalogue(messages.sparkSession)), "NavStatusInt", "left")
    return named.withColumn("NavStatusName", cleaning.nav_status_name("NavStatusInt", "NavStatusName"))
