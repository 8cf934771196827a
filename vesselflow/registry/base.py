"""How a registered query is described.

``shape`` lists the output columns of both sides. A prefix says how a value is
made comparable: ``f:`` rounds a floating-point number to six digits, ``t:``
writes a time or date as text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vesselflow.fixture import raw_messages
from vesselflow.operators.curation import curate
from vesselflow.registry import fixture_files
from vesselflow.session import fresh_dir, use_utc
from vesselflow.sources.messages import read_months, write_curated
from vesselflow.sources.storage import path_exists

DIGITS = 6
# Keeps means with few decimals off the rounding borders, where the last bit of a
# sum, which depends on the order of its terms, would decide.
OFFSET = 1.23e-8
_CURATED_TABLES: dict[tuple[str, str], str] = {}


@dataclass
class Context:
    """Inputs of a query: the session and the folder of the given tables."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def raw(self) -> DataFrame:
        """Raw messages derived from all events."""
        return raw_messages(self.spark, self.sf_dir)

    @cached_property
    def curated(self) -> DataFrame:
        """The curated table, written once per session by month, as analyses read it."""
        return self.spark.read.parquet(self.curated_base).withColumn("ym", F.col("ym").cast("string"))

    @cached_property
    def curated_base(self) -> str:
        """The folder of that table."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if key not in _CURATED_TABLES or not path_exists(self.spark, _CURATED_TABLES[key]):
            path = fresh_dir(self.spark, "curated")
            write_curated(curate(self.raw), path)
            _CURATED_TABLES[key] = path
        return _CURATED_TABLES[key]

    def fresh_dir(self, purpose: str) -> str:
        return fresh_dir(self.spark, purpose)

    def csv_files(self) -> str:
        return fixture_files.write_csv(self.raw, self.fresh_dir("csv"))

    def zip_files(self) -> str:
        return fixture_files.write_archives(self.spark, self.csv_files(), self.fresh_dir("zip"))

    def months(self, base: str) -> DataFrame:
        """All months of a month-partitioned folder."""
        names = [r.ym for r in self.raw_months().collect()]
        return read_months(self.spark, base, names)

    def raw_months(self) -> DataFrame:
        return self.raw.select(F.substring("BaseDateTime", 1, 7).alias("ym")).distinct()


@dataclass
class Query:
    build: Callable[[Context], DataFrame]
    shape: str
    sql: str | None = None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = self.build(Context(use_utc(spark), sf_dir))
        return rows.select(*[_spark_column(c) for c in self.shape.split()])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        columns = ", ".join(_sql_column(c) for c in self.shape.split())
        return f"SELECT {columns} FROM ({self.sql}) AS result"


def _spark_column(entry: str):
    kind, _, name = entry.rpartition(":")
    if kind == "f":
        return (F.round(F.col(name).cast("double") + OFFSET, DIGITS) + 0.0).alias(name)
    return F.col(name).cast("string").alias(name) if kind == "t" else F.col(name)


def _sql_column(entry: str) -> str:
    kind, _, name = entry.rpartition(":")
    if kind == "f":
        return f'round(CAST("{name}" AS DOUBLE) + {OFFSET}, {DIGITS}) + 0.0 AS "{name}"'
    return f'CAST("{name}" AS VARCHAR) AS "{name}"' if kind == "t" else f'"{name}"'


def all_queries() -> dict[str, Query]:
    from vesselflow.registry import analyses, cleaning, functions, operators, sources

    return {
        **sources.QUERIES,
        **cleaning.QUERIES,
        **functions.QUERIES,
        **operators.QUERIES,
        **analyses.QUERIES,
    }
