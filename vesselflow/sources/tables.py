"""Making sure that a published table exists (PUB1)."""

from __future__ import annotations

import re
import uuid
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from vesselflow.schema import COMPRESSION_SUFFIXES, SOURCE_FORMATS

FIELD_TYPES = {
    "STRING": T.StringType(),
    "BYTES": T.BinaryType(),
    "INTEGER": T.LongType(),
    "INT64": T.LongType(),
    "FLOAT": T.DoubleType(),
    "FLOAT64": T.DoubleType(),
    "NUMERIC": T.DecimalType(38, 9),
    "BIGNUMERIC": T.DecimalType(38, 18),
    "BOOLEAN": T.BooleanType(),
    "BOOL": T.BooleanType(),
    "TIMESTAMP": T.TimestampType(),
    "DATETIME": T.TimestampNTZType(),
    "DATE": T.DateType(),
    "TIME": T.StringType(),
    "GEOGRAPHY": T.StringType(),
    "JSON": T.StringType(),
}
NESTED_TYPES = ("RECORD", "STRUCT")


def schema_from_spec(spec: list[dict[str, Any]]) -> T.StructType:
    """Schema from a list of ``{"name", "type", "mode", "fields"}``."""
    return T.StructType([_field(entry) for entry in spec])


def _field(entry: dict[str, Any]) -> T.StructField:
    kind = entry["type"].upper()
    mode = (entry.get("mode") or "NULLABLE").upper()
    if kind in NESTED_TYPES:
        data_type: T.DataType = schema_from_spec(entry.get("fields") or [])
    elif kind in FIELD_TYPES:
        data_type = FIELD_TYPES[kind]
    else:
        raise ValueError(f"unknown type {entry['type']!r} of field {entry['name']!r}")
    if mode == "REPEATED":
        data_type = T.ArrayType(data_type)
    return T.StructField(entry["name"], data_type, nullable=mode != "REQUIRED")


_EXTENSION = re.compile(
    rf"\.({'|'.join(sorted(set(SOURCE_FORMATS.values())))})(?:{'|'.join(map(re.escape, COMPRESSION_SUFFIXES))})?$",
    re.IGNORECASE,
)


def format_from_name(path: str) -> str | None:
    """The format that the path's extension names, a compression suffix aside."""
    found = _EXTENSION.search(path)
    return found[1].lower() if found else None


def read_sample(spark: SparkSession, path: str, source_format: str | None = None) -> DataFrame:
    """Files of a given format, or of the one their name tells, with the schema found in them.

    ValueError if the format is not known: bytes of any kind pass for CSV rows."""
    chosen = SOURCE_FORMATS.get(source_format.upper()) if source_format else format_from_name(path)
    if chosen is None:
        raise ValueError(f"the format of {path} is not known; one of {', '.join(SOURCE_FORMATS)} is needed")
    reader = spark.read.format(chosen)
    if chosen == "csv":
        reader = reader.option("header", "true").option("inferSchema", "true")
    return reader.load(path)


def _write_then_name(spark: SparkSession, rows: DataFrame, name: str) -> None:
    """Write a table under a name of its own and give it the final one in one step of the catalogue."""
    closing = "`" if name.endswith("`") else ""
    draft = f"{name.removesuffix('`')}_{uuid.uuid4().hex}{closing}"
    try:
        rows.write.format("parquet").mode("errorifexists").saveAsTable(draft)
        spark.sql(f"ALTER TABLE {draft} RENAME TO {name}")
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {draft}")
        raise


def publish_table(
    spark: SparkSession,
    name: str,
    schema: list[dict[str, Any]] | None = None,
    sample: str | None = None,
    source_format: str | None = None,
) -> dict[str, Any]:
    """PUB1: create the table unless it exists, and say what was done.

    With a schema the table is created empty. Without one it takes schema **and**
    rows of the sample files, which are written under another name first: the table
    appears with all its rows or not at all. Failures are reported, not raised.
    """
    if not name:
        return {"ok": False, "error": "a table name is required"}
    if spark.catalog.tableExists(name):
        return {"ok": True, "exists": True, "action": "none", "table": name}
    missing = {"exists": False, "table": name}
    try:
        if schema:
            spark.catalog.createTable(name, schema=schema_from_spec(schema), source="parquet")
            return {"ok": True, **missing, "action": "created"}
        if not sample:
            return {
                "ok": False,
                **missing,
                "action": "skipped",
                "error": "the table does not exist; give a schema or sample files",
            }
        _write_then_name(spark, read_sample(spark, sample, source_format), name)
        return {"ok": True, **missing, "action": "created (autodetect)", "autodetect_from": sample}
    except Exception as error:  # noqa: BLE001 - the outcome is part of the contract
        if isinstance(error, AnalysisException) and error.getCondition() == "TABLE_OR_VIEW_ALREADY_EXISTS":
            return {"ok": True, "exists": True, "action": "none (race)", "table": name}
        return {"ok": False, **missing, "action": "failed", "error": str(error)}
