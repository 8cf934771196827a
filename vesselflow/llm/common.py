"""What several operators share: scratch tables, ASCII lower case, row keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vesselflow.session import fresh_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that a task turns into Python strings at once.
SLICE_BYTES = 3 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends here, whatever executor is lost."""
    return stored_at(df, fresh_dir(df.sparkSession, purpose))


def stored_at(df: DataFrame, path: str) -> DataFrame:
    """The same at a place that the caller may remove when nothing reads it any more."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z only; other letters keep their case and code points."""
    return F.translate(column, UPPER, LOWER)


def lower_a_z(text: str) -> str:
    """The same for a Python string."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def text_of(docs: DataFrame, column: str = "text") -> Column:
    """The text; a null one is empty."""
    return F.coalesce(docs[column], F.lit(""))


def slices(batch, column: int, most: int = SLICE_BYTES):
    """Stretches of an Arrow batch with at most about so many bytes in a text column each."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    cuts = (np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1).tolist()
    for start, end in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
        if end > start:
            yield batch.slice(start, end - start)
