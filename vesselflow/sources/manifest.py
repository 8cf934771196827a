"""Files that still have to be fetched (SRC8)."""

from __future__ import annotations

from pyspark.sql import DataFrame


def pending_files(manifest: DataFrame, landed: DataFrame) -> DataFrame:
    """Manifest rows without a landed file of equal name and size.

    An unknown (NULL) or zero size never counts as landed, so it is fetched again.
    """
    complete = landed.where("size > 0").select("name", "size")
    return manifest.join(complete, ["name", "size"], "left_anti")
