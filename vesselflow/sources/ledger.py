"""What an ingest has finished, kept so that a killed one goes on where it stopped.

The ledger is a folder of small files, each written in one step after the work that it
speaks of is complete: one per batch of archives, with a line per archive, and one per
month that was published. Nothing is ever changed in place. A batch without its file has
not happened: its half-written rows lie in a folder that no file names, and it is done anew.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vesselflow.sources.storage import path_exists, remove_tree, write_text

ARCHIVE_SCHEMA = (
    "staged string, source string, bytes bigint, modified bigint, members bigint, text_bytes bigint"
)
MONTH_SCHEMA = "ym string, staged array<string>"


class ChangedArchive(RuntimeError):
    """An archive is no longer the one whose rows were staged."""


@dataclass
class Ledger:
    spark: SparkSession
    base: str

    def _folder(self, kind: str) -> str:
        return f"{self.base.rstrip('/')}/{kind}"

    def _read(self, kind: str, schema: str) -> DataFrame:
        folder = self._folder(kind)
        if not path_exists(self.spark, folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("pathGlobFilter", "*.json").json(folder)

    def archives(self) -> DataFrame:
        """One row per archive whose messages are staged."""
        return self._read("batches", ARCHIVE_SCHEMA)

    def batches(self) -> list[str]:
        """Folders with the messages of the finished batches; empty for one without a CSV file."""
        return [r.staged for r in self.archives().select("staged").distinct().collect()]

    def staged(self, folders: list[str]) -> DataFrame:
        """The messages below some of the folders."""
        rows = self.spark.read.option("basePath", self._folder("staged")).parquet(*folders).drop("batch")
        return rows.withColumn("ym", F.col("ym").cast("string"))

    def published(self) -> dict[str, set[str]]:
        """Per month the folders that it was last written from; they only ever get more."""
        found: dict[str, set[str]] = {}
        for row in self._read("months", MONTH_SCHEMA).collect():
            found[row.ym] = max(found.get(row.ym, set()), set(row.staged), key=len)
        return found

    def new_batch(self) -> str:
        """Folder of a batch that is about to be staged."""
        return f"{self._folder('staged')}/batch=b{uuid.uuid4().hex}"

    def commit_batch(self, staged: str, has_rows: bool, archives: Iterable[dict]) -> None:
        lines = [json.dumps({"staged": staged if has_rows else "", **a}) for a in archives]
        name = staged.rsplit("=", 1)[-1]
        write_text(self.spark, f"{self._folder('batches')}/{name}.json", "\n".join(lines) + "\n")

    def commit_month(self, ym: str, folders: Iterable[str]) -> None:
        text = json.dumps({"ym": ym, "staged": sorted(folders)})
        write_text(self.spark, f"{self._folder('months')}/{ym}-{uuid.uuid4().hex}.json", text + "\n")

    def pending(self, listed: DataFrame) -> DataFrame:
        """Archives of ``listed`` (source, bytes, modified) that are not staged yet.

        One that was staged with another size or time is an error: its old rows are among
        the staged ones, so another ledger has to begin."""
        staged = self.archives().select("source", F.col("bytes").alias("_bytes"), F.col("modified").alias("_modified"))
        met = listed.join(staged, "source", "left")
        changed = met.where("_bytes <> bytes or _modified <> modified").select("source").limit(20).collect()
        if changed:
            raise ChangedArchive(f"changed since they were staged: {', '.join(sorted(r.source for r in changed))}")
        return met.where("_bytes is null").select(*listed.columns)

    def close(self) -> None:
        """Remove the ledger and the staged messages, when no more archives are to come."""
        remove_tree(self.spark, self.base)
