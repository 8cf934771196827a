"""Listing, existence checks and success markers on any Hadoop file system."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _file_system(spark, path)
    return fs.exists(hadoop_path)


def list_files(spark: SparkSession, root: str, recursive: bool = True) -> list[tuple[str, int]]:
    """(path, bytes) of the files below ``root``, also of those that Spark's readers skip
    because their names begin with ``_`` or ``.``."""
    return [(path, size) for path, size, _ in list_states(spark, root, recursive)]


def list_states(spark: SparkSession, root: str, recursive: bool = True) -> list[tuple[str, int, int]]:
    """(path, bytes, time of the last change in milliseconds) of the files below ``root``."""
    fs, hadoop_path = _file_system(spark, root)
    files, found = fs.listFiles(hadoop_path, recursive), []
    while files.hasNext():
        status = files.next()
        found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return sorted(found)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is either there as a whole or not at all.

    It is written under another name and renamed, which file systems do in one step; stores
    without renames show a new object only when it is complete. An existing file is an error."""
    fs, final = _file_system(spark, path)
    _, draft = _file_system(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(draft, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise FileExistsError(path)


def remove_tree(spark: SparkSession, path: str) -> None:
    """Remove a folder that this library made; a missing one is fine."""
    fs, hadoop_path = _file_system(spark, path)
    fs.delete(hadoop_path, True)


def list_months(spark: SparkSession, base: str) -> list[str]:
    """Months of a month-partitioned folder, by its directories alone."""
    fs, hadoop_path = _file_system(spark, base)
    names = [status.getPath().getName() for status in fs.listStatus(hadoop_path)]
    return sorted(name.removeprefix("ym=") for name in names if name.startswith("ym=") and "__HIVE" not in name)


def month_path(base: str, month: str) -> str:
    return f"{base.rstrip('/')}/ym={month}"


# Fixed value: the place of markers, which other programs of a deployment look for.
def marker_path(base: str, month: str) -> str:
    return f"{base.rstrip('/')}/_markers/ym={month}/_SUCCESS"


def write_marker(spark: SparkSession, base: str, month: str) -> None:
    """Create the marker of a month; an existing one is replaced."""
    fs, hadoop_path = _file_system(spark, marker_path(base, month))
    fs.create(hadoop_path, True).close()
