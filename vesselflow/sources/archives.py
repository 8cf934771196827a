"""ZIP archives of CSV files as rows of text lines (SRC1).

The driver lists the archives; their members become rows that are dealt out by size,
and each task streams its members in small Arrow batches. Neither an archive nor a
member is ever held whole, and a large archive is read by many tasks. Archives lie
on any file system that both Hadoop and Arrow know. This is the only Python code of
the message sources that runs on executors.
"""

from __future__ import annotations

import sys
from urllib.parse import unquote, urlsplit

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vesselflow.sources.storage import list_states

# What runs on executors travels by value: they need no installed copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Uncompressed bytes that one task reads, as far as members can be told apart.
BYTES_PER_TASK = 128 << 20

MEMBER_SCHEMA = "source string, place int, member string, size bigint"
LINE_SCHEMA = "source string, member string, line_no bigint, line string"

#: Hadoop's schemes and the file system of Arrow that reads them.
SCHEMES = {
    "": "local",
    "file": "local",
    "s3": "s3",
    "s3a": "s3",
    "s3n": "s3",
    "gs": "gcs",
    "abfs": "azure",
    "abfss": "azure",
    "hdfs": "hdfs",
    "viewfs": "hdfs",
}
#: Hadoop settings and the options of Arrow's S3 file system that they become.
S3_SETTINGS = {
    "fs.s3a.endpoint": "endpoint_override",
    "fs.s3a.endpoint.region": "region",
    "fs.s3a.access.key": "access_key",
    "fs.s3a.secret.key": "secret_key",
    "fs.s3a.session.token": "session_token",
}


def arrow_location(uri: str, settings: dict[str, str] | None = None) -> tuple[str, str, dict[str, str]]:
    """(kind of file system, path in it, options) of a Hadoop path; ValueError for others.

    Blanks and other characters of a path mean themselves, as in Hadoop."""
    scheme, separator, rest = uri.partition(":")
    if not separator or "/" in scheme:
        return "local", uri, {}
    kind = SCHEMES.get(scheme.lower())
    if kind is None:
        raise ValueError(f"archives cannot be read from {scheme}: (known: {', '.join(sorted(filter(None, SCHEMES)))})")
    if kind == "local":
        return kind, "/" + rest.lstrip("/"), {}
    authority, _, path = rest.removeprefix("//").partition("/")
    if kind == "hdfs":
        return kind, "/" + path, {"host": f"{scheme.lower()}://{authority}" if authority else "default"}
    if kind == "azure":
        container, _, account = authority.partition("@")
        return kind, f"{container}/{path}", {"account_name": account.split(".")[0]}
    options = {S3_SETTINGS[k]: v for k, v in (settings or {}).items() if k in S3_SETTINGS and v} if kind == "s3" else {}
    endpoint = options.get("endpoint_override")
    if endpoint and "://" in endpoint:
        parts = urlsplit(endpoint)
        options |= {"scheme": parts.scheme, "endpoint_override": unquote(parts.netloc)}
    return kind, f"{authority}/{path}", options


def store_settings(spark: SparkSession) -> dict[str, str]:
    """The session's Hadoop settings that reading from an object store needs."""
    conf = spark._jsc.hadoopConfiguration()
    return {key: conf.get(key) for key in S3_SETTINGS if conf.get(key)}


def list_archives(spark: SparkSession, root: str, name_regex: str = r"(?i)\.zip$") -> DataFrame:
    """Archives below ``root`` whose base name matches; error if there is none.

    The suffix counts in either case, and names that begin with ``_`` or ``.`` count, too.
    """
    files = [f for f in list_states(spark, root) if f[0].lower().endswith(".zip")]
    listed = spark.createDataFrame(files, "source string, bytes bigint, modified bigint")
    chosen = listed.where(F.element_at(F.split("source", "/"), -1).rlike(name_regex))
    first = chosen.first()
    if first is None:
        raise FileNotFoundError(f"no archive below {root} matches {name_regex}")
    arrow_location(first.source)
    return chosen


def _member_reader(
    settings: dict[str, str] | None = None, quoting: tuple[str, str] | None = None, comment: str | None = None
):
    """Functions for the executors; nested so that they travel by value."""
    locate = arrow_location

    def open_archive(uri):
        import zipfile

        from pyarrow import fs

        kind, path, options = locate(uri, settings)
        if kind == "hdfs":
            store = fs.HadoopFileSystem(**options)
        else:
            makers = {"local": "LocalFileSystem", "s3": "S3FileSystem", "gcs": "GcsFileSystem", "azure": "AzureFileSystem"}
            store = getattr(fs, makers[kind])(**options)
        return zipfile.ZipFile(store.open_input_file(path))

    def list_members(batches):
        import pyarrow as pa

        for batch in batches:
            for uri in batch.column("source").to_pylist():
                with open_archive(uri) as archive:
                    files = [(i, m) for i, m in enumerate(archive.infolist()) if not m.is_dir()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([uri] * len(files), pa.string()),
                        pa.array([i for i, _ in files], pa.int32()),
                        pa.array(
                            [m.filename.replace("\\", "/").lstrip("/") for _, m in files], pa.string()
                        ),
                        pa.array([m.file_size for _, m in files], pa.int64()),
                    ],
                    names=["source", "place", "member", "size"],
                )

    def is_before(line):
        """Blank lines and comments before the first line have no number."""
        return not line.strip() or bool(comment and line.startswith(comment))

    def records(reader, quote, escape):
        """Lines joined while a quoted value is open, for values with line breaks."""
        held = ""
        for line in reader:
            held += line
            plain = held.replace(escape + quote, "") if escape != quote else held
            if plain.count(quote) % 2 == 0:
                yield held
                held = ""
        if held:
            yield held

    def read_lines(batches):
        import io

        import pyarrow as pa

        max_lines, max_chars = 8192, 4_000_000

        def to_batch(uri, member, first, lines):
            count = len(lines)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([uri] * count, pa.string()),
                    pa.array([member] * count, pa.string()),
                    pa.array(range(first, first + count), pa.int64()),
                    pa.array(lines, pa.string()),
                ],
                names=["source", "member", "line_no", "line"],
            )

        for batch in batches:
            for row in batch.to_pylist():
                with open_archive(row["source"]) as archive:
                    info = archive.infolist()[row["place"]]
                    with archive.open(info) as raw:
                        reader = io.TextIOWrapper(raw, encoding="utf-8-sig", errors="replace", newline=None)
                        first, chars, lines = 0, 0, []
                        for line in records(reader, *quoting) if quoting else reader:
                            if not first and not lines and is_before(line):
                                continue
                            lines.append(line.rstrip("\r\n"))
                            chars += len(line)
                            if len(lines) >= max_lines or chars >= max_chars:
                                yield to_batch(row["source"], row["member"], first, lines)
                                first, chars, lines = first + len(lines), 0, []
                        if lines:
                            yield to_batch(row["source"], row["member"], first, lines)

    return list_members, read_lines


def archive_members(archives: DataFrame) -> DataFrame:
    """One row per file in each archive; reads only the archives' directories."""
    list_members, _ = _member_reader(store_settings(archives.sparkSession))
    return archives.select("source").mapInArrow(list_members, MEMBER_SCHEMA)


def member_counts(archives: DataFrame) -> DataFrame:
    """Number of files per archive."""
    return archive_members(archives).groupBy("source").agg(F.count("*").alias("members"))


def expand_members(
    members: DataFrame,
    tasks: int | None = None,
    quoting: tuple[str, str] | None = None,
    comment: str | None = None,
) -> DataFrame:
    """Lines of the members, numbered from 0 at the first one that is no blank or comment.

    A member can only be unpacked from start to end, hence by one task. The member list (a
    few bytes per file, in order of size) is dealt out in turn over ``tasks`` partitions, by
    default one for each core, or for each ``BYTES_PER_TASK`` of text, so that tasks get equal shares of large
    and small ones. Lines are not shuffled. ``quoting`` has the quote and escape characters
    if values may have line breaks; a line is then a whole record.
    """
    sizes = members.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    if not sizes.n:
        raise FileNotFoundError("the archives hold no CSV file")
    # Few bytes still keep all cores of the session at work, as far as there are members.
    cores = members.sparkSession.sparkContext.defaultParallelism
    tasks = tasks or min(sizes.n, max(cores, -(-sizes.bytes // BYTES_PER_TASK)))
    turn = F.row_number().over(Window.orderBy(F.desc("size"), "source", "place")) % tasks
    _, read_lines = _member_reader(store_settings(members.sparkSession), quoting, comment)
    dealt = members.withColumn("turn", turn).repartitionByRange(tasks, "turn").drop("turn")
    return dealt.mapInArrow(read_lines, LINE_SCHEMA)


def read_zip_lines(
    spark: SparkSession,
    root: str,
    name_regex: str = r"(?i)\.zip$",
    tasks: int | None = None,
    quoting: tuple[str, str] | None = None,
    comment: str | None = None,
) -> DataFrame:
    """SRC1: lines of the CSV members of all matching archives; error if there are none."""
    members = archive_members(list_archives(spark, root, name_regex))
    return expand_members(members.where(F.lower("member").endswith(".csv")), tasks, quoting, comment)
