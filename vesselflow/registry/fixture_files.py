"""CSV files and ZIP archives made from the messages, as inputs of the file sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_csv(messages: DataFrame, out: str) -> str:
    """Several files, each of a span of time, as archives of days are."""
    files = messages.sparkSession.sparkContext.defaultParallelism
    (
        messages.repartitionByRange(files, "BaseDateTime")
        .write.option("header", "true")
        .option("ignoreLeadingWhiteSpace", "false")
        .option("ignoreTrailingWhiteSpace", "false")
        .csv(out)
    )
    return out


def write_archives(spark: SparkSession, csv_dir: str, out: str) -> str:
    """One archive per CSV file, with a text file that is not data beside it."""

    def zip_each(batches):
        import shutil
        import zipfile

        import pyarrow as pa
        from pyarrow import fs

        def locate(uri):
            if uri.startswith("file:"):
                uri = "/" + uri[len("file:") :].lstrip("/")
            return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)

        target, folder = locate(out)
        target.create_dir(folder, recursive=True)
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                store, path = locate(uri)
                name = path.rsplit("/", 1)[-1].removesuffix(".csv")
                archive = f"{folder}/AIS_{name}.zip"
                with target.open_output_stream(archive) as sink, zipfile.ZipFile(
                    sink, "w", zipfile.ZIP_DEFLATED
                ) as zipped:
                    zipped.writestr("readme.txt", "not a message\n")
                    with store.open_input_stream(path) as source, zipped.open(
                        f"data/{name}.csv", "w"
                    ) as member:
                        shutil.copyfileobj(source, member, 1 << 20)
                yield pa.RecordBatch.from_pydict({"archive": [archive]})

    listed = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(csv_dir).select("path")
    )
    listed.mapInArrow(zip_each, "archive string").write.format("noop").mode("overwrite").save()
    return out
