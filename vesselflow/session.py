"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL_BASES: dict[str, str] = {}


def build_session(app_name: str = "vesselflow", master: str | None = None, **conf: str) -> SparkSession:
    """Session in UTC; ``conf`` keys use ``__`` for ``.``. Adaptive execution is Spark's default.

    The number of shuffle partitions is left to the cluster's setting, and AQE
    merges or splits them by measured size.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return use_utc(builder.getOrCreate())


def use_utc(spark: SparkSession) -> SparkSession:
    """All day, month and hour fields are UTC, whoever made the session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach: the session's ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own;
    on a cluster the missing setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the whole cluster")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_BASES:
        _LOCAL_BASES[app] = tempfile.mkdtemp(prefix="vesselflow-")
    return _LOCAL_BASES[app]


def fresh_dir(spark: SparkSession, purpose: str) -> str:
    """A new, not yet existing path below the shared folder."""
    return f"{shared_dir(spark)}/vesselflow/{purpose}-{uuid.uuid4().hex}"
