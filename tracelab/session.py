"""Session settings that the operators count on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tracelab", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, AQE and Arrow; ``master`` only for local runs, a cluster sets its own."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder for ``name`` under ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session without that setting gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), f"tracelab-{os.getpid()}")
    return f"{with_scheme(spark, root).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def with_scheme(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme that Spark reads it by, so that tasks open the same place; local paths stay as they are."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at)
    return path if whole.toUri().getScheme() == "file" else whole.toString()


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to a new shared folder and read again, which cuts its lineage."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int = 8192) -> DataFrame:
    """``df`` stored with so many rows to a file, so that the work on it has tasks however the files of a table are cut."""
    return kept(df.repartition(max(1, -(-df.count() // rows))), "spread")
