"""Shared folders, stored tables and files that tasks write and read.

Intermediate results that a later step reads go to the folder named by
``spark.checkpoint.dir``, which driver and executors share. Only a local
session without that setting gets a temporary folder.
"""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracelab.session import with_scheme

FILE_ROWS, LEAST_FILES = 250_000, 6  #: rows in a file of a narrow table, where their number is known
BATCH_ROWS = 256  #: rows in an Arrow batch, so that long texts stay bounded
SPACE = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder for ``name`` under the folder that the cluster shares."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), f"tracelab-{os.getpid()}")
    return f"{with_scheme(spark, root).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str, path: str | None = None, rows: int | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again, which cuts its lineage.

    ``rows``, a bound on the rows of a narrow table, keeps it from many small files.
    """
    if rows is not None:
        df = df.coalesce(max(LEAST_FILES, math.ceil(rows / FILE_ROWS)))
    path = path or shared_dir(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Stored tables of one run, deleted one by one when no later step reads them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.paths = spark, shared_dir(spark, name), {}

    def keep(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """``df`` stored under ``name``; an older table of that name goes once the new one is whole."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        out = stored(df, name, path, rows)
        self.drop(name)
        self.paths[name] = path
        return out

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for path in filter(None, (self.paths.pop(n, None) for n in names)):
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lowers the session's rows in an Arrow batch, for good: plans read the setting when they run."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = int(spark.conf.get(name))
    if not 0 < held <= rows:
        spark.conf.set(name, str(rows))


ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}


def batch_of(schema: str, columns: list) -> pa.RecordBatch:
    """A batch of the columns of a schema such as "doc_id long, text string"; None is null."""
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(v, ARROW[k]) for v, k in zip(columns, kinds, strict=True)], names=list(names))


def appended(df: DataFrame, made: str, find: Callable, reads: list[str], without: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the columns of ``made`` computed by ``find`` from Arrow arrays of the columns ``reads``.

    All other columns pass through as Arrow arrays, so neither nulls nor large
    integers change on the way. Columns named in ``made`` are replaced, those
    named in ``without`` left out.
    """
    added = [c.split()[0] for c in made.split(", ")]
    fields = [f for f in df.schema if f.name not in {*added, *without}]
    kept = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = batch_of(made, find(*(batch.column(c) for c in reads)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new.columns], names=[*kept, *added])

    return df.mapInArrow(run, StructType(fields + StructType.fromDDL(made).fields))


HOT_KEYS = 50_000  #: keys at most that are taken out of a shuffle and broadcast


def joined_by(rows: DataFrame, other: DataFrame, key: str, n: str, total: int, many: int = 1000) -> DataFrame:
    """``rows`` joined with ``other``, one row for each ``key``, of which ``n`` says how many of the ``total`` rows it meets.

    Keys with more than ``many`` rows and more than 1/``HOT_KEYS`` of all, of
    which there are at most ``HOT_KEYS``, are broadcast; the others are joined
    by a shuffle in which no key is large.
    """
    limit = max(many, total // HOT_KEYS)
    hot, usual = other.filter(F.col(n) > limit).drop(n), other.filter(F.col(n) <= limit).drop(n)
    large = rows.join(F.broadcast(hot), key)
    return large.unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(usual, key))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or local path, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1) if path.startswith("s3a:") else path)
    return pafs.LocalFileSystem(), path


@contextmanager
def new_file(path: str) -> Iterator:
    """A file that appears under its name only when whole, so a task may be run again."""
    system, at = file_system(path)
    system.create_dir(os.path.dirname(at), recursive=True)
    part = f"{at}.{uuid.uuid4().hex[:8]}.tmp"
    with system.open_output_stream(part, compression=None) as out:
        yield out
    system.move(part, at)


def read_range(path: str, offset: int = 0, length: int | None = None) -> bytes:
    system, at = file_system(path)
    with system.open_input_file(at) as f:
        return f.read_at(f.size() - offset if length is None else length, offset)
