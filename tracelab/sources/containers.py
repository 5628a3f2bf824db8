"""Frame containers as a data source: ``spark.read.format("frame_containers")``.

The driver lists the files of a folder and cuts each into stretches of whole
images; a task reads the byte range of its stretch, batch by batch. The options
``first`` and ``last`` leave out stretches, and parts of them, before anything
is read. They are options and not filters that are pushed down, as with those a
table that had been filtered before lost rows of a later filter in a test.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FRAMES = "frame_id long, h int, w int, pixels array<double>"
STRETCH_BYTES, BATCH_BYTES = 64 << 20, 4 << 20  #: of images in a partition, and of those read at once


@dataclass
class Stretch(InputPartition):
    """``n`` images of a file from a byte on, of which the first has the number ``first``."""

    path: str
    offset: int
    first: int
    n: int


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1)) if "://" in path else (pafs.LocalFileSystem(), path)


class ContainerReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.end = options["path"], options.get("ending", ".glimpse")
        self.h, self.w = int(options["height"]), int(options["width"])
        if self.h < 1 or self.w < 1:
            raise ValueError("height and width of images have to be positive")
        self.kind = ">i2" if options.get("deep", "false").lower() == "true" else ">u1"
        self.by_name = options.get("order", "time") == "name"
        self.low, self.high = int(options.get("first", 0)), int(options.get("last", (1 << 63) - 1))

    @property
    def size(self) -> int:
        return self.h * self.w * np.dtype(self.kind).itemsize

    def partitions(self) -> list[Stretch]:
        system, at = opened(self.path)
        files = [i for i in system.get_file_info(pafs.FileSelector(at)) if i.is_file and i.size and i.base_name.endswith(self.end)]
        files.sort(key=lambda i: i.base_name if self.by_name else (i.mtime_ns or 0, i.base_name))
        out, first, most = [], 0, max(1, STRETCH_BYTES // self.size)
        for i in files:
            held = i.size // self.size
            low, high = max(0, self.low - first), min(held, self.high - first + 1)
            folder = self.path.rstrip("/")
            out += [Stretch(f"{folder}/{i.base_name}", k * self.size, first + k, min(most, high - k)) for k in range(low, high, most)]
            first += held
        return out or [Stretch("", 0, 0, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        if not partition.n:
            return
        system, at = opened(partition.path)
        together, place = max(1, BATCH_BYTES // self.size), self.h * self.w
        with system.open_input_file(at) as f:
            for k in range(0, partition.n, together):
                n = min(together, partition.n - k)
                raw = f.read_at(n * self.size, partition.offset + k * self.size)
                if len(raw) < n * self.size:
                    raise OSError(f"{partition.path} has become shorter")
                pixels = pa.ListArray.from_arrays(np.arange(0, n * place + 1, place, dtype=np.int32), np.frombuffer(raw, self.kind).astype(np.float64))
                ids = np.arange(partition.first + k, partition.first + k + n)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(n, self.h, np.int32)), pa.array(np.full(n, self.w, np.int32)), pixels], names=["frame_id", "h", "w", "pixels"])


class FrameContainers(DataSource):
    """Options: ``height`` and ``width``; ``deep`` for 16-bit pixels; ``ending`` of files; ``order`` of files, by time (of change, then name) or by name; ``first`` and ``last`` number of images, both included."""

    @classmethod
    def name(cls) -> str:
        return "frame_containers"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> ContainerReader:
        return ContainerReader(self.options)


def read_containers(spark: SparkSession, path: str, height: int, width: int, **options: str) -> DataFrame:
    """All images of the containers of a folder, numbered over all files: ``FRAMES``. An empty folder gives no rows."""
    spark.dataSource.register(FrameContainers)
    return spark.read.format("frame_containers").options(height=height, width=width, **options).load(path)
