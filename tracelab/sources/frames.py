"""Frame containers: files of equal big-endian images, and their header.

Which frame is in which file at which offset is worked out as a DataFrame;
tasks then read just the byte ranges of the frames that are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab.operators.windows import earlier_sum, numbered

HEADER_ROWS = ("frames", "width", "height", "fps", "pixeldepth")


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """One row: frames, width, height, fps, pixeldepth, from a two-column TSV in this order of rows."""
    rows = spark.read.text(path, wholetext=True).select(F.split(F.trim(F.col("value")), r"\r?\n").alias("r"))
    value = {n: F.split(F.get("r", F.lit(i)), "\t")[1] for i, n in enumerate(HEADER_ROWS)}
    return rows.select(*(value[n].cast("double" if n == "fps" else "int").alias(n) for n in HEADER_ROWS))


def list_files(spark: SparkSession, path: str, pattern: str = "*.glimpse") -> DataFrame:
    """path and size of the files that aren't empty, with their number by time of change."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length", "modificationTime")
    some = numbered(files.filter("length > 0"), ["modificationTime", "path"], "file")
    return some.select("file", "path", F.col("length").alias("size"))


def frame_layout(files: DataFrame, image_bytes: int) -> DataFrame:
    """frame_id, path, offset of every whole image; each file begins at offset 0 and may hold another number."""
    held = files.withColumn("held", F.floor(F.col("size") / image_bytes))
    each = earlier_sum(held, ["file"], F.col("held"), "before").filter("held > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("held") - 1)))
    return each.select((F.col("before") + F.col("i")).cast("long").alias("frame_id"), "path", (F.col("i") * image_bytes).cast("long").alias("offset"))


def read_frames(layout: DataFrame, height: int, width: int, deep: bool = False) -> DataFrame:
    """The images of the rows of a layout: frame_id, h, w, pixels. ``deep`` reads 16-bit pixels."""
    kind, size = np.dtype(">i2" if deep else ">u1"), height * width * (2 if deep else 1)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, rows in batch.groupby("path"):
                system, at = pafs.FileSystem.from_uri(path) if ":" in path else (pafs.LocalFileSystem(), path)
                with system.open_input_file(at) as f:
                    images = [np.frombuffer(f.read_at(size, int(o)), kind).astype(float) for o in rows["offset"]]
                yield pd.DataFrame({"frame_id": rows["frame_id"], "h": height, "w": width, "pixels": images})

    return layout.mapInPandas(read, "frame_id long, h int, w int, pixels array<double>")
