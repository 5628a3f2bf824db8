"""Sheets: folders of CSV traces, fit results, workbooks and MAT files.

A workbook or MAT file is small and opened whole by one task; a folder of them
is read by as many tasks as there are files.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab.operators.imaging import SPOT

FIT_RESULTS = "frame int, aoi int, " + ", ".join(f"{c} double" for c in (*SPOT, "intensity", "intensity_integral", "ss_res"))
CELLS = "path string, sheet string, row long, col int, value double, label string"
ARRAYS = "path string, name string, row long, col long, value double"


def read_trace_folder(spark: SparkSession, path: str) -> DataFrame:
    """CSV sheets without header, time first: label (the folder's name), file, trace_id, t, x; gaps left out."""
    rows = spark.read.text(path, recursiveFileLookup=True, pathGlobFilter="*.csv").select(F.input_file_name().alias("file"), F.split("value", ",").alias("c"))
    cells = rows.select("file", F.try_to_number(F.trim(F.get("c", F.lit(0))), F.lit("S999999999.999999999")).alias("t0"), F.get("c", F.lit(0)).try_cast("double").alias("t"), F.posexplode(F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(0)))).alias("trace_id", "x")).drop("t0")
    named = cells.select(F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("label"), "file", F.col("trace_id").cast("long").alias("trace_id"), "t", F.col("x").try_cast("double").alias("x"))
    return named.filter(F.col("t").isNotNull() & F.col("x").isNotNull() & ~F.isnan("x"))


def read_fit_results(spark: SparkSession, path: str, frames: int | None = None) -> DataFrame:
    """Tracking results of the first ``frames`` frames; failed fits are marked."""
    rows = spark.read.csv(path, header=True, schema=FIT_RESULTS)
    kept = rows if frames is None else rows.filter(F.col("frame") < frames)
    return kept.withColumn("fit_ok", F.col("amplitude") > 0)


def _cells(data: bytes) -> Iterator[tuple[str, int, int, float | None, str | None]]:
    """Cells of a workbook: sheet, row, column, number, text."""
    space = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        texts = []
        if "xl/sharedStrings.xml" in z.namelist():
            texts = ["".join(t.text or "" for t in s.iter(f"{{{space['m']}}}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", space)]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:sheets", space):
            part = targets[sheet.get(rel)].lstrip("/")
            for c in ElementTree.fromstring(z.read(part if part.startswith("xl/") else f"xl/{part}")).iter(f"{{{space['m']}}}c"):
                name, digits = re.fullmatch(r"([A-Z]+)([0-9]+)", c.get("r")).groups()
                column = 0
                for letter in name:
                    column = 26 * column + ord(letter) - 64
                kind, v = c.get("t"), c.find("m:v", space)
                text = texts[int(v.text)] if kind == "s" else "".join(t.text or "" for t in c.iter(f"{{{space['m']}}}t")) if kind == "inlineStr" else None
                number = float(v.text) if text is None and v is not None and kind not in ("str", "e", "b") else None
                if number is not None or text:
                    yield sheet.get("name"), int(digits) - 1, column - 1, number, text


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """Every filled cell of the workbooks of a folder (``CELLS``), row and column from 0."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame([(name, *c) for c in _cells(data)], columns=[c.split()[0] for c in CELLS.split(", ")])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content").mapInPandas(read, CELLS)


def whole_books(cells: DataFrame) -> DataFrame:
    """Cells of workbooks whose parts are named book.row.column (``sinks.in_parts``), under the name and at the places of the book."""
    part = r"\.(\d+)\.(\d+)\.xlsx$"
    first = [F.regexp_extract("path", part, i).cast("long") for i in (1, 2)]
    at = {"row": F.col("row") + first[0], "col": (F.col("col") + first[1]).cast("int"), "path": F.regexp_replace("path", part, ".xlsx")}
    return cells.withColumns(at)


def block_traces(cells: DataFrame, size: int = 4) -> DataFrame:
    """Traces of sheets in blocks of columns (time, value, ...): path, sheet, trace_id, idx, t, x, with fs."""
    in_block = cells.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.col("col") % size < 2))
    rows = in_block.groupBy("path", "sheet", F.floor(F.col("col") / size).cast("long").alias("trace_id"), F.col("row").alias("idx")).agg(F.max(F.when(F.col("col") % size == 0, F.col("value"))).alias("t"), F.max(F.when(F.col("col") % size == 1, F.col("value"))).alias("x")).filter(F.col("x").isNotNull())
    key = ["path", "sheet", "trace_id"]
    first = rows.groupBy(*key).agg(F.array_sort(F.collect_set(F.when(F.col("idx") < 3, F.struct("idx", "t")))).alias("s"))
    rate = first.select(*key, F.try_divide(F.lit(1.0), F.get("s", F.lit(1))["t"] - F.get("s", F.lit(0))["t"]).alias("fs"))
    return rows.join(rate, key)


def matrix_traces(cells: DataFrame, sheet: str | None = None) -> DataFrame:
    """Traces of sheets with a trace in each column: path, sheet, trace_id, idx, x."""
    rows = cells.filter(F.col("value").isNotNull())
    rows = rows if sheet is None else rows.filter(F.col("sheet") == sheet)
    return rows.select("path", "sheet", F.col("col").cast("long").alias("trace_id"), F.col("row").alias("idx"), F.col("value").alias("x"))


_MAT_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}


def _elements(data: bytes, end: str) -> Iterator[tuple[int, bytes]]:
    """Data elements of MAT level 5: type and bytes, compressed ones opened."""
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from(f"{end}II", data, at)
        if kind >> 16:  # small element: size and type share a word
            kind, size, body, at = kind & 0xFFFF, kind >> 16, at + 4, at + 8
        else:
            body = at + 8
            at = body + size + (-size % 8 if kind != 15 else 0)
        raw = data[body : body + size]
        if kind == 15:
            yield from _elements(zlib.decompress(raw), end)
        else:
            yield kind, raw


def _matrix(raw: bytes, end: str) -> tuple[str, list]:
    """Name and cells of a matrix element: ((row, column), array) for each cell, or one for a plain array."""
    parts = list(_elements(raw, end))
    kind = struct.unpack_from(f"{end}I", parts[0][1])[0] & 0xFF
    shape = np.frombuffer(parts[1][1], f"{end}i4")
    name = parts[2][1].decode("ascii", "replace")
    if kind == 1:
        cells = [_matrix(p, end)[1][0][1] if p else np.zeros(0) for k, p in parts[3:] if k == 14]
        return name, [((i % int(shape[0]), i // int(shape[0])), c) for i, c in enumerate(cells)]
    if len(parts) < 4 or parts[3][0] not in _MAT_TYPES:
        return name, [((0, 0), np.zeros(0))]
    return name, [((0, 0), np.frombuffer(parts[3][1], end + _MAT_TYPES[parts[3][0]]).astype(float).reshape(shape, order="F"))]


def read_mat(spark: SparkSession, path: str, pattern: str = "*.mat") -> DataFrame:
    """Values of all numeric arrays and cell arrays: path, name, row, col, at, value.

    For a cell array (row, col) is the cell and ``at`` the place in it; for a
    plain array ``at`` is 0.
    """
    schema = "path string, name string, row long, col long, at long, value double"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, data in zip(batch["path"], batch["content"], strict=True):
                end = "<" if data[126:128] == b"IM" else ">"
                for kind, raw in _elements(data[128:], end):
                    if kind != 14:
                        continue
                    name, cells = _matrix(raw, end)
                    for (r, c), values in cells:
                        v = np.atleast_2d(values)
                        if len(cells) > 1:
                            flat = v.ravel(order="F")
                            yield pd.DataFrame({"path": file, "name": name, "row": r, "col": c, "at": np.arange(len(flat)), "value": flat})
                        else:
                            rows, cols = np.indices(v.shape)
                            yield pd.DataFrame({"path": file, "name": name, "row": rows.ravel(), "col": cols.ravel(), "at": 0, "value": v.ravel()})

    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content").mapInPandas(read, schema)


def whole_mats(values: DataFrame) -> DataFrame:
    """Values of plain arrays of one row in MAT files whose parts are named file.place (``sinks.mat_parts``), under the name and at the places of the file."""
    part = r"\.(\d+)\.mat$"
    first = F.regexp_extract("path", part, 1).cast("long")
    return values.withColumns({"col": F.col("col") + first, "path": F.regexp_replace("path", part, ".mat")})


def step_dwell(values: DataFrame) -> DataFrame:
    """Pairs of the arrays named step and dwell of each file: path, i, step, dwell."""
    rows = values.filter(F.col("name").isin("step", "dwell")).withColumn("i", F.col("row") + F.col("col"))
    return rows.groupBy("path", "i").pivot("name", ["step", "dwell"]).agg(F.first("value"))


def transitions(values: DataFrame, name: str = "Transmat") -> DataFrame:
    """Dwells of neighbouring states of a cell matrix: path, way (on: from r to r-1, off: back), state, dwell."""
    rows = values.filter((F.col("name") == name) & (F.abs(F.col("row") - F.col("col")) == 1))
    way = F.when(F.col("col") == F.col("row") - 1, "on").otherwise("off")
    return rows.select("path", way.alias("way"), F.greatest("row", "col").alias("state"), F.col("value").alias("dwell"))
