"""Between long and wide layouts, and combining sheets.

Inside the library data stays long; a pivot belongs at a sink or a source.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelab.operators.generate import uniform


def wide(df: DataFrame, at: str, key: str, value: str, keys: list | None = None, prefix: str | None = None) -> DataFrame:
    """One column for each key. Naming the keys spares a pass over the data."""
    grouped = df.groupBy(at)
    out = (grouped.pivot(key, keys) if keys is not None else grouped.pivot(key)).agg(F.first(value))
    return out.select(at, *(F.col(f"`{c}`").alias(f"{prefix}_{c}" if prefix else c) for c in out.columns if c != at))


def long(df: DataFrame, at: str, key: str = "trace_id", value: str = "x") -> DataFrame:
    """A row for each cell of the columns other than ``at``; missing cells are left out."""
    cells = [c for c in df.columns if c != at]
    out = df.unpivot(at, cells, key, value)
    return out.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))


def block_columns(df: DataFrame, size: int = 4, key: str = "trace_id") -> DataFrame:
    """Sheets of repeating blocks of ``size`` columns: time and value of the first two, gaps left out."""
    pairs = [F.struct(F.lit(i // size).cast("long").alias(key), F.col(f"`{df.columns[i]}`").cast("double").alias("t"), F.col(f"`{df.columns[i + 1]}`").cast("double").alias("x")) for i in range(0, len(df.columns) - 1, size)]
    rows = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
    return rows.filter(F.col("x").isNotNull() & ~F.isnan("x"))


def stacked(sheets: list[DataFrame]) -> DataFrame:
    """Rows of all sheets, columns matched by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sheets)


def side_by_side(sheets: list[DataFrame], at: str) -> DataFrame:
    """Columns of all sheets, rows matched on ``at``; a row of any sheet stays."""
    return reduce(lambda a, b: a.join(b, at, "full"), sheets)


def padded(df: DataFrame, at: str, key: str, value: str, keys: list | None = None) -> DataFrame:
    """Lists of different lengths as columns filled up with zeros."""
    return wide(df, at, key, value, keys).fillna(0)


def with_attributes(df: DataFrame, attributes: list[DataFrame], key: str) -> DataFrame:
    return reduce(lambda a, b: a.join(b, key, "left"), attributes, df)


def one_trace(df: DataFrame, key: str, value) -> DataFrame:
    return df.filter(F.col(key) == value)


def timed(df: DataFrame, fps: float, times: DataFrame | None = None, idx: str = "idx") -> DataFrame:
    """Adds t: the given time of each row where there is one, else its number over ``fps``."""
    even = F.col(idx) / F.lit(float(fps))
    if times is None:
        return df.withColumn("t", even)
    return df.join(times.select(F.col("idx").alias("__i"), F.col("t").alias("__t")), F.col(idx) == F.col("__i"), "left").withColumn("t", F.coalesce("__t", even)).drop("__i", "__t")


def selected(df: DataFrame, passing: DataFrame, key: str) -> DataFrame:
    return df.join(passing.select(key), key, "left_semi")


def removed(df: DataFrame, passing: DataFrame, key: str) -> DataFrame:
    return df.join(passing.select(key), key, "left_anti")


def resampled(df: DataFrame, traces: DataFrame, draws: int, seed: int, key: str = "trace_id") -> DataFrame:
    """Bootstrap: ``draws`` traces drawn with replacement, in order of draw.

    ``traces`` has a row for each trace with its number ``ordinal`` from 0. A
    draw is a hash of the seed and its number, so a rerun draws the same.
    """
    n = traces.agg(F.count("*").alias("n"))
    picks = df.sparkSession.range(draws).withColumnRenamed("id", "draw").crossJoin(F.broadcast(n)).select("draw", F.floor(uniform(seed, "draw", "draw") * F.col("n")).alias("ordinal"))
    return df.join(picks.join(traces, "ordinal").select("draw", key), key)
