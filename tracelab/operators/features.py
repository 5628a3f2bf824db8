"""Bead features of tethered-particle tracks, and the quality filter on them.

Tracks are rows (aoi, idx, t, x, y, sx, sy, ...). Features stay long:
(sheet, aoi, idx, t, value).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelab.functions.projections import NM_PER_PIXEL, or_zero, ratio
from tracelab.operators.windows import blocks, framed

RATIOS = ("xy_ratio_sliding", "xy_ratio_fixing", "sx_over_sy_squared")
RAW = ("amplitude", "sx", "sy", "x", "y", "theta_deg", "offset", "intensity", "intensity_integral", "ss_res")


def bead_features(tracks: DataFrame, window: int = 20, factor: float = NM_PER_PIXEL, key: str = "aoi") -> DataFrame:
    """All analysed sheets as rows: sheet, aoi, idx, t, value."""

    parts, at = [], [key, "idx", "t"]
    positive = {v: F.when(F.col(v) > 0, F.col(v)) for v in ("x", "y")}
    made = {name: lambda w, v=v: F.stddev_samp(positive[v]).over(w) * factor for name, v in (("bx", "x"), ("by", "y"))}
    made |= {"__full": lambda w: F.count("*").over(w), "__t": lambda w: F.avg("t").over(w)}
    sliding = framed(tracks.select(*at, "x", "y"), 0, window - 1, made, key).filter(F.col("__full") == window).select(key, "idx", F.col("__t").alias("t"), "bx", "by")
    fixing = blocks(tracks, window, [(F.stddev_samp(positive["x"]) * factor).alias("bx"), (F.stddev_samp(positive["y"]) * factor).alias("by"), F.avg("t").alias("t")], key).withColumnRenamed("block", "idx")
    for mode, both in (("sliding", sliding), ("fixing", fixing)):
        cells = [(f"BMx_{mode}", F.col("bx")), (f"BMy_{mode}", F.col("by")), (f"xy_ratio_{mode}", ratio("bx", "by").cast("double"))]
        parts.append(both.select(*at, F.explode(F.array(*(F.struct(F.lit(n).alias("sheet"), c.alias("value")) for n, c in cells))).alias("c")))
    own = [("sx_sy", F.col("sx") * F.col("sy")), ("sx_over_sy_squared", ratio(F.col("sx") * F.col("sx"), F.col("sy") * F.col("sy")).cast("double"))]
    parts.append(tracks.select(*at, F.explode(F.array(*(F.struct(F.lit(n).alias("sheet"), c.alias("value")) for n, c in own))).alias("c")))
    return reduce(DataFrame.unionByName, parts).select("c.sheet", *at, "c.value")


def bead_attributes(features: DataFrame, fps: float, key: str = "aoi") -> DataFrame:
    """Median, mean and deviation of every sheet of every bead; ratios over the first two seconds alone.

    A sheet with a missing value has no median or mean, as in an array; such
    results count as 0.
    """
    first = F.when(F.col("sheet") == "xy_ratio_fixing", F.lit(int(2 * fps / 20))).otherwise(F.lit(int(2 * fps)))
    used = features.filter(~F.col("sheet").isin(*RATIOS) | (F.col("idx") < first))
    whole = F.count("*") == F.count("value")
    med, avg, std = (F.when(whole, a) for a in (F.median("value"), F.avg("value"), F.stddev_samp("value")))
    return used.groupBy(key, "sheet").agg(or_zero(med).alias("med"), or_zero(avg).alias("avg"), or_zero(std).alias("std"))


def passes_quality(lower: float, upper: float, low_ratio: float = 0.8, high_ratio: float = 1.2) -> Column:
    """Whether a bead's median ratios and spread are in range, over columns named like the sheets."""
    ok = [(or_zero(r) > low_ratio) & (or_zero(r) < high_ratio) for r in RATIOS]
    ok.append((F.col("BMx_sliding") > lower) & (F.col("BMx_sliding") < upper))
    return reduce(Column.__and__, ok)


def passing_beads(attributes: DataFrame, lower: float, upper: float, key: str = "aoi", **limits: float) -> DataFrame:
    """Ids of the beads that pass the quality filter."""
    cells = attributes.filter(F.col("sheet").isin(*RATIOS, "BMx_sliding")).groupBy(key).pivot("sheet", [*RATIOS, "BMx_sliding"]).agg(F.first("med"))
    return cells.filter(passes_quality(lower, upper, **limits)).select(key)


def tether_quality(traces: DataFrame, low: float = 48, high: float = 68, drift: float = 20, seconds: float = 20, key: str = "trace_id", time: str = "t", value: str = "x") -> DataFrame:
    """Ids of traces whose level before time 0 is in range and near that of the first seconds."""
    before = F.avg(F.when(F.col(time) < 0, F.col(value)))
    early = F.avg(F.when((F.col(time) >= 0) & (F.col(time) <= seconds), F.col(value)))
    levels = traces.groupBy(key).agg(before.alias("b"), early.alias("e"))
    return levels.filter((F.col("b") > low) & (F.col("b") < high) & (F.abs(F.col("b") - F.col("e")) < drift)).select(key)


def short_steps(events: DataFrame, limit: float = 15, step: str = "step") -> DataFrame:
    """Pairs of step and dwell whose step is below ``limit``."""
    return events.filter(F.col(step) < limit)


def above(df: DataFrame, least: float = 0.1, value: str = "x") -> DataFrame:
    """Rows whose value is larger than ``least``; missing values are left out."""
    return df.filter(F.col(value) > least)


def amplitude_between(spots: DataFrame, black: float | None = None, white: float | None = None, amplitude: str = "amplitude") -> DataFrame:
    """Spots that are neither darker than ``black`` nor brighter than ``white``."""
    if black is not None:
        spots = spots.filter(F.col(amplitude) >= black)
    return spots if white is None else spots.filter(F.col(amplitude) <= white)
