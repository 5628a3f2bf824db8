"""Seeded simulations with known parameters.

Random numbers are hashes of the seed and of a row's own number, so neither the
partitioning nor a rerun changes them.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DIGITS = 12  #: hexadecimal digits of a hash that make a number


def uniform(seed: int, name: str, *keys: Column | str) -> Column:
    """A number between 0 and 1, both excluded, for each value of ``keys``."""
    text = F.concat_ws(":", F.lit(f"{seed}:{name}"), *((F.col(k) if isinstance(k, str) else k).cast("string") for k in keys))
    drawn = F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("double")
    return (drawn + 0.5) / float(16**DIGITS)


def sql_uniform(seed: int, name: str, *keys: str) -> str:
    text = " || ':' || ".join([f"'{seed}:{name}'", *(f"CAST({k} AS VARCHAR)" for k in keys)])
    return f"((CAST('0x' || substr(md5({text}), 1, {DIGITS}) AS UBIGINT)::DOUBLE + 0.5::DOUBLE) / {16**DIGITS}.0::DOUBLE)"


def normal(seed: int, mean: float = 0.0, sd: float = 1.0, key: str = "id") -> Column:
    return F.lit(float(mean)) + F.lit(float(sd)) * F.sqrt(-2 * F.log(uniform(seed, "size", key))) * F.cos(2 * math.pi * uniform(seed, "turn", key))


def sql_normal(seed: int, mean: float, sd: float, key: str = "id") -> str:
    return f"({mean}::DOUBLE + {sd}::DOUBLE * sqrt(-2 * ln({sql_uniform(seed, 'size', key)})) * cos(2 * pi() * {sql_uniform(seed, 'turn', key)}))"


def dwell(seed: int, tau: float, key: str = "id") -> Column:
    return -F.lit(float(tau)) * F.log(uniform(seed, "stay", key))


def sql_dwell(seed: int, tau: float, key: str = "id") -> str:
    return f"(-{tau}::DOUBLE * ln({sql_uniform(seed, 'stay', key)}))"


def gauss_sample(spark: SparkSession, n: int, means: list[float], sds: list[float], seed: int = 0) -> DataFrame:
    """``n`` values of each component: component, id, x."""
    return reduce(DataFrame.unionByName, (spark.range(n).select(F.lit(i).alias("component"), "id", normal(seed + i, m, s).alias("x")) for i, (m, s) in enumerate(zip(means, sds, strict=True))))


def dwell_sample(spark: SparkSession, n: int, taus: list[float], seed: int = 0) -> DataFrame:
    return reduce(DataFrame.unionByName, (spark.range(n).select(F.lit(i).alias("component"), "id", dwell(seed + i, t).alias("x")) for i, t in enumerate(taus)))


def ramp_trace(spark: SparkSession, levels: tuple[float, float], changes: tuple[int, int], tail: int, noise: float = 0.0, seed: int = 0, trace: int = 0) -> DataFrame:
    """Level, ramp, level: trace_id, idx, x."""
    (a, b), (t1, t2) = levels, changes
    i = F.col("id")
    clean = F.when(i < t1, F.lit(a)).when(i >= t2, F.lit(b)).otherwise(a + (b - a) * (i - t1) / (t2 - t1))
    return spark.range(t2 + tail).select(F.lit(trace).cast("long").alias("trace_id"), i.alias("idx"), (clean + normal(seed, 0, noise)).alias("x"))


def staircase(spark: SparkSession, steps: list[tuple[float, float, float]], n: int, fs: float, noise: float = 0.0, seed: int = 0, trace: int = 0) -> DataFrame:
    """A trace of steps (size, deviation, tau), ``n`` of each in shuffled order: trace_id, idx, x."""
    events = reduce(DataFrame.unionByName, (spark.range(n).select(F.lit(k).alias("kind"), "id", normal(seed + 3 * k, m, s).alias("step"), F.greatest(F.lit(1), F.floor(dwell(seed + 3 * k + 1, tau) * fs + 0.5)).cast("long").alias("stay")) for k, (m, s, tau) in enumerate(steps)))
    order = Window.orderBy(uniform(seed, "order", "kind", "id"), "kind", "id")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = events.select(F.coalesce(F.sum("step").over(upto), F.lit(0.0)).alias("level"), F.coalesce(F.sum("stay").over(upto), F.lit(0)).alias("at"), "stay")
    rows = placed.select("level", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("stay") - 1)).alias("idx"))
    return rows.select(F.lit(trace).cast("long").alias("trace_id"), "idx", (F.col("level") + normal(seed + 99, 0, noise, "idx")).alias("x"))
