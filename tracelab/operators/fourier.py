"""Discrete Fourier transforms of long columns, and sums of products at all lags.

A transform of n places is cut in rows and columns of about the root of n
(n = rows x columns): tasks transform columns, turn each value by its twiddle
factor, and transform rows after one shuffle. So no task holds more than
``TOGETHER`` values, or one row of a transform if that is longer. Lengths that
aren't powers of two go through chirps of a length that is.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHOLE = 4096  #: places up to which a transform is one task's work
TOGETHER = 1 << 16  #: values that a task transforms at once
LEAF = 4096  #: products of a lag and a place that are taken one by one

SCHEMA = "at long, re double, im double"


def _by_block(df: DataFrame, block: Column, work: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``work`` turns the places and values of a block into others."""

    def run(rows: pa.Table) -> pa.Table:
        at, value = work(rows.column("at").to_numpy(), rows.column("re").to_numpy() + 1j * rows.column("im").to_numpy())
        return pa.table({"at": at.astype(np.int64), "re": value.real, "im": value.imag})

    return df.groupBy(block.alias("__block")).applyInArrow(run, SCHEMA)


def _power_of_two(df: DataFrame, n: int, inverse: bool, whole: int) -> DataFrame:
    turn = np.fft.ifft if inverse else np.fft.fft

    def at_once(at, value):
        full = np.zeros(n, complex)
        full[at] = value
        return np.arange(n), turn(full)

    if n <= whole:
        return _by_block(df, F.lit(0), at_once)
    rows = 1 << (n.bit_length() - 1) // 2
    columns = n // rows
    sign = 1 if inverse else -1
    wide, high = max(1, TOGETHER // columns), max(1, TOGETHER // rows)

    # place = row + rows * column, and in the result place = column * ... + row's turn
    def along(at, value):
        own = np.unique(at % rows)
        full = np.zeros((len(own), columns), complex)
        full[np.searchsorted(own, at % rows), at // rows] = value
        k = np.arange(columns)
        turned = turn(full, axis=1) * np.exp(sign * 2j * np.pi * ((own[:, None] * k) % n) / n)
        return (own[:, None] + rows * k).ravel(), turned.ravel()

    def across(at, value):
        own = np.unique(at // rows)
        full = np.zeros((len(own), rows), complex)
        full[np.searchsorted(own, at // rows), at % rows] = value
        return (own[:, None] + columns * np.arange(rows)).ravel(), turn(full, axis=1).ravel()

    turned = _by_block(df, F.floor(F.col("at") % rows / wide), along)
    return _by_block(turned, F.floor(F.floor(F.col("at") / rows) / high), across)


def _chirp(at: Column, n: int, sign: int) -> tuple[Column, Column]:
    angle = sign * np.pi * ((at * at) % (2 * n)) / n
    return F.cos(angle), F.sin(angle)


def _times(df: DataFrame, re: Column, im: Column) -> DataFrame:
    return df.select("at", (F.col("re") * re - F.col("im") * im).alias("re"), (F.col("re") * im + F.col("im") * re).alias("im"))


def fourier(df: DataFrame, n: int, inverse: bool = False, whole: int = WHOLE) -> DataFrame:
    """The transform of ``n`` places of (at, re, im) as (at, re, im); places without a row are 0, their order is free.

    The inverse is divided by ``n``. ``whole`` is the length up to which one task does it all.
    """
    if n < 1:
        return df.select(F.col("at").cast("long").alias("at"), F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im")).limit(0)
    if n <= whole and n & (n - 1):
        turn = np.fft.ifft if inverse else np.fft.fft

        def at_once(at, value):
            full = np.zeros(n, complex)
            full[at] = value
            return np.arange(n), turn(full)

        return _by_block(df, F.lit(0), at_once)
    if not n & (n - 1):
        return _power_of_two(df, n, inverse, whole)
    # k j = (k^2 + j^2 - (k - j)^2) / 2 makes the transform a convolution with a chirp.
    m = 1 << (2 * n - 1).bit_length()
    sign = 1 if inverse else -1
    chirped = _times(df, *_chirp(F.col("at"), n, sign))
    spark = df.sparkSession
    back = spark.range(-(n - 1), n).select(F.pmod("id", F.lit(m)).alias("at"), *(c.alias(name) for c, name in zip(_chirp(F.col("id"), n, -sign), ("re", "im"), strict=True)))
    one, two = _power_of_two(chirped, m, False, whole), _power_of_two(back, m, False, whole)
    both = one.join(two.select("at", F.col("re").alias("re2"), F.col("im").alias("im2")), "at")
    folded = _power_of_two(_times(both, F.col("re2"), F.col("im2")), m, True, whole).filter(F.col("at") < n)
    out = _times(folded, *_chirp(F.col("at"), n, sign))
    return out.select("at", (F.col("re") / n).alias("re"), (F.col("im") / n).alias("im")) if inverse else out


def self_products(df: DataFrame, n: int, whole: int = WHOLE) -> DataFrame:
    """Sums of value(i) value(i + lag) over (at, value) with ``n`` places: lag, total, for lags 0 to n - 1."""
    m = 1 << max(1, (2 * n - 1).bit_length())
    there = fourier(df.select(F.col("at").cast("long").alias("at"), F.col("value").cast("double").alias("re"), F.lit(0.0).alias("im")), m, whole=whole)
    power = there.select("at", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("re"), F.lit(0.0).alias("im"))
    return fourier(power, m, True, whole).filter(F.col("at") < n).select(F.col("at").alias("lag"), F.col("re").alias("total"))


def _correlated(x: np.ndarray, y: np.ndarray, first: int, count: int) -> np.ndarray:
    """Sums of x[i] y[i - m + first + count - 1] for ``count`` lags m from ``first`` on; y has as many values more than x as there are lags, less one."""
    if len(x) * count <= 1 << 14:
        return np.correlate(y, x, "valid")[::-1]
    size = 1 << (len(y) + len(x)).bit_length()
    both = np.fft.irfft(np.fft.rfft(y, size) * np.conj(np.fft.rfft(x, size)), size)
    return both[:count][::-1]


def lagged_products(x: np.ndarray, y: np.ndarray, i0: int, j0: int, first: int, limit: np.ndarray) -> np.ndarray:
    """For each lag m from ``first`` on the sum of x(i) y(i - m) over i below the lag's ``limit``.

    x begins at place ``i0`` and y at ``j0``. Where a part of the places and lags
    lies below the limits as a whole it's one convolution, parts beyond have
    none, and parts across are halved until they are small.
    """
    out = np.zeros(len(limit))
    # y with zeros around, so that every lag finds a place
    low, high = i0 - (first + len(limit) - 1), i0 + len(x) - first
    padded = np.zeros(max(high - low, 0))
    a, b = max(low, j0), min(high, j0 + len(y))
    if b > a:
        padded[a - low : b - low] = y[a - j0 : b - j0]

    def part(p0: int, p1: int, m0: int, m1: int) -> None:
        limits = limit[m0:m1]
        if p0 >= p1 or m0 >= m1 or limits.max() <= i0 + p0:
            return
        if limits.min() >= i0 + p1:
            k = p0 + len(limit) - m1  # the place in padded of the first place at the last lag
            out[m0:m1] += _correlated(x[p0:p1], padded[k : k + p1 - p0 + m1 - m0 - 1], first + m0, m1 - m0)
        elif (p1 - p0) * (m1 - m0) <= LEAF:
            i, m = np.arange(p0, p1)[:, None], np.arange(m0, m1)
            out[m0:m1] += np.where(i0 + i < limits, x[p0:p1, None] * padded[i + len(limit) - 1 - m], 0.0).sum(axis=0)
        elif p1 - p0 >= m1 - m0:
            part(p0, (p0 + p1) // 2, m0, m1)
            part((p0 + p1) // 2, p1, m0, m1)
        else:
            part(p0, p1, m0, (m0 + m1) // 2)
            part(p0, p1, (m0 + m1) // 2, m1)

    if len(x) and len(limit):
        part(0, len(x), 0, len(limit))
    return out
