"""The tables behind plots: curves and surfaces of fitted mixtures on even grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab.functions import densities as D
from tracelab.operators.mixture import Fit


def grid(spark: SparkSession, lo: float, hi: float, n: int, name: str = "x") -> DataFrame:
    """``n`` even places from ``lo`` to ``hi``, both included."""
    return spark.range(n).select((F.lit(lo) + (hi - lo) / max(1, n - 1) * F.col("id")).alias(name))


def _sum(parts: list[Column]) -> Column:
    return reduce(Column.__add__, parts)


def component_curves(spark: SparkSession, fit: Fit, lo: float, hi: float, n: int = 200) -> DataFrame:
    """x, a column for each component and their sum: densities, or survival for exponential fits."""
    p = fit.ordered()
    parts = D.gauss_mixture("x", p["f"], p["m"], p["s"]) if fit.kind != "exp" else D.exp_survival("x", p["f"], p["tau"])
    return grid(spark, lo, hi, n).select("x", *(c.alias(f"component_{i}") for i, c in enumerate(parts)), _sum(parts).alias("total"))


def joint_surface(spark: SparkSession, fit: Fit, x: tuple[float, float], t: tuple[float, float], n: int = 60) -> DataFrame:
    """x, t and the joint density of a gauss_exp fit."""
    p = fit.ordered()
    both = grid(spark, *x, n).crossJoin(grid(spark, *t, n, "t"))
    return both.select("x", "t", _sum(D.gauss_exp_mixture("x", "t", p["f"], p["m"], p["s"], p["tau"])).alias("density"))
