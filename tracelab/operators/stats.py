"""Aggregates, histograms, fits and scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelab.session import kept

RANGES = 200  #: parts of a running sum over values
CUTS, HELD = 200, 4096  #: parts that a bracket of quantiles is cut in, and values of a group that are gathered at most


def _refined(rows: DataFrame, open_: DataFrame, by: list[str]) -> DataFrame:
    """The brackets (by, rank, a, b, below, inside) of ranks, narrower; ``found`` where a bracket's end is the value."""
    v = F.col("__v")
    inside = (v > F.col("a")) & (v < F.col("b"))
    cuts = rows.join(open_, by).filter(inside).groupBy(*by, "rank").agg(F.percentile_approx("__v", [i / CUTS for i in range(CUTS + 1)], 50 * CUTS).alias("cuts"))
    share = F.floor((F.col("rank") - F.col("below")) * CUTS / F.col("inside")).cast("int")
    narrow = kept(open_.join(cuts, [*by, "rank"]).withColumns({"low": F.get("cuts", F.greatest(share - 1, F.lit(0))), "high": F.get("cuts", F.least(share + 2, F.lit(CUTS)))}).drop("cuts"), "narrow-brackets")  # a second sketch may cut elsewhere
    counts = {"under": v < F.col("low"), "first": v == F.col("low"), "between": (v > F.col("low")) & (v < F.col("high"))}
    counted = rows.join(narrow, by).filter(inside).groupBy(*by, "rank").agg(*(F.count_if(c).alias(n) for n, c in counts.items()))
    known = narrow.join(counted, [*by, "rank"])
    start = F.col("below") + F.col("under") + F.col("first")
    found = F.when(F.col("rank") < start, F.col("low")).when(F.col("rank") >= start + F.col("between"), F.col("high"))
    return known.select(*by, "rank", F.col("low").alias("a"), F.col("high").alias("b"), start.alias("below"), F.col("between").alias("inside"), found.alias("found"))


def quantiles(df: DataFrame, by: list[str], value: str, probs: list[float], held: int = HELD) -> DataFrame:
    """Exact quantiles of every group, between neighbouring values by their distance: by, p, quantile.

    The ranks of all groups are bracketed at once by sketches of the values in
    the last bracket, each some hundredth as wide; an end of a bracket takes all
    its equals along. Brackets with at most ``held`` values are gathered, no
    others. Nulls don't count, values are finite, groups without values have no
    rows; a null in ``by`` is a group like any other.
    """
    own = [f"__g{i}" for i in range(len(by))] or ["__all"]
    groups = [F.struct(F.col(b).isNull().alias("none"), F.col(b).alias("it")).alias(g) for b, g in zip(by, own, strict=False)] or [F.lit(0).alias("__all")]
    rows = df.select(*groups, F.col(value).cast("double").alias("__v")).filter("__v is not null")
    sizes = kept(rows.groupBy(*own).agg(F.count("*").alias("n")).withColumn("p", F.explode(F.array(*map(F.lit, probs)).cast("array<double>"))).withColumn("at", F.col("p") * (F.col("n") - 1)), "ranks")
    ranks = sizes.select(*own, "n", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("rank")).distinct()
    end = F.lit(float("inf"))
    state = kept(ranks.select(*own, "rank", (-end).alias("a"), end.alias("b"), F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), F.lit(None).cast("double").alias("found")), "brackets")
    wide = F.col("found").isNull() & (F.col("inside") > held)
    settled, left = state.filter(~wide), state.filter(wide)
    while not left.isEmpty():
        state = kept(_refined(rows, left.drop("found"), own), "brackets")
        settled, left = settled.unionByName(state.filter(~wide)), state.filter(wide)
    near = rows.join(settled.filter("found is null"), own).filter((F.col("__v") > F.col("a")) & (F.col("__v") < F.col("b")))
    gathered = near.groupBy(*own, "rank").agg(F.sort_array(F.collect_list("__v")).alias("values"))
    values = settled.join(gathered, [*own, "rank"], "left").select(*own, "rank", F.coalesce("found", F.get("values", (F.col("rank") - F.col("below")).cast("int"))).alias("v"))
    low, high = (values.select(*own, F.col("rank").alias(f"{n}_rank"), F.col("v").alias(n)) for n in ("low", "high"))
    both = sizes.withColumns({"low_rank": F.floor("at"), "high_rank": F.ceil("at")}).join(low, [*own, "low_rank"]).join(high, [*own, "high_rank"])
    exact = F.when(F.col("low_rank") == F.col("high_rank"), F.col("low")).otherwise((F.col("high_rank") - F.col("at")) * F.col("low") + (F.col("at") - F.col("low_rank")) * F.col("high"))
    return both.select(*(F.col(g)["it"].alias(b) for g, b in zip(own, by, strict=False)), "p", exact.alias("quantile"))


def summary(df: DataFrame, by: list[str], values: list[str], held: int = HELD) -> DataFrame:
    """Median, mean and sample deviation of each value column: by, attr, med, avg, std.

    Medians are exact; a group with more than ``held`` values has its median by ``quantiles``.
    """
    long = kept(df.select(*by, F.explode(F.array(*(F.struct(F.lit(v).alias("attr"), F.col(v).cast("double").alias("v")) for v in values))).alias("a")).select(*by, "a.attr", "a.v"), "summary-values")
    moments = [F.avg("v").alias("avg"), F.stddev_samp("v").alias("std")]
    keys = [*by, "attr"]
    large = long.groupBy(*keys).agg(F.count("v").alias("n")).filter(F.col("n") > held).select(*(F.col(k).alias(f"__{k}") for k in keys))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    if large.isEmpty():
        return long.groupBy(*keys).agg(F.median("v").alias("med"), *moments)
    few = long.join(large, same, "left_anti").groupBy(*keys).agg(F.median("v").alias("med"), *moments)
    many = long.join(large, same, "left_semi")
    halves = quantiles(many, keys, "v", [0.5], held).select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("quantile").alias("med"))
    return few.unionByName(many.groupBy(*keys).agg(*moments).join(halves, same).select(*keys, "med", "avg", "std"))


def histogram(df: DataFrame, bins: int, value: str = "x") -> DataFrame:
    """``bins`` equal bins from least to largest value, the last one closed: bin, center, count, share, density.

    Empty bins are there too. ``density`` is the share divided by the bin's width.
    """
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.floor(F.coalesce(F.try_divide(F.col(value) - F.col("lo"), width), F.lit(0.0))), F.lit(bins - 1))
    counts = df.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("count"))
    grid = ends.select("lo", "hi", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    full = grid.join(counts, "bin", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    share = F.try_divide(F.col("count").cast("double"), F.col("n").cast("double"))
    return full.select("bin", (F.col("lo") + width * (F.col("bin") + 0.5)).alias("center"), "count", share.alias("share"), F.try_divide(share, width).alias("density"))


def width_bins(width: float, start: float, end: float) -> int:
    """How many bins ``width_histogram`` has."""
    return max(0, math.ceil((end + width - start) / width - 1e-12) - 1) if end > start else 0


def width_histogram(df: DataFrame, width: float, start: float, end: float, value: str = "x") -> DataFrame:
    """Bins of a fixed width with edges start, start + width, ... below end + width: bin, center, count.

    Values before the first or past the last edge are left out; the last bin is closed.
    """
    bins = width_bins(width, start, end)
    last = start + bins * width
    inside = df.filter((F.col(value) >= start) & (F.col(value) <= last))
    counts = inside.groupBy(F.least(F.floor((F.col(value) - start) / width), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("count"))
    grid = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return grid.join(counts, "bin", "left").select("bin", (start + width * (F.col("bin") + 0.5)).alias("center"), F.coalesce("count", F.lit(0)).alias("count"))


def log2_bins(n: Column) -> Column:
    return F.floor(F.log2(n))


def scott_width(n: Column, mean: Column) -> Column:
    return F.pow(12 / n, 1 / 3) * mean


def line_fit(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Least-squares line for each group: slope, intercept."""
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def survival(df: DataFrame, value: str = "x") -> DataFrame:
    """Kaplan-Meier curve with every event observed: value, survival, a row for each distinct value.

    Counts of distinct values come first, so ties don't multiply; the running
    sum goes over ranges with about as many distinct values each, and then
    inside each. The ranges are stored, as a sketch taken again may cut elsewhere.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("c"))
    ends = counts.agg(F.percentile_approx("value", [i / RANGES for i in range(1, RANGES)], 20 * RANGES).alias("cuts"), F.sum("c").alias("n"))
    placed = kept(counts.crossJoin(F.broadcast(ends)).withColumn("slot", F.size(F.filter("cuts", lambda cut: cut < F.col("value")))).drop("cuts"), "survival-slots")
    before = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("slot").agg(F.sum("c").alias("s")).select("slot", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("slot").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return placed.join(F.broadcast(totals), "slot").select("value", (1 - (F.sum("c").over(inside) + F.col("earlier")) / F.col("n")).alias("survival"))


def zscore(df: DataFrame, by: list[str], value: str, name: str = "z", sample: bool = False) -> DataFrame:
    """Distance from the group's mean in deviations (population, or sample with null as 0)."""
    spread = F.stddev_samp(value) if sample else F.stddev_pop(value)
    moments = df.groupBy(*by).agg(F.avg(value).alias("__m"), spread.alias("__s")) if by else df.agg(F.avg(value).alias("__m"), spread.alias("__s"))
    joined = df.join(moments, by) if by else df.crossJoin(F.broadcast(moments))
    z = F.try_divide(F.col(value) - F.col("__m"), F.col("__s"))
    return joined.withColumn(name, F.coalesce(z, F.lit(0.0)) if sample else z).drop("__m", "__s")


def group_sizes(df: DataFrame, label: str, values: list[str]) -> DataFrame:
    """Number, mean and sample deviation of each group."""
    return df.groupBy(label).agg(F.count("*").alias("n"), *(a for v in values for a in (F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_std"))))


def residual_square_sum(df: DataFrame, by: list[str], y: str, fitted: Column) -> DataFrame:
    d = F.col(y) - fitted
    return df.groupBy(*by).agg(F.sum(d * d).alias("ss_res"))


def best(df: DataFrame, by: list[str], choice: str, score: str) -> DataFrame:
    """The choice with the least score of each group; null and NaN scores never win."""
    ok = df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    return ok.groupBy(*by).agg(F.min(F.struct(F.col(score), F.col(choice))).alias("b")).select(*by, F.col(f"b.{choice}"), F.col(f"b.{score}"))


def pooled_curve(df: DataFrame, at: str, value: str, sem: str, traces: Column | int) -> DataFrame:
    """Mean of curves at each place, with the root of the sum of squared errors over the number of traces."""
    return df.groupBy(at).agg(F.avg(value).alias(value), F.sqrt(F.sum(F.col(sem) * F.col(sem)) / traces).alias(sem))


def within_one_deviation(df: DataFrame, value: str) -> DataFrame:
    """Rows whose value is less than one population deviation from the mean of all."""
    moments = df.agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    return df.crossJoin(F.broadcast(moments)).filter((F.col(value) > F.col("__m") - F.col("__s")) & (F.col(value) < F.col("__m") + F.col("__s"))).drop("__m", "__s")
