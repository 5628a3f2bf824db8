"""Running and block operators along traces.

A trace is rows (key, idx, x) with idx 0, 1, 2, ... No operator needs a whole
trace in one task: rows are dealt by stretches of ``STRETCH`` places. For frames
of a bounded width the rows near a border go to both sides of it; running values
are taken inside stretches and carried from one to the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelab.session import kept

STRETCH = 100_000


def indexed(df: DataFrame, key: str, order: list[str], idx: str = "idx", bucket: Column | None = None) -> DataFrame:
    """Numbers the rows of each trace from 0 in the given order.

    ``bucket`` cuts a trace in parts that follow each other in that order (such
    as the day of a time stamp); then each part is numbered by itself and moved
    by the size of the parts before, so that a very long trace isn't one task.
    """
    if bucket is None:
        return df.withColumn(idx, (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("long"))
    cut = df.withColumn("__bucket", bucket)
    sizes = cut.groupBy(key, "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col(key).alias("__key"), F.col("__bucket").alias("__of"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy(key, "__bucket").orderBy(*order)) - 1
    joined = cut.join(offsets, F.col(key).eqNullSafe(F.col("__key")) & F.col("__bucket").eqNullSafe(F.col("__of")))
    return joined.withColumn(idx, (own + F.col("__before")).cast("long")).drop("__bucket", "__key", "__of", "__before")


def running_sums(df: DataFrame, columns: dict[str, Column], key: str = "trace_id", idx: str = "idx", stretch: int = STRETCH) -> DataFrame:
    """Adds the sums of all rows of a trace up to each: inside its stretch, and over the stretches before."""
    cut = df.withColumns({"__part": F.floor(F.col(idx) / stretch)} | {f"__v_{n}": c for n, c in columns.items()})
    totals = cut.groupBy(key, "__part").agg(*(F.sum(f"__v_{n}").alias(f"__s_{n}") for n in columns))
    before = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(key, "__part", *(F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0.0)).alias(f"__s_{n}") for n in columns))
    own = Window.partitionBy(key, "__part").orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.join(carried, [key, "__part"]).withColumns({n: F.sum(f"__v_{n}").over(own) + F.col(f"__s_{n}") for n in columns})
    return out.drop("__part", *(f"__{k}_{n}" for n in columns for k in "vs"))


def framed(df: DataFrame, before: int, after: int, columns: dict[str, callable], key: str = "trace_id", idx: str = "idx", stretch: int = STRETCH) -> DataFrame:
    """Adds columns over the frame from ``before`` rows back to ``after`` rows on.

    ``columns`` maps a name to a function from the window to a Column.
    """
    if max(before, after) >= stretch:
        raise ValueError("a frame has to be smaller than a stretch")
    part, at = F.floor(F.col(idx) / stretch), F.col(idx) % stretch
    lent = F.filter(F.array(F.when(at >= stretch - before, part + 1), F.when(at < after, part - 1)), lambda p: p.isNotNull() & (p >= 0))
    both = df.withColumn("__own", part).withColumn("__part", F.explode(F.concat(F.array(part), lent)))
    w = Window.partitionBy(key, "__part").orderBy(idx).rowsBetween(-before, after)
    out = both.withColumns({name: make(w) for name, make in columns.items()})
    return out.filter(F.col("__part") == F.col("__own")).drop("__part", "__own")


def earlier_sum(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows before each in the given order, 0 at the first.

    Rows are sorted in ranges; a range adds the sums of those before it, of
    which there is one row each, so no task puts all rows in order.
    """
    ranged = kept(df.withColumn("__v", value).repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("__range").agg(F.sum("__v").alias("__s")).select("__range", F.sum("__s").over(before).alias("__before"))
    own = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast(ranged.schema["__v"].dataType)
    return ranged.join(F.broadcast(totals), "__range").withColumn(name, F.coalesce(F.sum("__v").over(own), none) + F.coalesce("__before", none)).drop("__v", "__range", "__before")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds the number of each row from 0 in the given order, by ranges."""
    return earlier_sum(df, order, F.lit(1).cast("long"), name)


def lengths(df: DataFrame, key: str = "trace_id") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def moving_average(df: DataFrame, window: int, mode: str = "sliding", key: str = "trace_id", idx: str = "idx", value: str = "x") -> DataFrame:
    """Mean of the last ``window`` values (fewer at the start), or of whole blocks of them.

    ``sliding`` gives a row for each row, ``fixing`` one for each full block; a
    remainder is left out.
    """
    if mode == "sliding":
        return framed(df, window - 1, 0, {"ma": lambda w: F.avg(value).over(w)}, key, idx)
    if mode != "fixing":
        raise ValueError(f"mode is sliding or fixing, not {mode!r}")
    return blocks(df, window, [F.avg(value).alias("ma")], key, idx)


def blocks(df: DataFrame, window: int, aggregates: list[Column], key: str = "trace_id", idx: str = "idx") -> DataFrame:
    """Aggregates of each full block of ``window`` rows: key, block, aggregates."""
    grouped = df.groupBy(key, F.floor(F.col(idx) / window).alias("block")).agg(F.count("*").alias("__n"), *aggregates)
    return grouped.filter(F.col("__n") == window).drop("__n")


def _spread(value: str, factor: float) -> Column:
    return F.stddev_samp(F.when(F.col(value) > 0, F.col(value))) * factor


def brownian_motion(df: DataFrame, window: int = 20, factor: float = 1.0, mode: str = "sliding", key: str = "trace_id", idx: str = "idx", value: str = "x", time: str | None = None) -> DataFrame:
    """Spread of the valid (positive) values in windows that are full; null with fewer than two.

    A sliding window is placed at its first row. With ``time`` the mean time of
    the window is added as t.
    """
    if mode == "fixing":
        return blocks(df, window, [_spread(value, factor).alias("bm"), *([F.avg(time).alias("t")] if time else [])], key, idx)
    if mode != "sliding":
        raise ValueError(f"mode is sliding or fixing, not {mode!r}")
    made = {"bm": lambda w: F.stddev_samp(F.when(F.col(value) > 0, F.col(value))).over(w) * factor, "__full": lambda w: F.count("*").over(w)}
    if time:
        made["t"] = lambda w: F.avg(time).over(w)
    kept = [key, idx, "bm", *(["t"] if time else [])]
    return framed(df, 0, window - 1, made, key, idx).filter(F.col("__full") == window).select(*kept)


def gapped_block_mean(df: DataFrame, window: int = 20, key: str = "trace_id", idx: str = "idx", value: str = "x") -> DataFrame:
    """Block means of traces with gaps: null where half of a window or more is missing.

    The last block may be short, and a trace's very last row is left out.
    """
    last = df.groupBy(key).agg((F.max(idx)).alias("__last"))
    rows = df.join(last, key)
    # the last row still opens its block
    grouped = rows.groupBy(key, F.floor(F.col(idx) / window).alias("block"))
    inside = F.col(idx) < F.col("__last")
    missing = F.count_if(inside & F.col(value).isNull())
    return grouped.agg(F.when(missing < window / 2, F.avg(F.when(inside, F.col(value)))).alias("mean"))


def lag_differences(df: DataFrame, m: int, key: str = "trace_id", idx: str = "idx", value: str = "x") -> DataFrame:
    """x[i] - x[i-m] on the part of a trace whose length is a multiple of ``m``."""
    n = lengths(df, key)
    out = framed(df, m, 0, {"__first": lambda w: F.first(value).over(w), "__count": lambda w: F.count("*").over(w)}, key, idx)
    return out.filter(F.col("__count") == m + 1).join(n, key).filter(F.col(idx) < F.floor(F.col("n") / m) * m).select(key, idx, (F.col(value) - F.col("__first")).alias("dx"))


def repaired(df: DataFrame, low: float, high: float, key: str = "trace_id", idx: str = "idx", value: str = "x", stretch: int = STRETCH) -> DataFrame:
    """Values out of (low, high) replaced by the last one inside; nothing before the first."""
    cut = df.withColumns({"__part": F.floor(F.col(idx) / stretch), "__ok": F.when((F.col(value) > low) & (F.col(value) < high), F.col(value))})
    lasts = cut.groupBy(key, "__part").agg(F.max(F.when(F.col("__ok").isNotNull(), F.struct(idx, "__ok")))["__ok"].alias("__last"))
    before = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(key, "__part", F.last("__last", ignorenulls=True).over(before).alias("__last"))
    own = Window.partitionBy(key, "__part").orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    filled = F.coalesce(F.last("__ok", ignorenulls=True).over(own), F.col("__last"))
    return cut.join(carried, [key, "__part"]).withColumn(value, filled).drop("__part", "__ok", "__last")


def connected(df: DataFrame, tail: int = 20, key: str = "trace_id", idx: str = "idx", value: str = "x") -> DataFrame:
    """Traces put end to end: each starts from the sum of the earlier ones' closing levels.

    The closing level is the mean of the last ``tail`` rows. One row for each
    trace takes part in the running sum, which goes by ranges of traces.
    """
    closing = df.join(lengths(df, key), key).filter(F.col(idx) >= F.col("n") - tail).groupBy(key).agg(F.avg(value).alias("level"))
    offsets = earlier_sum(closing, [key], F.col("level"), "shift").select(key, "shift")
    return df.join(offsets, key).withColumn(value, F.col(value) + F.col("shift")).drop("shift")


def expanding_spread(df: DataFrame, order: str, value: str, name: str, key: str = "trace_id") -> DataFrame:
    """Sample deviation of all values up to each row; null at the first."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.stddev_samp(value).over(w))


def positions(events: DataFrame, order: str = "idx", step: str = "step", key: str = "trace_id") -> DataFrame:
    """Cumulative position after each step; ``order`` is the events' number in their trace."""
    return running_sums(events, {"position": F.col(step)}, key, order)
