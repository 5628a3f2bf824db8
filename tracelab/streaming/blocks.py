"""Block means and spreads of traces over event time, for streams of events.

The batch operators count rows; on a stream a block is a span of event time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def time_blocks(events: DataFrame, length: str = "1 day", late: str = "1 hour", key: str = "trace_id", time: str = "ts", value: str = "x", factor: float = 1.0) -> DataFrame:
    """key, start, n, mean, bm of each span of ``length``; events later than ``late`` are dropped on a stream."""
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark(time, late)
    spread = F.stddev_samp(F.when(F.col(value) > 0, F.col(value))) * factor
    return timed.groupBy(key, F.window(time, length).alias("w")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), spread.alias("bm")).select(key, F.col("w.start").alias("start"), "n", "mean", "bm")
