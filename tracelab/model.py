"""The tables that stand for traces, tracks and points, as views of the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab.operators.windows import framed, indexed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trace_id, idx, ts, event_type, x: each user's events, numbered month by month in order of time."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("trace_id"), "ts", "event_id", "event_type", F.col("value").alias("x"))
    return indexed(e, "trace_id", ["ts", "event_id"], bucket=F.trunc("ts", "month"))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trace_id, idx, x: the values of each user's events in order of time."""
    return _events(spark, sf_dir).select("trace_id", "idx", "x")


def tracks(spark: SparkSession, sf_dir: str, fps: float = 10.0) -> DataFrame:
    """Bead tracks: x is the value, y the value of the next event (the last row repeats), sx and sy from both."""
    rows = traces(spark, sf_dir).select(F.col("trace_id").alias("aoi"), "idx", (F.col("idx") / F.lit(fps)).alias("t"), "x")
    both = framed(rows, 0, 1, {"y": lambda w: F.last("x").over(w)}, "aoi")
    return both.withColumns({"sx": F.col("x") / 100 + 1, "sy": F.col("y") / 100 + 1})


def dwells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trace_id, from_state, to_state, x (the value), t (hours until the next event)."""
    after = {"to_state": lambda w: F.last("event_type").over(w), "__ts": lambda w: F.last("ts").over(w), "__n": lambda w: F.count("*").over(w)}
    e = framed(_events(spark, sf_dir), 0, 1, after).filter("__n = 2")
    gap = (F.unix_micros(F.col("__ts").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / F.lit(3.6e9)
    return e.select("trace_id", F.col("event_type").alias("from_state"), "to_state", "x", gap.alias("t")).filter(F.col("t") > 0)


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_id, h, w, pixels: each embedding as an image of 8 by 8, values 0 to 255."""
    v = table(spark, sf_dir, "embeddings")
    pixels = F.transform("embedding", lambda x: F.floor(F.least(F.greatest(x.cast("double") * 256 + 128, F.lit(0.0)), F.lit(255.0))).cast("double"))
    return v.select(F.col("vec_id").alias("frame_id"), F.lit(8).alias("h"), F.lit(8).alias("w"), "label", pixels.alias("pixels"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """point_id, x, y on a plane of about 100 by 100."""
    v = table(spark, sf_dir, "embeddings")
    at = lambda i: F.get("embedding", F.lit(i)).cast("double") * 100 + 50
    return v.select(F.col("vec_id").alias("point_id"), at(0).alias("x"), at(1).alias("y"))


#: The same tables in SQL, as common table expressions.
SQL = """
trace AS (
  SELECT user_id AS trace_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS idx, value AS x
  FROM events
), track AS (
  SELECT aoi, idx, t, x, y, x / 100 + 1 AS sx, y / 100 + 1 AS sy
  FROM (SELECT trace_id AS aoi, idx, idx / 10.0::DOUBLE AS t, x,
               coalesce(lead(x) OVER (PARTITION BY trace_id ORDER BY idx), x) AS y FROM trace)
), dwell AS (
  SELECT * FROM (
    SELECT user_id AS trace_id, event_type AS from_state, lead(event_type) OVER w AS to_state, value AS x,
           (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 3.6e9::DOUBLE AS t
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE t > 0
), image AS (
  SELECT vec_id AS frame_id, label,
         list_transform(embedding, lambda x: floor(least(greatest(x::DOUBLE * 256 + 128, 0), 255))) AS pixels
  FROM embeddings
), point AS (
  SELECT vec_id AS point_id, embedding[1]::DOUBLE * 100 + 50 AS x, embedding[2]::DOUBLE * 100 + 50 AS y FROM embeddings
)
"""
