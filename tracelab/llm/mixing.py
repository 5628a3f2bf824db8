"""Mixing sources to target weights by weighted fair queueing (operator 2).

Every source's documents form a queue in a shuffled order that depends on
``doc_id`` alone. A document's virtual finish time is the number of words of
its queue up to its end divided by the source's target; a source whose target
is above its size goes through its queue again, up to ``MAX_EPOCHS`` times. All
copies are put in order of finish time and cut off at the total budget.

Built of DataFrame operations only. Cumulative sums are taken in two steps,
inside buckets and over the totals of buckets, so that neither a large source
nor the global order needs one task for all rows. The number of buckets grows
with the root of the number of rows, which bounds both steps alike.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelab.llm.common import SPACE, stored, table, text_or_empty

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = "mix"
IDENTITY = ("doc_id", "source", "text_hash", "nth")


def _identified(docs: DataFrame, doc_id: str, source: str, text: str) -> DataFrame:
    """The rows as structs, their sizes, and what tells them apart: ids may repeat, and so may whole rows."""
    words = F.regexp_count(text_or_empty(text), F.lit(f"[^{SPACE}]+")).cast("long")
    plain = docs.select(F.struct("*").alias("row"), words.alias("__size"), F.col(doc_id).alias("__id"), F.col(source).alias("__source"), F.xxhash64(text_or_empty(text)).alias("__hash"))
    return plain.withColumn("__nth", F.row_number().over(Window.partitionBy("__id", "__source", "__hash").orderBy("__hash")))


def _targets(sized: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """source, source_no, source_size, target; one row for each source, by code point, null last."""
    pattern = F.array(*map(F.lit, weights))
    n = F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("source_no", n).withColumn("weight", F.get(pattern, (F.col("source_no") - 1) % len(weights)))
    sources = sources.withColumn("cap", MAX_EPOCHS * F.col("source_size"))
    # By rising cap for each unit of weight: a source is capped if its share of
    # what the ones before it leave would exceed its cap.
    before = Window.orderBy(F.col("cap").cast("double") / F.col("weight"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything)
    left, weight_left = total - F.coalesce(F.sum("cap").over(before), F.lit(0)), F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    sources = sources.withColumn("capped", F.col("cap").cast("double") / F.col("weight") < left.cast("double") / weight_left.cast("double"))
    spare = total - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0))
    open_weight = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    shared = F.try_divide(spare.cast("double"), open_weight.cast("double")) * F.col("weight")
    return sources.select("source", "source_no", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.coalesce(shared, F.lit(0.0))).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """How often the mix takes each row of ``docs``, and when.

    A row's size is its number of words (null text: 0). Sources share all words
    by ``weights``, dealt in turn by code point, null last; a target is at most
    ``MAX_EPOCHS`` times its source's size. Returns for each row doc_id, source,
    text_hash, nth (which of equal rows), size, source_size, target, copies and
    taken (copies times size). Rows without words are never taken. An empty
    table gives no rows; repeated rows are rows of their own.
    """
    named = _identified(docs, doc_id, source, text)
    sized = stored(named.select(F.col("__id").alias("doc_id"), F.col("__source").alias("source"), F.col("__hash").alias("text_hash"), F.col("__nth").alias("nth"), F.col("__size").alias("size")), "mix-sizes")
    n_rows, budget = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    targets = _targets(sized, weights)
    # At finish time 1 each source has its target, less a document at most. By
    # `late` any source that still has copies has made up for all of these, so
    # the budget is spent, or no copy is left; none of the later ones is taken.
    room = targets.filter(F.col("target") < MAX_EPOCHS * F.col("source_size")).agg(F.min("target")).first()[0]
    spare = sized.groupBy("source").agg(F.max("size").alias("largest")).agg(F.coalesce(F.sum("largest"), F.lit(0))).first()[0]
    late = 1 + (spare + 1) / room if room else float("inf")
    known = sized.withColumn("key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")))
    known = known.join(targets.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    full = known.filter("size > 0")

    # Queue: a bucket holds the keys with the same first hexadecimal digits.
    digits = max(1, round(math.log(max(n_rows, 1), 16) / 2))
    order = ["key", "doc_id", "size", "text_hash", "nth"]
    own = Window.partitionBy("source_no", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = full.withColumn("bucket", F.substring("key", 1, digits)).withColumn("upto", F.sum("size").over(own))
    ahead = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = full.groupBy("source_no", F.substring("key", 1, digits).alias("bucket")).agg(F.sum("size").alias("words")).select("source_no", "bucket", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead"))
    queue = inside.join(offsets, ["source_no", "bucket"]).withColumn("upto", F.col("upto") + F.col("ahead"))

    # Global order: slots are ranges of finish time, equal in width, so a source
    # fills them evenly and each slot gets about as many words.
    slots = float(max(1, math.isqrt(MAX_EPOCHS * n_rows)))
    copies = stored(
        queue.withColumn("epoch", F.explode(F.array(*map(F.lit, range(MAX_EPOCHS)))))
        .withColumn("finish", (F.col("epoch") * F.col("source_size") + F.col("upto")).cast("double") / F.col("target"))
        .select("doc_id", "source", "text_hash", "nth", "size", "source_no", "source_size", "target", "key", "epoch", "finish", F.floor(F.col("finish") * slots).alias("slot"))
        .filter(F.col("finish") <= late),
        "mix-copies",
    )
    earlier = copies.groupBy("slot").agg(F.sum("size").alias("words")).select("slot", F.coalesce(F.sum("words").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    running = F.sum("size").over(Window.partitionBy("slot").orderBy("finish", "source_no", "epoch", *order).rowsBetween(Window.unboundedPreceding, 0))
    placed = copies.withColumn("running", running).join(earlier, "slot").withColumn("taken", F.col("running") + F.col("earlier") <= F.lit(budget))

    kept = ["doc_id", "source", "text_hash", "nth", "size", "source_size", "target"]
    counted = placed.groupBy(*kept).agg(F.sum(F.col("taken").cast("int")).alias("copies"))
    # Rows without words, and those whose first copy already comes too late.
    first = (F.col("upto").cast("double") / F.col("target"))
    rest = known.filter("size = 0").select(*kept).unionByName(queue.filter(first > late).select(*kept))
    return counted.unionByName(rest.withColumn("copies", F.lit(0).cast("long"))).withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The rows of the mix with all their columns, whatever their names, a row for each copy taken.

    Null ids and sources are values as others, null and empty texts are never
    taken, repeated rows are rows of their own; an empty table has no rows.
    """
    counts = mix(docs, doc_id=doc_id, source=source, text=text, **options).filter("copies > 0").select(*(F.col(c).alias(f"__m_{c}") for c in (*IDENTITY, "copies")))
    marked = _identified(docs, doc_id, source, text)
    pairs = zip(("__id", "__source", "__hash", "__nth"), IDENTITY, strict=True)
    match = [F.col(a).eqNullSafe(F.col(f"__m_{b}")) for a, b in pairs]
    return marked.join(counts, match).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__m_copies").cast("int")))).select("row.*")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, no, source_size, 3 * source_size AS cap, 1 + (no - 1) % 3 AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS no
        FROM d GROUP BY source)
), c AS (
  SELECT *, sum(source_size) OVER () AS total,
         CAST(cap AS DOUBLE) / weight
           < CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS DOUBLE)
             / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS capped
  FROM s WINDOW b AS (ORDER BY CAST(cap AS DOUBLE) / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, no, source_size, CAST(total AS BIGINT) AS total,
         CASE WHEN capped THEN CAST(cap AS DOUBLE)
              ELSE CAST(total - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0) AS DOUBLE)
                   / CAST(sum(CASE WHEN NOT capped THEN weight END) OVER () AS DOUBLE) * weight END AS target
  FROM c
), q AS (
  SELECT d.doc_id, d.k, d.size, t.no, t.source_size, t.target, t.total,
         CAST(sum(d.size) OVER (PARTITION BY t.no ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), x AS (
  SELECT q.*, e.epoch, CAST(e.epoch * source_size + upto AS DOUBLE) / target AS finish
  FROM q CROSS JOIN (SELECT unnest([0, 1, 2]) AS epoch) e WHERE size > 0
), r AS (
  SELECT *, sum(size) OVER (ORDER BY finish, no, epoch, k, doc_id, size ROWS UNBOUNDED PRECEDING) AS running FROM x
), g AS (
  SELECT doc_id, k, no, CAST(sum(CASE WHEN running <= total THEN size ELSE 0 END) AS BIGINT) AS taken FROM r GROUP BY doc_id, k, no
)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(g.taken, 0) AS taken
FROM q LEFT JOIN g ON q.doc_id IS NOT DISTINCT FROM g.doc_id AND q.no = g.no
"""
