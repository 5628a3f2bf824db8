"""Connected components of links between ids, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelab.llm.common import HOT_KEYS, Scratch

HUB = 1000  #: links that make a node a hub


def components(links: DataFrame, tables: Scratch | None = None) -> DataFrame:
    """node, label for every id in ``links`` (a, b): label is the smallest id of its component.

    Each round a node takes the smallest label around it, and then the label
    of that label, so chains halve. Labels are stored each round; none reach
    the driver, which reads only how many changed. Hubs, of which there are at
    most ``HOT_KEYS``, give their labels to the nodes around them by a
    broadcast, so no join has their links in one task.
    """
    tables, n = tables or Scratch(links.sparkSession, "components"), 2 * links.count()
    both = tables.keep(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "node-links", n)
    hubs = tables.keep(both.groupBy("b").agg(F.count("*").alias("n")).filter(F.col("n") > max(HUB, n // HOT_KEYS)).select("b"), "node-hubs", 1)
    some = not hubs.isEmpty()
    labels = tables.keep(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "node-labels", n)
    while True:
        known = labels.withColumnRenamed("node", "b")
        if some:
            near = both.join(F.broadcast(known.join(F.broadcast(hubs), "b", "left_semi")), "b").unionByName(both.join(F.broadcast(hubs), "b", "left_anti").join(known, "b"))
        else:
            near = both.join(known, "b")
        around = near.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jumps = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = tables.keep(lower.join(jumps, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "node-labels", n)
        labels = moved.select("node", "label")
        if moved.filter("old <> label").isEmpty():
            tables.drop("node-links", "node-hubs")
            return labels
