"""k-means of one value, for all groups at once, with seeds drawn in rounds of oversampling.

Equal values are one point with a weight. The first seed of a group is the
point with the least hash; in each of ``ROUNDS`` rounds every point is drawn
with a chance that grows with its weight and its squared distance from the
seeds so far, about 2 k at a time, so a group's seeds stay few at any number of
rows. Seeds are weighted by the points nearest to them and reduced to k, the
heaviest first and then those with the most weight times squared distance.
Means then move until none does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelab.session import kept

ROUNDS, MOST_LOOPS, STILL = 3, 300, 1e-9  #: STILL is how far a mean moves at most, as a share of itself, when it is settled
FINE = 1_000_000  #: parts of a unit that hashes of values tell apart


def chance(seed: int, loop: int, value: Column) -> Column:
    """A number from 0 up to 1 by a hash of the seed, the round and the value."""
    named = F.concat_ws(":", F.lit(f"{seed}:{loop}"), F.floor(value * FINE).cast("string"))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def _nearest(value: str, centres: str) -> Column:
    """The place of the nearest of an array, the first of equals."""
    away = F.transform(centres, lambda c: F.abs(F.col(value) - c))
    return F.array_position(away, F.array_min(away)).cast("int")


def _beside(points: DataFrame, table: DataFrame) -> DataFrame:
    """Points beside their group's row of a small table; Spark broadcasts it if it is small."""
    return points.join(table, "g")


def kmeans(df: DataFrame, k: int, by: list[str] | None = None, value: str = "x", seed: int = 0) -> DataFrame:
    """The clusters of each group by rising mean: by, component, f (share of the rows), m, s (deviation), n.

    Nulls are left out. A group with fewer distinct values than ``k`` has as
    many clusters as values; a centre that loses all its points goes.
    """
    by = by or []
    group = F.struct(*(F.struct(F.col(b).isNull().alias("none"), F.col(b).alias("it")).alias(f"b{i}") for i, b in enumerate(by))) if by else F.struct(F.lit(0).alias("b0"))
    rows = df.filter(F.col(value).isNotNull()).select(group.alias("g"), F.col(value).cast("double").alias("x"))
    points = kept(rows.groupBy("g", "x").agg(F.count("*").alias("c")), "kmeans-points")

    first = points.groupBy("g").agg(F.min(F.struct(chance(seed, 0, F.col("x")).alias("u"), "x")).alias("b"))
    seeds = kept(first.select("g", F.array("b.x").alias("seeds")), "kmeans-seeds")
    for loop in range(1, ROUNDS + 1):
        far = _beside(points, seeds).withColumn("d", F.array_min(F.transform("seeds", lambda s: (F.col("x") - s) * (F.col("x") - s))))
        cost = far.groupBy("g").agg(F.sum(F.col("c") * F.col("d")).alias("cost"))
        drawn = _beside(far, cost).filter(chance(seed, loop, F.col("x")) * F.col("cost") < 2 * k * F.col("c") * F.col("d"))
        more = drawn.groupBy("g").agg(F.sort_array(F.collect_list("x")).alias("more"))
        seeds = kept(seeds.join(more, "g", "left").select("g", F.array_sort(F.array_union("seeds", F.coalesce("more", F.array().cast("array<double>")))).alias("seeds")), "kmeans-seeds")

    weighted = kept(_beside(points, seeds).groupBy("g", F.get("seeds", _nearest("x", "seeds") - 1).alias("x")).agg(F.sum("c").alias("c")), "kmeans-weights")
    heaviest = Window.partitionBy("g").orderBy(F.desc("score"), "x")
    chosen = weighted.withColumn("score", F.col("c").cast("double")).withColumn("no", F.row_number().over(heaviest)).filter("no = 1").groupBy("g").agg(F.collect_list("x").alias("centres"))
    for _ in range(1, k):
        far = weighted.join(chosen, "g").withColumn("score", F.col("c") * F.array_min(F.transform("centres", lambda s: (F.col("x") - s) * (F.col("x") - s)))).filter("score > 0")
        best = far.withColumn("no", F.row_number().over(heaviest)).filter("no = 1").select("g", F.col("x").alias("next"))
        chosen = chosen.join(best, "g", "left").select("g", F.array_compact(F.concat("centres", F.array("next"))).alias("centres"))
    centres = kept(chosen.select("g", F.array_sort("centres").alias("centres")), "kmeans-centres")

    points = points.persist()
    try:
        for _ in range(MOST_LOOPS):
            near = _beside(points, centres).withColumn("j", _nearest("x", "centres"))
            means = near.groupBy("g", "j").agg((F.sum(F.col("c") * F.col("x")) / F.sum("c")).alias("m"))
            moved = means.groupBy("g").agg(F.sort_array(F.collect_list("m")).alias("new")).join(centres, "g")
            shift = F.aggregate(F.zip_with("new", "centres", lambda a, b: F.coalesce(F.abs(a - b) / F.greatest(F.abs(b), F.lit(1.0)), F.lit(1.0))), F.lit(0.0), lambda a, b: F.greatest(a, b))
            state = kept(moved.select("g", F.col("new").alias("centres"), (shift > STILL).alias("moves")), "kmeans-centres")
            centres = state.select("g", "centres")
            if state.filter("moves").isEmpty():
                break
        near = _beside(points, centres).withColumn("j", _nearest("x", "centres"))
        c, x = F.col("c"), F.col("x")
        m = F.col("sx") / F.col("n")
        # around the centre, so that no digits are lost
        out = F.get("centres", F.col("j") - 1)
        sums = near.withColumn("o", out).groupBy("g", "j").agg(F.sum(c).alias("n"), F.sum(c * x).alias("sx"), F.sum(c * (x - F.col("o")) * (x - F.col("o"))).alias("sq"), F.first("o").alias("o"))
        spread = F.sqrt(F.greatest(F.col("sq") / F.col("n") - (m - F.col("o")) * (m - F.col("o")), F.lit(0.0)))
        sizes = sums.groupBy("g").agg(F.sum("n").alias("all"))
        made = sums.join(sizes, "g").select(*(F.col(f"g.b{i}.it").alias(b) for i, b in enumerate(by)), (F.col("j") - 1).alias("component"), (F.col("n") / F.col("all")).alias("f"), m.alias("m"), spread.alias("s"), "n")
        return kept(made, "kmeans")
    finally:
        points.unpersist()


def kmeans_sql(rows: str, k: int, by: str, seed: int = 0) -> str:
    """The same in SQL, with what ``rows`` (by, x) are: the table expressions up to ``clusters``."""
    u = lambda loop: f"CAST('0x' || substr(md5('{seed}:{loop}:' || CAST(CAST(floor(x * {FINE}) AS BIGINT) AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"
    least = lambda names: f"list_min(list_transform({names}, lambda s: (x - s) * (x - s)))"
    nearest = lambda names: f"list_position(list_transform({names}, lambda s: abs(x - s)), list_min(list_transform({names}, lambda s: abs(x - s))))"
    parts = [f"points AS (SELECT {by} AS g, x, count(*) AS c FROM {rows} WHERE x IS NOT NULL GROUP BY 1, 2)", f"seeds0 AS (SELECT g, [arg_min(x, {{'u': {u(0)}, 'x': x}})] AS seeds FROM points GROUP BY g)"]
    for loop in range(1, ROUNDS + 1):
        parts += [
            f"far{loop} AS (SELECT g, x, c, {least('seeds')} AS d FROM points JOIN seeds{loop - 1} USING (g))",
            f"drawn{loop} AS (SELECT g, list(x) AS more FROM (SELECT *, sum(c * d) OVER (PARTITION BY g) AS cost FROM far{loop}) WHERE {u(loop)} * cost < {2 * k} * c * d GROUP BY g)",
            f"seeds{loop} AS (SELECT g, list_sort(list_distinct(seeds || coalesce(more, []))) AS seeds FROM seeds{loop - 1} LEFT JOIN drawn{loop} USING (g))",
        ]
    parts.append(f"weighted AS (SELECT g, seeds[{nearest('seeds')}] AS x, sum(c) AS c FROM points JOIN seeds{ROUNDS} USING (g) GROUP BY 1, 2)")
    parts.append("chosen1 AS (SELECT g, [arg_min(x, {'c': -c, 'x': x})] AS centres FROM weighted GROUP BY g)")
    for j in range(2, k + 1):
        parts += [
            f"best{j} AS (SELECT g, arg_min(x, {{'s': -score, 'x': x}}) AS next FROM (SELECT g, x, c * {least('centres')} AS score FROM weighted JOIN chosen{j - 1} USING (g)) WHERE score > 0 GROUP BY g)",
            f"chosen{j} AS (SELECT g, CASE WHEN next IS NULL THEN centres ELSE centres || [next] END AS centres FROM chosen{j - 1} LEFT JOIN best{j} USING (g))",
        ]
    parts.append(f"""way AS (
  SELECT 0 AS loop, g, list_sort(centres) AS centres, true AS moves FROM chosen{k}
  UNION ALL
  SELECT loop + 1, g, list(m ORDER BY m), list_max(list_transform(list_zip(list(m ORDER BY m), any_value(old)), lambda p: coalesce(abs(p[1] - p[2]) / greatest(abs(p[2]), 1), 1))) > {STILL}
  FROM (SELECT loop, g, j, any_value(centres) AS old, sum(c * x) / sum(c) AS m
        FROM (SELECT w.loop, w.g, w.centres, x, c, {nearest('w.centres')} AS j FROM way w JOIN points p ON p.g = w.g WHERE w.moves AND w.loop < {MOST_LOOPS})
        GROUP BY loop, g, j)
  GROUP BY loop, g
)""")
    parts.append("ends AS (SELECT g, arg_max(centres, loop) AS centres FROM way GROUP BY g)")
    parts.append(f"clusters AS (SELECT g, j - 1 AS component, sum(c) / sum(sum(c)) OVER (PARTITION BY g) AS f, sum(c * x) / sum(c) AS m, sum(c) AS n, sqrt(greatest(sum(c * (x - o) * (x - o)) / sum(c) - pow(sum(c * x) / sum(c) - any_value(o), 2), 0)) AS s FROM (SELECT *, centres[j] AS o FROM (SELECT g, x, c, centres, {nearest('centres')} AS j FROM points JOIN ends USING (g))) GROUP BY g, j)")
    return ",\n".join(parts)
