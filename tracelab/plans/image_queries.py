"""Queries on images, points and clusters, frame layouts, bootstrap and time blocks."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab import model
from tracelab.functions.projections import quantised as q
from tracelab.functions.projections import sql_quantised as sq
from tracelab.operators import clustering, imaging, outlines
from tracelab.session import kept, spread
from tracelab.sources.frames import frame_layout
from tracelab.streaming.blocks import time_blocks

DISTANCE = 1.5
QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def keep(make):
        QUERIES[make.__name__] = make
        if sql:
            ORACLE_SQL[make.__name__] = f"WITH RECURSIVE {model.SQL}{sql}" if sql.lstrip().startswith(",") else f"WITH {model.SQL} {sql}"
        return make

    return keep


@query("""SELECT label, CAST(i - 1 AS INTEGER) AS at, floor(avg(p)) AS v FROM (
  SELECT label, unnest(pixels) AS p, unnest(generate_series(1, len(pixels))) AS i FROM image) GROUP BY label, i""")
def stack_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    stacked = imaging.mean_image(model.images(spark, sf_dir), ["label"])
    return stacked.select("label", F.posexplode("pixels").alias("at", "v"))


@query(f"""SELECT frame_id, list_sum(pixels) AS total, {sq('list_sum(pixels) / 64')} AS mean,
  list_sum(list_transform(generate_series(0, 15), lambda i: pixels[(2 + i // 4) * 8 + 2 + i % 4 + 1])) AS inner FROM image""")
def aoi_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = imaging.crop("pixels", 8, F.lit(4), F.lit(4), 4)
    return model.images(spark, sf_dir).select("frame_id", imaging.total(F.col("pixels")).alias("total"), q(imaging.mean(F.col("pixels"))).alias("mean"), imaging.total(inner).alias("inner"))


@query("SELECT frame_id, (list_position(pixels, list_max(pixels)) - 1) % 8 AS x, (list_position(pixels, list_max(pixels)) - 1) // 8 AS y FROM image")
def aoi_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = imaging.peak(F.col("pixels"), 8)
    return model.images(spark, sf_dir).select("frame_id", x.alias("x"), y.alias("y"))


@query(f"""SELECT point_id, {sq('x')} AS x, {sq('y')} AS y FROM point a WHERE NOT EXISTS (
  SELECT 1 FROM point b WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) > 0 AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= {DISTANCE})""")
def min_distance_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imaging.far_apart(model.points(spark, sf_dir), DISTANCE).select("point_id", q("x").alias("x"), q("y").alias("y"))


@query(f""", o AS (SELECT *, sqrt(x * x + y * y) AS r, row_number() OVER (ORDER BY sqrt(x * x + y * y), point_id) AS i FROM point),
g AS (
  SELECT 0::BIGINT AS i, []::STRUCT(p BIGINT, x DOUBLE, y DOUBLE, r DOUBLE)[] AS kept
  UNION ALL
  SELECT o.i, CASE WHEN len(list_filter(kept, lambda k: NOT (abs(k.x - o.x) >= 10 OR abs(k.y - o.y) >= 10 OR abs(k.r - o.r) >= 10))) = 0
    THEN list_append(kept, {{'p': point_id, 'x': o.x, 'y': o.y, 'r': o.r}}) ELSE kept END
  FROM g JOIN o ON o.i = g.i + 1
) SELECT k.p AS point_id, {sq('k.x')} AS x, {sq('k.y')} AS y FROM (SELECT unnest(kept) AS k FROM g WHERE i = (SELECT max(i) FROM o))""")
def greedy_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imaging.spread_out(model.points(spark, sf_dir), 10.0).select("point_id", q("x").alias("x"), q("y").alias("y"))


@query(f""", o AS (SELECT p.*, e.label, sqrt(x * x + y * y) AS r, row_number() OVER (PARTITION BY label ORDER BY sqrt(x * x + y * y), point_id) AS i FROM point p JOIN embeddings e ON e.vec_id = p.point_id),
g AS (
  SELECT label, 0::BIGINT AS i, []::STRUCT(p BIGINT, x DOUBLE, y DOUBLE, r DOUBLE)[] AS kept FROM (SELECT DISTINCT label FROM o)
  UNION ALL
  SELECT o.label, o.i, CASE WHEN len(list_filter(kept, lambda k: NOT (abs(k.x - o.x) >= 10 OR abs(k.y - o.y) >= 10 OR abs(k.r - o.r) >= 10))) = 0
    THEN list_append(kept, {{'p': point_id, 'x': o.x, 'y': o.y, 'r': o.r}}) ELSE kept END
  FROM g JOIN o ON o.i = g.i + 1 AND o.label = g.label
) SELECT label, k.p AS point_id, {sq('k.x')} AS x, {sq('k.y')} AS y FROM (SELECT label, unnest(arg_max(kept, i)) AS k FROM g GROUP BY label)""")
def greedy_by_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = model.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), "label")
    return imaging.spread_out(model.points(spark, sf_dir).join(labels, "point_id"), 10.0, ["label"]).select("label", "point_id", q("x").alias("x"), q("y").alias("y"))


@query(f""", p AS (SELECT label AS contour, vec_id AS i, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
e AS (SELECT contour, x, y, coalesce(lead(x) OVER w, first(x) OVER w) AS x2, coalesce(lead(y) OVER w, first(y) OVER w) AS y2 FROM p WINDOW w AS (PARTITION BY contour ORDER BY i)),
s AS (SELECT contour, sum(sqrt(pow(x2 - x, 2) + pow(y2 - y, 2))) AS perimeter, sum(x * y2 - x2 * y) / 2 AS a, sum((x + x2) * (x * y2 - x2 * y)) AS mx, sum((y + y2) * (x * y2 - x2 * y)) AS my FROM e GROUP BY contour)
SELECT contour, {sq('perimeter')} AS perimeter, {sq('abs(a)')} AS area, {sq('mx / (6 * a)')} AS cx, {sq('my / (6 * a)')} AS cy, {sq('2 * abs(a) / perimeter')} AS radius FROM s WHERE perimeter <> 0 AND a <> 0""")
def contour_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = model.table(spark, sf_dir, "embeddings").select(F.col("label").alias("contour"), F.col("vec_id").alias("i"), F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    return imaging.polygon_moments(p).select("contour", *(q(c).alias(c) for c in ("perimeter", "area", "cx", "cy", "radius")))


LEVEL = 140  #: grey value above which pixels are bright
#: Every side of a bright pixel with a dark one beyond it, the side after it, and the walks from each side
#: until a smaller one comes. Walks that come back to where they began are the outlines.
OUTLINES_SQL = f""", p AS (SELECT frame_id, i % 8 AS x, i // 8 AS y FROM (SELECT frame_id, unnest(range(64)) AS i, unnest(pixels) AS v FROM image) WHERE v > {LEVEL}),
step AS (SELECT * FROM (VALUES (0, -1, 0), (1, 0, -1), (2, 1, 0), (3, 0, 1)) s(side, dx, dy)),
side AS (SELECT p.*, s.side, s.dx, s.dy, t.dx AS nx, t.dy AS ny, (y * 8 + x) * 4 + s.side AS n FROM p CROSS JOIN step s JOIN step t ON t.side = (s.side + 1) % 4
  WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.frame_id = p.frame_id AND q.x = p.x + s.dx AND q.y = p.y + s.dy)),
after AS MATERIALIZED (SELECT s.frame_id, s.n, CASE WHEN c.x IS NOT NULL THEN (c.y * 8 + c.x) * 4 + (side + 3) % 4 WHEN a.x IS NOT NULL THEN (a.y * 8 + a.x) * 4 + side ELSE (s.y * 8 + s.x) * 4 + (side + 1) % 4 END AS m
  FROM side s LEFT JOIN p c ON c.frame_id = s.frame_id AND c.x = s.x + dx + nx AND c.y = s.y + dy + ny LEFT JOIN p a ON a.frame_id = s.frame_id AND a.x = s.x + nx AND a.y = s.y + ny),
walk AS (SELECT frame_id, n AS head, n, m, 0 AS step FROM after
  UNION ALL SELECT w.frame_id, head, a.n, a.m, step + 1 FROM walk w JOIN after a ON a.frame_id = w.frame_id AND a.n = w.m WHERE w.m > head),
cycle AS (SELECT w.*, n // 4 % 8 AS x, n // 32 AS y, n % 4 AS side FROM walk w SEMI JOIN (SELECT frame_id, head FROM walk WHERE m = head) USING (frame_id, head)),
visit AS (SELECT *, coalesce(lag(n // 4) OVER (PARTITION BY frame_id, head ORDER BY step), last(n // 4) OVER (PARTITION BY frame_id, head ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) <> n // 4 AS new,
  sum(CASE side WHEN 2 THEN x + 1 WHEN 0 THEN -x ELSE 0 END) OVER (PARTITION BY frame_id, head) AS area, dense_rank() OVER (PARTITION BY frame_id ORDER BY head) - 1 AS outline FROM cycle),
seen AS (SELECT *, sum(new::INTEGER) OVER (PARTITION BY frame_id, head ORDER BY step) AS v, sum(new::INTEGER) OVER (PARTITION BY frame_id, head) AS all_, max(CASE WHEN step = 0 THEN new::INTEGER END) OVER (PARTITION BY frame_id, head) AS v0 FROM visit)
"""


@query(f"{OUTLINES_SQL} SELECT frame_id, outline::INTEGER AS outline, area < 0 AS hole, abs(area)::BIGINT AS area, (CASE WHEN all_ = 0 THEN 0 ELSE (v - v0 + all_) % all_ END)::INTEGER AS i, x::INTEGER AS x, y::INTEGER AS y FROM seen WHERE new OR all_ = 0 AND step = 0")
def outline_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines of the bright parts of all images, and of the holes in them, point by point."""
    return outlines.outline_points(model.images(spark, sf_dir), LEVEL)


@query(""", f AS (SELECT range AS file, 1000 + 37 * range AS size FROM range(6)),
h AS (SELECT *, size // 100 AS held, coalesce(sum(size // 100) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f)
SELECT CAST(before + i AS BIGINT) AS frame_id, 'file-' || file AS path, i * 100 AS "offset" FROM (SELECT *, unnest(range(held)) AS i FROM h)""")
def frame_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.range(6).select(F.col("id").alias("file"), F.concat(F.lit("file-"), F.col("id")).alias("path"), (1000 + 37 * F.col("id")).alias("size"))
    return frame_layout(files, 100)


@query(f"SELECT user_id AS trace_id, date_trunc('day', ts) AS start, count(*) AS n, {sq('avg(value)')} AS mean, {sq('stddev_samp(CASE WHEN value > 0 THEN value END)')} AS bm FROM events GROUP BY ALL")
def time_block_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = model.table(spark, sf_dir, "events").select(F.col("user_id").alias("trace_id"), "ts", F.col("value").alias("x"))
    return time_blocks(e).select("trace_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", q("mean").alias("mean"), q("bm").alias("bm"))


@query()
def track_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spot parameters of two beads in made-up frames of 60 by 60."""
    beads = spark.createDataFrame([(0, 20.0, 20.0), (1, 40.0, 38.0)], "aoi int, x double, y double")
    x, y = F.col("p") % 60, F.floor(F.col("p") / 60)
    bead = lambda cx, cy: 120 * F.exp(-(F.pow(x - cx, 2) + F.pow(y - cy, 2)) / (2 * 2.5**2))
    frames = spark.range(40).select(F.col("id").alias("frame_id"), F.explode(F.sequence(F.lit(0), F.lit(3599))).alias("p"))
    lit = frames.select("frame_id", "p", (10 + bead(20.3, 20.6) + bead(40.1, 38.4) + 2 * F.randn(7)).alias("v"))
    packed = lit.groupBy("frame_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda s: s["v"]).alias("pixels"))
    return imaging.track(packed.select("frame_id", F.lit(60).alias("h"), F.lit(60).alias("w"), "pixels"), beads, 20, 10.0)


def _main_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id and ``projection``, the two main axes of the standardised embeddings, stored."""
    v = spread(model.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    each = v.select("vec_id", *(F.get("embedding", F.lit(i)).cast("double").alias(f"v{i}") for i in range(64)))
    return kept(clustering.projected(clustering.standardised(each, [f"v{i}" for i in range(64)])).select("vec_id", "projection"), "axes")


@query()
def pca_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings standardised, projected to two components and clustered by the least BIC."""
    best, _ = clustering.clustered(_main_axes(spark, sf_dir), shapes=False)
    return best.select("vec_id", "label")



@query(f""", v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(generate_series(1, len(embedding))) AS pos FROM embeddings),
z AS (SELECT vec_id, pos, coalesce((x - avg(x) OVER (PARTITION BY pos)) / nullif(stddev_samp(x) OVER (PARTITION BY pos), 0), 0) AS z FROM v),
a AS (SELECT list(line ORDER BY i) AS a FROM (SELECT i, list(s ORDER BY j) AS line FROM (
  SELECT p.pos AS i, q.pos AS j, sum(p.z * q.z) / (SELECT count(*) - 1 FROM embeddings) AS s FROM z p JOIN z q USING (vec_id) GROUP BY 1, 2) GROUP BY i)),
way1 AS (SELECT 0 AS loop, list_transform(range(64), lambda i: 1 + i / 64.0::DOUBLE) AS v FROM a UNION ALL
  SELECT loop + 1, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) FROM (SELECT loop, list_transform(a, lambda line: list_dot_product(line, v)) AS w FROM way1, a WHERE loop < {{AXES_LOOPS}})),
one AS (SELECT a, v, list_dot_product(v, list_transform(a, lambda line: list_dot_product(line, v))) AS l FROM a, way1 WHERE loop = {{AXES_LOOPS}}),
b AS (SELECT list_transform(range(1, 65), lambda i: list_transform(range(1, 65), lambda j: a[i][j] - l * v[i] * v[j])) AS b FROM one),
way2 AS (SELECT 0 AS loop, list_transform(range(64), lambda i: 1 + i / 64.0::DOUBLE) AS v FROM b UNION ALL
  SELECT loop + 1, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) FROM (SELECT loop, list_transform(b, lambda line: list_dot_product(line, v)) AS w FROM way2, b WHERE loop < {{AXES_LOOPS}})),
two AS (SELECT list_dot_product(v, list_transform(b, lambda line: list_dot_product(line, v))) AS l FROM b, way2 WHERE loop = {{AXES_LOOPS}})
SELECT component, {sq('l', 6)} AS variance, {sq('l / total', 6)} AS share, 0.0::DOUBLE AS residual FROM (
  SELECT 0 AS component, l FROM one UNION ALL SELECT 1, l FROM two), (SELECT list_sum(list_transform(range(1, 65), lambda i: a[i][i])) AS total FROM a)""".replace("{AXES_LOOPS}", "3000"))
def principal_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two axes of most variance of all standardised embeddings, with their residuals."""
    v = model.table(spark, sf_dir, "embeddings").select("vec_id", *(F.get("embedding", F.lit(i)).cast("double").alias(f"v{i}") for i in range(64)))
    found = clustering.principal_axes(clustering.standardised(v, [f"v{i}" for i in range(64)]), 2)
    return found.select("component", q("variance", 6).alias("variance"), q("share", 6).alias("share"), q("residual", 6).alias("residual"))


@query(f""", v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
d AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))) AS away FROM v a, v b GROUP BY ALL),
n AS (SELECT label, count(*) AS n FROM v GROUP BY label),
s AS (SELECT vec_id, any_value(o.n) AS n, sum(away) FILTER (own = other) / nullif(any_value(o.n) - 1, 0) AS a, min(away / t.n) FILTER (own <> other) AS b
  FROM d JOIN n o ON o.label = d.own JOIN n t ON t.label = d.other GROUP BY vec_id)
SELECT 'label' AS labelling, {sq('avg(CASE WHEN n > 1 THEN (b - a) / greatest(a, b) ELSE 0 END)', 6)} AS silhouette FROM s""")
def label_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well their labels part all embeddings."""
    v = model.table(spark, sf_dir, "embeddings").select("label", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    return clustering.silhouettes(v, ["label"]).select("labelling", q("silhouette", 6).alias("silhouette"))


@query()
def cluster_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixtures of two to nine clusters of the embeddings' two main axes: k, bic, silhouette."""
    _, scores = clustering.clustered(_main_axes(spark, sf_dir))
    return spark.createDataFrame([(s["k"], float(s["bic"]), float(s["silhouette"])) for s in scores], "k int, bic double, silhouette double")


@query(f"SELECT from_state, {sq('count(*) / sum(count(*)) OVER ()', 6)} AS f, {sq('avg(x)')} AS m, {sq('stddev_pop(x)')} AS s, count(*) AS n FROM dwell GROUP BY from_state")
def label_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares, means and deviations that hard labels give, with states as labels."""
    found = clustering.label_moments(model.dwells(spark, sf_dir), "from_state")
    return found.select("from_state", q("f", 6).alias("f"), q("m").alias("m"), q("s").alias("s"), "n")
