"""Queries for reports: kinetics, bin rules, residuals, filters, time axes, simulations and tables behind plots."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab import model
from tracelab.functions import projections as P
from tracelab.functions.projections import quantised as q
from tracelab.functions.projections import sql_quantised as sq
from tracelab.operators import changepoint, clustering, features, generate, mixture, reshape, spectral, stats, windows
from tracelab.operators.generate import sql_dwell, sql_normal, sql_uniform
from tracelab.plans import pipelines, plots
from tracelab.plans.fit_queries import em_sql
from tracelab.plans.trace_queries import FPS, G1, G2, LAGS, VARIANCE_SQL
from tracelab.sources import sinks

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def keep(make):
        QUERIES[make.__name__] = make
        ORACLE_SQL[make.__name__] = f"WITH RECURSIVE {model.SQL}{sql}" if sql.lstrip().startswith(",") else f"WITH {model.SQL} {sql}"
        return make

    return keep


# Kinetics

KINETICS_SQL = f"""{VARIANCE_SQL}, line AS (
  SELECT trace_id, regr_slope(var_x, m / 10.0::DOUBLE) AS slope, regr_intercept(var_x, m / 10.0::DOUBLE) AS intercept, arg_max(var_x, m) AS last_var, arg_max(mean_x, m) AS last_mean FROM curve WHERE m <= 16 GROUP BY trace_id
), kept AS (SELECT * FROM line WHERE slope > (SELECT avg(slope) - stddev_pop(slope) FROM line) AND slope < (SELECT avg(slope) + stddev_pop(slope) FROM line)),
speed AS (SELECT trace_id, regr_slope(x, idx / 10.0::DOUBLE) AS velocity FROM trace GROUP BY trace_id),
kinetic AS (SELECT trace_id, slope, velocity, slope / velocity AS step, velocity * velocity / slope AS rate, (last_var - intercept) / last_mean AS randomness FROM kept JOIN speed USING (trace_id))"""


@query(f"{KINETICS_SQL} SELECT trace_id, {sq('step', 1)} AS step, {sq('rate', 6)} AS rate, {sq('randomness', 2)} AS randomness FROM kinetic")
def kinetic_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = spectral.kinetics(model.traces(spark, sf_dir), LAGS, FPS)
    return k.select("trace_id", q("step", 1).alias("step"), q("rate", 6).alias("rate"), q("randomness", 2).alias("randomness"))


@query(f"""{KINETICS_SQL} SELECT {sq('avg(step)', 1)} AS step_fit_avg, {sq('avg(rate)', 6)} AS rate_fit_avg, {sq('avg(randomness)', 2)} AS randomness_fit_avg,
  {sq('avg(slope) / avg(velocity)', 1)} AS step_avg_fit, {sq('avg(velocity) * avg(velocity) / avg(slope)', 6)} AS rate_avg_fit FROM kinetic""")
def kinetic_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits then mean, and mean then fit."""
    s = spectral.kinetic_summary(spectral.kinetics(model.traces(spark, sf_dir), LAGS, FPS))
    digits = {"step_fit_avg": 1, "rate_fit_avg": 6, "randomness_fit_avg": 2, "step_avg_fit": 1, "rate_avg_fit": 6}
    return s.select(*(q(c, d).alias(c) for c, d in digits.items()))


@query(f"{VARIANCE_SQL} SELECT m, {sq('avg(var_x)', 3)} AS var_x, {sq('sqrt(sum(sem_x * sem_x) / (SELECT count(DISTINCT trace_id) FROM trace))', 3)} AS sem_x FROM curve GROUP BY m")
def pooled_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean curve of all traces with its pooled error."""
    t = model.traces(spark, sf_dir)
    n = t.select("trace_id").distinct().count()
    return stats.pooled_curve(spectral.lag_variance(t, LAGS), "m", "var_x", "sem_x", n).select("m", q("var_x", 3).alias("var_x"), q("sem_x", 3).alias("sem_x"))


@query(", s AS (SELECT unnest(range(21)) AS i) SELECT DISTINCT greatest(1, floor((0.0::DOUBLE + 0.05::DOUBLE * i) * 12.5::DOUBLE + 1e-9))::BIGINT AS m FROM s WHERE i < 20")
def lag_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole lags for times from 0 to 1 second in steps of 0.05 at 12.5 frames a second."""
    return spark.createDataFrame([(m,) for m in spectral.lag_grid(0.0, 1.0, 0.05, 12.5)], "m long")


@query(f", s AS (SELECT from_state, avg(x) AS step, avg(t) AS tau, count(*) AS n FROM dwell GROUP BY from_state) SELECT {sq('sum(step * step / tau * n) / sum(n)', 4)} AS slope FROM s")
def expected_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = model.dwells(spark, sf_dir).groupBy("from_state").agg(F.avg("x").alias("step"), F.avg("t").alias("tau"), F.count("*").alias("n"))
    return spectral.expected_slope(s).select(q("slope", 4).alias("slope"))


@query(f""", e AS (SELECT trace_id, avg(x) FILTER (idx < 20) AS a, avg(x) FILTER (idx >= n - 20) AS b, max(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY trace_id) AS n FROM trace) GROUP BY trace_id)
SELECT trace_id, {sq('(b - a) / (n - 20 - 20)', 9)} AS per_frame, {sq('(b - a) / (n - 20 - 20) * 600', 6)} AS per_minute FROM e WHERE n <> 40""")
def level_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of level from the first to the last twenty frames of a trace."""
    t = model.traces(spark, sf_dir)
    ends = t.join(windows.lengths(t), "trace_id").groupBy("trace_id").agg(F.avg(F.when(F.col("idx") < 20, F.col("x"))).alias("a"), F.avg(F.when(F.col("idx") >= F.col("n") - 20, F.col("x"))).alias("b"), F.max("n").alias("n")).filter("n <> 40")
    place = F.lit(20), F.col("n") - 20
    return ends.select("trace_id", q(P.velocity(F.col("a"), F.col("b"), *place), 9).alias("per_frame"), q(P.velocity(F.col("a"), F.col("b"), *place, fps=FPS), 6).alias("per_minute"))


# Statistics

@query(f"SELECT trace_id, floor(log2(count(*)))::BIGINT AS bins, {sq('pow(12::DOUBLE / count(*), 1 / 3::DOUBLE) * avg(x)')} AS width FROM trace GROUP BY trace_id")
def bin_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*")
    return model.traces(spark, sf_dir).groupBy("trace_id").agg(stats.log2_bins(n).cast("long").alias("bins"), q(stats.scott_width(n, F.avg("x"))).alias("width"))


@query(f"SELECT l_returnflag, {sq('sum(pow(l_extendedprice / 1000 - (l_quantity * 1.5::DOUBLE + 0.5::DOUBLE), 2))', 2)} AS ss_res FROM lineitem GROUP BY l_returnflag")
def residual_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model.table(spark, sf_dir, "lineitem").withColumn("y", F.col("l_extendedprice") / 1000)
    return stats.residual_square_sum(rows, ["l_returnflag"], "y", F.col("l_quantity") * 1.5 + 0.5).select("l_returnflag", q("ss_res", 2).alias("ss_res"))


@query(f"SELECT vec_id, {sq('coalesce((embedding[1]::DOUBLE - avg(embedding[1]::DOUBLE) OVER ()) / nullif(stddev_samp(embedding[1]::DOUBLE) OVER (), 0), 0)')} AS a, {sq('coalesce((embedding[5]::DOUBLE - avg(embedding[5]::DOUBLE) OVER ()) / nullif(stddev_samp(embedding[5]::DOUBLE) OVER (), 0), 0)')} AS b FROM embeddings")
def standardised_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = model.table(spark, sf_dir, "embeddings").select("vec_id", *(F.get("embedding", F.lit(i)).cast("double").alias(f"v{i}") for i in (0, 4)))
    scores = clustering.standardised(v, ["v0", "v4"]).select("vec_id", vector_to_array("features").alias("s"))
    return scores.select("vec_id", q(F.get("s", F.lit(0))).alias("a"), q(F.get("s", F.lit(1))).alias("b"))


@query(f"""SELECT label, count(*) AS n, {', '.join(f'{sq(f"avg(embedding[{i + 1}]::DOUBLE)")} AS v{i}_mean, {sq(f"stddev_samp(embedding[{i + 1}]::DOUBLE)")} AS v{i}_std' for i in range(64))} FROM embeddings GROUP BY label""")
def cluster_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number, mean and deviation of all attributes of every cluster."""
    names = [f"v{i}" for i in range(64)]
    v = model.table(spark, sf_dir, "embeddings").select("label", *(F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)))
    return stats.group_sizes(v, "label", names).select("label", "n", *(q(f"{c}_{k}").alias(f"{c}_{k}") for c in names for k in ("mean", "std")))


# Filters, joins and time

@query(f"SELECT trace_id, idx, {sq('x')} AS x FROM trace WHERE x > 0.1::DOUBLE")
def values_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.above(model.traces(spark, sf_dir)).select("trace_id", "idx", q("x").alias("x"))


@query(f"SELECT aoi, idx, {sq('x')} AS amplitude FROM track WHERE x >= 20 AND x <= 150")
def bright_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    spots = model.tracks(spark, sf_dir).select("aoi", "idx", F.col("x").alias("amplitude"))
    return features.amplitude_between(spots, 20, 150).select("aoi", "idx", q("amplitude").alias("amplitude"))


@query(f", first AS (SELECT min(trace_id) AS a FROM trace) SELECT (trace_id - a)::BIGINT AS trace_id, {sq('idx / 10.0::DOUBLE')} AS t, {sq('x')} AS x FROM trace, first WHERE trace_id < a + 3 AND x < 100")
def block_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet of blocks of four columns (time, value, two more) with gaps, read as traces."""
    t = model.traces(spark, sf_dir)
    first = t.agg(F.min("trace_id")).first()[0]
    sheets = []
    for k in range(3):
        one = reshape.one_trace(t, "trace_id", first + k)
        sheets.append(one.select("idx", (F.col("idx") / F.lit(10.0)).alias(f"t{k}"), F.when(F.col("x") < 100, F.col("x")).otherwise(float("nan")).alias(f"x{k}"), F.lit(None).cast("double").alias(f"p{k}"), F.lit(0.0).alias(f"q{k}")))
    wide = reshape.side_by_side(sheets, "idx").drop("idx")
    return reshape.block_columns(wide).select("trace_id", q("t").alias("t"), q("x").alias("x"))


@query(f", a AS (SELECT trace_id, avg(x) AS mean FROM trace GROUP BY trace_id), b AS (SELECT trace_id, count(*) AS n FROM trace GROUP BY trace_id HAVING count(*) > 60) SELECT trace_id, idx, {sq('mean')} AS mean, n FROM trace JOIN a USING (trace_id) LEFT JOIN b USING (trace_id)")
def attributed_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = model.traces(spark, sf_dir)
    parts = [t.groupBy("trace_id").agg(F.avg("x").alias("mean")), windows.lengths(t).filter("n > 60")]
    return reshape.with_attributes(t, parts, "trace_id").select("trace_id", "idx", q("mean").alias("mean"), "n")


@query(f"SELECT trace_id, idx, {sq('CASE WHEN idx < 30 THEN idx * 0.25::DOUBLE ELSE idx / 10.0::DOUBLE END')} AS t FROM trace")
def time_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given times for the first frames, the others by their rate."""
    times = spark.range(30).select(F.col("id").alias("idx"), (F.col("id") * 0.25).alias("t"))
    return reshape.timed(model.traces(spark, sf_dir), FPS, times).select("trace_id", "idx", q("t").alias("t"))


@query("""SELECT from_state AS state, 0 AS component, 'component_tau_0' AS name, count(*) AS n FROM dwell GROUP BY from_state
UNION ALL SELECT from_state, 1, 'component_tau_1', count(*) FROM dwell GROUP BY from_state""")
def component_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = model.dwells(spark, sf_dir).groupBy(F.col("from_state").alias("state")).agg(F.count("*").alias("n"))
    named = F.explode(F.array(*(F.struct(F.lit(i).alias("component"), F.lit(P.component_name("tau", i)).alias("name")) for i in range(2))))
    return n.select("state", named.alias("c"), "n").select("state", "c.component", "c.name", "n")


# Fits

@query(f", {em_sql('exp', 1, by='from_state', value='t')} SELECT g AS state, {sq('f0', 4)} AS component_f_0, {sq('tau0', 4)} AS component_tau_0, 0.0::DOUBLE AS component_tau_1 FROM final")
def fit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits of each state side by side, missing components as 0."""
    d = model.dwells(spark, sf_dir)
    rows = mixture.as_rows(mixture.fit_mixture(d, "exp", 1, by=["from_state"], x="t"), d, ["from_state"])
    wide = sinks.fit_sheet(rows, "from_state", ["f", "tau"], 2)
    return wide.select(F.col("from_state").alias("state"), q("component_f_0", 4).alias("component_f_0"), q("component_tau_0", 4).alias("component_tau_0"), "component_tau_1")


@query(f""", short AS (SELECT from_state AS cond, x AS step, t AS dwell FROM dwell WHERE x < 150)
SELECT cond, 'dwell' AS fit, {sq('avg(dwell)', 4)} AS tau, NULL::DOUBLE AS m, NULL::DOUBLE AS s FROM short GROUP BY cond
UNION ALL SELECT cond, 'step_dwell', {sq('avg(dwell)', 4)}, {sq('avg(step)', 4)}, {sq('sqrt(avg(step * step) - avg(step) * avg(step))', 4)} FROM short GROUP BY cond""")
def step_dwell_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dwell and joint step-dwell fits of every condition."""
    d = model.dwells(spark, sf_dir).select(F.col("from_state").alias("cond"), F.col("x").alias("step"), F.col("t").alias("dwell"))
    return pipelines.step_dwell_fits(d, limit=150).select("cond", "fit", *(q(c, 4).alias(c) for c in ("tau", "m", "s")))


@query(f""", {em_sql('exp', 2, by="from_state || ':' || to_state", value='t')}
SELECT split_part(g, ':', 1) AS from_state, split_part(g, ':', 2) AS to_state, i AS component, {sq('CASE WHEN (i = 0) = (tau0 <= tau1) THEN f0 ELSE f1 END', 4)} AS f, {sq('CASE WHEN (i = 0) = (tau0 <= tau1) THEN tau0 ELSE tau1 END', 4)} AS tau FROM final, (SELECT unnest([0, 1]) AS i)""")
def transition_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dwell fits of every kind of transition."""
    d = model.dwells(spark, sf_dir).select("from_state", "to_state", F.col("t").alias("dwell"))
    return pipelines.transition_fits(d, ["from_state", "to_state"], 2).select("from_state", "to_state", "component", q("f", 4).alias("f"), q("tau", 4).alias("tau"))


CUBIC_ROWS = "SELECT l_quantity / 10 AS u, l_extendedprice / 1000 AS v FROM lineitem"


@query(f""", m AS (SELECT count(*)::DOUBLE AS n, sum(u ** 2) AS x2, sum(u ** 3) AS x3, sum(u ** 4) AS x4, sum(u ** 5) AS x5, sum(u ** 6) AS x6, sum(v * u) AS y1, sum(v * u ** 2) AS y2, sum(v * u ** 3) AS y3 FROM ({CUBIC_ROWS})),
s AS (
  SELECT 0 AS loop, 1.0::DOUBLE AS p1, 1.0::DOUBLE AS p2, 1.0::DOUBLE AS p3, {', '.join(f'0.0::DOUBLE AS a{k}, 0.0::DOUBLE AS b{k}' for k in (1, 2, 3))}, 1e9::DOUBLE AS moved
  UNION ALL
  SELECT loop + 1, p1 + d1, p2 + d2, p3 + d3, {', '.join(f'a{k}, b{k}' for k in (1, 2, 3))}, greatest(abs(d1), abs(d2), abs(d3)) FROM (
    SELECT loop, p1, p2, p3, {', '.join(f'a{k}, b{k}, -0.5 * (a{k} / (1 - pow(0.9::DOUBLE, loop + 1))) / (sqrt(b{k} / (1 - pow(0.999::DOUBLE, loop + 1))) + 1e-8) AS d{k}' for k in (1, 2, 3))} FROM (
      SELECT loop, p1, p2, p3, {', '.join(f'0.9 * a{k} + (1 - 0.9::DOUBLE) * g{k} AS a{k}, 0.999 * b{k} + (1 - 0.999::DOUBLE) * g{k} * g{k} AS b{k}' for k in (1, 2, 3))} FROM (
        SELECT s.*, 2 * (x2 * p1 + x3 * p2 + x4 * p3 - y1) / n AS g1, 2 * (x3 * p1 + x4 * p2 + x5 * p3 - y2) / n AS g2, 2 * (x4 * p1 + x5 * p2 + x6 * p3 - y3) / n AS g3
        FROM s, m WHERE loop < 4999 AND (loop < 50 OR moved >= 1e-3))))
) SELECT {', '.join(f'{sq(f"arg_max(p{k}, loop)", 4)} AS p{k}' for k in (1, 2, 3))}, max(loop) AS rounds FROM s""")
def cubic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cubic through the origin by batch Adam to its end."""
    rows = model.table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 10).alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    p, rounds = changepoint.cubic_descent(rows, standard=True)
    return spark.createDataFrame([(*map(float, p), rounds)], "p1 double, p2 double, p3 double, rounds int").select(*(q(c, 4).alias(c) for c in ("p1", "p2", "p3")), "rounds")


# Simulations and draws

@query(f"SELECT c AS component, id, {sq(f'CASE c WHEN 0 THEN {sql_normal(5, 6.0, 2.0)} ELSE {sql_normal(6, 12.0, 1.0)} END')} AS x FROM (SELECT unnest(range(200)) AS id), (SELECT unnest([0, 1]) AS c)")
def simulated_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.gauss_sample(spark, 200, [6.0, 12.0], [2.0, 1.0], 5).select("component", "id", q("x").alias("x"))


@query(f"SELECT c AS component, id, {sq(f'CASE c WHEN 0 THEN {sql_dwell(8, 0.5)} ELSE {sql_dwell(9, 4.0)} END')} AS x FROM (SELECT unnest(range(400)) AS id), (SELECT unnest([0, 1]) AS c)")
def simulated_dwells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.dwell_sample(spark, 400, [0.5, 4.0], 8).select("component", "id", q("x").alias("x"))


@query(f"SELECT id AS idx, {sq(f'CASE WHEN id < 400 THEN 20.0 WHEN id >= 1000 THEN 70.0 ELSE 20 + 50::DOUBLE * (id - 400) / 600 END + {sql_normal(4, 0.0, 5.0)}')} AS x FROM (SELECT unnest(range(2000)) AS id)")
def simulated_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.ramp_trace(spark, (20.0, 70.0), (400, 1000), 1000, 5.0, 4).select("idx", q("x").alias("x"))


@query(f""", ids AS (SELECT unnest(range(50)) AS id), event AS (
  SELECT 0 AS kind, id, {sql_normal(3, 5.0, 1.0)} AS step, greatest(1, floor({sql_dwell(4, 0.5)} * 100 + 0.5))::BIGINT AS stay FROM ids
  UNION ALL SELECT 1, id, {sql_normal(6, 10.0, 2.0)}, greatest(1, floor({sql_dwell(7, 1.0)} * 100 + 0.5))::BIGINT FROM ids
), placed AS (
  SELECT coalesce(sum(step) OVER w, 0) AS level, coalesce(sum(stay) OVER w, 0)::BIGINT AS began, stay
  FROM event WINDOW w AS (ORDER BY {sql_uniform(3, 'order', 'kind', 'id')}, kind, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), shown AS (SELECT level, unnest(range(began, began + stay)) AS idx FROM placed)
SELECT idx, {sq(f"level + {sql_normal(102, 0.0, 0.5, 'idx')}")} AS x FROM shown""")
def simulated_staircase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.staircase(spark, [(5.0, 1.0, 0.5), (10.0, 2.0, 1.0)], 50, 100.0, 0.5, seed=3).select("idx", q("x").alias("x"))


DRAWN_SQL = f""", numbered AS (SELECT trace_id, row_number() OVER (ORDER BY trace_id) - 1 AS ordinal FROM (SELECT DISTINCT trace_id FROM trace)),
pick AS (SELECT draw, floor({sql_uniform(1, 'draw', 'draw')} * (SELECT count(*) FROM numbered))::BIGINT AS ordinal FROM (SELECT unnest(range(20)) AS draw)),
drawn AS (SELECT draw AS trace_id, idx, x FROM pick JOIN numbered USING (ordinal) JOIN trace USING (trace_id)),
closing AS (SELECT trace_id, avg(x) AS level FROM (SELECT *, count(*) OVER (PARTITION BY trace_id) AS n FROM drawn) WHERE idx >= n - 20 GROUP BY trace_id),
shifted AS (SELECT trace_id, coalesce(sum(level) OVER (ORDER BY trace_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM closing),
joined AS (SELECT trace_id, idx, x + shift AS x FROM drawn JOIN shifted USING (trace_id))"""


@query(f"{DRAWN_SQL} SELECT trace_id, idx, {sq('x', 4)} AS x FROM joined")
def bootstrap_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces drawn with replacement and put end to end."""
    t = model.traces(spark, sf_dir)
    numbered = windows.numbered(t.select("trace_id").distinct(), ["trace_id"], "ordinal")
    drawn = reshape.resampled(t, numbered, 20, 1).select(F.col("draw").alias("trace_id"), "idx", "x")
    return windows.connected(drawn).select("trace_id", "idx", q("x", 4).alias("x"))


SPECTRUM_SQL = """, e AS (SELECT floor(min(x)) AS lo, ceil((max(x) + 50 - floor(min(x))) / 50 - 1e-12)::BIGINT - 1 AS bins FROM joined),
h AS (SELECT bin, count(*) AS count FROM (SELECT least(floor((x - lo) / 50)::BIGINT, bins - 1) AS bin FROM joined, e WHERE x >= lo AND x <= lo + 50 * bins) GROUP BY bin),
lags AS (SELECT unnest(range(bins)) AS lag, bins FROM e),
acf AS (SELECT lag, coalesce(sum(a.count * b.count), 0)::DOUBLE AS acf FROM lags LEFT JOIN h a ON true LEFT JOIN h b ON b.bin = a.bin + lag GROUP BY lag),
spectrum AS (SELECT k.lag AS k, 0.02::DOUBLE * k.lag / (k.bins - 1)::DOUBLE AS freq,
  sqrt(pow(sum(acf * cos(2 * pi() * ((k.lag * a.lag) % k.bins) / k.bins)), 2) + pow(sum(acf * sin(2 * pi() * ((k.lag * a.lag) % k.bins) / k.bins)), 2)) AS psd FROM acf a, lags k GROUP BY k.lag, k.bins)"""


@query(f"{DRAWN_SQL}{SPECTRUM_SQL} SELECT k, {sq('freq', 9)} AS freq, {sq('psd', 0)} AS psd, {sq('avg(psd) OVER (ORDER BY k ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)', 0)} AS smoothed FROM spectrum")
def bootstrapped_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power spectrum of bootstrapped traces, smoothed."""
    s = pipelines.step_spectrum(model.traces(spark, sf_dir), 0.02, draws=20, seed=1)
    return s.select(F.col("k").cast("long").alias("k"), q("freq", 9).alias("freq"), q("psd", 0).alias("psd"), q("smoothed", 0).alias("smoothed"))


@query(f"{DRAWN_SQL}{SPECTRUM_SQL} SELECT row_number() OVER (ORDER BY {sq('psd', 0)} DESC, k)::INTEGER AS place, k, {sq('psd', 0)} AS psd FROM spectrum")
def spectrum_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies by falling power."""
    s = pipelines.step_spectrum(model.traces(spark, sf_dir), 0.02, draws=20, seed=1).select(F.col("k").cast("long").alias("k"), q("psd", 0).alias("psd"))
    return windows.numbered(s.withColumn("least", -F.col("psd")), ["least", "k"], "place").select((F.col("place") + 1).cast("int").alias("place"), "k", "psd")


# Tables behind plots

@query(f", g AS (SELECT 0.0::DOUBLE + 500.0::DOUBLE / 199 * i AS x FROM (SELECT unnest(range(200)) AS i)) SELECT {sq('x')} AS x, {sq(f'0.4 * {G1}', 9)} AS component_0, {sq(f'0.6 * {G2}', 9)} AS component_1, {sq(f'0.4 * {G1} + 0.6 * {G2}', 9)} AS total FROM g")
def plot_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = mixture.Fit("gauss", {"f": [0.4, 0.6], "m": [100.0, 300.0], "s": [40.0, 90.0]})
    return plots.component_curves(spark, fit, 0.0, 500.0).select(q("x").alias("x"), *(q(c, 9).alias(c) for c in ("component_0", "component_1", "total")))


@query(f", g AS (SELECT 100.0::DOUBLE / 59 * i AS x, 50.0::DOUBLE / 59 * j AS t FROM (SELECT unnest(range(60)) AS i), (SELECT unnest(range(60)) AS j)) SELECT {sq('x')} AS x, {sq('t')} AS t, {sq('(exp(-(x - 30) * (x - 30) / 800) / (20 * sqrt(2 * pi())) * exp(-t / 12) / 12) * 1e6', 3)} AS density FROM g")
def plot_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = mixture.Fit("gauss_exp", {"f": [1.0], "m": [30.0], "s": [20.0], "tau": [12.0]})
    return plots.joint_surface(spark, fit, (0.0, 100.0), (0.0, 50.0)).select(q("x").alias("x"), q("t").alias("t"), q(F.col("density") * 1e6, 3).alias("density"))
