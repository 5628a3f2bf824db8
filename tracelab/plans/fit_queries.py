"""Queries that fit mixtures; the SQL side iterates with recursive common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab import model
from tracelab.functions.projections import quantised as q
from tracelab.functions.projections import sql_quantised as sq
from tracelab.operators import kmeans, mixture

QUERIES, ORACLE_SQL = {}, {}
PINNED = [30.0, 120.0]
LEAST, MOST, TOLERANCE = mixture.LEAST_LOOPS, mixture.MOST_LOOPS, mixture.TOLERANCE


def query(sql: str | None = None):
    def keep(make):
        QUERIES[make.__name__] = make
        if sql:
            ORACLE_SQL[make.__name__] = sql
        return make

    return keep


def em_sql(kind: str, k: int = 2, pinned: list[float] | None = None, by: str | None = None, rows: str = "dwell", value: str = "x", name: str = "", most: int = MOST, tolerance: float = TOLERANCE) -> str:
    """The common table expressions of a fit by the library's rule of when to stop: data, state after every round, final."""
    names = mixture.KINDS[kind]
    t = "t" if kind == "gauss_exp" else "x"
    group = f"{by} AS g" if by else "0 AS g"
    first = []
    for j in range(k):
        first.append(f"1.0::DOUBLE / {k} AS f{j}")
        if kind != "exp":
            first += [f"{pinned[j] if pinned else f'quantile_cont(x, {(j + 0.5) / k})'}::DOUBLE AS m{j}", f"stddev_pop(x) / {k} AS s{j}"]
        if kind != "gauss":
            lo, hi = f"abs(avg({t}) - 0.5 * stddev_pop({t}))", f"(avg({t}) + 0.5 * stddev_pop({t}))"
            first.append(f"{lo} + ({hi} - {lo}) * {j} / {max(1, k - 1)} AS tau{j}")
    ln = []
    for j in range(k):
        part = f"ln(p.f{j})"
        if kind != "exp":
            part += f" - ln(p.s{j}) - 0.5 * ln(2 * pi()) - (d.x - p.m{j}) * (d.x - p.m{j}) / (2 * p.s{j} * p.s{j})"
        if kind != "gauss":
            part += f" - ln(p.tau{j}) - d.{t} / p.tau{j}"
        ln.append(part)
    shares = [f"1 / ({' + '.join(f'exp(({ln[i]}) - ({ln[j]}))' for i in range(k))}) AS r{j}" for j in range(k)]
    columns = [f"{n}{j}" for j in range(k) for n in names]
    new = []
    for j in range(k):
        new.append(f"sum(r{j}) / count(*) AS f{j}")
        if kind != "exp":
            new += [f"{f'{pinned[j]}::DOUBLE' if pinned else f'sum(r{j} * x) / sum(r{j})'} AS m{j}", f"sqrt(sum(r{j} * x * x) / sum(r{j}) - pow(sum(r{j} * x) / sum(r{j}), 2)) AS s{j}"]
        if kind != "gauss":
            new.append(f"sum(r{j} * {t}) / sum(r{j}) AS tau{j}")
    old = ", ".join(f"any_value({c}) AS old_{c}" for c in columns)
    moved = f"greatest({', '.join(f'abs({c} - old_{c})' for c in columns)})"
    return f"""data{name} AS (SELECT {group}, {value} AS x, t FROM {rows}),
state{name} AS (
  SELECT 0 AS loop, g, 1e9::DOUBLE AS moved, {', '.join(first)} FROM data{name} GROUP BY g
  UNION ALL
  SELECT loop + 1, g, {moved}, {', '.join(columns)} FROM (SELECT loop, g, {', '.join(new)}, {old} FROM (
    SELECT p.loop, d.g, d.x, d.t, {', '.join(f'p.{c}' for c in columns)}, {', '.join(shares)} FROM state{name} p JOIN data{name} d ON d.g = p.g
    WHERE p.loop < {LEAST} OR p.loop < {most} AND p.moved >= {tolerance}) GROUP BY loop, g)
), final{name} AS (SELECT g, moved < {tolerance} AS converged, {', '.join(columns)} FROM (SELECT *, max(loop) OVER (PARTITION BY g) AS last FROM state{name}) WHERE loop = last)"""


def components_sql(kind: str, k: int = 2, scale: int = 4) -> str:
    names = mixture.KINDS[kind]
    rows = " UNION ALL ".join(f"SELECT g, converged, {', '.join(f'{n}{j} AS {n}' for n in names)} FROM final" for j in range(k))
    order = "m" if "m" in names else "tau"
    return f""" SELECT g, converged, CAST(row_number() OVER (PARTITION BY g ORDER BY {order}) - 1 AS INTEGER) AS component, {', '.join(f'{sq(n, scale)} AS {n}' for n in names)} FROM ({rows})"""


def fit_sql(kind: str, **options) -> str:
    return f"WITH RECURSIVE {model.SQL}, {em_sql(kind, **options)}"


def ungrouped(sql: str) -> str:
    return f" SELECT * EXCLUDE (g) FROM ({sql})"


def fitted_rows(fits: list[mixture.Fit], df: DataFrame, kind: str, by: list[str] | None = None) -> DataFrame:
    rows = mixture.as_rows(fits, df, by)
    return rows.select(*(F.col(b).alias("g") for b in by or []), "component", "converged", *(q(n, 4).alias(n) for n in mixture.KINDS[kind]))


@query(fit_sql("exp") + ungrouped(components_sql("exp")))
def em_pem(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = model.dwells(spark, sf_dir)
    return fitted_rows(mixture.fit_mixture(d, "exp", 2), d, "exp")


@query(fit_sql("gauss") + ungrouped(components_sql("gauss")))
def em_gmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = model.dwells(spark, sf_dir)
    return fitted_rows(mixture.fit_mixture(d, "gauss", 2), d, "gauss")


@query(fit_sql("gauss_exp") + ungrouped(components_sql("gauss_exp")))
def em_gpem(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = model.dwells(spark, sf_dir)
    return fitted_rows(mixture.fit_mixture(d, "gauss_exp", 2), d, "gauss_exp")


@query(fit_sql("gauss_exp", pinned=PINNED) + ungrouped(components_sql("gauss_exp")))
def em_gpem_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = model.dwells(spark, sf_dir)
    return fitted_rows(mixture.fit_mixture(d, "gauss_exp", 2, pinned=PINNED), d, "gauss_exp")


@query(fit_sql("exp", by="from_state") + components_sql("exp"))
def em_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = model.dwells(spark, sf_dir)
    return fitted_rows(mixture.fit_mixture(d, "exp", 2, by=["from_state"]), d, "exp", ["from_state"])


@query(f"""WITH {model.SQL}, e AS (SELECT count(*) AS n, avg(x) AS tau FROM dwell)
SELECT {sq('1.0', 4)} AS f, {sq('tau', 4)} AS tau, {sq('-n * ln(tau) - n', 3)} AS ln_likelihood, {sq('2 - 2 * (-n * ln(tau) - n)', 3)} AS aic, {sq('ln(n) - 2 * (-n * ln(tau) - n)', 3)} AS bic FROM e""")
def em_aic_bic(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = model.dwells(spark, sf_dir)
    rows = mixture.as_rows(mixture.fit_mixture(d, "exp", 1), d)
    return rows.select(q("f", 4).alias("f"), q("tau", 4).alias("tau"), *(q(c, 3).alias(c) for c in ("ln_likelihood", "aic", "bic")))


@query(f"""WITH {model.SQL} SELECT trace_id, x AS value, t, CASE WHEN ln(0.4) - ln(40) - (x - 30) * (x - 30) / 3200 >= ln(0.6) - ln(90) - (x - 120) * (x - 120) / 16200 THEN 0 ELSE 1 END AS label FROM dwell""")
def em_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = mixture.Fit("gauss", {"f": [0.4, 0.6], "m": [30.0, 120.0], "s": [40.0, 90.0]})
    return mixture.predict(model.dwells(spark, sf_dir), fit).select("trace_id", F.col("x").alias("value"), "t", "label")


@query("""WITH RECURSIVE toss(h, t) AS (VALUES (5, 5), (9, 1), (8, 2), (4, 6), (7, 3)),
s AS (
  SELECT 0 AS loop, 0.3::DOUBLE AS a, 0.48::DOUBLE AS b
  UNION ALL
  SELECT loop + 1, sum(w * h) / sum(w * (h + t)), sum((1 - w) * h) / sum((1 - w) * (h + t))
  FROM (SELECT loop, h, t, 1 / (1 + exp((h * ln(b) + t * ln(1 - b)) - (h * ln(a) + t * ln(1 - a)))) AS w FROM s, toss WHERE loop < 60) GROUP BY loop
) """ + f"SELECT {sq('a', 9)} AS p_a, {sq('b', 9)} AS p_b FROM s WHERE loop = 60")
def em_coin(spark: SparkSession, sf_dir: str) -> DataFrame:
    tosses = spark.createDataFrame([(5, 5), (9, 1), (8, 2), (4, 6), (7, 3)], "heads int, tails int")
    a, b, _ = mixture.coin_mixture(tosses)
    return spark.createDataFrame([(a, b)], "p_a double, p_b double").select(q("p_a", 9).alias("p_a"), q("p_b", 9).alias("p_b"))


def choice_sql(most: int, criterion: str = "bic") -> str:
    """Fits of 1 to ``most`` exponentials to the dwells, their scores, and which of them has the least."""
    fits = ", ".join(em_sql("exp", k, value="t", name=f"_{k}") for k in range(1, most + 1))
    each = []
    for k in range(1, most + 1):
        parts = [f"ln(p.f{j}) - ln(p.tau{j}) - d.x / p.tau{j}" for j in range(k)]
        top = f"greatest({', '.join(parts)})" if k > 1 else parts[0]
        each.append(f"SELECT {k} AS k, any_value(p.converged) AS converged, count(*) AS n, sum({top} + ln({' + '.join(f'exp(({x}) - ({top}))' for x in parts)})) AS ln_likelihood FROM final_{k} p JOIN data_{k} d ON d.g = p.g")
    return f"""WITH RECURSIVE {model.SQL}, {fits}, score AS ({' UNION ALL '.join(each)}),
scored AS (SELECT *, 2 * (2 * k - 1) - 2 * ln_likelihood AS aic, (2 * k - 1) * ln(n) - 2 * ln_likelihood AS bic FROM score)
SELECT k::INTEGER AS k, converged, {sq('ln_likelihood', 2)} AS ln_likelihood, {sq('aic', 2)} AS aic, {sq('bic', 2)} AS bic, {criterion} = min({criterion}) OVER () AS chosen FROM scored"""


@query(choice_sql(5))
def em_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many components the criterion chooses, with the scores of all numbers."""
    d = model.dwells(spark, sf_dir)
    best, fits = mixture.choose_components(d, "exp", "BIC", 5, x="t")
    scores = mixture.as_rows(fits, d).select("k", "converged", "ln_likelihood", "aic", "bic").distinct()
    return scores.select("k", "converged", *(q(c, 2).alias(c) for c in ("ln_likelihood", "aic", "bic")), (F.col("k") == best).alias("chosen"))


@query(choice_sql(5, "aic") + " ORDER BY aic LIMIT 1")
def em_components_aic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of components with the least AIC."""
    d = model.dwells(spark, sf_dir)
    best, fits = mixture.choose_components(d, "exp", "AIC", 5, x="t")
    scores = mixture.as_rows(fits, d).filter(F.col("k") == best).select("k", "converged", "ln_likelihood", "aic", "bic").distinct()
    return scores.select("k", "converged", *(q(c, 2).alias(c) for c in ("ln_likelihood", "aic", "bic")), F.lit(True).alias("chosen"))


@query(f"WITH RECURSIVE {model.SQL}, {kmeans.kmeans_sql('dwell', 3, 'from_state')} SELECT g AS from_state, component::INTEGER AS component, {sq('f')} AS f, {sq('m', 4)} AS m, {sq('s', 4)} AS s, n::BIGINT AS n FROM clusters")
def kmeans_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the values of each state, from which Gaussian mixtures can start."""
    found = kmeans.kmeans(model.dwells(spark, sf_dir), 3, ["from_state"])
    return found.select("from_state", "component", q("f").alias("f"), q("m", 4).alias("m"), q("s", 4).alias("s"), "n")


@query(fit_sql("gauss", most=5000, tolerance=1e-9) + ungrouped(components_sql("gauss", scale=3)))
def em_restarts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeliest of six random starts, with leaps, which ends where long plain rounds end."""
    d = model.dwells(spark, sf_dir)
    fits = mixture.fit_mixture(d, "gauss", 2, first=mixture.random_starts(d, "gauss", [2], 6, 3), leaps=True, tolerance=1e-5, most=120)
    best = max((f for f in fits if f.ln_likelihood is not None), key=lambda f: f.ln_likelihood)
    return mixture.as_rows([best], d).select("component", "converged", *(q(n, 3).alias(n) for n in mixture.KINDS["gauss"]))
