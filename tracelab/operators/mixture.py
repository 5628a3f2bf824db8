"""Mixtures fitted by expectation-maximisation.

The data stay distributed: an iteration joins them with a small table of the
parameters and sums by fit; a row for each fit reaches the driver. The fits of
all groups, numbers of components and restarts share the rounds, and a row is
compared with the fits of its own group alone. Responsibilities are taken in
the log domain with the largest term taken out.
"""

from __future__ import annotations

import hashlib
import math
import random
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tracelab.functions import densities as D
from tracelab.operators import kmeans, stats

KINDS = {"gauss": ("f", "m", "s"), "exp": ("f", "tau"), "gauss_exp": ("f", "m", "s", "tau")}
FREE = {"gauss": 3, "exp": 2, "gauss_exp": 4}  #: parameters of a component, one less over all
TOLERANCE, LEAST_LOOPS, MOST_LOOPS, LEAST_SIGMA = 1e-2, 20, 500, 1.0
BROADCAST_FITS = 50_000  #: rows of the parameter table, of some 200 bytes, that are broadcast; more are joined by a shuffle

Params = dict[str, list[float]]


def ln_components(kind: str, params: Params, x: str = "x", t: str = "t") -> list[Column]:
    if kind == "gauss":
        return D.ln_gauss_mixture(x, params["f"], params["m"], params["s"])
    if kind == "exp":
        return D.ln_exp_mixture(x, params["f"], params["tau"])
    return D.ln_gauss_exp_mixture(x, t, params["f"], params["m"], params["s"], params["tau"])


@dataclass
class Fit:
    """A model of a group, its way and whether it has settled."""

    kind: str
    params: Params
    group: tuple = ()
    pinned: list[float] | None = None
    history: list[Params] = field(default_factory=list)
    converged: bool = False
    n: int = 0
    ln_likelihood: float = float("nan")
    rounds: int = 0
    trail: list[Params] = field(default_factory=list)
    behind: tuple[Params, float] | None = None  #: where a leap began, and the likelihood that it has to reach

    @property
    def k(self) -> int:
        return len(self.params["f"])

    def aic(self) -> float:
        return 2 * (FREE[self.kind] * self.k - 1) - 2 * self.ln_likelihood

    def bic(self) -> float:
        return (FREE[self.kind] * self.k - 1) * math.log(self.n) - 2 * self.ln_likelihood

    def ordered(self) -> Params:
        """Parameters by rising mean (or time constant)."""
        by = self.params["m" if "m" in self.params else "tau"]
        order = sorted(range(self.k), key=lambda i: by[i])
        return {name: [v[i] for i in order] for name, v in self.params.items()}


def start_exp(mean: float, sd: float, k: int) -> Params:
    lo, hi = abs(mean - 0.5 * sd), mean + 0.5 * sd
    return {"f": [1 / k] * k, "tau": [lo + (hi - lo) * i / (k - 1) if k > 1 else lo for i in range(k)]}


def start_gauss(quantiles: list[float], sd: float, k: int) -> Params:
    return {"f": [1 / k] * k, "m": list(quantiles), "s": [max(sd / k, 1e-9)] * k}


def starts(df: DataFrame, kind: str, ks: list[int], by: list[str], x: str, t: str) -> list[Fit]:
    """Deterministic first parameters of every group for each number of components."""
    tau = t if kind == "gauss_exp" else x
    probs = sorted({(i + 0.5) / k for k in ks for i in range(k)})
    made = [F.count("*").alias("n"), F.avg(tau).alias("tm"), F.stddev_pop(tau).alias("ts"), F.stddev_pop(x).alias("xs")]
    middle: dict[tuple, dict[float, float]] = {}
    for row in stats.quantiles(df, by, x, probs).collect() if kind != "exp" else []:  # some rows for each group
        middle.setdefault(tuple(row[b] for b in by), {})[row["p"]] = row["quantile"]
    fits = []
    for row in (df.groupBy(*by).agg(*made) if by else df.agg(*made)).collect():  # a row for each group
        group = tuple(row[b] for b in by)
        for k in ks:
            params: Params = {}
            if kind != "exp":
                params |= start_gauss([middle[group][(i + 0.5) / k] for i in range(k)], row["xs"], k)
            if kind != "gauss":
                params |= {n: v for n, v in start_exp(row["tm"], row["ts"], k).items() if n not in params}
            fits.append(Fit(kind, {n: params[n] for n in KINDS[kind]}, group, n=row["n"]))
    return fits


def kmeans_starts(df: DataFrame, ks: int | list[int], by: list[str] | None = None, x: str = "x", seed: int = 0) -> list[Fit]:
    """First parameters of Gaussian mixtures from the clusters of k-means, for ``fit_mixture(..., first=...)``."""
    by, fits = by or [], {}
    for k in [ks] if isinstance(ks, int) else ks:
        for row in kmeans.kmeans(df, k, by, x, seed).orderBy("m").collect():  # k rows for each group
            fit = fits.setdefault((k, *(row[b] for b in by)), Fit("gauss", {n: [] for n in KINDS["gauss"]}, tuple(row[b] for b in by)))
            for name in KINDS["gauss"]:
                fit.params[name].append(max(row[name], 1e-9) if name == "s" else row[name])
            fit.n += row["n"]
    return list(fits.values())


def _table(fits: list[Fit], by: list[str], df: DataFrame) -> DataFrame:
    """A row for each fit: its number, its group, and for every component what the log density needs.

    That is a - (x - m)^2 c - t d with a, m, c and d of the component; components
    that a fit doesn't have are null.
    """
    most, rows = max(f.k for f in fits), []
    for i, fit in enumerate(fits):
        p, cells = fit.params, []
        for j in range(fit.k):
            a = math.log(p["f"][j]) if p["f"][j] > 0 else -math.inf
            m = c = d = 0.0
            if "m" in p:
                m, s = p["m"][j], p["s"][j]
                a, c = a - math.log(s) - D.HALF_LN_2PI, 1 / (2 * s * s)
            if "tau" in p:
                a, d = a - (math.log(p["tau"][j]) if p["tau"][j] > 0 else -math.inf), 1 / p["tau"][j] if p["tau"][j] > 0 else math.inf
            cells += [a, m, c, d]
        rows.append((i, *fit.group, *cells, *[None] * (4 * (most - fit.k))))
    # by Arrow the rows become a local relation, which needs no job
    kinds = {f.name: f.dataType for f in df.schema}
    schema = StructType([StructField("__fit", IntegerType()), *(StructField(f"__by_{b}", kinds[b]) for b in by), *(StructField(f"__{n}{j}", DoubleType()) for j in range(most) for n in "amcd")])
    columns = list(zip(*rows, strict=True))
    table = pa.Table.from_arrays([pa.array(list(c)) for c in columns], names=schema.fieldNames())
    return df.sparkSession.createDataFrame(table, schema)


def _scored(df: DataFrame, fits: list[Fit], by: list[str], x: str, t: str) -> tuple[DataFrame, list[Column], Column]:
    """Rows beside the fits of their group, the log densities of the components, and the largest of them."""
    table = _table(fits, by, df)
    table = F.broadcast(table) if len(fits) <= BROADCAST_FITS else table
    match = [F.col(b).eqNullSafe(F.col(f"__by_{b}")) for b in by]
    rows = df.join(table, match) if by else df.crossJoin(table)
    kind = fits[0].kind
    value = F.col(x)
    time = F.col(t) if kind == "gauss_exp" else value
    ln = []
    for j in range(max(f.k for f in fits)):
        part = F.col(f"__a{j}")
        if kind != "exp":
            part = part - (value - F.col(f"__m{j}")) * (value - F.col(f"__m{j}")) * F.col(f"__c{j}")
        if kind != "gauss":
            part = part - time * F.col(f"__d{j}")
        ln.append(part)
    return rows, ln, F.greatest(*ln) if len(ln) > 1 else ln[0]


def _sums(df: DataFrame, fits: list[Fit], by: list[str], x: str, t: str) -> list[list[dict[str, float]]]:
    """Weighted sums of all fits from one aggregation, whose plan is the same every round; a row counts ``__times``."""
    rows, ln, top = _scored(df, fits, by, x, t)
    e = rows.withColumns({f"__e{j}": F.coalesce(F.exp(part - top), F.lit(0.0)) for j, part in enumerate(ln)})
    whole = reduce(Column.__add__, (F.col(f"__e{j}") for j in range(len(ln))))
    made = []
    for j in range(len(ln)):
        r = F.col(f"__e{j}") / F.col("__whole") * F.col("__times")
        parts = {"w": r, "x": r * F.col(x)}
        if fits[0].kind != "exp":
            parts["xx"] = r * F.col(x) * F.col(x)
        if fits[0].kind == "gauss_exp":
            parts["t"] = r * F.col(t)
        made += [F.sum(c).alias(f"{n}{j}") for n, c in parts.items()]
    made.append(F.sum((top + F.log(F.col("__whole"))) * F.col("__times")).alias("__ln"))
    got = {r["__fit"]: r.asDict() for r in e.withColumn("__whole", whole).groupBy("__fit").agg(*made).collect()}  # a row for each fit
    for i, fit in enumerate(fits):
        fit.ln_likelihood = got[i]["__ln"]  # of the parameters before the step
    return [[{n: got[i][f"{n}{j}"] for n in ("w", "x", "xx", "t") if f"{n}{j}" in got[i]} for j in range(fit.k)] for i, fit in enumerate(fits)]


def _likelihoods(df: DataFrame, fits: list[Fit], by: list[str], x: str, t: str) -> list[float | None]:
    rows, ln, top = _scored(df, fits, by, x, t)
    whole = reduce(Column.__add__, (F.coalesce(F.exp(part - top), F.lit(0.0)) for part in ln))
    got = dict(rows.groupBy("__fit").agg(F.sum((top + F.log(whole)) * F.col("__times"))).collect())
    return [got.get(i) for i in range(len(fits))]


def _step(fit: Fit, sums: list[dict[str, float]], least_sigma: float, rng: random.Random) -> None:
    new: Params = {n: [] for n in fit.params}
    for j, s in enumerate(sums):
        w = s["w"] or 0.0
        new["f"].append(w / fit.n)
        if "m" in new:
            mean = s["x"] / w if w else fit.params["m"][j]
            var = s["xx"] / w - mean * mean if w else -1.0
            sigma = math.sqrt(var) if var > 0 else float("nan")
            new["m"].append(fit.pinned[j] if fit.pinned else mean)
            new["s"].append(sigma if sigma > least_sigma else rng.random() + 0.5)
        if "tau" in new:
            total = s["t"] if fit.kind == "gauss_exp" else s["x"]
            new["tau"].append(total / w if w else fit.params["tau"][j])
    fit.history.append(fit.params)
    fit.params = new


def _change(fit: Fit) -> float:
    old = fit.history[-1]
    return max(abs(a - b) for n in fit.params for a, b in zip(fit.params[n], old[n], strict=True))


def _leap(fit: Fit, least_sigma: float) -> None:
    """From three parameters in a row, each a step from the one before, on to where their steps lead.

    The steps' length and how it falls give the width of the leap; where it
    leaves the range of a parameter there is none.
    """
    one, two, three = *fit.trail, fit.params
    fit.trail = []
    step = [b - a for n in one for a, b in zip(one[n], two[n], strict=True)]
    turn = [c - 2 * b + a for n in one for a, b, c in zip(one[n], two[n], three[n], strict=True)]
    length, bend = math.hypot(*step), math.hypot(*turn)
    if not 0 < bend < length:
        return
    wide = length / bend
    far = {n: [a + 2 * wide * (b - a) + wide * wide * (c - 2 * b + a) for a, b, c in zip(one[n], two[n], three[n], strict=True)] for n in one}
    least = {"f": 0.0, "s": least_sigma, "tau": 0.0}
    if all(math.isfinite(v) and v > least.get(n, -math.inf) for n, values in far.items() for v in values):
        fit.behind, fit.params = (three, fit.ln_likelihood), far


def fit_mixture(df: DataFrame, kind: str, ks: int | list[int], by: list[str] | None = None, x: str = "x", t: str = "t", tolerance: float = TOLERANCE, least: int = LEAST_LOOPS, most: int = MOST_LOOPS, least_sigma: float = LEAST_SIGMA, seed: int = 0, first: list[Fit] | None = None, pinned: list[float] | None = None, leaps: bool = False) -> list[Fit]:
    """Fits every number of components in ``ks`` to every group of ``df``.

    ``kind`` is gauss (column x), exp (x) or gauss_exp (x and t). Means can be
    ``pinned``; spreads still go around the weighted means. A spread at or below
    ``least_sigma`` starts anew between 0.5 and 1.5. Stops when no parameter
    moves by ``tolerance`` or more, after ``least`` and before ``most`` rounds.
    With ``leaps`` every second round is followed by a squared extrapolation,
    taken back where the likelihood falls: fewer rounds to the same optimum.
    Rounds go over the distinct rows with their numbers.
    """
    by, rng = by or [], random.Random(seed)
    df = df.filter(F.col(x).isNotNull() & (F.col(t).isNotNull() if kind == "gauss_exp" else F.lit(True))).select(*by, x, *([t] if kind == "gauss_exp" else [])).cache()
    equal = df.groupBy(*df.columns).agg(F.count("*").alias("__times")).cache()
    try:
        fits = first or starts(df, kind, [ks] if isinstance(ks, int) else ks, by, x, t)
        for fit in fits:
            if pinned:
                fit.pinned, fit.params = pinned, fit.params | {"m": list(pinned)}
        for loop in range(most):
            going = [f for f in fits if loop < least or not f.converged]
            if not going:
                break
            for fit, sums in zip(going, _sums(equal, going, by, x, t), strict=True):
                fit.rounds += 1
                if fit.behind:
                    (start, reached), fit.behind = fit.behind, None
                    if not fit.ln_likelihood >= reached:
                        fit.params = start
                        continue
                before = fit.params
                _step(fit, sums, least_sigma, rng)
                fit.converged = _change(fit) < tolerance
                if leaps and not fit.converged:
                    fit.trail.append(before)
                    if len(fit.trail) == 2:
                        _leap(fit, least_sigma)
        for fit, ln in zip(fits, _likelihoods(equal, fits, by, x, t) if fits else [], strict=True):
            fit.ln_likelihood = ln
    finally:
        equal.unpersist()
        df.unpersist()
    return fits


def _draw(seed: int, *keys: object) -> float:
    """A number between 0 and 1 by a hash of the seed and keys, as ``generate.uniform`` has it."""
    return (int(hashlib.md5(":".join(map(str, (seed, *keys))).encode()).hexdigest()[:12], 16) + 0.5) / 16**12


def random_starts(df: DataFrame, kind: str, ks: list[int], restarts: int, seed: int, x: str = "x", t: str = "t") -> list[Fit]:
    """First parameters of ``restarts`` fits of each k, drawn by hashes of seed, parameter, k, restart and component."""
    tau = t if kind == "gauss_exp" else x
    row = df.agg(F.count("*").alias("n"), F.max(x).alias("xm"), F.stddev_pop(x).alias("xs"), F.max(tau).alias("tm")).first()
    out = []
    for k in ks:
        for turn in range(restarts):
            u = {name: [_draw(seed, name, k, turn, j) for j in range(k)] for name in KINDS[kind]}
            p: Params = {"f": [v / sum(u["f"]) for v in u["f"]]}
            if kind != "exp":
                p |= {"m": sorted(v * row["xm"] for v in u["m"]), "s": [v * row["xs"] + 0.5 for v in u["s"]]}
            if kind != "gauss":
                p["tau"] = sorted((v + 1e-3) * row["tm"] for v in u["tau"])
            out.append(Fit(kind, p, n=row["n"]))
    return out


def choose_components(df: DataFrame, kind: str, criterion: str = "BIC", most_components: int = 5, restarts: int = 1, seed: int = 0, **options) -> tuple[int, list[Fit]]:
    """The number of components with the least criterion, and all fits; fits without a finite value never win."""
    ks = list(range(1, most_components + 1))
    first = random_starts(df, kind, ks, restarts, seed, options.get("x", "x"), options.get("t", "t")) if restarts > 1 else None
    fits = fit_mixture(df, kind, ks, first=first, seed=seed, **options)
    score = (lambda f: f.aic()) if criterion.upper() == "AIC" else (lambda f: f.bic())
    able = [f for f in fits if f.ln_likelihood is not None and math.isfinite(f.ln_likelihood)]
    return min(able, key=score).k, fits


def predict(df: DataFrame, fit: Fit, x: str = "x", t: str = "t", name: str = "label") -> DataFrame:
    """Adds the number of the likeliest component from 0, the first of equals."""
    ln = F.array(*ln_components(fit.kind, fit.params, x, t))
    return df.withColumn("__ln", ln).withColumn(name, (F.array_position("__ln", F.array_max("__ln")) - 1).cast("int")).drop("__ln")


def as_rows(fits: list[Fit], df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A row for each component of each fit, by rising mean: groups, k, component, parameters, scores."""
    by = by or []
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([*(f"`{b}` {kinds[b]}" for b in by), "k int", "component int", "f double", "m double", "s double", "tau double", "converged boolean", "ln_likelihood double", "aic double", "bic double"])
    rows = []
    for fit in fits:
        p = fit.ordered()
        rows += [(*fit.group, fit.k, j, *(p[n][j] if n in p else None for n in ("f", "m", "s", "tau")), fit.converged, fit.ln_likelihood, fit.aic(), fit.bic()) for j in range(fit.k)]
    return df.sparkSession.createDataFrame(rows, schema)


def progress_rows(fit: Fit, df: DataFrame) -> DataFrame:
    """The way of a fit: iteration, component, parameters; what a progress plot shows."""
    rows = [(i, j, *(p[n][j] if n in p else None for n in ("f", "m", "s", "tau"))) for i, p in enumerate([*fit.history, fit.params]) for j in range(fit.k)]
    return df.sparkSession.createDataFrame(rows, "iteration int, component int, f double, m double, s double, tau double")


def coin_mixture(df: DataFrame, pa: float = 0.3, pb: float = 0.48, delta: float = 1e-14, most: int = 1000, heads: str = "heads", tails: str = "tails") -> tuple[float, float, int]:
    """Biases of two coins from runs of tosses with either one: pA, pB, rounds."""
    df = df.select(heads, tails).cache()
    try:
        for loop in range(1, most + 1):
            a, b = D.ln_binomial_kernel(heads, tails, pa), D.ln_binomial_kernel(heads, tails, pb)
            w = 1 / (1 + F.exp(b - a))
            s = df.agg(F.sum(w * F.col(heads)).alias("ah"), F.sum(w * F.col(tails)).alias("at"), F.sum((1 - w) * F.col(heads)).alias("bh"), F.sum((1 - w) * F.col(tails)).alias("bt")).first()
            na, nb = s["ah"] / (s["ah"] + s["at"]), s["bh"] / (s["bh"] + s["bt"])
            moved, pa, pb = max(abs(na - pa), abs(nb - pb)), na, nb
            if moved < delta:
                break
        return pa, pb, loop
    finally:
        df.unpersist()
