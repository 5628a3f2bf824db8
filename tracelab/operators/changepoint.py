"""Level, ramp, level: fits with two change points, and descent on smooth losses.

The loss of a pair of change points is a sum of squares that prefix sums of x,
x^2 and i x give at once for any pair, so no candidate looks at a trace again.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelab.operators.windows import running_sums
from tracelab.session import kept

DECAY, BETA1, BETA2, EPS = 0.9, 0.9, 0.999, 1e-8
LEAST_WIDTH, ROUNDING = 16, 1e-12  #: places of a stretch at least; error of sums, as a share of a trace's sum of squares
STRETCH = 512  #: places of a trace whose pairs with those of another stretch are taken together
TOGETHER, MOST_TRACES, HELD_BATCHES = 1 << 20, 512, 4096  #: rows and traces that a task fits at once, a longer trace by itself; sums of batches kept on the driver


def prefix_sums(df: DataFrame, key: str = "trace_id", idx: str = "idx", value: str = "x") -> DataFrame:
    """For each place the sums over all earlier rows: key, at, n, sx, sxx, six, and the trace's totals.

    There is a row for the end of each trace as well.
    """
    x, i = F.col(value).cast("double"), F.col(idx).cast("double")
    rows = df.select(key, idx, F.col(value).alias("__x"))
    totals = df.groupBy(key).agg(F.count("*").alias("n"), F.sum(x).alias("tx"), F.sum(x * x).alias("txx"))
    y = F.col("__x").cast("double")
    upto = running_sums(rows, {"sx": y, "sxx": y * y, "six": i * y}, key, idx)
    return upto.select(key, (F.col(idx) + 1).alias("at"), "sx", "sxx", "six").join(totals, key)


def pair_loss(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """Loss for change points at the places of ``a`` and ``b``, which give the columns of prefix sums."""
    t1, t2, n = a("at").cast("double"), b("at").cast("double"), a("n").cast("double")
    c1, c2 = a("sx") / t1, (a("tx") - b("sx")) / (n - t2)
    level1 = a("sxx") - a("sx") * a("sx") / t1
    level2 = (a("txx") - b("sxx")) - (a("tx") - b("sx")) * (a("tx") - b("sx")) / (n - t2)
    m, sx, sxx = t2 - t1, b("sx") - a("sx"), b("sxx") - a("sxx")
    six = b("six") - a("six") - t1 * sx  # sum of (i - t1) x over the ramp
    slope = F.when(m > 1, (c2 - c1) / (m - 1)).otherwise(F.lit(0.0))
    s1, s2 = m * (m - 1) / 2, (m - 1) * m * (2 * m - 1) / 6
    ramp = sxx - 2 * (c1 * sx + slope * six) + c1 * c1 * m + 2 * c1 * slope * s1 + slope * slope * s2
    return level1 + ramp + level2


def candidate_losses(df: DataFrame, candidates: int | None = None, key: str = "trace_id", idx: str = "idx", value: str = "x") -> DataFrame:
    """Losses of all pairs of places of each trace, or of about ``candidates`` evenly spaced ones: key, t1, t2, loss.

    Pairs are made stretch by stretch, so that a long trace is the work of many tasks.
    """
    sums = prefix_sums(df, key, idx, value).filter(F.col("at") < F.col("n"))
    if candidates:
        sums = sums.filter(F.col("at") % F.ceil(F.col("n") / candidates) == 0)
    own = F.floor(F.col("at") / STRETCH)
    a = sums.withColumn("met", F.explode(F.sequence(own, F.floor(F.col("n") / STRETCH)))).alias("a")
    b = sums.withColumn("met", own).alias("b")
    pairs = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.met") == F.col("b.met")) & (F.col("a.at") < F.col("b.at")))
    return pairs.select(F.col(f"a.{key}").alias(key), F.col("a.at").alias("t1"), F.col("b.at").alias("t2"), pair_loss(lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}")).alias("loss"))


def loss_profile(df: DataFrame, key: str = "trace_id", idx: str = "idx", value: str = "x") -> DataFrame:
    """For each first change point the second one with the least loss, the first of equals: key, t1, t2, loss."""
    losses = candidate_losses(df, None, key, idx, value)
    return losses.groupBy(key, "t1").agg(F.min(F.struct("loss", "t2")).alias("b")).select(key, "t1", "b.t2", "b.loss")


def pair_bound(a0: Callable[[str], Column], a1: Callable[[str], Column], b0: Callable[[str], Column], b1: Callable[[str], Column]) -> Column:
    """A loss that no pair falls below whose change points lie between a0 and a1, and between b0 and b1.

    The levels only grow with their rows, so those outside of both stretches
    count at least; between the stretches no ramp comes closer than the line of
    least squares.
    """
    t, u, n = a0("at").cast("double"), b1("at").cast("double"), a0("n").cast("double")
    level1 = a0("sxx") - a0("sx") * a0("sx") / t
    rest = a0("tx") - b1("sx")
    level2 = (a0("txx") - b1("sxx")) - rest * rest / (n - u)
    start = a1("at").cast("double")
    m, sx, sxx = b0("at") - start, b0("sx") - a1("sx"), b0("sxx") - a1("sxx")
    six = b0("six") - a1("six") - start * sx
    half, squares = m * (m - 1) / 2, (m - 1) * m * (2 * m - 1) / 6
    line = sxx - sx * sx / m - F.pow(six - half * sx / m, 2) / (squares - half * half / m)
    none = F.lit(0.0)
    return F.greatest(level1, none) + F.when(m > 2, F.greatest(line, none)).otherwise(none) + F.greatest(level2, none) - ROUNDING * a0("txx")


def searched_change_points(df: DataFrame, key: str = "trace_id", idx: str = "idx", value: str = "x") -> DataFrame:
    """The pair of change points with the least loss of all, the first of equals: key, t1, t2, loss, pairs, opened.

    Branch and bound: places are cut in stretches of about the root of a
    trace's length, so there are as many pairs of stretches as places, half of
    them. Each has a lower bound and one loss of its own; the pair with the
    least bound is searched first, and then all that may still hold less than
    the least loss known. ``pairs`` counts pairs of stretches, ``opened`` those
    that were searched. Traces with fewer than three rows have none.
    """
    width = F.greatest(F.ceil(F.sqrt(F.col("n"))), F.lit(LEAST_WIDTH))
    sums = kept(prefix_sums(df, key, idx, value).filter(F.col("at") < F.col("n")).withColumn("stretch", F.floor(F.col("at") / width)), "prefix-sums")
    place = F.struct("at", "sx", "sxx", "six")
    cut = sums.groupBy(key, "stretch").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), *(F.first(c).alias(c) for c in ("n", "tx", "txx")))
    own = F.floor(F.col("stretch") / STRETCH)
    a = cut.withColumn("met", F.explode(F.sequence(own, F.floor(F.floor(F.col("n") / width) / STRETCH)))).alias("a")
    b = cut.withColumn("met", own).alias("b")
    met = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.met") == F.col("b.met")) & (F.col("a.stretch") <= F.col("b.stretch")) & (F.col("a.lo.at") < F.col("b.hi.at")))
    total = ("n", "tx", "txx")
    at = {p: (lambda c, p=p: F.col(f"{p[0]}.{c}") if c in total else F.col(f"{p}.{c}")) for p in ("a.lo", "a.hi", "b.lo", "b.hi")}
    same = F.col("a.stretch") == F.col("b.stretch")
    shown = F.when(same, pair_loss(at["a.lo"], at["b.hi"])).otherwise(pair_loss(at["a.lo"], at["b.lo"]))
    pairs = kept(met.select(F.col(f"a.{key}").alias(key), F.col("a.stretch").alias("one"), F.col("b.stretch").alias("two"), pair_bound(at["a.lo"], at["a.hi"], at["b.lo"], at["b.hi"]).alias("bound"), shown.alias("shown")), "stretch-pairs")

    def least(cells: DataFrame) -> DataFrame:
        one, two = (sums.select(F.col(key), F.col("stretch").alias(name), F.struct("*").alias(side)) for name, side in (("one", "a"), ("two", "b")))
        each = cells.select(key, "one", "two").join(one, [key, "one"]).join(two, [key, "two"]).filter("a.at < b.at")
        losses = each.select(key, F.struct(pair_loss(lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}")).alias("loss"), F.col("a.at").alias("t1"), F.col("b.at").alias("t2")).alias("pair"))
        return losses.groupBy(key).agg(F.min("pair").alias("best"))

    known = kept(pairs.groupBy(key).agg(F.min("shown").alias("shown"), F.min(F.struct("bound", "one", "two")).alias("first"), F.count("*").alias("pairs")), "first-bounds")
    first = least(known.select(key, "first.one", "first.two"))
    limits = known.select(key, "pairs", "shown").join(first, key).select(key, "pairs", F.least("shown", "best.loss").alias("limit"))
    opened = kept(pairs.join(limits, key).filter(F.col("bound") <= F.col("limit")).select(key, "one", "two", "pairs"), "opened-pairs")
    counted = opened.groupBy(key).agg(F.first("pairs").alias("pairs"), F.count("*").alias("opened"))
    return least(opened).join(counted, key).select(key, "best.t1", "best.t2", "best.loss", "pairs", "opened")


def best_change_points(df: DataFrame, candidates: int | None = None, key: str = "trace_id", idx: str = "idx", value: str = "x") -> DataFrame:
    """The pair with the least loss of all, or among the candidates, the first of equals: key, t1, t2, loss."""
    if not candidates:
        return searched_change_points(df, key, idx, value).select(key, "t1", "t2", "loss")
    losses = candidate_losses(df, candidates, key, idx, value)
    return losses.groupBy(key).agg(F.min(F.struct("loss", "t1", "t2")).alias("b")).select(key, "b.t1", "b.t2", "b.loss")


def refined_change_points(df: DataFrame, candidates: int = 32, rounds: int = 3, key: str = "trace_id", idx: str = "idx", value: str = "x") -> DataFrame:
    """The best pair, then the best within half of the spacing around it, with ever finer spacing."""
    sums = prefix_sums(df, key, idx, value)
    best = best_change_points(df, candidates, key, idx, value)
    n = sums.groupBy(key).agg(F.max("n").alias("n"))
    best = best.join(n, key).withColumn("gap", F.ceil(F.col("n") / candidates).cast("long"))
    grid = F.array(*map(F.lit, range(-4, 5)))
    for _ in range(rounds):
        finer = F.greatest(F.ceil(F.col("gap") / 4), F.lit(1))
        moves = best.withColumn("gap", finer).withColumn("d1", F.explode(grid)).withColumn("d2", F.explode(grid))
        asked = moves.select(key, "gap", "n", (F.col("t1") + F.col("d1") * F.col("gap")).alias("t1"), (F.col("t2") + F.col("d2") * F.col("gap")).alias("t2")).filter("t1 >= 1 and t2 > t1 and t2 < n")
        s1, s2 = (sums.select(F.col(key).alias(f"k{i}"), *(F.col(c).alias(f"{c}{i}") for c in ("at", "sx", "sxx", "six", "n", "tx", "txx"))) for i in (1, 2))
        known = asked.join(s1, (F.col(key) == F.col("k1")) & (F.col("t1") == F.col("at1"))).join(s2, (F.col(key) == F.col("k2")) & (F.col("t2") == F.col("at2")))
        scored = known.withColumn("loss", pair_loss(lambda c: F.col(f"{c}1"), lambda c: F.col(f"{c}2")))
        best = scored.groupBy(key).agg(F.min(F.struct("loss", "t1", "t2", "gap", "n")).alias("b")).select(key, "b.t1", "b.t2", "b.loss", "b.gap", "b.n")
    return best.select(key, "t1", "t2", "loss")


class TraceLosses:
    """Losses of some traces at whole-number change points, from their prefix sums; NaN values are left out."""

    def __init__(self, traces: list[np.ndarray]):
        self.size = np.array([len(x) for x in traces])
        self.start = np.cumsum(self.size + 1) - self.size - 1
        self.sums = np.concatenate([self._prefix(x) for x in traces], axis=1)

    @staticmethod
    def _prefix(x: np.ndarray) -> np.ndarray:
        known, i = ~np.isnan(x), np.arange(len(x), dtype=float)
        y = np.where(known, x, 0.0)
        return np.concatenate([np.zeros((6, 1)), np.cumsum([known, y, y * y, i * y, i * known, i * i * known], axis=1)], axis=1)

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Counts and sums of x, x^2, i x, i and i^2 over the places from a to b of each trace."""
        return self.sums[:, self.start + b] - self.sums[:, self.start + a]

    def levels(self, t1: np.ndarray, t2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean before t1 and from t2 on, for places that are in range."""
        with np.errstate(invalid="ignore", divide="ignore"):
            before, after = self.between(np.zeros_like(t1), t1), self.between(t2, self.size)
            return before[1] / before[0], after[1] / after[0]

    def inside(self, t1: np.ndarray, t2: np.ndarray) -> np.ndarray:
        """Whether both change points lie in their trace, one behind the other."""
        with np.errstate(invalid="ignore"):
            return (np.trunc(t1) > 0) & (np.trunc(t1) < np.trunc(t2)) & (np.trunc(t2) < self.size)

    def __call__(self, t1: np.ndarray, t2: np.ndarray) -> np.ndarray:
        good = self.inside(t1, t2)
        a, b = (np.where(good, t, d).astype(np.int64) for t, d in ((t1, 0), (t2, 0)))
        c1, c2 = self.levels(a, b)
        with np.errstate(invalid="ignore", divide="ignore"):
            head, ramp, tail = self.between(np.zeros_like(a), a), self.between(a, b), self.between(b, self.size)
            slope = np.where(b - a > 1, (c2 - c1) / np.maximum(b - a - 1, 1), 0.0)
            base = c1 - slope * a
            n, x, xx, ix, i, ii = ramp
            line = xx - 2 * (base * x + slope * ix) + base * base * n + 2 * base * slope * i + slope * slope * ii
            return np.where(good, head[2] - c1 * c1 * head[0] + line + tail[2] - c2 * c2 * tail[0], np.nan)


# Ways to move along gradients. Each keeps what it needs of the gradients so far.

class Momentum:
    """The last move goes on, turned by the gradient."""

    def __init__(self, rate: float):
        self.rate, self.last = rate, 0.0

    def move(self, g: np.ndarray) -> np.ndarray:
        self.last = DECAY * self.last - self.rate * g
        return self.last


class AdaGrad:
    """Steps fall with the root of the sum of squared gradients."""

    def __init__(self, rate: float):
        self.rate, self.squares = rate, 0.0

    def move(self, g: np.ndarray) -> np.ndarray:
        self.squares = self.squares + g * g
        return -self.rate * g / np.sqrt(self.squares + EPS)


class RMSprop:
    """Steps are measured by a fading mean of squared gradients."""

    def __init__(self, rate: float):
        self.rate, self.mean = rate, 0.0

    def move(self, g: np.ndarray) -> np.ndarray:
        self.mean = DECAY * self.mean + (1 - DECAY) * g * g
        return -self.rate * g / np.sqrt(self.mean + EPS)


class Adam:
    """Fading means of gradients and of their squares, both corrected for their start at 0."""

    def __init__(self, rate: float):
        self.rate, self.first, self.second, self.moves = rate, 0.0, 0.0, 0

    def take_in(self, g: np.ndarray) -> None:
        self.first = BETA1 * self.first + (1 - BETA1) * g
        self.second = BETA2 * self.second + (1 - BETA2) * g * g
        self.moves += 1

    def move(self, g: np.ndarray) -> np.ndarray:
        self.take_in(g)
        return self.step(1 - BETA1**self.moves, 1 - BETA2**self.moves)

    def step(self, scale1: float, scale2: float) -> np.ndarray:
        return -self.rate * (self.first / scale1) / (np.sqrt(self.second / scale2) + EPS)


class LaggedAdam(Adam):
    """Adam whose means are those before the gradient, with the first round's correction in all rounds."""

    def move(self, g: np.ndarray) -> np.ndarray:
        if not self.moves:
            self.take_in(g)
        step = self.step(1 - BETA1, 1 - BETA2)
        self.take_in(g)
        return step


MOVERS = {"Adam": LaggedAdam, "AdaGrad": AdaGrad, "RMSprop": RMSprop, "Momentum": Momentum}


def mover(method: str, rate: float, standard: bool = False) -> Momentum | AdaGrad | RMSprop | Adam:
    """A way to move by name. Adam is the lagged form unless ``standard`` asks for the usual one."""
    if method not in MOVERS:
        raise ValueError(f"method is one of {', '.join(MOVERS)}, not {method!r}")
    return Adam(rate) if standard and method == "Adam" else MOVERS[method](rate)


def descend(loss: Callable[[np.ndarray, np.ndarray], np.ndarray], start: np.ndarray, method: str = "Adam", rate: float = 0.18, tolerance: float = 1e-2, most: int = 1000, standard: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Descent of many losses at once by forward differences of one place: the points (2, n), and their rounds.

    A point rests where its gradient is ``tolerance`` or less. One at which the
    loss is undefined ends with NaN.
    """
    way, p = mover(method, rate, standard), np.array(start, float)
    rounds, going = np.ones(p.shape[1], np.int64), np.ones(p.shape[1], bool)
    for _ in range(1, most):
        here = loss(p[0], p[1])
        g = np.stack([loss(p[0] + 1, p[1]) - here, loss(p[0], p[1] + 1) - here])
        lost = going & ~np.isfinite(g).all(axis=0)
        p[:, lost] = np.nan
        going &= ~lost & ~(np.hypot(g[0], g[1]) <= tolerance)
        if not going.any():
            break
        p = p + np.where(going, way.move(np.where(going, g, 0.0)), 0.0)
        rounds += going
    return p, rounds


def fit_change_points(df: DataFrame, start: tuple[float, float] | None = None, method: str = "Adam", rate: float = 0.18, tolerance: float = 1e-2, most: int = 1000, repeats: int = 1, fps: float = 1.0, standard: bool = False, key: str = "trace_id", idx: str = "idx", value: str = "x", fitted: str | None = None) -> DataFrame:
    """Change points of every trace by descent: key, cp_1, cp_2, bm_initial, bm_final, velocity, velocity_per_min, rounds.

    Descent goes on the column ``fitted`` (by default the values themselves,
    often their scores), levels come from ``value``. ``start`` is (t1, t2), by
    default a third and two thirds of a trace; each of the ``repeats`` begins
    where the one before ended. A trace whose change points cross or leave it
    has nulls. Traces are dealt to tasks whole; a task fits many of them at once.
    """
    mover(method, rate, standard)
    on, kind = fitted or value, dict(df.dtypes)[key]
    schema = f"`{key}` {kind}, cp_1 int, cp_2 int, bm_initial double, bm_final double, velocity double, velocity_per_min double, rounds int"
    names = [c.split()[0].strip("`") for c in schema.split(", ")]

    def fit(keys: list, scores: list[np.ndarray], values: list[np.ndarray]) -> pd.DataFrame:
        loss, own = TraceLosses(scores), TraceLosses(values)
        p = np.stack([np.full(len(keys), float(s)) for s in start]) if start else np.stack([own.size / 3, 2 * own.size / 3])
        rounds = np.zeros(len(keys), np.int64)
        for _ in range(repeats):
            p, n = descend(loss, p, method, rate, tolerance, most, standard)
            rounds += n
        good = own.inside(p[0], p[1])
        t1, t2 = (np.where(good, t, 0).astype(np.int64) for t in p)
        c1, c2 = own.levels(t1, t2)
        v = (c2 - c1) / np.where(good, t2 - t1, 1)
        hidden = [pd.array(np.where(good, t, 0), "Int32") for t in (t1, t2)]
        for column in hidden:
            column[~good] = pd.NA
        return pd.DataFrame(dict(zip(names, [keys, *hidden, *(np.where(good, x, np.nan) for x in (c1, c2, v, v * fps * 60)), rounds], strict=True)))

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        """The traces of a task one by one; a batch may end inside of one."""
        held: list[pd.DataFrame] = []
        for batch in batches:
            cuts = np.flatnonzero(np.append(True, batch[key].to_numpy()[1:] != batch[key].to_numpy()[:-1])[: len(batch)])
            for a, b in zip(cuts, np.append(cuts[1:], len(batch)), strict=True):
                piece = batch.iloc[a:b]
                if held and held[0][key].iloc[0] != piece[key].iloc[0]:
                    yield pd.concat(held)
                    held = []
                held.append(piece)
        if held:
            yield pd.concat(held)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, scores, values, rows = [], [], [], 0
        for trace in whole(batches):
            keys.append(trace[key].iloc[0])
            scores.append(trace[on].to_numpy(float))
            values.append(trace[value].to_numpy(float))
            rows += len(trace)
            if rows >= TOGETHER or len(keys) >= MOST_TRACES:
                yield fit(keys, scores, values)
                keys, scores, values, rows = [], [], [], 0
        if keys:
            yield fit(keys, scores, values)

    dealt = df.select(*dict.fromkeys([key, idx, value, on])).repartition(key).sortWithinPartitions(key, idx)
    return dealt.mapInPandas(run, schema)


def cubic_moments(df: DataFrame, x: str = "x", y: str = "y") -> dict[str, float]:
    """The sums that the squared error of p1 x + p2 x^2 + p3 x^3 and its gradient need, in one pass."""
    p = {f"x{k}": F.sum(F.pow(x, k)) for k in range(2, 7)} | {f"y{k}": F.sum(F.col(y) * F.pow(x, k)) for k in (1, 2, 3)}
    return df.agg(F.count("*").alias("n"), *(c.alias(n) for n, c in p.items())).first().asDict()


def cubic_gradient(m: dict[str, float], p: np.ndarray) -> np.ndarray:
    """Gradient of the mean squared error at ``p``."""
    a = np.array([[m[f"x{i + j}"] for j in (1, 2, 3)] for i in (1, 2, 3)])
    return 2 * (a @ p - np.array([m["y1"], m["y2"], m["y3"]])) / m["n"]


def cubic_descent(df: DataFrame, x: str = "x", y: str = "y", rate: float = 0.5, tolerance: float = 1e-3, least: int = 50, most: int = 5000, start: tuple[float, ...] = (1.0, 1.0, 1.0), standard: bool = False) -> tuple[np.ndarray, int]:
    """Batch Adam on the mean squared error; stops when no parameter moves by ``tolerance``, after ``least`` rounds.

    The data are read once: the gradient at any point follows from their moments.
    """
    m, p, way = cubic_moments(df, x, y), np.array(start), mover("Adam", rate, standard)
    for loop in range(1, most):
        move = way.move(cubic_gradient(m, p))
        p = p + move
        if loop >= least and np.abs(move).max() < tolerance:
            break
    return p, loop


def cubic_minibatch(df: DataFrame, x: str = "x", y: str = "y", batch: int = 32, epochs: int = 150, rate: float = 0.5, seed: int = 0, start: tuple[float, ...] = (1.0, 1.0, 1.0)) -> np.ndarray:
    """Mini-batch Adam in shuffled order, with a rate that falls to 0; the moments of all batches come from one aggregation.

    Rows are dealt to batches by a hash of the values and of their place among
    equal ones. Each epoch takes the batches by another turn of their numbers.
    The steps follow each other; where there are more than ``HELD_BATCHES``, a
    task takes them all, from nine sums of each batch, and the driver gets
    their end alone.
    """
    n_batches = max(1, -(-df.count() // batch))
    prime = next(p for p in range(n_batches + 1, 2 * n_batches + 3) if all(p % q for q in range(2, math.isqrt(p) + 1)))
    same = Window.partitionBy(x, y).orderBy(x)
    dealt = df.withColumn("nth", F.row_number().over(same)).withColumn("b", F.pmod(F.xxhash64(F.lit(seed), x, y, "nth"), F.lit(n_batches)))
    p = {f"x{k}": F.sum(F.pow(x, k)) for k in range(2, 7)} | {f"y{k}": F.sum(F.col(y) * F.pow(x, k)) for k in (1, 2, 3)}
    sums = dealt.groupBy("b").agg(F.count("*").alias("n"), *(c.alias(n) for n, c in p.items()))

    def steps(m: pa.Table) -> np.ndarray:
        c = {n: m.column(n).to_numpy() for n in m.column_names}
        a = np.stack([np.stack([c[f"x{i + j}"] for j in (1, 2, 3)], axis=1) for i in (1, 2, 3)], axis=1)
        right = np.stack([c["y1"], c["y2"], c["y3"]], axis=1)
        at, way, rng = np.array(start), Adam(rate), np.random.default_rng(seed)
        for epoch in range(epochs):
            turn, shift = int(rng.integers(1, prime)), int(rng.integers(prime))
            way.rate = rate * (1 - epoch / epochs)
            for k in np.argsort((c["b"] * turn + shift) % prime):
                at = at + way.move(2 * (a[k] @ at - right[k]) / c["n"][k])
        return at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([steps(pa.Table.from_batches(held)).tolist()], pa.list_(pa.float64()))], names=["at"])

    if n_batches <= HELD_BATCHES:
        return steps(sums.toArrow())
    end = sums.repartition(1).mapInArrow(run, "at array<double>").first()
    return np.array(end["at"] if end else start)


def cubic_exact(df: DataFrame, x: str = "x", y: str = "y") -> np.ndarray:
    m = cubic_moments(df, x, y)
    return np.linalg.solve(np.array([[m[f"x{i + j}"] for j in (1, 2, 3)] for i in (1, 2, 3)]), np.array([m["y1"], m["y2"], m["y3"]]))
