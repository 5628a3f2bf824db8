"""Spatial autocorrelation and power spectrum, and variance analysis of step traces."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tracelab.operators import fourier
from tracelab.operators.stats import histogram, width_bins, width_histogram
from tracelab.operators.windows import expanding_spread, framed, lengths, running_sums

POINTS = 16  #: lags that the initial line is fitted to
STRETCH = 1 << 16  #: places of a trace whose products with those of another stretch are taken together


def autocorrelation(counts: DataFrame, spatial_rate: float | Column, bins: int) -> DataFrame:
    """Sum of products of the counts of ``bins`` bins ``lag`` apart: lag, distance, acf, by transforms (whole numbers below 2^50 exactly)."""
    sums = fourier.self_products(counts.select(F.col("bin").alias("at"), F.col("count").alias("value")), bins)
    return sums.select("lag", (F.col("lag") / spatial_rate).alias("distance"), F.round("total").alias("acf"))


def _binned(df: DataFrame, spatial_rate: float | None, bins: int | None, value: str) -> tuple[DataFrame, int, float]:
    """The histogram of positions, the number of its bins, and bins by unit of length."""
    if bins:
        ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
        return histogram(df, bins, value), bins, bins / (ends["hi"] - ends["lo"])
    ends = df.agg(F.floor(F.min(value)).alias("lo"), F.max(value).alias("hi")).first()
    lo, hi = float(ends["lo"]), float(ends["hi"])
    return width_histogram(df, 1 / spatial_rate, lo, hi, value), width_bins(1 / spatial_rate, lo, hi), spatial_rate


def spatial_acf(df: DataFrame, spatial_rate: float | None = None, bins: int | None = None, value: str = "x") -> DataFrame:
    """Autocorrelation of the histogram of positions, bins 1/``spatial_rate`` wide or ``bins`` in number."""
    counts, n, rate = _binned(df, spatial_rate, bins, value)
    return autocorrelation(counts, rate, n)


def power_spectrum(acf: DataFrame, spatial_rate: float, n: int | None = None) -> DataFrame:
    """Modulus of the discrete Fourier transform: k, freq, psd.

    Frequencies run from 0 to the spatial rate, both ends included; ``n`` is
    the number of rows of ``acf``, which are counted without it.
    """
    n = n or acf.count()
    turned = fourier.fourier(acf.select(F.col("lag").alias("at"), F.col("acf").alias("re"), F.lit(0.0).alias("im")), n)
    freq = F.lit(float(spatial_rate)) * F.col("at") / F.lit(float(max(n - 1, 1)))
    return turned.select(F.col("at").alias("k"), freq.alias("freq"), F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("psd"))


def position_spectrum(df: DataFrame, spatial_rate: float | None = None, bins: int | None = None, value: str = "x") -> DataFrame:
    """Power spectrum of the autocorrelation of positions: k, freq, psd."""
    counts, n, rate = _binned(df, spatial_rate, bins, value)
    return power_spectrum(autocorrelation(counts, rate, n), rate, n)


def lag_variance_full(df: DataFrame, key: str = "trace_id", idx: str = "idx", value: str = "x", stretch: int = STRETCH) -> DataFrame:
    """As ``lag_variance``, for every lag from 1 to half of a trace.

    Sums of products of values ``m`` apart are convolutions of stretches, each
    pair of stretches a group of its own, so the work grows with n log n inside
    stretches and no task holds more than two of them. A trace's line is taken
    out first, which keeps digits. Null values take their differences out.
    """
    sizes = df.groupBy(key).agg(F.max(F.col(idx) + 1).alias("__n"), F.coalesce(F.regr_slope(value, idx), F.lit(0.0)).alias("__slope"), F.coalesce(F.regr_intercept(value, idx), F.avg(value)).alias("__from"))
    part, reach = F.floor(F.col(idx) / stretch), F.floor(F.col("__n") / 2 / stretch) + 1
    ahead = F.transform(F.sequence(part, F.least(part + reach, F.floor((F.col("__n") - 1) / stretch))), lambda p: F.struct(p.alias("i"), part.alias("j")))
    behind = F.transform(F.sequence(F.greatest(part - reach, F.lit(0)), part), lambda p: F.struct(part.alias("i"), p.alias("j")))
    rows = df.join(sizes, key).select(key, F.col(idx).alias("__at"), (F.col(value).cast("double") - F.col("__from") - F.col("__slope") * F.col(idx)).alias("__x"), "__slope", F.col("__n").cast("long").alias("__n"), F.explode(F.array_distinct(F.concat(ahead, behind))).alias("__pair"))
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, m long, c double, s double, ss double, drift double"
    kind = df.schema[key].dataType

    def run(pair: tuple, rows: pa.Table) -> pa.Table:
        i0, j0, n = pair[1].as_py() * stretch, pair[2].as_py() * stretch, rows.column("__n")[0].as_py()
        at, x = rows.column("__at").to_numpy(), rows.column("__x").to_numpy(zero_copy_only=False)
        first, last = max(1, i0 - j0 - stretch + 1), min(n // 2, i0 - j0 + stretch - 1)
        m = np.arange(first, last + 1)
        limit = n // m * m

        def side(begin):
            own = (at >= begin) & (at < begin + stretch)
            full = np.full(min(stretch, n - begin), np.nan)
            full[at[own] - begin] = x[own]
            known = (~np.isnan(full)).astype(float)
            return np.nan_to_num(full), known

        (a, have_a), (b, have_b) = side(i0), side(j0)
        sums = lambda u, v: fourier.lagged_products(u, v, i0, j0, first, limit)
        c = np.rint(sums(have_a, have_b))
        s = sums(a, have_b) - sums(have_a, b)
        ss = sums(a * a, have_b) - 2 * sums(a, b) + sums(have_a, b * b)
        return pa.table({key: pa.array([pair[0].as_py()] * len(m), to_arrow_type(kind)), "m": m, "c": c, "s": s, "ss": ss, "drift": rows.column("__slope")[0].as_py() * m})

    pairs = rows.groupBy(key, F.col("__pair.i").alias("__i"), F.col("__pair.j").alias("__j")).applyInArrow(run, schema)
    c, s, ss = (F.sum(x) for x in ("c", "s", "ss"))
    moments = pairs.groupBy(key, "m").agg(c.alias("c"), s.alias("s"), ss.alias("ss"), F.first("drift").alias("drift")).filter("c > 0")
    spread = F.when(F.col("c") > 1, F.greatest((F.col("ss") - F.col("s") * F.col("s") / F.col("c")) / (F.col("c") - 1), F.lit(0.0)))
    curve = moments.select(key, "m", spread.alias("var_x"), (F.col("s") / F.col("c") + F.col("drift")).alias("mean_x"))
    v = F.col("var_x")
    held = running_sums(curve, {"__k": v.isNotNull().cast("double"), "__v": F.coalesce(v, F.lit(0.0)), "__vv": F.coalesce(v * v, F.lit(0.0))}, key, "m")
    sem = F.sqrt(F.greatest((F.col("__vv") - F.col("__v") * F.col("__v") / F.col("__k")) / (F.col("__k") - 1), F.lit(0.0)))
    return held.select(key, "m", "var_x", "mean_x", F.when(F.col("__k") > 1, sem).alias("sem_x"))


def lag_variance(df: DataFrame, lags: list[int], key: str = "trace_id", idx: str = "idx", value: str = "x") -> DataFrame:
    """Variance and mean of the differences at each lag: key, m, var_x, mean_x, sem_x.

    Each lag uses the part of a trace that is a multiple of it. All lags are
    taken in one pass over one window. ``sem_x`` is the deviation of the
    variances up to that lag.
    """
    most = max(lags)
    far = framed(df.join(lengths(df, key), key), most, 0, {"__back": lambda w: F.collect_list(value).over(w)}, key, idx)
    pairs = [F.struct(F.lit(m).cast("long").alias("m"), (F.col(value) - F.get("__back", F.size("__back") - F.lit(m + 1))).alias("dx"), (F.floor(F.col("n") / m) * m).alias("upto")) for m in sorted(lags)]
    rows = far.select(key, idx, F.explode(F.array(*pairs)).alias("p")).select(key, idx, "p.*").filter(F.col("dx").isNotNull() & (F.col(idx) >= F.col("m")) & (F.col(idx) < F.col("upto")))
    curve = rows.groupBy(key, "m").agg(F.var_samp("dx").alias("var_x"), F.avg("dx").alias("mean_x"))
    return expanding_spread(curve, "m", "var_x", "sem_x", key)


def lag_grid(first: float, last: float, step: float, fs: float) -> list[int]:
    """Whole lags for the times first, first + step, ... below ``last``; 0 becomes 1."""
    n = max(0, math.ceil((last - first) / step - 1e-9))
    return sorted({max(1, math.floor((first + step * i) * fs + 1e-9)) for i in range(n)})


def initial_slopes(curve: DataFrame, fs: float, points: int = POINTS, key: str = "trace_id") -> DataFrame:
    """A line through the first ``points`` lags of each trace: slope, intercept, and the last of these lags' values."""
    t = F.col("m") / F.lit(float(fs))
    first = curve.withColumn("t", t).withColumn("place", F.row_number().over(_by(key, "m"))).filter(F.col("place") <= points)
    return first.groupBy(key).agg(F.regr_slope("var_x", "t").alias("slope"), F.regr_intercept("var_x", "t").alias("intercept"), F.max_by("var_x", "m").alias("last_var"), F.max_by("mean_x", "m").alias("last_mean"))


def _by(key: str, order: str):
    from pyspark.sql.window import Window

    return Window.partitionBy(key).orderBy(order)


def kinetics(df: DataFrame, lags: list[int], fs: float, key: str = "trace_id", idx: str = "idx", value: str = "x") -> DataFrame:
    """Step, rate and randomness of each trace from its variance line and its velocity, outliers left out.

    Slope and velocity are matched by trace. Traces whose slope is more than
    one deviation from the mean of all are left out.
    """
    from tracelab.operators.stats import within_one_deviation

    lines = within_one_deviation(initial_slopes(lag_variance(df, lags, key, idx, value), fs, key=key), "slope")
    speed = df.groupBy(key).agg(F.regr_slope(F.col(value), F.col(idx) / F.lit(float(fs))).alias("velocity"))
    v = F.col("velocity")
    return lines.join(speed, key).select(key, "slope", "intercept", "velocity", F.try_divide(F.col("slope"), v).alias("step"), F.try_divide(v * v, F.col("slope")).alias("rate"), F.try_divide(F.col("last_var") - F.col("intercept"), F.col("last_mean")).alias("randomness"))


def kinetic_summary(kinetic: DataFrame) -> DataFrame:
    """Both orders of averaging: fits then mean, and mean then the same formulas."""
    s, v = F.avg("slope"), F.avg("velocity")
    return kinetic.agg(F.avg("step").alias("step_fit_avg"), F.avg("rate").alias("rate_fit_avg"), F.avg("randomness").alias("randomness_fit_avg"), F.try_divide(s, v).alias("step_avg_fit"), F.try_divide(v * v, s).alias("rate_avg_fit"))


def expected_slope(steps: DataFrame, step: str = "step", tau: str = "tau", n: str = "n") -> DataFrame:
    """Slope of the variance that steps of known size and dwell should give."""
    return steps.agg((F.sum(F.col(step) * F.col(step) / F.col(tau) * F.col(n)) / F.sum(n)).alias("slope"))
