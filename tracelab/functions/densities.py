"""Probability densities, survival curves and model curves as Column expressions.

Arguments may be columns or numbers. Mixtures are lists with one Column for
each component, so a fit or a plot table can use them side by side.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = Column | float | int
ROOT_2PI = math.sqrt(2 * math.pi)
HALF_LN_2PI = 0.5 * math.log(2 * math.pi)


def col(v: Value | str) -> Column:
    return F.col(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(float(v))


def gauss(x: Value | str, m: Value, s: Value) -> Column:
    z = (col(x) - col(m)) / col(s)
    return F.exp(-z * z / 2) / (col(s) * ROOT_2PI)


def ln_gauss(x: Value | str, m: Value, s: Value) -> Column:
    z = (col(x) - col(m)) / col(s)
    return -F.log(col(s)) - HALF_LN_2PI - z * z / 2


def exponential(t: Value | str, tau: Value) -> Column:
    return F.exp(-col(t) / col(tau)) / col(tau)


def ln_exponential(t: Value | str, tau: Value) -> Column:
    return -F.log(col(tau)) - col(t) / col(tau)


def gauss_mixture(x: Value | str, f: Sequence[Value], m: Sequence[Value], s: Sequence[Value]) -> list[Column]:
    return [col(a) * gauss(x, b, c) for a, b, c in zip(f, m, s, strict=True)]


def ln_gauss_mixture(x: Value | str, f: Sequence[Value], m: Sequence[Value], s: Sequence[Value]) -> list[Column]:
    return [F.log(col(a)) + ln_gauss(x, b, c) for a, b, c in zip(f, m, s, strict=True)]


def exp_survival(t: Value | str, f: Sequence[Value], tau: Sequence[Value]) -> list[Column]:
    return [col(a) * F.exp(-col(t) / col(b)) for a, b in zip(f, tau, strict=True)]


def exp_mixture(t: Value | str, f: Sequence[Value], tau: Sequence[Value]) -> list[Column]:
    return [col(a) * exponential(t, b) for a, b in zip(f, tau, strict=True)]


def ln_exp_mixture(t: Value | str, f: Sequence[Value], tau: Sequence[Value]) -> list[Column]:
    return [F.log(col(a)) + ln_exponential(t, b) for a, b in zip(f, tau, strict=True)]


def gauss_exp_mixture(x: Value | str, t: Value | str, f: Sequence[Value], m: Sequence[Value], s: Sequence[Value], tau: Sequence[Value]) -> list[Column]:
    return [g * exponential(t, d) for g, d in zip(gauss_mixture(x, f, m, s), tau, strict=True)]


def ln_gauss_exp_mixture(x: Value | str, t: Value | str, f: Sequence[Value], m: Sequence[Value], s: Sequence[Value], tau: Sequence[Value]) -> list[Column]:
    return [g + ln_exponential(t, d) for g, d in zip(ln_gauss_mixture(x, f, m, s), tau, strict=True)]


def surface_exp_gauss(x: Value | str, t: Value | str, f: Value, m: Value, s: Value, tau: Value) -> Column:
    """A plot surface, not a density: the width multiplies and nothing is divided by tau."""
    d = col(x) - col(m)
    return col(f) * F.exp(-col(t) / col(tau)) * col(s) / ROOT_2PI * F.exp(-d * d / (2 * col(s) * col(s)))


def gauss_2d(x: Value | str, y: Value | str, amplitude: Value, sx: Value, sy: Value, x0: Value, y0: Value, theta_deg: Value, offset: Value) -> Column:
    """A Gaussian spot on a plane, turned by ``theta_deg`` degrees, on an offset."""
    a = F.radians(col(theta_deg))
    dx, dy = col(x) - col(x0), col(y) - col(y0)
    ca, sa, vx, vy = F.cos(a), F.sin(a), 2 * col(sx) * col(sx), 2 * col(sy) * col(sy)
    xx, yy = ca * ca / vx + sa * sa / vy, sa * sa / vx + ca * ca / vy
    xy = F.sin(2 * a) / 2 * (1 / vy - 1 / vx)
    return col(offset) + col(amplitude) * F.exp(-(xx * dx * dx + 2 * xy * dx * dy + yy * dy * dy))


def line(x: Value | str, slope: Value, intercept: Value) -> Column:
    return col(x) * col(slope) + col(intercept)


def cubic(x: Value | str, p1: Value, p2: Value, p3: Value) -> Column:
    """p1 x + p2 x^2 + p3 x^3."""
    return col(x) * (col(p1) + col(x) * (col(p2) + col(x) * col(p3)))


def ln_binomial_kernel(heads: Value | str, tails: Value | str, p: Value) -> Column:
    """Log-likelihood of coin tosses up to the binomial coefficient, which cancels in weights."""
    return col(heads) * F.log(col(p)) + col(tails) * F.log(1 - col(p))


def spot_volume(amplitude: Value | str, sx: Value | str, sy: Value | str) -> Column:
    return 2 * math.pi * col(amplitude) * col(sx) * col(sy)
