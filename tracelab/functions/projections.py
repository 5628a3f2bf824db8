"""Small projections that features, fits and sinks share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NM_PER_PIXEL = 10000 / 180
RATIO_LIMIT = 99999


def or_null(x: Column | str) -> Column:
    """NaN and null as null, the missing value inside the library."""
    c = F.col(x) if isinstance(x, str) else x
    return F.when(~F.isnan(c), c)


def or_zero(x: Column | str) -> Column:
    """Null and NaN as 0, infinities as the largest finite doubles."""
    c = F.coalesce(or_null(x), F.lit(0.0))
    big = 1.7976931348623157e308
    return F.greatest(F.least(c, F.lit(big)), F.lit(-big))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b as single precision; null where b is 0, and 0 where the ratio is out of range."""
    a, b = (F.col(v) if isinstance(v, str) else v for v in (a, b))
    r = F.try_divide(a, b)
    return F.when(r > RATIO_LIMIT, F.lit(0.0)).otherwise(r).cast("float")


def to_nm(x: Column | str, factor: float = NM_PER_PIXEL) -> Column:
    return (F.col(x) if isinstance(x, str) else x) * factor


def velocity(first: Column, last: Column, t1: Column, t2: Column, fps: float | None = None) -> Column:
    """Change of level per frame, or per minute if frames per second are given."""
    v = F.try_divide(last - first, (t2 - t1).cast("double"))
    return v if fps is None else v * (fps * 60)


def step_size(slope: Column, v: Column) -> Column:
    return F.try_divide(slope, v)


def step_rate(slope: Column, v: Column) -> Column:
    return F.try_divide(v * v, slope)


def randomness(variance: Column, intercept: Column, mean: Column) -> Column:
    return F.try_divide(variance - intercept, mean)


def component_name(name: str, i: int) -> str:
    return f"component_{name}_{i}"


def quantised(x: Column | str, digits: int = 6) -> Column:
    """Rounded the same way by every engine: half up, with exact ties moved off the boundary."""
    c = (F.col(x) if isinstance(x, str) else x).cast("double")
    scale = float(10**digits)
    return F.floor(c * scale + 0.5 + 1e-4).cast("double") / scale


def sql_quantised(x: str, digits: int = 6) -> str:
    scale = f"{10**digits}.0::DOUBLE"
    return f"(floor(({x})::DOUBLE * {scale} + 0.5::DOUBLE + 0.0001::DOUBLE)::DOUBLE / {scale})"
