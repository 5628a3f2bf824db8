"""Images: areas of interest, spots, contours and tracking.

A frame is a row (frame_id, h, w, pixels) with pixels row by row as an array of
doubles. Sums and peaks are Column expressions; edges and spot fits work on
numpy arrays inside tasks, a batch of frames at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelab.session import shared_dir

BEADS, BROADCAST_BEADS = 5000, 500_000  #: beads in one list, and those (of 24 bytes) that are broadcast
SPOT = ("amplitude", "sx", "sy", "x", "y", "theta_deg", "offset")
TRACK = "frame int, aoi int, " + ", ".join(f"{c} double" for c in (*SPOT, "intensity", "intensity_integral", "ss_res")) + ", fit_ok boolean"


# Column expressions

def mean_image(frames: DataFrame, by: list[str] | None = None, pixels: str = "pixels") -> DataFrame:
    """Mean of each pixel over frames, cut to whole numbers as stored images are: by, pixels."""
    by = by or []
    each = frames.select(*by, F.posexplode(pixels).alias("at", "v")).groupBy(*by, "at").agg(F.floor(F.avg("v")).cast("double").alias("v"))
    packed = F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias(pixels)
    return each.groupBy(*by).agg(packed) if by else each.agg(packed)


def total(pixels: Column | str) -> Column:
    return F.aggregate(pixels, F.lit(0.0), lambda a, v: a + v)


def mean(pixels: Column | str) -> Column:
    return total(pixels) / F.size(pixels)


def peak(pixels: Column | str, width: int | Column) -> tuple[Column, Column]:
    """x and y of the brightest pixel, the first of equals."""
    at = F.array_position(pixels, F.array_max(pixels)) - 1
    return at % width, F.floor(at / width)


def crop(pixels: str, width: int | Column, row: Column, column: Column, size: int) -> Column:
    """The square of ``size`` around a pixel as one array; edges are the caller's to check."""
    half = size // 2
    rows = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda r: F.slice(F.col(pixels), ((row - half + r) * width + column - half + 1).cast("int"), size))
    return F.flatten(rows)


def polygon_moments(points: DataFrame, key: str = "contour", order: str = "i", x: str = "x", y: str = "y") -> DataFrame:
    """Perimeter, area, centroid and radius of closed contours: sums over their edges.

    Contours without length or area are left out.
    """
    w = Window.partitionBy(key).orderBy(order)
    first = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    edges = points.select(key, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.coalesce(F.lead(x).over(w), F.first(x).over(first)).cast("double").alias("x2"), F.coalesce(F.lead(y).over(w), F.first(y).over(first)).cast("double").alias("y2"))
    cross = F.col("x") * F.col("y2") - F.col("x2") * F.col("y")
    sums = edges.groupBy(key).agg(F.sum(F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y"))).alias("perimeter"), (F.sum(cross) / 2).alias("a"), F.sum((F.col("x") + F.col("x2")) * cross).alias("mx"), F.sum((F.col("y") + F.col("y2")) * cross).alias("my"))
    kept = sums.filter((F.col("perimeter") != 0) & (F.col("a") != 0))
    return kept.select(key, "perimeter", F.abs("a").alias("area"), (F.col("mx") / (6 * F.col("a"))).alias("cx"), (F.col("my") / (6 * F.col("a"))).alias("cy"), (2 * F.abs("a") / F.col("perimeter")).alias("radius"))


# Point sets

def far_apart(points: DataFrame, distance: float, by: list[str] | None = None, x: str = "x", y: str = "y", point: str = "point_id") -> DataFrame:
    """Points with no other within ``distance``; points at the very same place don't count.

    Places are put in cells so small that two in one cell are always close.
    Only a place that is alone in its cell is compared, with those of the 24
    cells around it, so that a dense spot costs no more than its places.
    """
    by, width = by or [], distance / math.sqrt(2) * (1 - 1e-9)
    cell = [F.floor(F.col(c) / width).cast("long").alias(n) for c, n in ((x, "u"), (y, "v"))]
    places = points.select(*by, x, y, *cell).distinct()
    alone = places.groupBy(*by, "u", "v").agg(F.count("*").alias("__n"), F.min(x).alias("__x"), F.min(y).alias("__y")).filter("__n = 1").drop("__n")
    steps = F.sequence(F.lit(-2), F.lit(2))
    around = F.explode(F.flatten(F.transform(steps, lambda i: F.transform(steps, lambda j: F.struct((F.col("u") + i).alias("u"), (F.col("v") + j).alias("v"))))))
    spread = places.select(*by, x, y, around.alias("c")).select(*by, x, y, "c.u", "c.v")
    dx, dy = F.col(x) - F.col("__x"), F.col(y) - F.col("__y")
    d = F.sqrt(dx * dx + dy * dy)
    close = alone.join(spread, [*by, "u", "v"]).filter((d > 0) & (d <= distance)).select(*by, "u", "v").distinct()
    kept = alone.join(close, [*by, "u", "v"], "left_anti").select(*by, F.col("__x").alias(x), F.col("__y").alias(y))
    return points.join(kept, [*by, x, y], "left_semi")


def spread_out(points: DataFrame, distance: float, by: list[str] | None = None, x: str = "x", y: str = "y", point: str = "point_id") -> DataFrame:
    """Greedy choice by rising distance from the origin, then number: chosen points.

    A point is taken if it differs from every point taken before by ``distance``
    in x, in y or in distance from the origin. With ``by`` each image is one
    task's work; without, all points are one image, which is worked off in
    rounds of joins between neighbouring cells.
    """
    if not by:
        return _spread_in_rounds(points.select(point, x, y), distance, x, y, point)
    schema = points.select(*by, point, x, y).schema

    def choose(image: pd.DataFrame) -> pd.DataFrame:
        r = np.hypot(image[x], image[y])
        image = image.assign(__r=r).sort_values(["__r", point])
        px, py, pr = (image[c].to_numpy(float) for c in (x, y, "__r"))
        taken: list[int] = []
        for i in range(len(image)):
            t = np.array(taken, int)
            if not len(t) or ((np.abs(px[i] - px[t]) >= distance) | (np.abs(py[i] - py[t]) >= distance) | (np.abs(pr[i] - pr[t]) >= distance)).all():
                taken.append(i)
        return image.iloc[taken][[*by, point, x, y]]

    return points.groupBy(*by).applyInPandas(choose, schema)


def _spread_in_rounds(points: DataFrame, distance: float, x: str, y: str, point: str) -> DataFrame:
    """Each round takes the first point of every cell that no earlier one is in the way of, and drops those it is in the way of."""
    spark, path = points.sparkSession, shared_dir(points.sparkSession, "spread-out")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    cell = [F.floor(F.col(c) / distance).cast("long").alias(n) for c, n in ((x, "u"), (y, "v"))]
    open_ = kept(points.select(F.struct(F.hypot(x, y).alias("r"), F.col(point).alias("p"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).alias("q"), *cell), "points")
    steps = F.sequence(F.lit(-1), F.lit(1))
    around = F.explode(F.flatten(F.transform(steps, lambda i: F.transform(steps, lambda j: F.struct((F.col("u") + i).alias("u"), (F.col("v") + j).alias("v"))))))
    near = reduce(Column.__and__, (F.abs(F.col(f"q.{c}") - F.col(f"c.{c}")) < distance for c in ("x", "y", "r")))
    taken, turn = [], 0
    while not open_.isEmpty():
        first = open_.groupBy("u", "v").agg(F.min("q").alias("c")).select("c", around.alias("w")).select("c", "w.u", "w.v")
        met = kept(open_.join(first, ["u", "v"]).filter(near).select("q", "c"), f"met-{turn}")
        free = met.groupBy("c").agg(F.min("q").alias("least")).filter("least = c").select("c")
        taken.append(kept(free, f"taken-{turn}"))
        gone = met.join(taken[-1], "c", "left_semi").select("q").distinct()
        open_ = kept(open_.join(gone, "q", "left_anti"), f"open-{turn}")
        turn += 1
    if not taken:
        return points
    chosen = reduce(DataFrame.unionByName, taken).select(F.col("c.p").alias(point))
    return points.join(chosen, point, "left_semi")


# Kernels on numpy arrays

def enhanced(image: np.ndarray, contrast: float) -> np.ndarray:
    """Grey values moved away from the mean by ``contrast``, within 0 to 255."""
    middle = np.floor(image.mean() + 0.5)
    return np.clip(np.floor(middle + contrast * (image - middle)), 0, 255)


def edges(image: np.ndarray, low: float, high: float) -> np.ndarray:
    """Thin edges by gradient: local maxima across the edge above ``low`` that hang on one above ``high``."""
    p = np.pad(image.astype(float), 1, mode="edge")
    gx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    gy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    size = np.abs(gx) + np.abs(gy)
    turn = np.round(np.arctan2(gy, gx) / (np.pi / 4)).astype(int) % 4
    q, h, w = np.pad(size, 1), *image.shape
    peak_ = np.zeros(image.shape, bool)
    for k, (dy, dx) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
        one, other = q[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w], q[1 - dy : 1 - dy + h, 1 - dx : 1 - dx + w]
        peak_ |= (turn == k) & (size > one) & (size >= other)
    weak = peak_ & (size > low)
    label = components(weak)
    strong = np.unique(label[weak & (size > high)])
    return np.isin(label, strong[strong > 0])


def components(mask: np.ndarray) -> np.ndarray:
    """Numbers the 8-connected parts of a mask from 1; 0 is outside."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        p = np.pad(label, 1)
        near = np.max([p[1 + i : p.shape[0] - 1 + i, 1 + j : p.shape[1] - 1 + j] for i in (-1, 0, 1) for j in (-1, 0, 1)], axis=0)
        new = np.where(mask, near, 0)
        if (new == label).all():
            return np.unique(label, return_inverse=True)[1].reshape(mask.shape) if not mask.all() else np.ones(mask.shape, int)
        label = new


def contours(image: np.ndarray, low: float = 30, high: float = 90, margin: int = 30) -> list[tuple[float, float, float]]:
    """Centre x, y and radius of what edges enclose, away from the margin.

    An outline is filled row by row; its area and number of edge pixels give
    the radius 2A/P.
    """
    inner = image[margin : image.shape[0] - margin, margin : image.shape[1] - margin] if margin else image
    label, out = components(edges(inner, low, high)), []
    for k in range(1, int(label.max(initial=0)) + 1):
        ys, xs = np.nonzero(label == k)
        rows = np.unique(ys)
        left, right = np.array([xs[ys == r].min() for r in rows]), np.array([xs[ys == r].max() for r in rows])
        n = right - left + 1
        area = int(n.sum())
        if len(xs) > 2 and area > len(xs):
            out.append((float(((left + right) / 2 * n).sum() / area) + margin, float((rows * n).sum() / area) + margin, 2 * area / len(xs)))
    return out


def spot(p: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A turned Gaussian spot on a square of pixels, and its derivatives by the seven parameters."""
    amplitude, sx, sy, x0, y0, theta, offset = p
    y, x = np.mgrid[:size, :size]
    a = np.radians(theta)
    c, s, dx, dy = np.cos(a), np.sin(a), x - x0, y - y0
    u, v = c * dx - s * dy, s * dx + c * dy
    e = np.exp(-(u * u / (2 * sx * sx) + v * v / (2 * sy * sy)))
    g, gu, gv = amplitude * e, u / sx**2, v / sy**2
    d = [e, g * u * u / sx**3, g * v * v / sy**3, g * (gu * c + gv * s), g * (gv * c - gu * s), g * (gu * v - gv * u) * np.pi / 180, np.ones_like(e)]
    return (g + offset).ravel(), np.stack([z.ravel() for z in d], axis=1)


def fit_spot(area: np.ndarray, background: float, most: int = 200) -> tuple[np.ndarray, float, bool]:
    """Bounded least-squares fit of a spot from its brightest pixel: parameters, squared residuals, success."""
    size = area.shape[0]
    low = np.array([1, 0.5, 0.5, 0, 0, 0, 0], float)
    high = np.array([255, size / 2, size / 2, size, size, 90, 255], float)
    at, z = int(area.argmax()), area.astype(float).ravel()
    p = np.array([z.max() - background, 2.5, 2.5, at % size, at // size, 0, background])
    if not np.isfinite(z).all() or (p < low).any() or (p > high).any():
        return np.zeros(7), 0.0, False
    p, damp = np.clip(p, low + 1e-9, high - 1e-9), 1e-2
    f, j = spot(p, size)
    cost = float(((z - f) ** 2).sum())
    for _ in range(most):
        free = ~(((p <= low) & (j.T @ (z - f) < 0)) | ((p >= high) & (j.T @ (z - f) > 0)))
        a, b = j[:, free].T @ j[:, free], j[:, free].T @ (z - f)
        step = np.zeros(7)
        try:
            step[free] = np.linalg.solve(a + damp * np.diag(np.maximum(np.diag(a), 1e-12)), b)
        except np.linalg.LinAlgError:
            return np.zeros(7), 0.0, False
        q = np.clip(p + step, low, high)
        fq, jq = spot(q, size)
        new = float(((z - fq) ** 2).sum())
        if new <= cost:
            done = cost - new <= 1e-10 * max(cost, 1e-12) or np.abs(q - p).max() < 1e-9
            p, f, j, cost, damp = q, fq, jq, new, max(damp / 5, 1e-12)
            if done:
                return p, cost, True
        else:
            damp *= 4
            if damp > 1e12:
                return p, cost, True
    return np.zeros(7), 0.0, False


# Operators with kernels

def localize(images: DataFrame, contrast: float = 1.0, low: float = 30, high: float = 90, margin: int = 30, key: str = "image_id") -> DataFrame:
    """Outlines found in each image: key, point_id, x, y, radius."""
    kind = dict(images.dtypes)[key]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                image = np.asarray(r.pixels, float).reshape(int(r.h), int(r.w))
                rows += [(getattr(r, key), i, *c) for i, c in enumerate(contours(enhanced(image, contrast), low, high, margin))]
            yield pd.DataFrame(rows, columns=[key, "point_id", "x", "y", "radius"])

    return images.select(key, "h", "w", "pixels").mapInPandas(find, f"`{key}` {kind}, point_id long, x double, y double, radius double")


def track(frames: DataFrame, beads: DataFrame, size: int = 20, background: float = 0.0, contrast: float | None = None) -> DataFrame:
    """Spot parameters of every bead in every frame (the ``TRACK`` columns).

    Beads (aoi, x, y) go to the frames (frame_id, h, w, pixels) in lists of at
    most ``BEADS``, which are broadcast up to ``BROADCAST_BEADS`` beads. A failed
    fit has zeros and fit_ok false. The guess of each fit is its own frame's, so
    frames don't depend on each other.
    """
    n = beads.count()
    own = F.struct(F.col("aoi").cast("int").alias("aoi"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    part = F.pmod(F.xxhash64("aoi"), F.lit(max(1, -(-n // BEADS))))
    listed = beads.groupBy(part.alias("part")).agg(F.array_sort(F.collect_list(own)).alias("beads")).select("beads")
    if n <= BROADCAST_BEADS:
        listed = F.broadcast(listed)
    names = [c.split()[0] for c in TRACK.split(", ")]

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                image = np.asarray(r.pixels, float).reshape(int(r.h), int(r.w))
                for b in r.beads:
                    y, x = int(b["y"]), int(b["x"])
                    y0, x0 = max(0, y - size // 2), max(0, x - size // 2)
                    area = image[y0 : y0 + size, x0 : x0 + size]
                    whole = area.shape == (size, size)
                    seen = enhanced(area, contrast) if whole and contrast else area
                    p, ss, ok = fit_spot(seen, background) if whole else (np.zeros(7), 0.0, False)
                    volume = 2 * np.pi * p[0] * p[1] * p[2]
                    rows.append((int(r.frame_id), int(b["aoi"]), *p, float(area.sum()) if ok else 0.0, volume, ss, ok))
            yield pd.DataFrame(rows, columns=names)

    return frames.select("frame_id", "h", "w", "pixels").crossJoin(listed).mapInPandas(fit, TRACK)
