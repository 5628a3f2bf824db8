"""Outlines of what is bright in images, as ordered points.

The sides of a mask's pixels that face its outside follow each other: after a
side comes that of the pixel which one meets when walking clockwise along the
edge, with diagonal neighbours counted as touching. So the next side is known
from four pixels alone, for all sides of all images at once, and an outline is
a cycle of sides. Cycles are numbered and put in order by doubling the length
of the steps, as many rounds as a cycle's length has binary digits. An outline
is walked clockwise where it goes around a part, and the other way where it
goes around a hole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sides of a pixel in clockwise order, with the step (x, y) to what lies beyond: left, top, right, bottom.
SIDES = np.array([(-1, 0), (0, -1), (1, 0), (0, 1)])
TOGETHER = 1 << 22  #: pixels whose outlines are walked at once
OUTLINES = "outline int, hole boolean, area long, i int, x int, y int"


def _followed(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sides (image, y, x, side) of a stack of masks in order, and the number of the side after each."""
    n, h, w = mask.shape
    p = np.pad(mask, ((0, 0), (1, 1), (1, 1)))

    def at(dx: int, dy: int) -> np.ndarray:
        return p[:, 1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]

    free = np.stack([mask & ~at(*s) for s in SIDES], axis=-1)
    sides = np.argwhere(free)
    number = np.full(free.shape, -1)
    number[free] = np.arange(len(sides))
    after = np.empty(len(sides), np.int64)
    for k, (dx, dy) in enumerate(SIDES):
        own = np.flatnonzero(sides[:, 3] == k)
        image, y, x, _ = sides[own].T
        nx, ny = SIDES[(k + 1) % 4]  # the way one walks along this side
        corner, ahead = p[image, 1 + y + dy + ny, 1 + x + dx + nx], p[image, 1 + y + ny, 1 + x + nx]
        to_x = x + np.where(corner, dx + nx, np.where(ahead, nx, 0))
        to_y = y + np.where(corner, dy + ny, np.where(ahead, ny, 0))
        side = np.where(corner, (k + 3) % 4, np.where(ahead, k, (k + 1) % 4))
        after[own] = number[image, to_y, to_x, side]
    return sides, after


def _in_cycles(after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Head (its least member) of each one's cycle, and steps from the head."""
    each = np.arange(len(after))
    head, hop = each.copy(), after.copy()
    while True:
        least = np.minimum(head, head[hop])
        if (least == head).all():
            break
        head, hop = least, hop[hop]
    # Steps that are left to the head, which ends its own.
    left, hop = (each != head).astype(np.int64), np.where(each == head, each, after)
    while (hop != head).any():
        left, hop = left + left[hop], hop[hop]
    length = np.bincount(head, minlength=len(after))[head] if len(after) else each
    return head, (length - left) % np.maximum(length, 1)


def outlines(masks: np.ndarray) -> pd.DataFrame:
    """image, outline, hole, area, i, x, y for a stack (image, y, x) of masks.

    Outlines of an image are numbered by their first pixel, row by row.
    ``area`` is the number of pixels that an outline encloses, its own included
    where it goes around a part. A pixel that an outline passes twice, as in
    lines of one pixel's width, is in it twice.
    """
    sides, after = _followed(masks)
    head, step = _in_cycles(after)
    order = np.lexsort((step, head))
    image, y, x, side = sides[order].T
    head, step = head[order], step[order]
    first = step == 0
    cycle = np.cumsum(first) - 1
    begin = np.flatnonzero(first)
    last = np.append(begin[1:], len(order)) - 1 if len(begin) else begin
    previous = np.arange(len(order)) - 1
    previous[begin] = last
    # A visit to a pixel begins where the side before is another pixel's; the first visit is the head's.
    new = (x != x[previous]) | (y != y[previous])
    seen = np.cumsum(new)
    visit = seen - seen[begin][cycle] if len(begin) else seen
    visits = np.bincount(cycle, new, len(begin)).astype(np.int64)
    alone = visits[cycle] == 0
    size = np.bincount(cycle, np.where(side == 2, x + 1, np.where(side == 0, -x, 0)), len(begin)).astype(np.int64)
    in_image = np.arange(len(begin)) - np.searchsorted(image[begin], image[begin])
    keep = new | alone & first
    i = visit % np.maximum(visits, 1)[cycle]
    out = pd.DataFrame({"image": image, "outline": in_image[cycle], "hole": (size < 0)[cycle], "area": np.abs(size)[cycle], "i": i, "x": x, "y": y})[keep]
    return out.sort_values(["image", "outline", "i"], ignore_index=True)


def outline_points(frames: DataFrame, level: float | Column, key: str = "frame_id", together: int = TOGETHER) -> DataFrame:
    """Points of the outlines of all that is brighter than ``level``: key and ``OUTLINES``.

    ``level`` is a number, or a column of a level for each frame. Parts touch
    at sides and corners. ``i`` counts an outline's points from its topmost,
    then leftmost one; with key and outline as its contour it is what
    ``polygon_moments`` takes. Null or not finite pixels are dark; frames that
    are null, without a level, or not of h times w pixels give no points, and
    neither do dark ones. Frames with equal keys are told apart by nothing, so
    keys should be distinct.
    """
    kind = frames.schema[key].dataType.simpleString()
    names = [key, *(c.split()[0] for c in OUTLINES.split(", "))]

    def walk(part: list[tuple]) -> pd.DataFrame:
        keys, masks = zip(*part, strict=True)
        found = outlines(np.stack(masks))
        found[key] = pd.Series(keys, dtype=object).to_numpy()[found["image"].to_numpy()]
        return found[names]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (h, w), rows in batch.groupby(["h", "w"]):
                held, size = [], 0
                for k, lit in zip(rows[key], rows["lit"], strict=True):
                    held.append((k, np.asarray(lit, bool).reshape(h, w)))
                    size += h * w
                    if size >= together:
                        yield walk(held)
                        held, size = [], 0
                if held:
                    yield walk(held)

    above = level if isinstance(level, Column) else F.lit(float(level))
    bright = lambda v: F.coalesce((v > F.col("__level")) & (F.abs(v) < float("inf")), F.lit(False))
    lit = frames.select(key, "h", "w", "pixels", above.alias("__level")).filter("__level is not null and h > 0 and w > 0").filter(F.size("pixels") == F.col("h") * F.col("w"))
    return lit.select(key, "h", "w", F.transform("pixels", bright).alias("lit")).filter(F.exists("lit", lambda v: v)).mapInPandas(find, f"`{key}` {kind}, {OUTLINES}")
