"""Outlines against a walk of one pixel after the other, and against filled parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelab.operators import imaging, outlines

AROUND = [(-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1)]  # clockwise, x and y


def walked(mask, x, y):
    """Border of the part whose topmost, then leftmost pixel is (x, y), by looking around each pixel."""
    h, w = mask.shape
    lit = lambda px, py: 0 <= px < w and 0 <= py < h and mask[py, px]
    at, back, out, begun = (x, y), 0, [], set()
    while (at, back) not in begun:
        begun.add((at, back))
        out.append(at)
        for k in range(1, 9):
            dx, dy = AROUND[(back + k) % 8]
            if lit(at[0] + dx, at[1] + dy):
                dark = AROUND[(back + k - 1) % 8]
                seen = (at[0] + dark[0] - at[0] - dx, at[1] + dark[1] - at[1] - dy)
                at, back = (at[0] + dx, at[1] + dy), AROUND.index(seen)
                break
        else:
            break
    return out


def parts(mask, corners):
    """Sets of pixels that touch, at corners too if asked."""
    left, out = {(int(x), int(y)) for y, x in np.argwhere(mask)}, []
    while left:
        part, todo = set(), [left.pop()]
        while todo:
            x, y = todo.pop()
            part.add((x, y))
            near = {(x + dx, y + dy) for dx, dy in AROUND if corners or 0 in (dx, dy)} & left
            left -= near
            todo += near
        out.append(part)
    return out


@pytest.mark.parametrize("share", [0.05, 0.3, 0.5, 0.7, 0.95, 1.0])
@pytest.mark.parametrize("shape", [(1, 1), (1, 9), (7, 1), (8, 8), (17, 23)])
def test_outlines_equal_walks(share, shape):
    rng = np.random.default_rng(int(share * 100) + shape[0])
    masks = rng.random((12, *shape)) < share
    got = outlines.outlines(masks)
    for k, mask in enumerate(masks):
        own = got[got["image"] == k]
        found = {n: list(zip(g["x"], g["y"], strict=True)) for n, g in own[~own["hole"]].groupby("outline")}
        whole = parts(mask, True)
        want = {min(p, key=lambda q: (q[1], q[0])): p for p in whole}
        assert {line[0] for line in found.values()} == set(want)
        for n, line in found.items():
            walk = walked(mask, *line[0])
            # a walk ends where it meets its own beginning; both are one round
            assert line == walk[: len(line)] and set(line) == set(walk)
            enclosed = int(own.loc[own["outline"] == n, "area"].iloc[0])
            holes = [d for d in parts(np.pad(~mask, 1, constant_values=True), False) if (0, 0) not in d]
            around = np.zeros(tuple(s + 2 for s in shape), bool)
            for x, y in want[line[0]]:
                around[y + 1, x + 1] = True
            inside = sum(len(d) for d in parts(~around, False) if (0, 0) not in d)
            assert enclosed == len(want[line[0]]) + inside
        dark = sorted(len(d) for d in parts(np.pad(~mask, 1, constant_values=True), False) if (0, 0) not in d)
        # a hole inside a hole's island is that island's: sizes of holes count what lies in them
        per_hole = own[own["hole"]].groupby("outline")["area"].first()
        assert len(per_hole) == len(dark) and per_hole.sum() >= sum(dark)


def frame(spark, rows):
    return spark.createDataFrame(rows, "frame_id long, h int, w int, pixels array<double>")


def test_odd_frames(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 2, 2, [9.0, 0.0, 0.0, 9.0]), (2, 2, 2, None), (3, 2, 2, [1.0]), (4, 1, 3, [nan, None, inf]), (5, 1, 4, [9.0, 9.0, None, 9.0]), (6, 0, 0, []), (7, 2, 2, [0.0] * 4), (None, 1, 1, [9.0])]
    got = outlines.outline_points(frame(spark, rows), 5.0).orderBy("frame_id", "outline", "i").collect()
    assert [tuple(r) for r in got] == [
        (None, 0, False, 1, 0, 0, 0),
        (1, 0, False, 2, 0, 0, 0), (1, 0, False, 2, 1, 1, 1),
        (5, 0, False, 2, 0, 0, 0), (5, 0, False, 2, 1, 1, 0), (5, 1, False, 1, 0, 3, 0),
    ]
    assert outlines.outline_points(frame(spark, []), 5.0).count() == 0


def test_levels_by_frame_and_moments(spark):
    y, x = np.mgrid[:80, :90]
    disc = lambda cx, cy, r: 100.0 * ((x - cx) ** 2 + (y - cy) ** 2 <= r * r)
    rows = [(k, 80, 90, (disc(*d) * (k + 1)).ravel().tolist()) for k, d in enumerate([(30, 40, 20), (45.5, 38.5, 12), (60, 30, 25)])]
    points = outlines.outline_points(frame(spark, rows), F.array_max("pixels") / 2, together=1).withColumn("contour", F.col("frame_id") * 1000 + F.col("outline"))
    got = imaging.polygon_moments(points).orderBy("contour").toPandas()
    for r, (cx, cy, radius) in zip(got.itertuples(), [(30, 40, 20), (45.5, 38.5, 12), (60, 30, 25)], strict=True):
        assert abs(r.cx - cx) < 0.3 and abs(r.cy - cy) < 0.3 and abs(r.radius - radius) < 0.1 * radius
