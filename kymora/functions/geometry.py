"""Geometry over landmark arrays: packed coordinates, ``dims`` numbers per point, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(a: Column, point: int, axis: int, dims: int = 2) -> Column:
    """A coordinate of a point, as double."""
    return F.get(a, F.lit(point * dims + axis)).cast("double")


def distance(a: Column, p: int, q: int, dims: int = 2) -> Column:
    dx, dy = at(a, p, 0, dims) - at(a, q, 0, dims), at(a, p, 1, dims) - at(a, q, 1, dims)
    return F.sqrt(dx * dx + dy * dy)


def aspect_ratio(a: Column, ends: tuple[int, int], pairs: list[tuple[int, int]], dims: int = 2) -> Column:
    """Mean of vertical distances over the horizontal one; 0 for a width under 1e-6. Two pairs: an eye, three: a mouth."""
    width = distance(a, *ends, dims)
    return F.when(width < 1e-6, 0.0).otherwise(sum((distance(a, *p, dims) for p in pairs[1:]), distance(a, *pairs[0], dims)) / (len(pairs) * width))


def iris_position(a: Column, iris: int, outer: int, inner: int, dims: int = 2) -> tuple[Column, Column]:
    """The iris on the eye's axis, which points to larger x, and on its upward normal, in half widths, in [-1, 1]."""
    swap = at(a, outer, 0, dims) > at(a, inner, 0, dims)
    lx, ly = (F.when(swap, at(a, inner, i, dims)).otherwise(at(a, outer, i, dims)) for i in (0, 1))
    rx, ry = (F.when(swap, at(a, outer, i, dims)).otherwise(at(a, inner, i, dims)) for i in (0, 1))
    w = F.sqrt((rx - lx) * (rx - lx) + (ry - ly) * (ry - ly))
    ux, uy = (rx - lx) / w, (ry - ly) / w
    dx, dy = at(a, iris, 0, dims) - (lx + rx) / 2, at(a, iris, 1, dims) - (ly + ry) / 2
    clip = lambda v: F.when(w < 1e-6, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v / (w / 2))))
    return clip(dx * ux + dy * uy), clip(dx * uy - dy * ux)


def axis(a: Column, which: int, dims: int = 2) -> Column:
    """One coordinate of all points."""
    return F.transform(F.filter(a, lambda _, i: i % dims == which), lambda v: v.cast("double"))


def bounding_box(a: Column, dims: int = 2) -> dict[str, Column]:
    """x0, y0, x1, y1; zeros for an array without points or with NaN."""
    x, y = axis(a, 0, dims), axis(a, 1, dims)
    bad = a.isNull() | (F.size(a) < dims) | F.exists(a, lambda v: F.isnan(v))
    return {n: F.when(bad, 0.0).otherwise(c) for n, c in (("x0", F.array_min(x)), ("y0", F.array_min(y)), ("x1", F.array_max(x)), ("y1", F.array_max(y)))}


def center_scale(a: Column, dims: int = 2, floor: float = 1.0) -> dict[str, Column]:
    """Centre of the box and its larger side, ``floor`` at least."""
    b = bounding_box(a, dims)
    return {"cx": (b["x0"] + b["x1"]) / 2, "cy": (b["y0"] + b["y1"]) / 2, "scale": F.greatest(b["x1"] - b["x0"], b["y1"] - b["y0"], F.lit(floor))}


def remap(a: Column, x0: Column, y0: Column, w: Column, h: Column, dims: int = 2) -> Column:
    """Coordinates of a crop as those of the frame; sides count as 1 at least."""
    w, h = F.greatest(w, F.lit(1.0)), F.greatest(h, F.lit(1.0))
    return F.transform(a, lambda v, i: F.when(i % dims == 0, x0 + v * w).when(i % dims == 1, y0 + v * h).otherwise(v * w))


def unmap(a: Column, x0: Column, y0: Column, w: Column, h: Column, dims: int = 2) -> Column:
    """The inverse of ``remap``."""
    w, h = F.greatest(w, F.lit(1.0)), F.greatest(h, F.lit(1.0))
    return F.transform(a, lambda v, i: F.when(i % dims == 0, (v - x0) / w).when(i % dims == 1, (v - y0) / h).otherwise(v / w))


def derotate(a: Column, left: int, right: int, centre: int, dims: int = 2) -> Column:
    """Points turned about one of them until the line between two others is level."""
    angle = -F.atan2(at(a, right, 1, dims) - at(a, left, 1, dims), at(a, right, 0, dims) - at(a, left, 0, dims))
    cx, cy, c, s = at(a, centre, 0, dims), at(a, centre, 1, dims), F.cos(angle), F.sin(angle)
    turned = lambda v, i: F.when(
        i % dims == 0, cx + (F.get(a, i) - cx) * c - (F.get(a, i + 1) - cy) * s
    ).when(i % dims == 1, cy + (F.get(a, i - 1) - cx) * s + (F.get(a, i) - cy) * c).otherwise(v.cast("double"))
    return F.transform(a, turned)


def is_valid(a: Column, points: int, dims: int = 2, reach: float = 1e-3) -> Column:
    """Enough points, all finite, and some extent in both directions."""
    ok = a.isNotNull() & (F.size(a) >= points * dims) & F.forall(a, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    b = bounding_box(a, dims)
    return F.coalesce(ok & (b["x1"] - b["x0"] >= reach) & (b["y1"] - b["y0"] >= reach), F.lit(False))


def vergence(left_x: Column, right_x: Column, degrees: float = 15.0, limit: float = -3.5) -> tuple[Column, Column]:
    """Angle between the eyes, and whether they drift apart."""
    v = (right_x - left_x) * degrees
    return v, v < limit


def square_crop(cx: Column, cy: Column, scale: Column, margin: float, width: float, height: float) -> dict[str, Column]:
    """A square about the centre, as large as ``scale * margin`` but inside the frame, shifted until it fits."""
    side = F.least(F.greatest(F.bround(scale * margin), F.lit(1.0)), F.lit(min(width, height)))
    x0 = F.least(F.greatest(F.bround(cx - side / 2), F.lit(0.0)), F.lit(width) - side)
    y0 = F.least(F.greatest(F.bround(cy - side / 2), F.lit(0.0)), F.lit(height) - side)
    return {"x0": x0, "y0": y0, "x1": x0 + side, "y1": y0 + side}


def pose_compensated(left: Column, right: Column, yaw: Column, pitch: Column) -> Column:
    """Mean opening, weighted to the larger eye when turned over 12 degrees and raised when looking down over 6."""
    mean, top = (left + right) / 2, F.greatest(left, right)
    weight = F.least(F.lit(0.35), (F.abs(yaw) - 12) / 40)
    turned = F.when((F.abs(yaw) > 12) & (top > 0.18), mean * (1 - weight) + top * weight).otherwise(mean)
    return turned + F.when(pitch > 6, F.least(F.lit(0.045), (pitch - 6) * 0.0025)).otherwise(0.0)


def down_glance_scale(pitch: Column, gaze_y: Column) -> Column:
    down = F.greatest(F.lit(0.0), pitch - 6, -pitch - 8)
    gaze = F.greatest(F.lit(0.0), -gaze_y - 0.20)
    return F.greatest(F.lit(0.65), 1 - 0.012 * down - 0.15 * gaze)


def gamma_table(gamma: float) -> Column:
    """256 entries of (i / 255) ** gamma * 255, cut to whole numbers."""
    return F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.pow(i / 255.0, F.lit(gamma)) * 255.0))).cast("int"))
