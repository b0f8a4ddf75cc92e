"""Boxes and planes as Column functions. Boxes are x, y, w, h (top left) unless named otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def corners(x: Column, y: Column, w: Column, h: Column) -> tuple[Column, Column, Column, Column]:
    return x, y, x + w, y + h


def center(x: Column, y: Column, w: Column, h: Column) -> tuple[Column, Column]:
    return x + w / 2, y + h / 2


def from_corners(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column, Column, Column]:
    return x1, y1, x2 - x1, y2 - y1


def iou(a: tuple[Column, ...], b: tuple[Column, ...], eps: float | None = None) -> Column:
    """Intersection over union of two x, y, w, h boxes. With ``eps`` it is added to the union, else an empty union gives 0."""
    ax, ay, aw, ah = a
    bx, by, bw, bh = b
    zero = F.lit(0.0)
    wide = F.greatest(zero, F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    high = F.greatest(zero, F.least(ay + ah, by + bh) - F.greatest(ay, by))
    both = wide * high
    union = F.greatest(aw, zero) * F.greatest(ah, zero) + F.greatest(bw, zero) * F.greatest(bh, zero) - both
    return both / (union + eps) if eps is not None else F.when(union > 0, both / union).otherwise(zero)


def yolo_label(x: Column, y: Column, w: Column, h: Column, width: float, height: float, cls: int = 0) -> Column:
    """``cls cx cy w h``, normalised, held in 0..1, six places."""
    unit = lambda c: F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)), 6)
    cx, cy = center(x, y, w, h)
    return F.format_string(f"{cls} %.6f %.6f %.6f %.6f", unit(cx / width), unit(cy / height), unit(w / width), unit(h / height))


def sort_corners(points: Column) -> Column:
    """Four [x, y] points as top left, top right, bottom right, bottom left: extremes of x + y and y - x."""
    total, slope = (lambda p: p[0] + p[1]), (lambda p: p[1] - p[0])
    pick = lambda key, last: F.array_sort(F.transform(points, lambda p: F.struct(key(p).alias("k"), p.alias("p"))))[3 if last else 0]["p"]
    return F.array(pick(total, False), pick(slope, False), pick(total, True), pick(slope, True))


def output_size(c: Column) -> tuple[Column, Column]:
    """Width and height that keep the longer of opposite edges of sorted corners, truncated."""
    edge = lambda i, j: F.hypot(c[j][0] - c[i][0], c[j][1] - c[i][1])
    return F.greatest(edge(3, 2), edge(0, 1)).cast("int"), F.greatest(edge(1, 2), edge(0, 3)).cast("int")


def rectify(px: Column, py: Column, c: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Map a point by the homography that takes sorted corners to a width x height rectangle (ends at width - 1, height - 1).

    The square-to-quadrilateral map of Heckbert (1989) in closed form, inverted by its adjugate.
    """
    x0, y0, x1, y1, x2, y2, x3, y3 = (c[i][k] for i in range(4) for k in range(2))
    sx, sy = x0 - x1 + x2 - x3, y0 - y1 + y2 - y3
    dx1, dx2, dy1, dy2 = x1 - x2, x3 - x2, y1 - y2, y3 - y2
    det = dx1 * dy2 - dx2 * dy1
    g, h = (sx * dy2 - dx2 * sy) / det, (dx1 * sy - sx * dy1) / det
    a, b, d, e = x1 - x0 + g * x1, x3 - x0 + h * x3, y1 - y0 + g * y1, y3 - y0 + h * y3
    u = (e - y0 * h) * px + (x0 * h - b) * py + (b * y0 - x0 * e)
    v = (y0 * g - d) * px + (a - x0 * g) * py + (x0 * d - a * y0)
    w = (d * h - e * g) * px + (b * g - a * h) * py + (a * e - b * d)
    return u / w * (width - 1), v / w * (height - 1)
