"""Geometry as column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def sphere_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance by the spherical law of cosines; the cosine is clamped, so equal points are 0 apart."""
    c = F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lng2) - F.radians(lng1)) + F.sin(F.radians(lat1)) * F.sin(F.radians(lat2))
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), c))) * EARTH_KM


def area(b: Column, known: bool = False) -> Column:
    """Of a box; ``known``: as its field ``area`` says, since sides that were added up are off by a rounding."""
    if known:
        return b["area"]
    zero = F.lit(0.0)
    return F.greatest(zero, b["x2"] - b["x1"]) * F.greatest(zero, b["y2"] - b["y1"])


def iou(a: Column, b: Column, known: bool = False) -> Column:
    """Overlap of two boxes over their union; 0 where the union is empty. ``known``: see :func:`area`."""
    zero = F.lit(0.0)
    common = F.greatest(zero, F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])) * F.greatest(zero, F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    union = area(a, known) + area(b, known) - common
    return F.when(union > 0, common / union).otherwise(zero)


def homography(h: list[list[float]], u: Column, v: Column) -> tuple[Column, Column]:
    """A point through a 3 x 3 matrix; null where it goes to infinity."""
    q = [F.lit(float(r[0])) * u + F.lit(float(r[1])) * v + F.lit(float(r[2])) for r in h]
    return F.try_divide(q[0], q[2]), F.try_divide(q[1], q[2])


def world_to_pixel(h: list[list[float]], x: Column, y: Column, most: float = 10_000.0) -> tuple[Column, Column]:
    """The way back through a pixel-to-world matrix, whose inverse is taken once; null at infinity and beyond ``most`` pixels."""
    inverse = np.linalg.inv(np.array(h, float))
    q = [F.lit(float(r[0])) * x + F.lit(float(r[1])) * y + F.lit(float(r[2])) for r in inverse]
    u, v = F.try_divide(q[0], q[2]), F.try_divide(q[1], q[2])
    fine = (F.abs(q[2]) >= 1e-6) & (F.abs(u) <= most) & (F.abs(v) <= most)
    return F.when(fine, u), F.when(fine, v)


def undistort(camera: list[list[float]], lens: list[float], u: Column, v: Column, rounds: int = 30) -> Column:
    """struct(u, v) of a pixel without its lens's distortion (k1, k2, p1, p2 and perhaps k3), by a fixed-point iteration."""
    (fx, _, cx), (_, fy, cy) = (list(map(float, r)) for r in camera[:2])
    k1, k2, p1, p2, k3 = [*map(float, lens), 0.0][:5]
    x0, y0 = (u - cx) / fx, (v - cy) / fy

    def step(p: Column, _: Column) -> Column:
        x, y = p["x"], p["y"]
        r2 = x * x + y * y
        scale = 1 / (1 + ((k3 * r2 + k2) * r2 + k1) * r2)
        return F.struct(((x0 - (2 * p1 * x * y + p2 * (r2 + 2 * x * x))) * scale).alias("x"), ((y0 - (p1 * (r2 + 2 * y * y) + 2 * p2 * x * y)) * scale).alias("y"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(x0.alias("x"), y0.alias("y")), step)
    return F.transform(F.array(found), lambda p: F.struct((p["x"] * fx + cx).alias("u"), (p["y"] * fy + cy).alias("v")))[0]


def affine(m: list[list[float]], u: Column, v: Column) -> tuple[Column, Column]:
    return tuple(F.lit(float(r[0])) * u + F.lit(float(r[1])) * v + F.lit(float(r[2])) for r in m)  # type: ignore[return-value]


def in_rectangles(rects: list[tuple[float, float, float, float]], x: Column, y: Column) -> Column:
    """Whether a point lies in any of (x, y, width, height), edges included."""
    out = F.lit(False)
    for rx, ry, w, h in rects:
        out = out | (x.between(rx, rx + w) & y.between(ry, ry + h))
    return out


def in_polygon(corners: list[tuple[float, float]], x: Column, y: Column) -> Column:
    """Ray casting: an odd number of edges crosses the ray to the right."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(corners, [*corners[1:], corners[0]], strict=True):
        if y1 == y2:
            continue
        cut = x < F.lit(float(x2 - x1)) * (y - float(y1)) / F.lit(float(y2 - y1)) + float(x1)
        crossings = crossings + F.when(((F.lit(float(y1)) > y) != (F.lit(float(y2)) > y)) & cut, 1).otherwise(0)
    return crossings % 2 == 1


def segment_distance(x: Column, y: Column, x1: float, y1: float, x2: float, y2: float) -> Column:
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    t = F.lit(0.0) if length == 0 else F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - x1) * dx + (y - y1) * dy) / length))
    return distance(x, y, F.lit(x1) + t * dx, F.lit(y1) + t * dy)


def nearest_edge(corners: list[tuple[float, float]], x: Column, y: Column) -> Column:
    """struct(d, i) of the nearest edge of a polygon; of equals the first."""
    ends = [*corners[1:], corners[0]]
    return F.array_min(F.array(*(F.struct(segment_distance(x, y, *map(float, a), *map(float, b)).alias("d"), F.lit(i).alias("i")) for i, (a, b) in enumerate(zip(corners, ends, strict=True)))))


def polygon_area(corners: list[tuple[float, float]]) -> float:
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(corners, [*corners[1:], corners[0]], strict=True))) / 2


def border_distance(x1: Column, y1: Column, x2: Column, y2: Column, width: float, height: float) -> Column:
    """Distance of a box to the nearest image border, at least 0."""
    return F.greatest(F.lit(0.0), F.least(x1, y1, F.lit(float(width)) - x2, F.lit(float(height)) - y2))


def crop_box(b: Column, pad: float, least: float, width: int, height: int) -> Column:
    """A box padded, grown about its centre to a least size, rounded outwards, moved into the frame and cut to it."""
    cx, cy = (b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2
    w, h = F.greatest(b["x2"] - b["x1"] + 2 * pad, F.lit(float(least))), F.greatest(b["y2"] - b["y1"] + 2 * pad, F.lit(float(least)))
    x1, y1 = F.floor(cx - w / 2), F.floor(cy - h / 2)
    x2, y2 = F.ceil(cx + w / 2), F.ceil(cy + h / 2)
    sx = F.when(x1 < 0, -x1).when(x2 > width, width - x2).otherwise(0)
    sy = F.when(y1 < 0, -y1).when(y2 > height, height - y2).otherwise(0)
    clamp = lambda v, top: F.least(F.greatest(v, F.lit(0)), F.lit(top)).cast("long")
    return F.struct(clamp(x1 + sx, width).alias("x1"), clamp(y1 + sy, height).alias("y1"), clamp(x2 + sx, width).alias("x2"), clamp(y2 + sy, height).alias("y2"))


def hinge_squared(z: Column) -> Column:
    over = F.greatest(F.lit(0.0), z - 1)
    return over * over


def reliability(rel: Column, alpha: float, floor: float) -> Column:
    """A cost's factor: more for contacts of less reliability."""
    return 1 + alpha * (1 - F.greatest(F.least(F.greatest(rel, F.lit(0.0)), F.lit(1.0)), F.lit(floor)))


def frame_seconds(start: Column, end: Column, fps: float) -> tuple[Column, Column]:
    return start / F.lit(fps), (end + 1) / F.lit(fps)
