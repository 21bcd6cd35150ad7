"""Boxes, polygons, grids and homographies as Column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from touchline.functions.ids import col


def distance(ax: Column | str, ay: Column | str, bx: Column | str, by: Column | str) -> Column:
    dx, dy = col(ax) - col(bx), col(ay) - col(by)
    return F.sqrt(dx * dx + dy * dy)


def box_columns(x1: str = "x1", y1: str = "y1", x2: str = "x2", y2: str = "y2") -> dict[str, Column]:
    """Width, height, area, aspect, middle and foot point of a box."""
    w, h = F.col(x2) - F.col(x1), F.col(y2) - F.col(y1)
    return {
        "box_width": w, "box_height": h, "box_area": w * h, "box_aspect": F.try_divide(w, h), "mid_x": (F.col(x1) + F.col(x2)) / 2,
        "mid_y": (F.col(y1) + F.col(y2)) / 2, "box_foot_x": (F.col(x1) + F.col(x2)) / 2, "box_foot_y": F.col(y2),
    }


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Overlap of two boxes (x1, y1, x2, y2) over their union; 0 where the union is empty."""
    zero = F.lit(0.0)
    inter = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), zero) * F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), zero)
    area = lambda q: F.greatest(q[2] - q[0], zero) * F.greatest(q[3] - q[1], zero)
    union = area(a) + area(b) - inter
    return F.when(union <= 0, 0.0).otherwise(F.try_divide(inter, union))


def parse_polygon(text: Column | str) -> Column:
    """``"x,y;x,y;..."`` as an array of points; null and empty text give null."""
    points = F.transform(F.split(F.trim(col(text)), ";"), lambda p: F.struct(F.split(p, ",")[0].try_cast("double").alias("x"), F.split(p, ",")[1].try_cast("double").alias("y")))
    return F.when(F.trim(col(text)) != "", F.filter(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull()))


def in_polygon(x: Column | str, y: Column | str, points: Column | list[tuple[float, float]], boundary: str = "half_open", null_is: bool | None = None) -> Column:
    """Even-odd test. ``boundary``: "half_open" counts an edge's upper end and points on its left-looking side,
    "even_odd" its lower end, "inclusive" also every point on an edge. A null polygon gives ``null_is``."""
    x, y = col(x), col(y)
    if isinstance(points, list):
        n = len(points)
        edges = [tuple(map(F.lit, map(float, (*points[i], *points[(i + 1) % n])))) for i in range(n)]
        return _fold([_edge(x, y, *e, boundary) for e in edges], [_on_edge(x, y, *e) for e in edges] if boundary == "inclusive" else [])
    n = F.size(points)
    pairs = F.zip_with(points, F.concat(F.slice(points, 2, F.greatest(n - 1, F.lit(0))), F.slice(points, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    inside = F.aggregate(pairs, F.lit(False), lambda acc, e: acc != F.coalesce(_edge(x, y, e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"], boundary), F.lit(False)))
    if boundary == "inclusive":
        inside = inside | F.exists(pairs, lambda e: _on_edge(x, y, e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]))
    return F.when(points.isNull(), F.lit(null_is)).otherwise(inside)


def _edge(x, y, ax, ay, bx, by, boundary):  # noqa: ANN001, ANN202
    cut = ax + F.try_divide((y - ay) * (bx - ax), by - ay)
    if boundary == "half_open":
        return (y > F.least(ay, by)) & (y <= F.greatest(ay, by)) & (x <= cut)
    return (y >= F.least(ay, by)) & (y < F.greatest(ay, by)) & (x < cut)


def _on_edge(x, y, ax, ay, bx, by):  # noqa: ANN001, ANN202
    cross = (x - ax) * (by - ay) - (y - ay) * (bx - ax)
    return (F.abs(cross) <= 1e-9) & x.between(F.least(ax, bx), F.greatest(ax, bx)) & y.between(F.least(ay, by), F.greatest(ay, by))


def _fold(crossings: list[Column], on: list[Column]) -> Column:
    odd = sum((F.coalesce(c.cast("int"), F.lit(0)) for c in crossings), F.lit(0)) % 2 == 1
    for c in on:
        odd = odd | c
    return odd


def field_zone(x: Column | str, y: Column | str, strict, tolerant) -> Column:  # noqa: ANN001
    """"strict" within the inner polygon, else "tolerant" within the outer one, else "off_field"."""
    return F.when(in_polygon(x, y, strict, "even_odd", False), "strict").when(in_polygon(x, y, tolerant, "even_odd", False), "tolerant").otherwise("off_field")


def fit_homography(pixel: list[tuple[float, float]], field: list[tuple[float, float]]) -> np.ndarray:
    """Least-squares homography of at least four landmark pairs."""
    if len(pixel) < 4 or len(pixel) != len(field):
        raise ValueError("a homography needs at least four landmark pairs")
    rows = []
    for (x, y), (u, v) in zip(pixel, field):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y, -u], [0, 0, 0, x, y, 1, -v * x, -v * y, -v]]
    h = np.linalg.svd(np.array(rows, dtype=float))[2][-1].reshape(3, 3)
    return h / h[2, 2]


def project(x: Column | str, y: Column | str, h: np.ndarray) -> tuple[Column, Column]:
    x, y = col(x), col(y)
    (a, b, c), (d, e, f), (g, i, j) = h.tolist()
    w = x * g + y * i + j
    return F.try_divide(x * a + y * b + c, w), F.try_divide(x * d + y * e + f, w)


def within_field(x: Column, y: Column, length: float = 120.0, width: float = 75.0, margin: float = 0.0) -> Column:
    return x.between(-margin, length + margin) & y.between(-margin, width + margin)


def grid_bin(value: Column | str, extent: float, bins: int) -> Column:
    """Bin of a coordinate, truncated and clamped to the grid; null for null."""
    return F.when(col(value).isNotNull(), F.least(F.greatest((col(value) / extent * bins).cast("int"), F.lit(0)), F.lit(bins - 1)))
