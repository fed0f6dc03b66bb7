"""Geometry as column expressions over struct columns; coordinates are fractions of a sheet, y downwards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
GEOMETRY = f"struct<type:string,points:array<{POINT}>,radius:double,start_angle:double,end_angle:double>"


def box(x_min: Column, y_min: Column, x_max: Column, y_max: Column) -> Column:
    return F.struct(x_min.cast("double").alias("x_min"), y_min.cast("double").alias("y_min"), x_max.cast("double").alias("x_max"), y_max.cast("double").alias("y_max"))


def bounds(g: Column) -> Column:
    """Box around a geometry; null without points; a circle or arc with a radius is its centre plus and minus it."""
    p = g["points"]
    r = F.abs(g["radius"])
    c = F.element_at(p, 1)
    low = lambda a: F.array_min(F.transform(p, lambda q: q[a]))
    high = lambda a: F.array_max(F.transform(p, lambda q: q[a]))
    round_ = g["type"].isin("circle", "arc") & r.isNotNull()
    return F.when(F.size(p) > 0, F.when(round_, box(c["x"] - r, c["y"] - r, c["x"] + r, c["y"] + r)).otherwise(box(low("x"), low("y"), high("x"), high("y"))))


def width(b: Column) -> Column:
    return b["x_max"] - b["x_min"]


def height(b: Column) -> Column:
    return b["y_max"] - b["y_min"]


def area(b: Column) -> Column:
    """Negative sides count as 0."""
    return F.greatest(width(b), F.lit(0.0)) * F.greatest(height(b), F.lit(0.0))


def center(b: Column) -> Column:
    return F.struct(((b["x_min"] + b["x_max"]) / 2).alias("x"), ((b["y_min"] + b["y_max"]) / 2).alias("y"))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union is 0."""
    w = F.least(a["x_max"], b["x_max"]) - F.greatest(a["x_min"], b["x_min"])
    h = F.least(a["y_max"], b["y_max"]) - F.greatest(a["y_min"], b["y_min"])
    both = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def contains(b: Column, x: Column, y: Column, slack: float = 0.0) -> Column:
    """Whether a point is in a box, its sides included."""
    return x.between(b["x_min"] - slack, b["x_max"] + slack) & y.between(b["y_min"] - slack, b["y_max"] + slack)


def contains_box(b: Column, inner: Column, slack: float = 1e-6) -> Column:
    return (inner["x_min"] >= b["x_min"] - slack) & (inner["y_min"] >= b["y_min"] - slack) & (inner["x_max"] <= b["x_max"] + slack) & (inner["y_max"] <= b["y_max"] + slack)


def shoelace(points: Column) -> Column:
    """Area of the closed polygon through ``points``."""
    after = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    cross = F.zip_with(points, after, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2


def measured_area(g: Column) -> Column:
    """Area of three points or more as a polygon, else of the box."""
    return F.when(F.size(g["points"]) >= 3, shoelace(g["points"])).otherwise(area(bounds(g)))


def distance(a: Column, b: Column) -> Column:
    return F.hypot(b["x"] - a["x"], b["y"] - a["y"])


def shape(kind: str, points: Column, radius: Column | None = None) -> Column:
    none = F.lit(None).cast("double")
    return F.struct(F.lit(kind).alias("type"), points.alias("points"), (none if radius is None else radius.cast("double")).alias("radius"), none.alias("start_angle"), none.alias("end_angle"))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box_shape(x_min: Column, y_min: Column, x_max: Column, y_max: Column) -> Column:
    return shape("bbox", F.array(point(x_min, y_min), point(x_max, y_max)))


def arc_points(cx: Column, cy: Column, r: Column, start: Column, end: Column, n: int = 24) -> Column:
    """``n`` points along an arc given in degrees; an end not after the start is a turn later."""
    a, b = F.radians(start), F.radians(end)
    turn = F.when(b <= a, b + 2 * F.pi()).otherwise(b) - a
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: point(cx + r * F.cos(a + turn * k / (n - 1)), cy + r * F.sin(a + turn * k / (n - 1))))


def circle_points(cx: Column, cy: Column, r: Column, n: int = 32) -> Column:
    """``n`` points around a circle, the first not repeated."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: point(cx + r * F.cos(2 * F.pi() * k / n), cy + r * F.sin(2 * F.pi() * k / n)))


def without_repeats(points: Column) -> Column:
    """Points other than the one just before."""
    return F.filter(points, lambda p, k: (k == 0) | (p != F.element_at(points, F.greatest(k, F.lit(1)))))


def normalized(x: Column, y: Column, b: Column, *, flip_y: bool) -> Column:
    """A source point as fractions of the source's bounds; a degenerate extent counts as 1."""
    side = lambda s: F.when(s > 1e-9, s).otherwise(1.0)
    down = (b["y_max"] - y) if flip_y else (y - b["y_min"])
    return point((x - b["x_min"]) / side(width(b)), down / side(height(b)))


def to_sheet(tile: Column, inner: Column) -> Column:
    """A box in fractions of a tile as fractions of the sheet; ``tile`` is the tile's box on the sheet."""
    x, y = lambda v: tile["x_min"] + v * width(tile), lambda v: tile["y_min"] + v * height(tile)
    return box(x(inner["x_min"]), y(inner["y_min"]), x(inner["x_max"]), y(inner["y_max"]))


def to_tile(tile: Column, outer: Column) -> Column:
    """The inverse of ``to_sheet``; null for a tile without extent."""
    ok = (width(tile) != 0) & (height(tile) != 0)
    x = lambda v: (v - tile["x_min"]) / F.nullif(width(tile), F.lit(0.0))
    y = lambda v: (v - tile["y_min"]) / F.nullif(height(tile), F.lit(0.0))
    return F.when(ok, box(x(outer["x_min"]), y(outer["y_min"]), x(outer["x_max"]), y(outer["y_max"])))


def centred_grid(x0: Column, y0: Column, x1: Column, y1: Column, n: Column) -> Column:
    """``n`` points on a centred grid of about as many rows as columns, row by row."""
    cols = F.ceil(F.sqrt(n.cast("double")))
    rows = F.ceil(n / F.greatest(cols, F.lit(1)))
    at = lambda k: point(x0 + (k % cols + 1) / (cols + 1) * (x1 - x0), y0 + (F.floor(k / cols) + 1) / (rows + 1) * (y1 - y0))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), at)).otherwise(F.array().cast(f"array<{POINT}>"))


def pixel_box(b: Column, full_width: Column, full_height: Column) -> Column:
    """A box in pixels for cutting an image: down to whole pixels at the lower ends, to the nearest at the upper ones
    (halves to the even one), within the image."""
    low = lambda v, n: F.greatest(F.lit(0), F.floor(v * n).cast("int"))
    high = lambda v, n: F.least(n.cast("int"), F.bround(v * n).cast("int"))
    return F.struct(low(b["x_min"], full_width).alias("x0"), low(b["y_min"], full_height).alias("y0"), high(b["x_max"], full_width).alias("x1"), high(b["y_max"], full_height).alias("y1"))


def extent_is_valid(b: Column) -> Column:
    """Whether bounds are in order and not zero on at least one axis."""
    return F.coalesce((width(b) >= 0) & (height(b) >= 0) & ((width(b) > 0) | (height(b) > 0)), F.lit(False))
