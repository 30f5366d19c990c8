"""Boxes, points, edges and page-image coordinates as Column expressions. y grows downward."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(prefix: str = "") -> dict[str, Column]:
    """The columns of a box by side."""
    return {k: F.col(f"{prefix}{k}") for k in ("xmin", "ymin", "xmax", "ymax")}


def _col(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def width(b: dict[str, Column]) -> Column:
    return b["xmax"] - b["xmin"]


def height(b: dict[str, Column]) -> Column:
    return b["ymax"] - b["ymin"]


def area(b: dict[str, Column]) -> Column:
    return width(b) * height(b)


def xmid(b: dict[str, Column]) -> Column:
    return (b["xmin"] + b["xmax"]) / 2


def ymid(b: dict[str, Column]) -> Column:
    return (b["ymin"] + b["ymax"]) / 2


def is_horizontal(b: dict[str, Column]) -> Column:
    return width(b) > height(b)


def from_corners(x1: Column, y1: Column, x2: Column, y2: Column) -> dict[str, Column]:
    """A box from any two opposite corners."""
    return {"xmin": F.least(x1, x2), "ymin": F.least(y1, y2), "xmax": F.greatest(x1, x2), "ymax": F.greatest(y1, y2)}


def union_aggregates(b: dict[str, Column]) -> list[Column]:
    """Aggregates that give the bounding box of a group."""
    return [F.min(b["xmin"]).alias("xmin"), F.min(b["ymin"]).alias("ymin"), F.max(b["xmax"]).alias("xmax"), F.max(b["ymax"]).alias("ymax")]


def polygon_box(coords: Column) -> dict[str, Column]:
    """The bounding box of an array of (x, y)."""
    xs, ys = F.transform(coords, lambda c: c["x"]), F.transform(coords, lambda c: c["y"])
    return {"xmin": F.array_min(xs), "ymin": F.array_min(ys), "xmax": F.array_max(xs), "ymax": F.array_max(ys)}


def inside(x: Column, y: Column, b: dict[str, Column]) -> Column:
    """Whether a point is in a box, its edges included."""
    return x.between(b["xmin"], b["xmax"]) & y.between(b["ymin"], b["ymax"])


def move(value: Column, percent: Column | float, sign: int, top: Column | float = 1.0) -> Column:
    """A coordinate moved by a percentage of the page and kept on it."""
    return F.greatest(F.lit(0), F.least(_col(top), value + sign * _col(percent) / 100 * _col(top)))


def expanded(b: dict[str, Column], percent: float, top: float = 1.0) -> dict[str, Column]:
    return {"xmin": move(b["xmin"], percent, -1, top), "ymin": move(b["ymin"], percent, -1, top), "xmax": move(b["xmax"], percent, 1, top), "ymax": move(b["ymax"], percent, 1, top)}


def shrunk(b: dict[str, Column], percent: float, top: float = 1.0) -> dict[str, Column]:
    """Each corner moved inwards; the lower right one from its own place."""
    return {"xmin": move(b["xmin"], percent, 1, top), "ymin": move(b["ymin"], percent, 1, top), "xmax": move(b["xmax"], percent, -1, top), "ymax": move(b["ymax"], percent, -1, top)}


def overlap_percent(small: dict[str, Column], big: dict[str, Column]) -> Column:
    """The truncated percentage of ``small`` that ``big`` covers; 100 of a box without area that touches, 0 of disjoint boxes."""
    w = F.least(small["xmax"], big["xmax"]) - F.greatest(small["xmin"], big["xmin"])
    h = F.least(small["ymax"], big["ymax"]) - F.greatest(small["ymin"], big["ymin"])
    share = F.floor(w * h * 100 / F.nullif(area(small), F.lit(0))).cast("int")
    return F.when((w < 0) | (h < 0), 0).when(area(small) == 0, 100).otherwise(share)


def overlaps(small: dict[str, Column], big: dict[str, Column], percent: float = 1.0) -> Column:
    return overlap_percent(small, big) > percent


def in_range(low: Column, high: Column, start: Column | float, end: Column | float, partial: bool) -> Column:
    """Whether [low, high] lies within (start, end), or with ``partial`` touches [start, end]."""
    start, end = _col(start), _col(end)
    return (low <= end) & (high >= start) if partial else (low > start) & (high < end)


def in_xrange(b: dict[str, Column], start: Column | float, end: Column | float, partial: bool = False) -> Column:
    return in_range(b["xmin"], b["xmax"], start, end, partial)


def in_yrange(b: dict[str, Column], start: Column | float, end: Column | float, partial: bool = False) -> Column:
    return in_range(b["ymin"], b["ymax"], start, end, partial)


def x_subsumes(big: dict[str, Column], small: dict[str, Column]) -> Column:
    return (big["xmin"] <= small["xmin"]) & (big["xmax"] >= small["xmax"])


def y_subsumes(big: dict[str, Column], small: dict[str, Column]) -> Column:
    return (big["ymin"] <= small["ymin"]) & (big["ymax"] >= small["ymax"])


def subsumes(big: dict[str, Column], small: dict[str, Column]) -> Column:
    return x_subsumes(big, small) & y_subsumes(big, small)


def reduced_width(b: dict[str, Column], other: dict[str, Column], side: str, gap: float = 0.001) -> Column:
    """The left or right edge pulled back from a neighbour."""
    return other["xmax"] + gap if side == "left" else other["xmin"] - gap


# ---- rotation


def rotated_size(w: Column, h: Column, angle: Column) -> tuple[Column, Column]:
    s, c = F.abs(F.sin(F.radians(angle))), F.abs(F.cos(F.radians(angle)))
    return F.ceil(w * c) + F.ceil(h * s), F.ceil(w * s) + F.ceil(h * c)


def rotated_point(x: Column, y: Column, angle: Column, before: tuple[Column, Column], after: tuple[Column, Column]) -> tuple[Column, Column]:
    """An image point turned about the centre into the turned image, kept in it and rounded half to even."""
    s, c = F.sin(F.radians(angle)), F.cos(F.radians(angle))
    dx, dy = x - before[0] / 2, y - before[1] / 2
    nx, ny = c * dx + s * dy + after[0] / 2, -s * dx + c * dy + after[1] / 2
    return F.bround(F.greatest(F.lit(0.0), F.least(nx, after[0].cast("double")))), F.bround(F.greatest(F.lit(0.0), F.least(ny, after[1].cast("double"))))


def reoriented(x: Column, y: Column, angle: Column) -> tuple[Column, Column]:
    """Page coordinates of 0 … 1 brought upright from a turn by 90, 180 or 270 degrees."""
    nx = F.when(angle == 90, y).when(angle == 180, 1 - x).when(angle == 270, 1 - y).otherwise(x)
    ny = F.when(angle == 90, 1 - x).when(angle == 180, 1 - y).when(angle == 270, x).otherwise(y)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), nx)), F.greatest(F.lit(0.0), F.least(F.lit(1.0), ny))


def corner_orientation(coords: Column) -> Column:
    """0, 90, 180 or 270 by where the first of four corners (x, y) stands among them; null of other shapes."""
    order = F.array_sort(F.transform(coords, lambda c, i: F.struct(c["y"], c["x"], i.alias("i"))))
    first = F.concat_ws("", F.transform(F.slice(order, 1, 2), lambda s: s["i"].cast("string")))
    return F.when(F.size(coords) == 4, F.when(first.isin("01", "10"), 0).when(first.isin("30", "03"), 90).when(first.isin("23", "32"), 180).when(first.isin("12", "21"), 270))


# ---- edges


def edge_length(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x2 - x1, y2 - y1)


def point_along(x1: Column, y1: Column, x2: Column, y2: Column, ratio: Column | float) -> tuple[Column, Column]:
    return x1 + (x2 - x1) * _col(ratio), y1 + (y2 - y1) * _col(ratio)


def intersection(a: Sequence[Column], b: Sequence[Column]) -> tuple[Column, Column]:
    """Where the infinite lines through two edges (x1, y1, x2, y2) meet; null of parallel ones."""
    dax, day, dbx, dby = a[0] - a[2], a[1] - a[3], b[0] - b[2], b[1] - b[3]
    det = F.nullif(dax * dby - day * dbx, F.lit(0))
    ca, cb = a[0] * a[3] - a[1] * a[2], b[0] * b[3] - b[1] * b[2]
    return (ca * dbx - cb * dax) / det, (ca * dby - cb * day) / det


# ---- page images


def doc_to_image(x: Column, y: Column, w: Column, h: Column) -> tuple[Column, Column]:
    return x * w, y * h


def image_to_doc(x: Column, y: Column, w: Column, h: Column) -> tuple[Column, Column]:
    return x / w, y / h


def image_point(x: Column, y: Column, page: str = "page_image") -> tuple[Column, Column]:
    """A point of a page, 0 … 1, in the pixels of its image: over the whole image of a raster, through the box of an embedded one."""
    p = F.col(page)

    def one(v: Column, size: str, page_size: str, low: str, high: str) -> Column:
        embedded = (v * p[page_size] - p["box"][low]) / (p["box"][high] - p["box"][low]) * p[size]
        return F.bround(F.greatest(F.lit(0.0), F.least(F.when(p["image_type"] == "raster", v * p[size]).otherwise(embedded), p[size])))

    return one(x, "image_width", "page_width", "xmin", "xmax"), one(y, "image_height", "page_height", "ymin", "ymax")


def page_point(x: Column, y: Column, page: str = "page_image") -> tuple[Column, Column]:
    """A pixel of a page's image as a point of the page."""
    p = F.col(page)

    def one(v: Column, size: str, page_size: str, low: str, high: str) -> Column:
        embedded = (v / p[size] * (p["box"][high] - p["box"][low]) + p["box"][low]) / p[page_size]
        return F.when(p["image_type"] == "raster", v / p[size]).otherwise(embedded)

    return one(x, "image_width", "page_width", "xmin", "xmax"), one(y, "image_height", "page_height", "ymin", "ymax")


def transformed(x: Column, y: Column, chain: Column, inverse: bool = False) -> Column:
    """A point (x, y) through an array of crops (op, dx, dy, …) and quarter or free turns (op, angle, w, h, w2, h2) of an image, or back.

    Elements: struct<op: 'crop' | 'rotate', dx, dy, angle, w, h, w2, h2>, all numbers DOUBLE.
    """
    start = F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    def forward(p: Column, t: Column) -> Column:
        s, c = F.sin(F.radians(t["angle"])), F.cos(F.radians(t["angle"]))
        dx, dy = p["x"] - t["w"] / 2, p["y"] - t["h"] / 2
        turned = F.struct((c * dx + s * dy + t["w2"] / 2).alias("x"), (-s * dx + c * dy + t["h2"] / 2).alias("y"))
        return F.when(t["op"] == "crop", F.struct((p["x"] - t["dx"]).alias("x"), (p["y"] - t["dy"]).alias("y"))).otherwise(turned)

    def back(p: Column, t: Column) -> Column:
        s, c = F.sin(F.radians(t["angle"])), F.cos(F.radians(t["angle"]))
        dx, dy = p["x"] - t["w2"] / 2, p["y"] - t["h2"] / 2
        turned = F.struct((c * dx - s * dy + t["w"] / 2).alias("x"), (s * dx + c * dy + t["h"] / 2).alias("y"))
        return F.when(t["op"] == "crop", F.struct((p["x"] + t["dx"]).alias("x"), (p["y"] + t["dy"]).alias("y"))).otherwise(turned)

    return F.aggregate(F.reverse(chain) if inverse else chain, start, back if inverse else forward)
