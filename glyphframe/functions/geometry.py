"""Points, quads and boxes as column expressions. A point is struct<x, y>, a quad an array of four, clockwise from top left."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x, y) -> Column:
    return F.struct(_col(x).cast("double").alias("x"), _col(y).cast("double").alias("y"))


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def sub(a: Column, b: Column) -> Column:
    return point(a["x"] - b["x"], a["y"] - b["y"])


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"]


def cross(a: Column, b: Column) -> Column:
    return a["x"] * b["y"] - a["y"] * b["x"]


def length(a: Column) -> Column:
    return F.hypot(a["x"], a["y"])


def rect(x, y, width, height) -> Column:
    """The quad of an axis-aligned box."""
    x, y, w, h = map(_col, (x, y, width, height))
    return F.array(point(x, y), point(x + w, y), point(x + w, y + h), point(x, y + h))


def quad_bounds(quad: Column) -> Column:
    xs, ys = F.transform(quad, lambda p: p["x"]), F.transform(quad, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("width"), (F.array_max(ys) - F.array_min(ys)).alias("height"))


def polygon_area(points: Column) -> Column:
    """Shoelace formula; the points in order, any number."""
    following = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    return F.abs(F.aggregate(F.zip_with(points, following, cross), F.lit(0.0), lambda a, x: a + x)) / 2


def let(value: Column, body) -> Column:
    """body of a value that is computed once; written into a lambda, it would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ordered_quad(points: Column) -> Column:
    """The corners by their angle around the centre, from the one of smallest x + y on, of equal ones that of smallest x."""
    mean = lambda ps, c: F.aggregate(ps, F.lit(0.0), lambda a, p: a + p[c]) / F.size(ps)
    around = lambda s: F.array_sort(F.transform(s["ps"], lambda p: F.struct(F.atan2(p["y"] - s["y"], p["x"] - s["x"]).alias("angle"), p.alias("p"))))
    turned = let(F.struct(points.alias("ps"), mean(points, "x").alias("x"), mean(points, "y").alias("y")), around)

    def from_first(ring: Column) -> Column:
        keys = F.transform(ring, lambda s: F.struct((s["p"]["x"] + s["p"]["y"]).alias("sum"), s["p"]["x"].alias("x")))
        first = let(keys, lambda k: F.array_position(k, F.array_min(k)).cast("int"))
        return let(first, lambda f: F.transform(F.concat(F.slice(ring, f, F.size(ring)), F.slice(ring, F.lit(1), f - 1)), lambda s: s["p"]))

    return let(turned, from_first)


def sides(quad: Column) -> tuple[Column, Column]:
    """(width, height) of an ordered quad: the longer of each pair of opposite sides."""
    side = lambda i, j: length(sub(quad[j], quad[i]))
    return F.greatest(side(0, 1), side(3, 2)), F.greatest(side(0, 3), side(1, 2))


def region_aspect(quad: Column) -> Column:
    """Longer over shorter side of an ordered quad; infinite if it has no width or height."""
    w, h = sides(quad)
    return F.when((w <= 0) | (h <= 0), F.lit(float("inf"))).otherwise(F.greatest(w, h) / F.least(w, h))


def is_compact(quad: Column) -> Column:
    return region_aspect(quad) <= 2


def rect_iou(a: Column, b: Column) -> Column:
    """Overlap of two axis-aligned boxes (struct<x, y, width, height>) over their union, which counts as 1e-6 at least."""
    w = F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"])
    both = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    return both / F.greatest(a["width"] * a["height"] + b["width"] * b["height"] - both, F.lit(1e-6))


def wrapped(angle: Column) -> Column:
    return F.atan2(F.sin(angle), F.cos(angle))


def turns(page_angle: Column, region_angle: Column) -> Column:
    """Quarter turns (0 to 3) from a region to its page; 0 without a page angle, or over 30 degrees from a quarter."""
    delta = wrapped(page_angle - region_angle)
    quarters = F.signum(delta) * F.floor(F.abs(delta) / (math.pi / 2) + 0.5)
    near = F.abs(delta - quarters * (math.pi / 2)) <= math.pi / 6
    return F.when(page_angle.isNotNull() & near, F.pmod(quarters + 4, F.lit(4.0))).otherwise(0.0).cast("int")


def edge_angle(quad: Column) -> Column:
    edge = sub(quad[1], quad[0])
    return F.atan2(edge["y"], edge["x"])


def rotation_degrees(quarter: Column) -> Column:
    return F.pmod(360 - 90 * quarter, F.lit(360)).cast("int")


def rounded(value: Column, digits: int = 3) -> Column:
    """Half to even, as the contract rounds coordinates."""
    return F.rint(value * 10**digits) / 10**digits


def rounded_quad(quad: Column) -> Column:
    return F.transform(quad, lambda p: point(rounded(p["x"]), rounded(p["y"])))


def clamp(value: Column, low, high) -> Column:
    return F.least(F.greatest(value, _col(low)), _col(high))


def rescaled(p: Column, from_width: Column, from_height: Column, width: Column, height: Column) -> Column:
    """A point of the scaled image in the original, kept inside it."""
    return point(clamp(p["x"] * width / from_width, 0.0, width - 1), clamp(p["y"] * height / from_height, 0.0, height - 1))


def detector_scale(width: Column, height: Column, max_side: int = 1600) -> Column:
    """scale, scaled and padded size (multiples of 32) of a page for the detector."""
    scale = F.least(F.lit(1.0), F.lit(float(max_side)) / F.greatest(width, height))
    w, h = F.greatest(F.lit(1.0), F.rint(width * scale)), F.greatest(F.lit(1.0), F.rint(height * scale))
    up = lambda v: (F.ceil(v / 32) * 32).cast("int")
    return F.struct(scale.alias("scale"), w.cast("int").alias("scaled_width"), h.cast("int").alias("scaled_height"), up(w).alias("padded_width"), up(h).alias("padded_height"))


def line_width(width: Column, height: Column, stride: int = 8, line_height: int = 60, pad: int = 16, widest: int = 8192) -> Column:
    """Width of a line at line_height with white pads, aligned to stride; null if that is wider than allowed."""
    core = F.greatest(F.lit(8.0), F.rint(width * line_height / height))
    full = (F.ceil((core + 2 * pad) / stride) * stride).cast("int")
    return F.when(full <= widest, full)


def anchor_point(cell: Column, columns: int, stride: int, dx: Column, dy: Column) -> Column:
    """A corner of the region that a detector cell proposes: the cell's centre and an offset in eighths of the stride's reach."""
    x, y = F.pmod(cell, F.lit(columns)), F.floor(cell / columns)
    reach = float(8 * stride - 1)
    return point(x * stride + (stride - 1) / 2.0 + dx * reach, y * stride + (stride - 1) / 2.0 + dy * reach)


def rotated(p: Column, angle: Column) -> Column:
    """The point turned by -angle, which levels text of that direction."""
    return point(p["x"] * F.cos(angle) + p["y"] * F.sin(angle), p["y"] * F.cos(angle) - p["x"] * F.sin(angle))


def composited(channel: Column, alpha: Column, premultiplied: bool = False) -> Column:
    """An 8-bit channel over white."""
    if premultiplied:
        over = F.raise_error(F.lit("invalid pixels: premultiplied channel exceeds alpha")).cast("int")
        return F.when(channel > alpha, over).otherwise((channel + (255 - alpha)).cast("int"))
    wide = F.floor(channel * 257 * alpha / 255) + (255 - alpha) * 257  # in 16 bits, as the contract converts
    return F.floor(wide / 257).cast("int")


def is_rotated_180(quarter: Column) -> Column:
    return quarter >= 2
