"""Box and point geometry as Catalyst expressions.

A box is a struct x0, y0, x1, y1 (corners).  Boxes given as x, y, width,
height have constructors and functions of their own, as the two conventions
differ in what an empty box is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x0", "y0", "x1", "y1")


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A box from its corners."""
    return F.struct(*[c.cast("double").alias(n) for c, n in zip((x0, y0, x1, y1), SIDES)])


def box_xywh(x: Column, y: Column, w: Column, h: Column) -> Column:
    """A box from a corner, width and height."""
    return box(x, y, x + w, y + h)


def box_from_corners(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """A box from any two opposite corners."""
    return box(F.least(ax, bx), F.least(ay, by), F.greatest(ax, bx), F.greatest(ay, by))


def area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def centre(b: Column) -> Column:
    return F.struct(((b["x0"] + b["x1"]) / 2).alias("x"), ((b["y0"] + b["y1"]) / 2).alias("y"))


def contains(outer: Column, inner: Column, tolerance: float = 1.0) -> Column:
    """All four sides of ``inner`` are within ``outer``, or beyond it by ``tolerance`` at most."""
    return (outer["x0"] - tolerance <= inner["x0"]) & (outer["y0"] - tolerance <= inner["y0"]) & (outer["x1"] + tolerance >= inner["x1"]) & (outer["y1"] + tolerance >= inner["y1"])


def holds_point(b: Column, x: Column, y: Column) -> Column:
    """Half-open: the left and upper sides belong to the box."""
    return (b["x0"] <= x) & (x < b["x1"]) & (b["y0"] <= y) & (y < b["y1"])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for disjoint or empty boxes."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    shared = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    union = area(a) + area(b) - shared
    return F.when((shared > 0) & (union > 0), shared / union).otherwise(0.0)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.hypot(ax - bx, ay - by)


def in_image(x: Column, y: Column, width: Column, height: Column) -> Column:
    return (x >= 0) & (x < width) & (y >= 0) & (y < height)


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, value))


def display_to_image(shown: Column, origin: Column, scale: Column) -> Column:
    """A coordinate on the screen back to the image it shows a crop of."""
    return shown / scale + origin


def denormalise(value: Column, extent: Column, frame: float = 1000.0) -> Column:
    """A coordinate in units of 1 / ``frame`` of the extent, in pixels."""
    return value / F.lit(frame) * extent


def frame_readings(sides: Column, width: Column, height: Column) -> Column:
    """What four numbers (y0, x0, y1, x1) of a model may mean, as an array of (reading, x0, y0, x1, y1): pixels, or thousandths of the image."""

    def reading(name: str, x: Callable[[Column], Column], y: Callable[[Column], Column]) -> Column:
        return F.struct(F.lit(name).alias("reading"), x(sides[1]).alias("x0"), y(sides[0]).alias("y0"), x(sides[3]).alias("x1"), y(sides[2]).alias("y1"))

    return F.array(reading("raw_pixels", lambda v: v, lambda v: v), reading("div1000_x_w_h", lambda v: denormalise(v, width), lambda v: denormalise(v, height)))


def mask_crop(bounds: Column, pad: float, width: Column, height: Column) -> Column:
    """Extents of a mask (bounds x0, y0, x1, y1, both ends inclusive) with a margin, inside the image."""
    return box(F.greatest(bounds["x0"] - pad, F.lit(0)), F.greatest(bounds["y0"] - pad, F.lit(0)), F.least(bounds["x1"] + pad, width), F.least(bounds["y1"] + pad, height))


def crop(xs: Column, ys: Column, pad: float, width: Column, height: Column) -> Column:
    """Extents of points with a margin, inside the image."""
    return box(F.greatest(F.array_min(xs) - pad, F.lit(0)), F.greatest(F.array_min(ys) - pad, F.lit(0)), F.least(F.array_max(xs) + pad, width), F.least(F.array_max(ys) + pad, height))


def hue(index: Column, n: Column) -> Column:
    """Evenly spaced hues in [0, 1)."""
    return F.try_divide(index.cast("double"), n.cast("double"))
