"""Box arithmetic on columns. A box is a struct with x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(b: Column) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def overlap_area(a: Column, b: Column) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    inter = overlap_area(a, b)
    union = area(a) + area(b) - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(0.0)


def horizontal_overlap(a: Column, b: Column) -> Column:
    """Shared width over the narrower box."""
    inter = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    narrow = F.greatest(F.least(a["x2"] - a["x1"], b["x2"] - b["x1"]), F.lit(1e-6))
    return F.when(inter > 0, inter / narrow).otherwise(0.0)


def intersects(a: Column, b: Column) -> Column:
    return (F.least(a["x2"], b["x2"]) > F.greatest(a["x1"], b["x1"])) & (F.least(a["y2"], b["y2"]) > F.greatest(a["y1"], b["y1"]))


def to_percent(value: Column, side: Column) -> Column:
    return F.round(100.0 * value / side, 4)


def to_pixels(value: Column, side: Column) -> Column:
    return value * side / 100.0


def pixel_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Corners in whole pixels of a box in percent; halves round to even."""
    left, top = to_pixels(x, width), to_pixels(y, height)
    corners = (left, top, left + to_pixels(w, width), top + to_pixels(h, height))
    return F.struct(*(F.bround(c).cast("int").alias(n) for c, n in zip(corners, ("x1", "y1", "x2", "y2"))))


def padded(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, pad_x: Column, pad_y: Column) -> Column:
    """The box grown by the pads, cut at the page, in whole pixels (towards zero)."""
    return F.struct(
        F.greatest(F.lit(0), (x1 - pad_x).cast("int")).alias("x1"), F.greatest(F.lit(0), (y1 - pad_y).cast("int")).alias("y1"),
        F.least(width.cast("int"), (x2 + pad_x).cast("int")).alias("x2"), F.least(height.cast("int"), (y2 + pad_y).cast("int")).alias("y2"),
    )


def centre_box(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Centre and size in shares of the page from percent, kept within 0 and 1."""
    clamp = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v / 100.0))
    return F.struct(clamp(x + w / 2).alias("cx"), clamp(y + h / 2).alias("cy"), clamp(w).alias("w"), clamp(h).alias("h"))


def left_top_size(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Whole-pixel left, top, width, height; halves round to even."""
    return F.struct(F.bround(x1).cast("int").alias("left"), F.bround(y1).cast("int").alias("top"), F.bround(x2 - x1).cast("int").alias("width"), F.bround(y2 - y1).cast("int").alias("height"))
