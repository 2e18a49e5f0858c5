"""Boxes and points as Column expressions. A box is struct<x1, y1, x2, y2: int>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x1", "y1", "x2", "y2")


def clamp(v: Column, low: Column, high: Column) -> Column:
    """max(low, min(high, v)); null if any is null."""
    known = v.isNotNull() & low.isNotNull() & high.isNotNull()
    return F.when(known, F.greatest(low, F.least(high, v)))


def box(x1, y1, x2, y2) -> Column:
    return F.struct(*[v.cast("int").alias(n) for n, v in zip(SIDES, (x1, y1, x2, y2))])


def width(b: Column) -> Column:
    return F.greatest(F.lit(0), b["x2"] - b["x1"])


def height(b: Column) -> Column:
    return F.greatest(F.lit(0), b["y2"] - b["y1"])


def area(b: Column) -> Column:
    return width(b).cast("long") * height(b)


def center(b: Column) -> tuple[Column, Column]:
    """Midpoint, halves to the even number."""
    return tuple(F.bround((b[a] + b[c]) / 2.0).cast("int") for a, c in (("x1", "x2"), ("y1", "y2")))


def intersection(a: Column, b: Column) -> Column:
    """Common part; boxes that only touch have none, given as zeros."""
    x1, y1 = F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"])
    x2, y2 = F.least(a["x2"], b["x2"]), F.least(a["y2"], b["y2"])
    zero = F.lit(0)
    return F.when((x2 > x1) & (y2 > y1), box(x1, y1, x2, y2)).otherwise(box(zero, zero, zero, zero))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Common area over the smaller area (at least 1)."""
    return area(intersection(a, b)) / F.greatest(F.lit(1), F.least(area(a), area(b)))


def clamp_box(b: Column, w: Column, h: Column) -> Column:
    z = F.lit(0)
    return box(clamp(b["x1"], z, w), clamp(b["y1"], z, h), clamp(b["x2"], z, w), clamp(b["y2"], z, h))


def scale_box(b: Column, from_w, from_h, to_w, to_h) -> Column:
    """A thumbnail's box on the full image, halves to even, inside the image."""
    x = lambda n: F.bround(b[n] * to_w / from_w)
    y = lambda n: F.bround(b[n] * to_h / from_h)
    return clamp_box(box(x("x1"), y("y1"), x("x2"), y("y2")), to_w, to_h)


def millionths(v: Column, whole: Column) -> Column:
    """v / max(1, whole) to six places, as a whole number of millionths."""
    n = F.greatest(F.lit(1), whole).cast("long")
    return F.floor((v.cast("long") * 2000000 + n) / (n * 2)).cast("long")


def clamp_center(x: Column, y: Column, size: Column, w: Column, h: Column) -> tuple[Column, Column]:
    """Nearest center whose window of ``size`` stays inside."""
    half = F.floor(size / 2).cast("int")
    return tuple(clamp(v, half, F.greatest(half, n - half)) for v, n in ((x, w), (y, h)))


def window(x: Column, y: Column, size: Column) -> Column:
    half = F.floor(size / 2).cast("int")
    return box(x - half, y - half, x + half, y + half)
