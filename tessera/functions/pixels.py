"""Pixel masks on whole-number colours 0 to 255."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _parts(r: Column, g: Column, b: Column) -> tuple[Column, Column]:
    return r + g + b, F.greatest(r, g, b) - F.least(r, g, b)


def tissue(r, g, b) -> Column:
    total, spread = _parts(r, g, b)
    return (total < 705) & (spread > 8)


def pale(r, g, b) -> Column:
    total, spread = _parts(r, g, b)
    return tissue(r, g, b) & (total > 495) & (spread < 28)


def artifact(r, g, b) -> Column:
    _, spread = _parts(r, g, b)
    return (spread > 75) & ((r * 4 > g * 5) | (b * 4 > g * 5) | (g * 4 > r * 5))


def background(r, g, b) -> Column:
    return (r + g + b) > 705


def ten_thousandths(part: Column, whole: Column) -> Column:
    """part / whole to four places, halves up, as a whole number; 0 where whole is 0."""
    p, n = part.cast("long"), whole.cast("long")
    return F.when(n > 0, F.floor((p * 20000 + n) / (n * 2)).cast("long")).otherwise(F.lit(0).cast("long"))


def share(flag: Column) -> Column:
    """Ten-thousandths of the rows where flag holds."""
    return ten_thousandths(F.count_if(flag), F.count(F.lit(1)))
