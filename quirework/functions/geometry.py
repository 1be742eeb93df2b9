"""Bounding-box arithmetic as column expressions (y grows downwards)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = ("x0", "y0", "x1", "y1")


def area(side: str) -> Column:
    c = lambda n: F.col(f"{side}.{n}")
    return (c("x1") - c("x0")) * (c("y1") - c("y0"))


def overlap_area(a: str, b: str) -> Column:
    """Intersection area of two aliased boxes, 0 when they only touch."""
    w = F.least(F.col(f"{a}.x1"), F.col(f"{b}.x1")) - F.greatest(F.col(f"{a}.x0"), F.col(f"{b}.x0"))
    h = F.least(F.col(f"{a}.y1"), F.col(f"{b}.y1")) - F.greatest(F.col(f"{a}.y0"), F.col(f"{b}.y0"))
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def bands(lo: Column, hi: Column, step: float) -> Column:
    """Every horizontal band of height ``step`` touched by [lo, hi]."""
    first = F.floor(lo / F.lit(step)).cast("int")
    last = F.floor(hi / F.lit(step)).cast("int")
    return F.sequence(first, F.greatest(first, last))


def band_of(y: Column, step: float) -> Column:
    return F.floor(y / F.lit(step)).cast("int")
