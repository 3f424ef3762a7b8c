"""Boxes as structs of left, top, right, bottom."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom"))


def area(b: Column) -> Column:
    return F.greatest(b["right"] - b["left"], F.lit(0)) * F.greatest(b["bottom"] - b["top"], F.lit(0))


def intersection(a: Column, b: Column) -> Column:
    return F.greatest(F.least(a["right"], b["right"]) - F.greatest(a["left"], b["left"]), F.lit(0)) * F.greatest(F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"]), F.lit(0))


def iou(a: Column, b: Column) -> Column:
    """Shared part of two boxes' joint area; 0 where the joint area is empty."""
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def union(a: Column, b: Column) -> Column:
    return box(F.least(a["left"], b["left"]), F.least(a["top"], b["top"]), F.greatest(a["right"], b["right"]), F.greatest(a["bottom"], b["bottom"]))


def to_pixels(x: Column, extent: Column | int, scale: Column | float) -> Column:
    """A coordinate on a 0..scale axis as whole pixels inside the picture, towards zero."""
    extent = F.lit(extent) if isinstance(extent, int) else extent
    return F.greatest(F.lit(0.0), F.least(extent.cast("double"), x / scale * extent)).cast("int")


def pad(b: Column, by: int, width: Column | int, height: Column | int) -> Column:
    return box(F.greatest(F.lit(0), b["left"] - by), F.greatest(F.lit(0), b["top"] - by), F.least(F.lit(width), b["right"] + by), F.least(F.lit(height), b["bottom"] + by))


def suppress(boxes: Column, threshold: float) -> Column:
    """Greedy suppression over an ordered array of boxes: one is kept unless it overlaps a kept one by ``threshold`` or more.
    A fold inside the row, so no Python and no pairs between rows."""
    return F.aggregate(boxes, F.slice(boxes, 1, 0), lambda kept, b: F.when(F.exists(kept, lambda k: iou(b, k) >= threshold), kept).otherwise(F.concat(kept, F.array(b))))
