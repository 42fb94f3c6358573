"""Boxes as columns: (x, y, width, height) in any unit."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x: Column
    y: Column
    w: Column
    h: Column

    @classmethod
    def of(cls, prefix: str) -> Box:
        """Columns <prefix>x, <prefix>y, <prefix>w and <prefix>h."""
        return cls(*(F.col(prefix + c) for c in "xywh"))

    @property
    def area(self) -> Column:
        return F.greatest(self.w, F.lit(0.0)) * F.greatest(self.h, F.lit(0.0))

    @property
    def centre(self) -> tuple[Column, Column]:
        return self.x + self.w / 2, self.y + self.h / 2


def intersection(a: Box, b: Box) -> Column:
    w = F.least(a.x + a.w, b.x + b.w) - F.greatest(a.x, b.x)
    h = F.least(a.y + a.h, b.y + b.h) - F.greatest(a.y, b.y)
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 for an empty union."""
    shared = intersection(a, b)
    union = a.w * a.h + b.w * b.h - shared
    return F.when(union <= 0, 0.0).otherwise(shared / union)


def coverage(a: Box, b: Box) -> Column:
    """Share of a that b covers."""
    return F.when(a.area <= 0, 0.0).otherwise(intersection(a, b) / a.area)


def area_similarity(a: Box, b: Box) -> Column:
    return F.when((a.area <= 0) | (b.area <= 0), 0.0).otherwise(F.least(a.area, b.area) / F.greatest(a.area, b.area))


def centre_similarity(a: Box, b: Box) -> Column:
    """1 less the larger of the centre's distances along the axes, for boxes in units of the page."""
    (ax, ay), (bx, by) = a.centre, b.centre
    return F.greatest(F.lit(0.0), 1 - F.greatest(F.abs(ax - bx), F.abs(ay - by)))


def box_similarity(a: Box, b: Box) -> Column:
    return (iou(a, b) + area_similarity(a, b) + centre_similarity(a, b)) / 3


def centre_similarity_px(a: Box, b: Box, width: float = 1440.0, height: float = 900.0) -> Column:
    """For boxes in pixels: distances are taken in units of a standard viewport."""
    (ax, ay), (bx, by) = a.centre, b.centre
    return F.greatest(F.lit(0.0), 1 - F.sqrt(((ax - bx) / width) ** 2 + ((ay - by) / height) ** 2))


def clip(a: Box, width: Column, height: Column) -> Box:
    """The part of a box inside a canvas."""
    zero = F.lit(0.0)
    x, y = F.greatest(zero, F.least(a.x, width)), F.greatest(zero, F.least(a.y, height))
    right, bottom = F.greatest(zero, F.least(a.x + a.w, width)), F.greatest(zero, F.least(a.y + a.h, height))
    return Box(x, y, right - x, bottom - y)


def dimension_match(a: Column, b: Column) -> Column:
    """Smaller over larger; 0 when either is not positive."""
    return F.when((a <= 0) | (b <= 0), 0.0).otherwise(F.least(a, b) / F.greatest(a, b))


def border_area(width: Column, height: Column, top: Column, right: Column, bottom: Column, left: Column) -> Column:
    """Area of the four border strips, corners counted once."""
    rows = F.least(height, top + bottom)
    return width * rows + F.greatest(F.lit(0.0), height - rows) * F.least(width, left + right)


def colour_area(prop: Column, width: Column, height: Column, top: Column, right: Column, bottom: Column, left: Column) -> Column:
    """The area that a colour property paints, 1 at least; 1 for any other property and without a box."""
    one = F.lit(1.0)
    area = F.greatest(one, width * height)
    border = F.least(area, border_area(width, height, top, right, bottom, left))
    painted = (
        F.when(prop.isin("background", "background-color"), area - border).when(prop == "border-color", border)
        .when(prop == "border-top-color", width * F.least(top, height)).when(prop == "border-bottom-color", width * F.least(bottom, height))
        .when(prop == "border-left-color", height * F.least(left, width)).when(prop == "border-right-color", height * F.least(right, width))
    )
    return F.greatest(one, F.coalesce(painted, one))
