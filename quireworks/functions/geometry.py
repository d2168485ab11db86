"""Rectangles as Spark columns.  Geometry is single precision throughout, so every number is cast to FLOAT."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


def f(x: float | int | Column | str) -> Column:
    """A FLOAT column from a number, a name or a column."""
    if isinstance(x, str):
        x = F.col(x)
    elif not isinstance(x, Column):
        x = F.lit(x)
    return x.cast("float")


class Rect(NamedTuple):
    """Bottom-left corner and size."""

    x: Column
    y: Column
    w: Column
    h: Column

    @staticmethod
    def of(prefix: str = "", names: tuple[str, str, str, str] = ("x", "y", "width", "height")) -> Rect:
        return Rect(*(f(prefix + n) for n in names))

    @property
    def right(self) -> Column:
        return self.x + self.w

    @property
    def top(self) -> Column:
        return self.y + self.h

    @property
    def cx(self) -> Column:
        return self.x + self.w * f(0.5)

    @property
    def cy(self) -> Column:
        return self.y + self.h * f(0.5)

    def struct(self) -> Column:
        return F.struct(self.x.alias("x"), self.y.alias("y"), self.w.alias("width"), self.h.alias("height"))


def intersects(a: Rect, b: Rect) -> Column:
    """Whether the open rectangles share a point."""
    return (a.x < b.right) & (a.right > b.x) & (a.y < b.top) & (a.top > b.y)


def union(a: Rect, b: Rect) -> Rect:
    x, y = F.least(a.x, b.x), F.least(a.y, b.y)
    return Rect(x, y, F.greatest(a.right, b.right) - x, F.greatest(a.top, b.top) - y)


def intersection(a: Rect, b: Rect) -> tuple[Rect, Column]:
    """(rectangle, whether it is not empty)."""
    x, y, right, top = F.greatest(a.x, b.x), F.greatest(a.y, b.y), F.least(a.right, b.right), F.least(a.top, b.top)
    return Rect(x, y, right - x, top - y), (right > x) & (top > y)


def expand(a: Rect, by: float | Column) -> Rect:
    return Rect(a.x - f(by), a.y - f(by), a.w + f(by) * f(2), a.h + f(by) * f(2))


def overlap_fraction(subject: Rect, region: Rect) -> Column:
    """Share of the subject's area inside the region: 0 to 1, and 0 for a subject without area."""
    common, some = intersection(subject, region)
    area = F.greatest(subject.w, f(0)) * F.greatest(subject.h, f(0))
    share = F.greatest(f(0), F.least(f(1), (common.w * common.h / F.when(area > 0, area)).cast("float")))
    return F.when(some & (area > 0), share).otherwise(f(0))


def vertical_gap(a: Rect, b: Rect) -> Column:
    return F.when(a.top < b.y, b.y - a.top).when(b.top < a.y, a.y - b.top).otherwise(f(0))


def overlaps_materially(content: Rect, region: Rect) -> Column:
    """Horizontal overlap of at least a quarter of the narrower."""
    overlap = F.least(content.right, region.right) - F.greatest(content.x, region.x)
    return (overlap > 0) & (overlap >= F.least(content.w, region.w) * f(0.25))


def centre_inside(subject: Rect, region: Rect) -> Column:
    return subject.cx.between(region.x, region.right) & subject.cy.between(region.y, region.top)


def titles_align(a: Rect, b: Rect, font: Column) -> Column:
    overlap = F.least(a.right, b.right) - F.greatest(a.x, b.x)
    return (overlap > 0) | (F.abs(a.cx - b.cx) <= F.greatest(a.w, b.w) * f(0.35) + f(font))


def column_bounds(a: Rect, page: Rect, two_columns: Column) -> tuple[Column, Column]:
    middle = page.cx
    left = ~two_columns | (a.cx < middle)
    return F.when(left, page.x).otherwise(middle), F.when(two_columns & left, middle).otherwise(page.right)


def bounding_box(r: Rect) -> list[Column]:
    """Aggregates for the smallest rectangle around all."""
    return [
        F.min(r.x).alias("x"), F.min(r.y).alias("y"), (F.max(r.right) - F.min(r.x)).alias("width"), (F.max(r.top) - F.min(r.y)).alias("height")]
