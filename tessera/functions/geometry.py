"""Box arithmetic as Column expressions: x, y, w, h in points, origin top left, y down.

A box is named by the prefix of its columns: ``box("b_")`` is b_x, b_y, b_w, b_h.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    x: Column
    y: Column
    w: Column
    h: Column

    @property
    def right(self) -> Column:
        return self.x + self.w

    @property
    def bottom(self) -> Column:
        return self.y + self.h

    @property
    def cx(self) -> Column:
        return self.x + self.w / 2

    @property
    def cy(self) -> Column:
        return self.y + self.h / 2

    @property
    def area(self) -> Column:
        """Negative sides count as 0."""
        return F.greatest(F.lit(0.0), self.w) * F.greatest(F.lit(0.0), self.h)

    def holds(self, x: Column, y: Column) -> Column:
        """All four edges belong to the box."""
        return (x >= self.x) & (x <= self.right) & (y >= self.y) & (y <= self.bottom)

    def holds_centre_of(self, other: Box) -> Column:
        return self.holds(other.cx, other.cy)

    def holds_box(self, inner: Box, tolerance: float = 0.5) -> Column:
        t = F.lit(tolerance)
        return (inner.x >= self.x - t) & (inner.y >= self.y - t) & (inner.right <= self.right + t) & (inner.bottom <= self.bottom + t)

    def overlap(self, other: Box) -> Column:
        wide = F.greatest(F.lit(0.0), F.least(self.right, other.right) - F.greatest(self.x, other.x))
        high = F.greatest(F.lit(0.0), F.least(self.bottom, other.bottom) - F.greatest(self.y, other.y))
        return wide * high

    def touches(self, other: Box) -> Column:
        return (self.x <= other.right) & (other.x <= self.right) & (self.y <= other.bottom) & (other.y <= self.bottom)

    def iou(self, other: Box) -> Column:
        common = self.overlap(other)
        union = self.area + other.area - common
        return F.when(union > 0, common / union).otherwise(F.lit(0.0))

    def distance(self, other: Box) -> Column:
        return F.sqrt(F.pow(self.cx - other.cx, 2) + F.pow(self.cy - other.cy, 2))


def box(prefix: str = "") -> Box:
    return Box(*(F.col(f"{prefix}{c}") for c in "xywh"))


def box_of(struct: Column, prefix: str = "") -> Box:
    """The box of a struct's fields."""
    return Box(*(struct[f"{prefix}{c}"] for c in "xywh"))


def from_edges(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """Struct x, y, w, h of edges in either order."""
    x, y = F.least(left, right), F.least(top, bottom)
    return F.struct(x.alias("x"), y.alias("y"), (F.greatest(left, right) - x).alias("w"), (F.greatest(top, bottom) - y).alias("h"))


def prefixed(columns: tuple[str, ...], prefix: str) -> list[Column]:
    return [F.col(c).alias(f"{prefix}{c}") for c in columns]
