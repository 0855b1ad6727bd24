"""Bounding boxes, as Python values and as Spark columns."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, floor

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("left", "bottom", "right", "top")


@dataclass(frozen=True)
class Bounds:
    left: float
    bottom: float
    right: float
    top: float
    crs: str | None = None

    def __post_init__(self):
        if self.left > self.right or self.bottom > self.top:
            raise ValueError(f"left must not exceed right, nor bottom top: {self}")

    def __iter__(self):
        return iter((self.left, self.bottom, self.right, self.top))

    def __add__(self, other: Bounds) -> Bounds:
        if self.crs and other.crs and self.crs != other.crs:
            raise ValueError(f"bounds in {self.crs} and {other.crs}")
        return Bounds(min(self.left, other.left), min(self.bottom, other.bottom), max(self.right, other.right), max(self.top, other.top), self.crs or other.crs)

    @property
    def width(self) -> float:
        return self.right - self.left

    @property
    def height(self) -> float:
        return self.top - self.bottom

    @property
    def ring(self) -> list[tuple[float, float]]:
        return [(self.left, self.bottom), (self.right, self.bottom), (self.right, self.top), (self.left, self.top), (self.left, self.bottom)]

    def intersects(self, other: Bounds) -> bool:
        """Touching edges count."""
        return self.left <= other.right and self.right >= other.left and self.bottom <= other.top and self.top >= other.bottom

    def intersection(self, other: Bounds) -> Bounds | None:
        if not self.intersects(other):
            return None
        return Bounds(max(self.left, other.left), max(self.bottom, other.bottom), min(self.right, other.right), min(self.top, other.top), self.crs)

    @classmethod
    def of(cls, value) -> Bounds:
        """From bounds, four numbers, a mapping or anything with ``bounds``."""
        if isinstance(value, Bounds):
            return value
        if isinstance(value, dict):
            return cls(*(float(value[k]) for k in FIELDS))
        if hasattr(value, "bounds"):
            return cls.of(value.bounds)
        value = list(value)
        if len(value) != 4:
            raise ValueError(f"four numbers are needed, not {value}")
        return cls(*map(float, value))

    def latlon(self) -> Bounds:
        """This box, in Web Mercator metres, in degrees."""
        from gridloom.functions.geometry import mercator_to_latlon

        return Bounds(*mercator_to_latlon(self.left, self.bottom), *mercator_to_latlon(self.right, self.top), "EPSG:4326")


def clip(bounds: Bounds, to: Bounds) -> Bounds:
    return Bounds(max(bounds.left, to.left), max(bounds.bottom, to.bottom), min(bounds.right, to.right), min(bounds.top, to.top), bounds.crs)


def snap(bounds: Bounds, pyramid, zoom: int) -> Bounds:
    """The smallest box of whole tiles (with their pixel buffer) around ``bounds``."""
    g, span = pyramid.grid, pyramid.tile_span(zoom)
    first = max(0, floor((bounds.left - g.left) / span))
    last = min(pyramid.matrix_width(zoom), ceil((bounds.right - g.left) / span)) - 1
    top = max(0, floor((g.top - bounds.top) / span))
    bottom = min(pyramid.matrix_height(zoom), ceil((g.top - bounds.bottom) / span)) - 1
    return pyramid.tile_bounds(zoom, top, first) + pyramid.tile_bounds(zoom, bottom, max(first, last))


def pixel_ranges(bounds: Bounds, affine) -> tuple[int, int, int, int]:
    """First and one past the last row and column of a raster's pixels that a box covers, to the nearest pixel edge."""
    top, left = round((affine.f - bounds.top) / -affine.e), round((bounds.left - affine.c) / affine.a)
    return top, top + round(bounds.height / -affine.e), left, left + round(bounds.width / affine.a)


def column(left, bottom, right, top) -> Column:
    return F.struct(*[F.lit(v).cast("double").alias(n) if isinstance(v, (int, float)) else v.cast("double").alias(n) for n, v in zip(FIELDS, (left, bottom, right, top))])


def literal(b: Bounds) -> Column:
    return column(*b)


def intersect(a: Column, b: Column) -> Column:
    """Whether two boxes meet; touching edges count."""
    return (a["left"] <= b["right"]) & (a["right"] >= b["left"]) & (a["bottom"] <= b["top"]) & (a["top"] >= b["bottom"])


def overlap(a: Column, b: Column) -> Column:
    """Whether two boxes share an area; touching edges don't count."""
    return (a["left"] < b["right"]) & (a["right"] > b["left"]) & (a["bottom"] < b["top"]) & (a["top"] > b["bottom"])


def holds(box: Column, x: Column, y: Column) -> Column:
    """Half open: left and bottom edges belong to a box, right and top edges don't, so that a point falls in one cell."""
    return (x >= box["left"]) & (x < box["right"]) & (y >= box["bottom"]) & (y < box["top"])


def shared(a: Column, b: Column) -> Column:
    return column(F.greatest(a["left"], b["left"]), F.greatest(a["bottom"], b["bottom"]), F.least(a["right"], b["right"]), F.least(a["top"], b["top"]))


def total(box: str) -> list[Column]:
    """Aggregates: the box around all boxes."""
    return [F.min(f"{box}.left").alias("left"), F.min(f"{box}.bottom").alias("bottom"), F.max(f"{box}.right").alias("right"), F.max(f"{box}.top").alias("top")]
