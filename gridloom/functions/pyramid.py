"""Tile pyramids: a grid that every zoom level halves, cut into (meta)tiles of a fixed pixel size.

A pyramid is a small driver-side value. Its methods on numbers serve planning; its methods on columns
put the pyramid's constants into expressions as literals, so that Spark can fold, push down and compile them.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from math import ceil, floor

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions import bounds as B
from gridloom.functions.bounds import Bounds

METATILINGS = (1, 2, 4, 8, 16, 32, 64, 128, 256)


@dataclass(frozen=True)
class Grid:
    """What a pyramid divides: bounds, and tiles at zoom 0."""

    name: str
    left: float
    bottom: float
    right: float
    top: float
    rows: int
    cols: int
    crs: str
    is_global: bool = False

    @property
    def bounds(self) -> Bounds:
        return Bounds(self.left, self.bottom, self.right, self.top, self.crs)


#: The two common grids.
GEODETIC = Grid("geodetic", -180.0, -90.0, 180.0, 90.0, 1, 2, "EPSG:4326", True)
MERCATOR = Grid("mercator", -20037508.3427892, -20037508.3427892, 20037508.3427892, 20037508.3427892, 1, 1, "EPSG:3857", True)
GRIDS = {"geodetic": GEODETIC, "mercator": MERCATOR}


@dataclass(frozen=True)
class Affine:
    """x = a col + b row + c, y = d col + e row + f."""

    a: float
    b: float
    c: float
    d: float
    e: float
    f: float


@dataclass(frozen=True)
class Tile:
    zoom: int
    row: int
    col: int

    @property
    def task_id(self) -> str:
        return f"{self.zoom}-{self.row}-{self.col}"


def task_id(zoom: Column, row: Column, col: Column) -> Column:
    return F.format_string("%d-%d-%d", zoom, row, col)


@dataclass(frozen=True)
class Pyramid:
    grid: Grid = GEODETIC
    tile_size: int = 256
    metatiling: int = 1
    pixelbuffer: int = 0

    def __post_init__(self):
        if self.metatiling not in METATILINGS:
            raise ValueError(f"metatiling must be one of {METATILINGS}")
        if self.pixelbuffer < 0 or self.tile_size < 1:
            raise ValueError("pixelbuffer and tile_size must not be negative")

    @classmethod
    def of(cls, value) -> Pyramid:
        """From a grid's name, or a mapping with grid, tile_size, metatiling and pixelbuffer."""
        if isinstance(value, Pyramid):
            return value
        if isinstance(value, str):
            value = {"grid": value}
        grid = value["grid"]
        if isinstance(grid, dict) and "type" in grid and grid["type"] in GRIDS:
            grid = grid["type"]
        if isinstance(grid, str):
            if grid not in GRIDS:
                raise ValueError(f"unknown grid {grid!r}")
            grid = GRIDS[grid]
        elif isinstance(grid, dict):
            shape = grid.get("shape", (1, 1))
            crs = grid.get("crs") or grid.get("proj") or f"EPSG:{grid['epsg']}"
            grid = Grid(grid.get("name", "custom"), *map(float, tuple(grid["bounds"])), int(shape[0]), int(shape[1]), str(crs), bool(grid.get("is_global", False)))
        return cls(grid, int(value.get("tile_size", 256)), int(value.get("metatiling", 1)), int(value.get("pixelbuffer", 0)))

    def to_dict(self) -> dict:
        g = self.grid
        grid = g.name if g.name in GRIDS else {"name": g.name, "bounds": list(g.bounds), "shape": [g.rows, g.cols], "crs": g.crs, "is_global": g.is_global}
        return {"grid": grid, "tile_size": self.tile_size, "metatiling": self.metatiling, "pixelbuffer": self.pixelbuffer}

    def without_pixelbuffer(self) -> Pyramid:
        return replace(self, pixelbuffer=0)

    # Sizes

    def pixel_size(self, zoom: int) -> float:
        return (self.grid.right - self.grid.left) / (self.grid.cols * 2**zoom * self.tile_size)

    def tile_span(self, zoom: int) -> float:
        return self.pixel_size(zoom) * self.tile_size * self.metatiling

    def matrix_width(self, zoom: int) -> int:
        return max(1, -(-self.grid.cols * 2**zoom // self.metatiling))

    def matrix_height(self, zoom: int) -> int:
        return max(1, -(-self.grid.rows * 2**zoom // self.metatiling))

    def matrix_affine(self, zoom: int) -> Affine:
        """Of the tile matrix as an image of one pixel a tile."""
        if self.pixelbuffer:
            raise ValueError("a matrix has no affine with a pixelbuffer")
        g = self.grid
        return Affine((g.right - g.left) / self.matrix_width(zoom), 0.0, g.left, 0.0, -(g.top - g.bottom) / self.matrix_height(zoom), g.top)

    def is_valid(self, tile: Tile) -> bool:
        return tile.zoom >= 0 and 0 <= tile.row < self.matrix_height(tile.zoom) and 0 <= tile.col < self.matrix_width(tile.zoom)

    def tile_bounds(self, zoom: int, row: int, col: int, pixelbuffer: int | None = None) -> Bounds:
        """With the pixel buffer; top and bottom end with the grid, left and right only if it isn't global."""
        g, span = self.grid, self.tile_span(zoom)
        extra = (self.pixelbuffer if pixelbuffer is None else pixelbuffer) * self.pixel_size(zoom)
        left, top = g.left + col * span, g.top - row * span
        right, bottom = min(left + span, g.right), max(top - span, g.bottom)
        left, right = left - extra, right + extra
        if not g.is_global:
            left, right = max(left, g.left), min(right, g.right)
        return Bounds(left, max(bottom - extra, g.bottom), right, min(top + extra, g.top), g.crs)

    def tile_shape(self, zoom: int, row: int, col: int) -> tuple[int, int]:
        b, px = self.tile_bounds(zoom, row, col), self.pixel_size(zoom)
        return round(b.height / px), round(b.width / px)

    def tile_affine(self, zoom: int, row: int, col: int) -> Affine:
        b, px = self.tile_bounds(zoom, row, col), self.pixel_size(zoom)
        return Affine(px, 0.0, b.left, 0.0, -px, b.top)

    def is_on_edge(self, tile: Tile) -> bool:
        """Whether the buffered tile reaches over the antimeridian or the grid's left or right edge."""
        b = self.tile_bounds(tile.zoom, tile.row, tile.col)
        return b.left <= self.grid.left or b.right >= self.grid.right

    def tile_from_point(self, zoom: int, x: float, y: float, on_edge_use: str = "rb") -> Tile:
        """``on_edge_use``: which neighbour has a point on a tile's edge (l or r, then t or b)."""
        g, span = self.grid, self.tile_span(zoom)
        c, r = (x - g.left) / span, (g.top - y) / span
        col = ceil(c) - 1 if "l" in on_edge_use and c == floor(c) else floor(c)
        row = ceil(r) - 1 if "t" in on_edge_use and r == floor(r) else floor(r)
        return Tile(zoom, min(max(row, 0), self.matrix_height(zoom) - 1), min(max(col, 0), self.matrix_width(zoom) - 1))

    def cell_range(self, zoom: int, b: Bounds) -> tuple[int, int, int, int] | None:
        """First and last row and column of tiles that share an area with ``b``; None if none does."""
        g, span = self.grid, self.tile_span(zoom)
        inner = b.intersection(g.bounds)
        if inner is None:
            return None
        first, top = floor((inner.left - g.left) / span), floor((g.top - inner.top) / span)
        last, bottom = ceil((inner.right - g.left) / span) - 1, ceil((g.top - inner.bottom) / span) - 1
        w, h = self.matrix_width(zoom) - 1, self.matrix_height(zoom) - 1
        return min(top, h), min(max(bottom, top), h), min(first, w), min(max(last, first), w)

    def parent(self, t: Tile) -> Tile | None:
        return Tile(t.zoom - 1, t.row // 2, t.col // 2) if t.zoom > 0 else None

    def children(self, t: Tile) -> list[Tile]:
        found = [Tile(t.zoom + 1, 2 * t.row + i, 2 * t.col + j) for i in (0, 1) for j in (0, 1)]
        return [x for x in found if self.is_valid(x)]

    def neighbors(self, t: Tile, connectedness: int = 8) -> list[Tile]:
        """Wrapped over the antimeridian on a global grid; none beyond the poles."""
        steps = [(-1, 0), (0, 1), (1, 0), (0, -1)] + ([(-1, 1), (1, 1), (1, -1), (-1, -1)] if connectedness == 8 else [])
        if connectedness not in (4, 8):
            raise ValueError("connectedness must be 4 or 8")
        w, h = self.matrix_width(t.zoom), self.matrix_height(t.zoom)
        found = dict.fromkeys(Tile(t.zoom, t.row + dr, (t.col + dc) % w if self.grid.is_global else t.col + dc) for dr, dc in steps)
        return [x for x in found if x != t and 0 <= x.row < h and 0 <= x.col < w]

    def intersecting(self, t: Tile, other: Pyramid) -> list[Tile]:
        """Tiles of this pyramid that share an area with a tile of another over the same grid."""
        if self.grid != other.grid:
            raise ValueError("pyramids over different grids")
        found = self.cell_range(t.zoom, other.tile_bounds(t.zoom, t.row, t.col, 0))
        if found is None:
            return []
        r0, r1, c0, c1 = found
        return [Tile(t.zoom, r, c) for r in range(r0, r1 + 1) for c in range(c0, c1 + 1)]

    # Columns; the zoom is a plain number, as a query's plan is made for one or a few zooms.

    def col_of(self, x: Column, zoom: int) -> Column:
        raw = F.floor((x - F.lit(self.grid.left)) / F.lit(self.tile_span(zoom)))
        return F.greatest(F.least(raw, F.lit(self.matrix_width(zoom) - 1)), F.lit(0)).cast("int")

    def row_of(self, y: Column, zoom: int) -> Column:
        raw = F.floor((F.lit(self.grid.top) - y) / F.lit(self.tile_span(zoom)))
        return F.greatest(F.least(raw, F.lit(self.matrix_height(zoom) - 1)), F.lit(0)).cast("int")

    def box(self, zoom: int, row: Column, col: Column, pixelbuffer: int | None = None) -> Column:
        """A struct of the tile's bounds."""
        g, span = self.grid, F.lit(self.tile_span(zoom))
        extra = F.lit((self.pixelbuffer if pixelbuffer is None else pixelbuffer) * self.pixel_size(zoom))
        left, top = F.lit(g.left) + col * span, F.lit(g.top) - row * span
        right, bottom = F.least(left + span, F.lit(g.right)), F.greatest(top - span, F.lit(g.bottom))
        left, right = left - extra, right + extra
        if not g.is_global:
            left, right = F.greatest(left, F.lit(g.left)), F.least(right, F.lit(g.right))
        return B.column(left, F.greatest(bottom - extra, F.lit(g.bottom)), right, F.least(top + extra, F.lit(g.top)))

    def first_last(self, zoom: int, box: Column) -> tuple[Column, Column, Column, Column]:
        """First and last row and column of the cells that a box reaches into, clamped to the matrix."""
        last_col = F.greatest(self.col_of(box["left"], zoom), F.least(F.ceil((box["right"] - F.lit(self.grid.left)) / F.lit(self.tile_span(zoom))) - 1, F.lit(self.matrix_width(zoom) - 1)).cast("int"))
        last_row = F.greatest(self.row_of(box["top"], zoom), F.least(F.ceil((F.lit(self.grid.top) - box["bottom"]) / F.lit(self.tile_span(zoom))) - 1, F.lit(self.matrix_height(zoom) - 1)).cast("int"))
        return self.row_of(box["top"], zoom), last_row, self.col_of(box["left"], zoom), last_col


def mercator_col(lon: Column, zoom: int) -> Column:
    """Column of a longitude in the Web Mercator matrix."""
    n = 2**zoom
    return F.greatest(F.least(F.floor((lon + F.lit(180.0)) / F.lit(360.0) * F.lit(float(n))), F.lit(n - 1)), F.lit(0)).cast("int")


def mercator_row(lat: Column, zoom: int) -> Column:
    """Row of a latitude in the Web Mercator matrix."""
    n = 2**zoom
    phi = F.radians(lat)
    raw = F.floor((F.lit(1.0) - F.log(F.tan(phi) + F.lit(1.0) / F.cos(phi)) / F.lit(3.141592653589793)) / F.lit(2.0) * F.lit(float(n)))
    return F.greatest(F.least(raw, F.lit(n - 1)), F.lit(0)).cast("int")


def scale_denominator(pixel_size: Column | float, unit_to_meter: float = 111319.49079327358):
    """OGC's scale denominator, with its 0.28 mm pixel; the default unit is a degree."""
    return pixel_size * unit_to_meter / 0.00028


def best_zoom(pyramid: Pyramid, resolution: float, top: int = 40) -> int:
    """The zoom before the first whose pixels are as small as ``resolution``, 0 at least."""
    for zoom in range(top):
        if pyramid.pixel_size(zoom) <= resolution:
            return max(0, zoom - 1)
    raise ValueError("no zoom is that fine")


def matching_zoom(tile: Tile, pyramid: Pyramid, other: Pyramid, method: str = "min", precision: int = 8) -> int:
    """The zoom of ``other`` that is as fine as a tile of ``pyramid``: by its finest corner pixel (min) or its mean (gdal, approximately)."""
    from gridloom.functions.geometry import reproject_point

    b, px = pyramid.tile_bounds(tile.zoom, tile.row, tile.col), pyramid.pixel_size(tile.zoom)
    g = pyramid.grid.crs, other.grid.crs

    def edge(x: float, y: float) -> float | None:
        try:
            (x0, y0), (x1, y1) = reproject_point(x, y, *g), reproject_point(x + px, y - px, *g)
        except ValueError:
            return None
        return min(abs(x1 - x0), abs(y1 - y0)) or None

    if method == "min":
        found = [s for s in (edge(b.left, b.top), edge(b.right - px, b.top), edge(b.left, b.bottom + px), edge(b.right - px, b.bottom + px)) if s]
        if not found:
            raise ValueError("the tile can't be reprojected")
        size = min(found)
    elif method == "gdal":
        (x0, y0), (x1, y1) = reproject_point(b.left, b.bottom, *g), reproject_point(b.right, b.top, *g)
        height, width = pyramid.tile_shape(tile.zoom, tile.row, tile.col)
        size = ((x1 - x0) ** 2 + (y1 - y0) ** 2) ** 0.5 / (height**2 + width**2) ** 0.5
    else:
        raise ValueError(f"unknown method {method!r}")
    size = round(size, precision)
    zoom = 0
    while round(other.pixel_size(zoom), precision) > size and zoom < 40:
        zoom += 1
    return zoom
