"""User functions over tiles, and the built-in processes.

A user function gets the tile and its inputs as numpy arrays (rasters) or lists of features (vectors) and
returns an array, (array, tags), a list of features or "empty". Each tile is a group of rows and so one
call; inputs are grouped by tile beforehand, so nothing but a tile's rows is in memory at once.
"""

from __future__ import annotations

import importlib
import importlib.util
import inspect
import json
import warnings
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import arrays
from gridloom.functions import geometry as G
from gridloom.functions import raster as R
from gridloom.functions.pyramid import Pyramid, Tile
from gridloom.operators.tiles import by_tile

EMPTY = "empty"
RASTER_OUT = "zoom int, row int, col int, band int, height int, width int, pixels array<double>, tags string"
VECTOR_OUT = "zoom int, row int, col int, geom struct<type:string,rings:array<array<struct<x:double,y:double>>>,part:array<int>>, properties map<string,string>"


class ProcessError(RuntimeError):
    """A user function failed on a tile."""


@dataclass
class RasterInput:
    """A raster of one tile: bands by height by width, masked where there is no data."""

    rows: pa.Table

    def is_empty(self) -> bool:
        return not self.rows.num_rows or bool(self.read().mask.all())

    def read(self, indexes: int | list[int] | None = None) -> np.ma.MaskedArray:
        if not self.rows.num_rows:
            return np.ma.masked_all((0, 0, 0))
        data = arrays.cubes(self.rows)
        if indexes is not None:
            there = sorted(self.rows["band"].to_pylist())
            data = data[[there.index(i) for i in ([indexes] if isinstance(indexes, int) else indexes)]]
        return np.ma.masked_invalid(data)


@dataclass
class VectorInput:
    """The features of one tile."""

    rows: pa.Table

    def is_empty(self) -> bool:
        return not self.rows.num_rows

    def read(self) -> list[dict]:
        return [{"geometry": g, "properties": dict(p or {})} for g, p in zip(arrays.geometries(self.rows["geom"]), arrays.maps(self.rows["properties"]))]


@dataclass
class Context:
    """What a function may ask of the tile it runs on."""

    tile: Tile
    pyramid: Pyramid
    inputs: dict[str, RasterInput | VectorInput] = field(default_factory=dict)
    params: dict[str, Any] = field(default_factory=dict)

    @property
    def bounds(self):
        return self.pyramid.tile_bounds(self.tile.zoom, self.tile.row, self.tile.col)

    @property
    def resolution(self) -> float:
        return self.pyramid.pixel_size(self.tile.zoom)


def load_function(source: str | list[str] | Callable) -> Callable:
    """A function: itself, ``execute`` of a module or file, or of lines of code."""
    if callable(source):
        return source
    if isinstance(source, list):
        scope: dict[str, Any] = {}
        exec("\n".join(source), scope)  # the user's own process code
        found = scope.get("execute")
    elif source.endswith(".py"):
        spec = importlib.util.spec_from_file_location("user_process", source)
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        found = getattr(module, "execute", None)
    else:
        found = getattr(importlib.import_module(source), "execute", None)
    if not callable(found):
        raise ValueError(f"{source!r} has no function execute")
    return found


def check_parameters(function: Callable, given: Iterable[str]) -> list[str]:
    """Names of ``given`` that the function takes; raises if a required one is missing, warns of unknown ones."""
    params = inspect.signature(function).parameters
    given = list(given)
    if any(p.kind is p.VAR_KEYWORD for p in params.values()):
        return given
    lacking = [n for n, p in params.items() if p.default is p.empty and p.kind in (p.POSITIONAL_OR_KEYWORD, p.KEYWORD_ONLY) and n not in given and n != "mp"]
    if lacking:
        raise ValueError(f"the process needs {', '.join(lacking)}")
    for n in given:
        if n not in params:
            warnings.warn(f"the process doesn't take {n}", stacklevel=2)
    return [n for n in given if n in params]


def filtered_parameters(params: dict[str, Any]) -> dict[str, Any]:
    return {k: v for k, v in params.items() if v is not None}


def output_rows(found: Any, tile: Tile, vector: bool) -> pa.Table:
    """What a function returned, as rows; None is an error, "empty" and all-masked arrays give none."""
    none = arrays.empty_table(VECTOR_OUT if vector else RASTER_OUT)
    if found is None:
        raise ProcessError(f"tile {tile.task_id}: the process returned None")
    if isinstance(found, str):
        if found != EMPTY:
            raise ProcessError(f"tile {tile.task_id}: the process returned {found!r}")
        return none
    key = lambda n: {"zoom": [tile.zoom] * n, "row": [tile.row] * n, "col": [tile.col] * n}
    if vector:
        geoms = [f["geometry"] if "rings" in f["geometry"] else G.from_geojson(f["geometry"]) for f in found]
        properties = [[(k, None if v is None else str(v)) for k, v in f["properties"].items()] for f in found]
        return arrays.table_of({**key(len(geoms)), "geom": geoms, "properties": properties}, VECTOR_OUT)
    array, tags = found if isinstance(found, tuple) else (found, {})
    array = np.ma.asanyarray(array)
    if array.ndim == 2:
        array = array[None]
    if array.ndim != 3:
        raise ProcessError(f"tile {tile.task_id}: 2 or 3 dimensions are needed, not {array.ndim}")
    data = np.ma.getdata(array).astype(float)
    data = np.where(np.ma.getmaskarray(array) | ~np.isfinite(data), np.nan, data)
    if np.isnan(data).all():
        return none
    n, height, width = data.shape
    return arrays.table_of({**key(n), "band": list(range(1, n + 1)), "height": [height] * n, "width": [width] * n, "pixels": arrays.lists(data), "tags": [json.dumps(tags)] * n}, RASTER_OUT)


def run(tiles: DataFrame, inputs: dict[str, DataFrame], function: Callable, pyramid: Pyramid, params: dict[str, Any] | None = None, vector: bool = False, vector_inputs: Iterable[str] = ()) -> DataFrame:
    """Call ``function`` for each tile. Inputs (packed rasters or features with zoom, row, col) are joined by tile.

    The rows of all inputs are put under one another with their input's name, and grouped by tile once: rasters many tiles
    at a time, features tile by tile.
    """
    vector_inputs = set(vector_inputs)
    params = filtered_parameters(params or {})
    takes = check_parameters(function, [*inputs, *params])
    keys = R.TILE
    rasters = not vector and not vector_inputs
    common = "zoom int, row int, col int, _input string, band int, height int, width int, pixels array<double>, geom struct<type:string,rings:array<array<struct<x:double,y:double>>>,part:array<int>>, properties map<string,string>"
    names = [f.split(" ")[0] for f in common.split(", ")][: 8 if rasters else None]
    types = dict(zip(names, [f.split(" ", 1)[1] for f in common.split(", ")]))
    parts = [tiles.select(*keys).distinct()]
    for name, df in inputs.items():
        parts.append(df.join(tiles.select(*keys).distinct(), keys, "left_semi").withColumn("_input", F.lit(name)))
    union = None
    for df in parts:
        row = df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(types[n]).alias(n) for n in names])
        union = row if union is None else union.unionByName(row)
    given_names = list(inputs)
    needs_context = "mp" in inspect.signature(function).parameters

    def call(key: tuple[int, int, int], rows: pa.Table) -> pa.Table:
        tile = Tile(*key)
        given: dict[str, Any] = {}
        for name in given_names:
            # One row is the tile's own, without an input.
            own = rows.filter(pc.equal(rows["_input"], name)) if rows.num_rows > 1 else rows.slice(0, 0)
            given[name] = VectorInput(own) if name in vector_inputs else RasterInput(own)
        context = Context(tile, pyramid, dict(given), params)
        arguments = {k: v for k, v in {**given, **params}.items() if k in takes}
        if needs_context:
            arguments["mp"] = context
        try:
            found = function(**arguments)
        except Exception as e:
            raise ProcessError(f"tile {tile.task_id}: {e!r}") from e
        return output_rows(list(found) if vector and not isinstance(found, (str, type(None))) else found, tile, vector)

    if rasters:
        return by_tile(union, call, RASTER_OUT)
    return union.groupBy(*keys).applyInArrow(lambda key, rows: call(tuple(int(k.as_py()) for k in key), rows), VECTOR_OUT if vector else RASTER_OUT)


# Built-in processes, as DataFrame plans.

def clip(pixels: DataFrame, features: DataFrame, pyramid: Pyramid, zoom: int, width: int, invert: bool = False, all_touched: bool = False, buffer: float = 0.0) -> DataFrame:
    """Pixels whose centre no feature holds become NULL (those that one holds, with ``invert``); ``buffer`` and ``all_touched`` widen the features."""
    from gridloom.operators.vector import mask

    x, y = R.pixel_centre(pyramid, zoom, width)
    df = mask(pixels.withColumns({"x": x, "y": y}), features, pyramid, zoom, invert, all_touched=all_touched, buffer=buffer, pixel=pyramid.tile_span(zoom) / width)
    return df.withColumn("value", F.when(~F.col("masked"), F.col("value"))).drop("x", "y", "masked")


def convert(pixels: DataFrame, ratio: float = 1.0, offset: float = 0.0, dtype: str | None = None) -> DataFrame:
    return pixels.withColumn("value", R.scaled(F.col("value"), ratio, offset, dtype))


def contours(packed: DataFrame, pyramid: Pyramid, interval: float = 100.0, base: float = 0.0, field_name: str = "elev") -> DataFrame:
    """zoom, row, col, ``field_name``, geom: contour lines of each tile by marching squares between pixel centres."""
    schema = f"zoom int, row int, col int, {field_name} double, geom struct<type:string,rings:array<array<struct<x:double,y:double>>>,part:array<int>>"

    def lines(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"zoom": [], "row": [], "col": [], field_name: [], "geom": []}
            keys = [batch.column(i).to_pylist() for i in range(5)]
            for zoom, row, col, height, width, pixels in zip(*keys, arrays.blocks(batch.column(5))):
                data = pixels.reshape(height, width)
                if np.isnan(data).all():
                    continue
                b = pyramid.tile_bounds(zoom, row, col)
                sx, sy = b.width / width, b.height / height
                for level in R.contour_values(float(np.nanmin(data)), float(np.nanmax(data)), interval, base):
                    for line in marching_squares(data, level):
                        ring = [{"x": x, "y": y} for x, y in zip((b.left + (line[:, 0] + 0.5) * sx).tolist(), (b.top - (line[:, 1] + 0.5) * sy).tolist())]
                        for name, value in zip(out, (zoom, row, col, level, {"type": "LineString", "rings": [ring], "part": [0]})):
                            out[name].append(value)
            yield from arrays.table_of(out, schema).to_batches()

    return packed.select(*R.TILE, "height", "width", "pixels").mapInArrow(lines, schema)


def crossings(data: np.ndarray, level: float) -> tuple[np.ndarray, np.ndarray]:
    """Ends (n, 2) of the pieces of line in the squares between four pixels, as numbers of the edges they cross; and x, y (edges, 2) of each edge's crossing.

    Edges to the right of a pixel are numbered by the pixel, those below it after them all. Squares with no data have no piece.
    """
    h, w = data.shape
    with np.errstate(invalid="ignore", divide="ignore"):
        y, x = np.mgrid[0:h, 0:w].astype(float)
        right, down = np.full((h, w), np.nan), np.full((h, w), np.nan)
        right[:, :-1] = (level - data[:, :-1]) / (data[:, 1:] - data[:, :-1])
        down[:-1] = (level - data[:-1]) / (data[1:] - data[:-1])
    at = np.concatenate((np.stack((x + right, y), axis=2).reshape(-1, 2), np.stack((x, y + down), axis=2).reshape(-1, 2)))
    above = data >= level
    a, b, c, d = above[:-1, :-1], above[:-1, 1:], above[1:, 1:], above[1:, :-1]
    four = np.stack((data[:-1, :-1], data[:-1, 1:], data[1:, 1:], data[1:, :-1]))
    seen = ~np.isnan(four).any(axis=0)
    number = np.arange(h * w).reshape(h, w)
    top, bottom, left, side = number[:-1, :-1], number[1:, :-1], h * w + number[:-1, :-1], h * w + number[:-1, 1:]
    crossed = np.stack((a != b, b != c, d != c, a != d)) & seen
    edges = np.stack((top, side, bottom, left))
    count = crossed.sum(axis=0)
    pairs = []
    for i in range(4):
        for j in range(i + 1, 4):
            one = (count == 2) & crossed[i] & crossed[j]
            pairs.append(np.stack((edges[i][one], edges[j][one]), axis=1))
    # All four sides are crossed: the middle says which corners belong together.
    with np.errstate(invalid="ignore"):
        like_first = (four.mean(axis=0) >= level) == a
    for here, (i, j), (k, m) in (((count == 4) & like_first, (0, 1), (2, 3)), ((count == 4) & ~like_first, (0, 3), (1, 2))):
        pairs += [np.stack((edges[i][here], edges[j][here]), axis=1), np.stack((edges[k][here], edges[m][here]), axis=1)]
    return np.concatenate(pairs), at


def marching_squares(data: np.ndarray, level: float) -> list[np.ndarray]:
    """Lines (n, 2: x, y in pixels) along which ``data`` passes ``level``. Only the joining of pieces is a loop."""
    pieces, at = crossings(data, level)
    ends: dict[int, list[int]] = {}
    for a, b in pieces.tolist():
        ends.setdefault(a, []).append(b)
        ends.setdefault(b, []).append(a)
    # Open lines first, from their ends; what is left are rings.
    lines = []
    for start in [e for e, n in ends.items() if len(n) == 1] + list(ends):
        if not ends[start]:
            continue
        line, here = [start], start
        while ends[here]:
            to = ends[here].pop()
            ends[to].remove(here)
            line.append(to)
            here = to
        lines.append(at[line])
    return lines


PROCESSES = {"clip": clip, "contours": contours, "convert": convert, "hillshade": R.hillshade, "passthrough": lambda df: df}


# The same by name in a configuration: plans over a zoom's tiles, of the raster input and, if one is given, the features ``clip``.

def _given(todo: DataFrame, given: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame | None]:
    rasters = {k: v for k, v in given.items() if k != "clip"}
    if len(rasters) != 1:
        raise ValueError(f"one raster input is needed, not {sorted(rasters)}")
    return next(iter(rasters.values())).join(todo.select(*R.TILE).distinct(), R.TILE, "left_semi"), given.get("clip")


def _through(todo: DataFrame, given: dict[str, DataFrame], pyramid: Pyramid, zoom: int, change: Callable[[DataFrame], DataFrame], clip_buffer: float = 0.0) -> DataFrame:
    """Pixels with a changed value, packed again; clipped first to the features. Sizes keep the pixel buffer."""
    packed, features = _given(todo, given)
    size = pyramid.tile_size * pyramid.metatiling + 2 * pyramid.pixelbuffer
    long = R.to_long(packed.select(*R.TILE, "band", "height", "width", "pixels"))
    if features is not None:
        own, b = pyramid.without_pixelbuffer(), pyramid.pixelbuffer
        shifted = long.withColumns({"py": F.col("py") - b, "px": F.col("px") - b})
        cut = clip(shifted, features.select("geom"), own, zoom, size - 2 * b, buffer=clip_buffer * own.pixel_size(zoom))
        long = cut.withColumns({"py": F.col("py") + b, "px": F.col("px") + b})
    return R.to_packed(change(long), size, size).withColumn("tags", F.lit("{}"))


def _with_clip(todo: DataFrame, given: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame], DataFrame | None]:
    """The tiles that have a feature of ``clip`` (all if it isn't given), the other inputs, and ``clip``."""
    rest, features = {k: v for k, v in given.items() if k != "clip"}, given.get("clip")
    return todo if features is None else todo.join(features.select(*R.TILE).distinct(), R.TILE, "left_semi"), rest, features


def _hillshade(todo, given, pyramid, zoom, azimuth=315.0, altitude=45.0, z=1.0, scale=1.0):
    """Shaded relief. ``clip`` only says which tiles are made: those with a feature of it, whole."""
    px = pyramid.pixel_size(zoom)
    change = lambda df: R.hillshade(df, px, -px, azimuth, altitude, z, scale).withColumn("value", F.col("shade").cast("double")).drop("shade")
    todo, given, _ = _with_clip(todo, given)
    return _through(todo, given, pyramid, zoom, change)


def _convert(todo, given, pyramid, zoom, scale_ratio=1.0, scale_offset=0.0, clip_to_output_dtype=None, clip_pixelbuffer=0):
    """Scaled pixels; features as they are (a clip of features is an error)."""
    rest = {k: v for k, v in given.items() if k != "clip"}
    if len(rest) == 1 and "geom" in (features := next(iter(rest.values()))).columns:
        if "clip" in given:
            raise ValueError("features can't be clipped by convert")
        return features.join(todo.select(*R.TILE).distinct(), R.TILE, "left_semi")
    return _through(todo, given, pyramid, zoom, lambda df: convert(df, scale_ratio, scale_offset, clip_to_output_dtype).withColumn("value", F.col("value").cast("double")), clip_pixelbuffer)


def _clip(todo, given, pyramid, zoom, clip_pixelbuffer=0):
    if "clip" not in given:
        raise ValueError("clip needs the input clip")
    return _through(todo, given, pyramid, zoom, lambda df: df, clip_pixelbuffer)


def _passthrough(todo, given, pyramid, zoom):
    return _through(todo, given, pyramid, zoom, lambda df: df)


def _contours(todo, given, pyramid, zoom, interval=100.0, base=0.0, field_name="elev", clip_pixelbuffer=0):
    """Contour lines. With ``clip`` those outside its features, cut at them (widened by ``clip_pixelbuffer`` pixels), of tiles that have one."""
    from gridloom.operators import overlay

    todo, given, features = _with_clip(todo, given)
    packed, _ = _given(todo, given)
    lines = contours(packed, pyramid, interval, base, field_name)
    if features is not None:
        areas = features.select(*R.TILE, "geom")
        if clip_pixelbuffer:
            areas = overlay.buffered(areas, clip_pixelbuffer * pyramid.pixel_size(zoom))
        lines = overlay.lines_cut(lines, overlay.united(areas, R.TILE), keep_inside=False)
    return lines.withColumn("properties", F.create_map(F.lit(field_name), F.col(field_name).cast("string"))).select(*R.TILE, "geom", "properties")


BUILT_IN = {"hillshade": _hillshade, "convert": _convert, "clip": _clip, "passthrough": _passthrough, "contours": _contours}
for _f in BUILT_IN.values():
    _f.plan = True


def processes() -> dict[str, str]:
    """Names of the built-in processes and the first line of what they do."""
    return {k: (inspect.getdoc(v) or "rows as they are").splitlines()[0] for k, v in PROCESSES.items()}
