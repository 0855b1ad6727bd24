"""Raster formulas as column expressions, and layouts.

Two layouts: packed, a row for each tile and band with ``pixels`` (row-major, NULL for no data), and long,
a row for each pixel: zoom, row, col, band, py, px, value. y runs down from the top edge.
"""

from __future__ import annotations

from collections.abc import Callable
from math import atan2, ceil, copysign, pi, radians

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.pyramid import Pyramid

TILE = ["zoom", "row", "col"]
PIXEL = [*TILE, "band", "py", "px"]
#: Ranges of the pixel types; Spark has no unsigned ones, so values are clipped to these.
RANGES = {"uint8": (0, 255), "int8": (-128, 127), "uint16": (0, 65535), "int16": (-32768, 32767), "uint32": (0, 4294967295), "int32": (-2147483648, 2147483647)}
SPARK_TYPE = {"uint8": "smallint", "int8": "tinyint", "uint16": "int", "int16": "smallint", "uint32": "bigint", "int32": "int", "float32": "float", "float64": "double"}
RESAMPLINGS = ("nearest", "bilinear", "cubic", "average", "mode", "min", "max", "sum", "first", "last", "q1", "med", "q3", "rms")


def to_long(packed: DataFrame, pixels: str = "pixels", width: str = "width") -> DataFrame:
    """A row for each pixel, also those without data."""
    keep = [c for c in packed.columns if c not in (pixels, width, "height")]
    df = packed.select(*keep, F.col(width).alias("_w"), F.posexplode(pixels).alias("_i", "value"))
    return df.withColumn("py", F.expr("_i DIV _w").cast("int")).withColumn("px", F.expr("_i % _w").cast("int")).drop("_i", "_w")


def to_packed(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """A row for each tile and band; pixels that are missing are NULL."""
    cells = F.collect_list(F.struct((F.col("py") * width + F.col("px")).alias("i"), F.col("value").alias("v")))
    df = pixels.groupBy(*TILE, "band").agg(F.array(F.map_from_entries(F.array_distinct(cells))).alias("m"))
    # The map is a lambda's argument, so it is made once for a tile and not again for each pixel.
    filled = F.transform("m", lambda m: F.transform(F.sequence(F.lit(0), F.lit(height * width - 1)), lambda i: F.try_element_at(m, i)))[0]
    return df.select(*TILE, "band", F.lit(height).alias("height"), F.lit(width).alias("width"), filled.alias("pixels"))


def masked(value: Column, nodata: float | None) -> Column:
    """NULL where the value is the declared no-data value."""
    return value if nodata is None else F.nullif(value, F.lit(nodata).cast("double"))


def clipped_to(value: Column, dtype: str) -> Column:
    """In the range of a pixel type, truncated to whole numbers for whole types."""
    if dtype in RANGES:
        low, high = RANGES[dtype]
        value = F.greatest(F.least(value, F.lit(float(high))), F.lit(float(low)))
    return value.cast(SPARK_TYPE[dtype])


def scaled(value: Column, ratio: float = 1.0, offset: float = 0.0, dtype: str | None = None) -> Column:
    """The offset is added before the ratio is applied."""
    out = (value + F.lit(float(offset))) * F.lit(float(ratio))
    return clipped_to(out, dtype) if dtype else out


def no_data(pixels: Column) -> Column:
    return ~F.exists(pixels, lambda v: v.isNotNull())


def band(bands: Column, index: int) -> Column:
    """Bands count from 1."""
    return F.element_at(bands, index)


# Focal operations: all eight neighbours from two passes of windows, with edges repeated.

def neighbourhood(pixels: DataFrame, keys: list[str], value: str = "value", inner: bool = False) -> DataFrame:
    """``pixels`` with w0..w8, the 3 x 3 values row by row; beyond an edge the edge's value stands, or with ``inner`` the whole
    neighbourhood of the inner pixel beside it.

    Two windows, by rows and then by columns of the same tile: one shuffle, as both have the tile's keys
    among theirs and the tile is what rows are dealt by.
    """
    df = pixels.repartition(*keys)
    own = F.col(value)
    # Structs, so that a NULL neighbour is told from no neighbour.
    df = _three(df, [*keys, "py"], "px", F.struct(own.alias("v")), "_row", inner)
    df = df.withColumn("_row", F.struct(F.col("_row.a.v").alias("a"), F.col("_row.b.v").alias("b"), F.col("_row.c.v").alias("c")))
    df = _three(df, [*keys, "px"], "py", F.col("_row"), "_all", inner)
    return df.withColumns({f"w{i}": F.col(f"_all.{s}.{k}") for i, (s, k) in enumerate((s, k) for s in "abc" for k in "abc")}).drop("_row", "_all")


def _three(df: DataFrame, keys: list[str], order: str, value: Column, name: str, inner: bool) -> DataFrame:
    """``name``: the value before, here and after in the order; at an end as `neighbourhood` says."""
    by = Window.partitionBy(*keys).orderBy(order)
    at = lambda k: F.lag(value, k).over(by) if k > 0 else F.lead(value, -k).over(by)
    before, after = at(1), at(-1)
    usual = F.struct(F.coalesce(before, value).alias("a"), value.alias("b"), F.coalesce(after, value).alias("c"))
    if inner:
        # At the first place what the second sees, at the last what the one before it sees.
        first = F.struct(value.alias("a"), after.alias("b"), F.coalesce(at(-2), after).alias("c"))
        last = F.struct(F.coalesce(at(2), before).alias("a"), before.alias("b"), value.alias("c"))
        usual = F.when(before.isNull() & after.isNotNull(), first).when(after.isNull() & before.isNotNull(), last).otherwise(usual)
    return df.withColumn(name, usual)


def gradient(w: list[Column], xres: float, yres: float, scale: float = 1.0, z: float = 1.0) -> tuple[Column, Column]:
    """Horn's differences; yres is negative, as rows run down."""
    w = [x * F.lit(float(z)) for x in w]
    x = ((w[0] + 2 * w[3] + w[6]) - (w[2] + 2 * w[5] + w[8])) / F.lit(8.0 * xres * scale)
    y = ((w[6] + 2 * w[7] + w[8]) - (w[0] + 2 * w[1] + w[2])) / F.lit(8.0 * yres * scale)
    return x, y


def slope_aspect(w: list[Column], xres: float, yres: float, scale: float = 1.0, z: float = 1.0) -> tuple[Column, Column]:
    """Flat pixels have the aspect of zeros with the resolutions' signs, which Spark's atan2 drops."""
    x, y = gradient(w, xres, yres, scale, z)
    flat = atan2(copysign(0.0, xres * scale), copysign(0.0, yres * scale))
    return F.lit(pi / 2) - F.atan(F.sqrt(x * x + y * y)), F.when((x == 0) & (y == 0), F.lit(flat)).otherwise(F.atan2(x, y))


def shade(slope: Column, aspect: Column, azimuth: float = 315.0, altitude: float = 45.0) -> Column:
    """1 to 255, whole."""
    alt = radians(altitude)
    v = F.lit(0.0) + F.sin(F.lit(alt)) * F.sin(slope) + F.cos(F.lit(alt)) * F.cos(slope) * F.cos(F.lit(radians(azimuth - 90.0)) - aspect)
    return F.greatest(F.least(F.lit(255.0) * v, F.lit(255.0)), F.lit(1.0)).cast("int")


def hillshade(pixels: DataFrame, xres: float = 1.0, yres: float = -1.0, azimuth: float = 315.0, altitude: float = 45.0, z: float = 1.0, scale: float = 1.0, keys: list[str] | None = None) -> DataFrame:
    """``pixels`` with ``shade``; the border has the shade of the inner pixel beside it, no data stays no data and beside it a pixel's own value stands."""
    keys = keys or [*TILE, "band"]
    df = neighbourhood(pixels, keys, inner=True)
    slope, aspect = slope_aspect([F.coalesce(f"w{i}", "w4", "value") for i in range(9)], xres, yres, scale, z)
    df = df.withColumn("shade", F.when(F.col("value").isNotNull(), shade(slope, aspect, azimuth, altitude)))
    return df.drop(*[f"w{i}" for i in range(9)])


def halo(pixels: DataFrame, pyramid: Pyramid, zoom: int, size: int, width: int) -> DataFrame:
    """``pixels`` and copies of those within ``size`` of a neighbour tile's edge, as that tile sees them.

    Offsets are exploded in place (no join): positions run from -size to width + size - 1. Columns wrap on a
    global grid; rows end at the poles.
    """
    near = lambda c: F.array_compact(F.array(F.lit(0), F.when(F.col(c) < size, F.lit(-1)), F.when(F.col(c) >= width - size, F.lit(1))))
    df = pixels.withColumn("_dr", F.explode(near("py"))).withColumn("_dc", F.explode(near("px")))
    w, h = pyramid.matrix_width(zoom), pyramid.matrix_height(zoom)
    col = F.pmod(F.col("col") + F.col("_dc"), F.lit(w)) if pyramid.grid.is_global else F.col("col") + F.col("_dc")
    df = df.withColumns({"row": F.col("row") + F.col("_dr"), "col": col, "py": F.col("py") - F.col("_dr") * width, "px": F.col("px") - F.col("_dc") * width}).drop("_dr", "_dc")
    return df.where((F.col("row") >= 0) & (F.col("row") < h) & (F.col("col") >= 0) & (F.col("col") < w))


def without_halo(pixels: DataFrame, width: int) -> DataFrame:
    return pixels.where((F.col("py") >= 0) & (F.col("py") < width) & (F.col("px") >= 0) & (F.col("px") < width))


# Resampling

def aggregate(method: str, value: Column, order: list[Column] | None = None) -> Column:
    """How the values that fall in one pixel become one. Ties of ``mode`` give the smallest; ``nearest`` is the first by ``order``."""
    at = F.struct(*order) if order else None
    valid = value.isNotNull()
    if method in ("nearest", "first"):
        return F.min_by(value, F.when(valid, at)) if at is not None else F.first(value, ignorenulls=True)
    if method == "last":
        return F.max_by(value, F.when(valid, at)) if at is not None else F.last(value, ignorenulls=True)
    if method == "mode":
        return F.mode(value, True)
    plain = {"average": F.avg, "bilinear": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "med": F.median}
    if method in plain:
        return plain[method](value)
    if method in ("q1", "q3"):
        return F.percentile(value, 0.25 if method == "q1" else 0.75)
    if method == "rms":
        return F.sqrt(F.avg(value * value))
    raise ValueError(f"unknown resampling {method!r}")


def overview(pixels: DataFrame, width: int, method: str = "nearest") -> DataFrame:
    """The next lower zoom: each 2 x 2 pixels become one pixel of the parent tile. One shuffle, partial sums before it."""
    py, px = F.col("row") % 2 * width + F.col("py"), F.col("col") % 2 * width + F.col("px")
    keys = [(F.col("zoom") - 1).alias("zoom"), F.expr("row DIV 2").cast("int").alias("row"), F.expr("col DIV 2").cast("int").alias("col"), "band", F.floor(py / 2).cast("int").alias("py"), F.floor(px / 2).cast("int").alias("px")]
    return pixels.where("zoom > 0").groupBy(*keys).agg(aggregate(method, F.col("value"), [py, px]).alias("value"))


def coarser(pixels: DataFrame, pyramid: Pyramid, zoom: int, width: int, method: str) -> DataFrame:
    """The next lower zoom by a kernel twice as wide: bilinear weighs 4 x 4 pixels, cubic 8 x 8, also of neighbour tiles.

    Each pixel is dealt to the coarser ones it has a weight in, by its place in the whole matrix, and weights
    are added up: one shuffle, partial sums before it. Pixels without data leave their weight to the others.
    Only tiles with a child are made.
    """
    reach = {"bilinear": 1, "cubic": 2}[method]
    df = pixels.where((F.col("zoom") == zoom) & F.col("value").isNotNull())
    y, x = (F.col("row") * width + F.col("py")).alias("_y"), (F.col("col") * width + F.col("px")).alias("_x")
    df = df.select("band", "value", y, x)
    n = F.sequence(F.lit(-reach), F.lit(reach))
    df = df.withColumn("_ty", F.explode(F.transform(n, lambda i: F.floor(F.col("_y") / 2).cast("int") + i))).withColumn("_tx", F.explode(F.transform(n, lambda i: F.floor(F.col("_x") / 2).cast("int") + i)))
    far = lambda at, to: F.abs((F.col(at) + 0.5) / 2 - (F.col(to) + 0.5))
    df = df.withColumn("_k", kernel(far("_y", "_ty"), method) * kernel(far("_x", "_tx"), method)).where("_k <> 0")
    h, w = pyramid.matrix_height(zoom - 1) * width, pyramid.matrix_width(zoom - 1) * width
    df = df.where((F.col("_ty") >= 0) & (F.col("_ty") < h))
    df = df.withColumn("_tx", F.pmod(F.col("_tx"), F.lit(w))) if pyramid.grid.is_global else df.where((F.col("_tx") >= 0) & (F.col("_tx") < w))
    cell = lambda v, name: [F.expr(f"CAST({v} DIV {width} AS INT)").alias(name), F.expr(f"CAST({v} % {width} AS INT)").alias("p" + v[-1])]
    (row, py), (col, px) = cell("_ty", "row"), cell("_tx", "col")
    out = df.groupBy(F.lit(zoom - 1).alias("zoom"), row, col, "band", py, px).agg((F.sum(F.col("value") * F.col("_k")) / F.nullif(F.sum("_k"), F.lit(0.0))).alias("value"))
    own = pixels.where(F.col("zoom") == zoom).select((F.col("zoom") - 1).alias("zoom"), F.expr("row DIV 2").cast("int").alias("row"), F.expr("col DIV 2").cast("int").alias("col")).distinct()
    return out.join(own, TILE, "left_semi")


def kernel(d: Column, method: str) -> Column:
    """The weight at a distance: a tent for bilinear, Keys's cubic with a = -1/2."""
    if method == "bilinear":
        return F.greatest(F.lit(0.0), 1 - d)
    a = -0.5
    return F.when(d < 1, (a + 2) * d * d * d - (a + 3) * d * d + 1).when(d < 2, a * d * d * d - 5 * a * d * d + 8 * a * d - 4 * a).otherwise(F.lit(0.0))


def overviews(pixels: DataFrame, width: int, top: int, bottom: int, method: str = "nearest", cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """All lower zooms down to ``bottom``, each from the one above. ``cut`` stores a level and reads it again, so that it is made once, not once for each level below it."""
    level, out = pixels, None
    for _ in range(top, bottom, -1):
        level = cut(overview(level, width, method))
        out = level if out is None else out.unionByName(level)
    return out


def underview(pixels: DataFrame, width: int) -> DataFrame:
    """The next higher zoom: each pixel becomes 2 x 2 pixels of a child tile."""
    both = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    df = pixels.withColumn("_o", F.explode(both))
    py, px = F.col("row") * 2 * width + F.col("py") * 2 + F.col("_o.i"), F.col("col") * 2 * width + F.col("px") * 2 + F.col("_o.j")
    df = df.withColumns({"_y": py, "_x": px, "zoom": F.col("zoom") + 1})
    return df.withColumns({"row": F.expr(f"_y DIV {width}").cast("int"), "col": F.expr(f"_x DIV {width}").cast("int"), "py": F.expr(f"_y % {width}").cast("int"), "px": F.expr(f"_x % {width}").cast("int")}).drop("_o", "_x", "_y")


def mosaic(pixels: DataFrame, order: str = "ord", value: str = "value") -> DataFrame:
    """Of several values of a pixel the last by ``order`` that isn't NULL; NULL if all are."""
    return pixels.groupBy(*PIXEL).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("value"))


def resample(pixels: DataFrame, pyramid: Pyramid, zoom: int, target: int, width: int, method: str = "nearest") -> DataFrame:
    """To another zoom of the same pyramid, by index arithmetic: no join."""
    step = target - zoom
    df = pixels.where(F.col("zoom") == zoom)
    if step > 0:
        return finer(df, pyramid, zoom, 2**step, width, method)
    if step < 0:
        k = 2**-step
        y, x = F.col("row") * width + F.col("py"), F.col("col") * width + F.col("px")
        df = df.withColumns({"_y": y, "_x": x})
        keys = [F.lit(target).alias("zoom"), F.expr(f"_y DIV {k * width}").cast("int").alias("row"), F.expr(f"_x DIV {k * width}").cast("int").alias("col"), "band", F.expr(f"_y DIV {k} % {width}").cast("int").alias("py"), F.expr(f"_x DIV {k} % {width}").cast("int").alias("px")]
        df = df.groupBy(*keys).agg(aggregate(method, F.col("value"), [F.col("_y"), F.col("_x")]).alias("value"))
    return df


#: Names that give a finer pixel the value of the one pixel it lies in.
REPEATED = ("nearest", "first", "last", "mode", "average", "min", "max", "med", "q1", "q3")


def finer(pixels: DataFrame, pyramid: Pyramid, zoom: int, factor: int, width: int, method: str = "nearest") -> DataFrame:
    """``factor`` (a power of 2) times finer tiles of pixels at ``zoom``; bilinear and cubic see the neighbour tiles' edges."""
    if method in REPEATED:
        for _ in range(factor.bit_length() - 1):
            pixels = underview(pixels, width)
        return pixels
    if method not in ("bilinear", "cubic"):
        raise ValueError(f"resampling {method!r} isn't there for finer pixels")
    own = pixels.select(*TILE).distinct()
    near = halo(pixels.select(*PIXEL, "value"), pyramid, zoom, 1 if method == "bilinear" else 2, width)
    df = interpolate(near, width, factor, method).join(own, TILE, "left_semi")
    at = lambda tile, p: (F.col(tile) * factor + F.expr(f"{p} DIV {width}")).cast("int")
    return df.select((F.col("zoom") + factor.bit_length() - 1).cast("int").alias("zoom"), at("row", "py").alias("row"), at("col", "px").alias("col"), "band", F.expr(f"CAST(py % {width} AS INT)").alias("py"), F.expr(f"CAST(px % {width} AS INT)").alias("px"), "value")


def interpolate(pixels: DataFrame, width: int, factor: int, method: str = "bilinear") -> DataFrame:
    """``factor`` times finer pixels by bilinear or cubic weights of 4 or 16 neighbours, as a weighted explode and one sum.

    Neighbours without data give their weight to the others. Tiles are taken alone; give them a halo first.
    """
    reach = {"bilinear": 1, "cubic": 2}[method]
    source = pixels.where(F.col("value").isNotNull())
    offsets = F.sequence(F.lit(-reach * factor), F.lit((reach + 1) * factor - 1))
    df = source.withColumn("_y", F.explode(offsets)).withColumn("_x", F.explode(offsets))

    def weight(o: Column) -> Column:
        return kernel(F.abs((o + 0.5) / factor - 0.5), method)

    df = df.withColumn("_k", weight(F.col("_y")) * weight(F.col("_x"))).where(F.col("_k") != 0)
    df = df.withColumns({"py": F.col("py") * factor + F.col("_y"), "px": F.col("px") * factor + F.col("_x")}).where((F.col("py") >= 0) & (F.col("py") < width * factor) & (F.col("px") >= 0) & (F.col("px") < width * factor))
    return df.groupBy(*PIXEL).agg((F.sum(F.col("value") * F.col("_k")) / F.sum("_k")).alias("value"))


def window(pixels: DataFrame, height: int, width: int, top: int, left: int) -> DataFrame:
    """The pixels of a window, counted from its corner."""
    df = pixels.where((F.col("py") >= top) & (F.col("py") < top + height) & (F.col("px") >= left) & (F.col("px") < left + width))
    return df.withColumns({"py": F.col("py") - top, "px": F.col("px") - left})


def within(pixels: DataFrame, affine, bounds) -> DataFrame:
    """The pixels of a raster within a box, counted from its corner."""
    from gridloom.functions.bounds import pixel_ranges

    top, bottom, left, right = pixel_ranges(bounds, affine)
    return window(pixels, bottom - top, right - left, top, left)


def pixel_centre(pyramid: Pyramid, zoom: int, width: int) -> tuple[Column, Column]:
    """x, y of a pixel's centre."""
    span = pyramid.tile_span(zoom)
    px = F.lit(span / width)
    return F.lit(pyramid.grid.left) + F.col("col") * F.lit(span) + (F.col("px") + 0.5) * px, F.lit(pyramid.grid.top) - F.col("row") * F.lit(span) - (F.col("py") + 0.5) * px


def warp(pixels: DataFrame, src: Pyramid, dst: Pyramid, zoom: int, dst_zoom: int, width: int, dst_width: int | None = None, method: str = "nearest", tiles: DataFrame | None = None) -> DataFrame:
    """Pixels of ``dst``'s zoom from those of ``src``'s, between all projections that have formulas.

    nearest, bilinear and cubic look back from the centre of each wanted pixel: the source pixels around it are an
    equi-join on their place in the matrix, their weights one sum. The other methods deal each source pixel to
    the wanted pixel that its centre falls in and aggregate, without a join. ``tiles``: the wanted tiles; by
    default all that the source tiles' boxes reach.
    """
    from gridloom.functions import geometry as G

    dst_width = dst_width or width
    crs = src.grid.crs, dst.grid.crs
    df = pixels.where(F.col("zoom") == zoom)
    if method not in ("nearest", "bilinear", "cubic"):
        x, y = pixel_centre(src, zoom, width)
        x, y = G.reproject_xy(x, y, *crs)
        size = dst.pixel_size(dst_zoom)
        df = df.select("band", "value", "py", "px", F.floor((F.lit(dst.grid.top) - y) / size).alias("_y"), F.floor((x - F.lit(dst.grid.left)) / size).alias("_x"))
        h, w = dst.matrix_height(dst_zoom) * dst_width, dst.matrix_width(dst_zoom) * dst_width
        df = df.where((F.col("_y") >= 0) & (F.col("_y") < h) & (F.col("_x") >= 0) & (F.col("_x") < w))
        keys = [F.lit(dst_zoom).alias("zoom"), *[F.expr(f"CAST({a} {op} {dst_width} AS INT)").alias(n) for a, op, n in (("_y", "DIV", "row"), ("_x", "DIV", "col"))], "band", *[F.expr(f"CAST({a} % {dst_width} AS INT)").alias(n) for a, n in (("_y", "py"), ("_x", "px"))]]
        out = df.groupBy(*keys).agg(aggregate(method, F.col("value"), [F.col("py"), F.col("px")]).alias("value"))
        return out if tiles is None else out.join(tiles.where(F.col("zoom") == dst_zoom).select(*TILE), TILE, "left_semi")
    tiles = reached_tiles(df, src, dst, zoom, dst_zoom) if tiles is None else tiles.where(F.col("zoom") == dst_zoom).select(*TILE)
    n = F.sequence(F.lit(0), F.lit(dst_width - 1))
    want = tiles.withColumn("py", F.explode(n)).withColumn("px", F.explode(n))
    x, y = G.reproject_xy(*pixel_centre(dst, dst_zoom, dst_width), crs[1], crs[0])
    size = src.tile_span(zoom) / width
    # Places in pixels; whole numbers are pixel centres.
    want = want.withColumns({"_fy": (F.lit(src.grid.top) - y) / size - 0.5, "_fx": (x - F.lit(src.grid.left)) / size - 0.5})
    own = df.select((F.col("row") * width + F.col("py")).cast("long").alias("_sy"), (F.col("col") * width + F.col("px")).cast("long").alias("_sx"), "band", "value")
    return looked_up(want, own, PIXEL, method, src.matrix_width(zoom) * width if src.grid.is_global else None)


def looked_up(want: DataFrame, own: DataFrame, keys: list[str], method: str, wrap: int | None = None, more: list[str] | None = None) -> DataFrame:
    """``keys`` and value of wanted pixels (with _fy, _fx, their place in source pixels) from source pixels (_sy, _sx, band, value): the
    nearest, or a weighted mean of those around; an equi-join on the place (and the columns ``more``)."""
    more = more or []
    if method == "nearest":
        want = want.withColumns({"_sy": F.floor(F.col("_fy") + 0.5), "_sx": F.floor(F.col("_fx") + 0.5)})
    else:
        reach = {"bilinear": 1, "cubic": 2}[method]
        around = F.sequence(F.lit(1 - reach), F.lit(reach))
        want = want.withColumn("_sy", F.explode(F.transform(around, lambda i: F.floor(F.col("_fy")) + i))).withColumn("_sx", F.explode(F.transform(around, lambda i: F.floor(F.col("_fx")) + i)))
        want = want.withColumn("_k", kernel(F.abs(F.col("_sy") - F.col("_fy")), method) * kernel(F.abs(F.col("_sx") - F.col("_fx")), method)).where("_k <> 0")
    if wrap:
        want = want.withColumn("_sx", F.pmod(F.col("_sx"), F.lit(wrap)))
    met = want.join(own, ["_sy", "_sx", *more])
    if method == "nearest":
        return met.select(*keys, "value")
    return met.where("value IS NOT NULL").groupBy(*keys).agg((F.sum(F.col("value") * F.col("_k")) / F.nullif(F.sum("_k"), F.lit(0.0))).alias("value"))


def reached_tiles(pixels: DataFrame, src: Pyramid, dst: Pyramid, zoom: int, dst_zoom: int) -> DataFrame:
    """Tiles of ``dst`` within the box of each source tile's outline, reprojected."""
    from gridloom.operators.tiles import cells

    own = pixels.select("row", "col").distinct()
    boxes = own.select(reprojected_box(src.box(zoom, F.col("row"), F.col("col")), src.grid.crs, dst).alias("box"))
    return cells(boxes, dst, dst_zoom).select(*TILE).distinct()


def reprojected_box(box: Column, crs: str, dst: Pyramid, steps: int = 8) -> Column:
    """The box in ``dst``'s projection of ``steps`` places a side of a box, held within where that projection is used."""
    from gridloom.functions import bounds as B
    from gridloom.functions import geometry as G

    at = F.sequence(F.lit(0), F.lit(steps))
    degrees = G.crs_bounds(dst.grid.crs)

    def place(i: Column, j: Column) -> Column:
        x, y = box["left"] + (box["right"] - box["left"]) * i / steps, box["bottom"] + (box["top"] - box["bottom"]) * j / steps
        lon, lat = G.reproject_xy(x, y, crs, "EPSG:4326")
        lat = F.greatest(F.lit(degrees[1]), F.least(F.lit(degrees[3]), lat))
        lon = lon if dst.grid.is_global else F.greatest(F.lit(degrees[0]), F.least(F.lit(degrees[2]), lon))
        x, y = G.reproject_xy(lon, lat, "EPSG:4326", dst.grid.crs)
        return F.struct(x.alias("x"), y.alias("y"))

    places = F.flatten(F.transform(at, lambda i: F.transform(at, lambda j: place(i, j))))
    edge = lambda f, name: f(F.transform(places, lambda p: p[name]))
    return B.column(edge(F.array_min, "x"), edge(F.array_min, "y"), edge(F.array_max, "x"), edge(F.array_max, "y"))


# Contours

def contour_values(low: float, high: float, interval: float, base: float = 0.0) -> list[float]:
    """base, base + interval, ... within low and high."""
    first = base + ceil((low - base) / interval) * interval
    out, k = [], 0
    while first + k * interval <= high:
        out.append(first + k * interval)
        k += 1
    return out


def contour_levels(low: Column, high: Column, interval: float, base: float = 0.0) -> Column:
    first, last = F.ceil((low - base) / interval), F.floor((high - base) / interval)
    return F.when(first <= last, F.transform(F.sequence(first, last), lambda i: F.lit(float(base)) + i * F.lit(float(interval)))).otherwise(F.array().cast("array<double>"))


# Images

def rgba(bands: Column, n: int) -> Column:
    """One or two bands become gray and alpha, three colour and alpha, four stay. NULL pixels are transparent."""
    b = [F.element_at(bands, i + 1) for i in range(n)]
    clear = F.lit(0)
    seen = b[0].isNotNull()
    alpha = F.when(seen, 255).otherwise(clear)
    full = [F.coalesce(x, clear) for x in b]
    if n == 1:
        return F.array(full[0], full[0], full[0], alpha)
    if n == 2:
        return F.array(full[0], full[0], full[0], full[1])
    if n == 3:
        return F.array(*full, alpha)
    if n == 4:
        return F.array(*full)
    raise ValueError("1 to 4 bands")


def shade_alpha(value: Column, four: bool = False) -> Column:
    """Black whose alpha is 255 less the shade: gray and alpha, or with ``four`` colour and alpha."""
    alpha = F.when(value.isNull(), 0).otherwise(F.lit(255) - value)
    return F.array(*[F.lit(0)] * (3 if four else 1), alpha)


def shift_required(tiles: DataFrame, pyramid: Pyramid, zoom: int) -> DataFrame:
    """A row with ``shift``: whether tiles on both sides of the antimeridian are nearer over it than across the map.

    Columns are grouped where they follow each other; the groups at both ends of the matrix are compared. At
    most the matrix's width of distinct columns is windowed.
    """
    from pyspark.sql import Window as W

    cols = tiles.where(F.col("zoom") == zoom).select("col").distinct()
    order = W.orderBy("col")
    grouped = cols.withColumn("g", F.sum(F.coalesce((F.col("col") - F.lag("col").over(order) > 1).cast("int"), F.lit(0))).over(order))
    spans = grouped.groupBy("g").agg(F.min("col").alias("a"), F.max("col").alias("b"))
    w = pyramid.matrix_width(zoom)
    one = spans.agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("first"), F.max("b").alias("last"), F.min_by("b", "g").alias("inner_left"), F.max_by("a", "g").alias("inner_right"))
    edges = (F.col("first") == 0) & (F.col("last") == w - 1)
    normal = F.col("inner_right") - F.col("inner_left")
    across = F.col("inner_left") + w - F.col("inner_right")
    return one.select(F.coalesce((F.col("n") > 1) & edges & (across < normal), F.lit(False)).alias("shift"))
