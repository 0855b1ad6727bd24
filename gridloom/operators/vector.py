"""Features: reading by tile, filtering by type, parts, clipping, union by tile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import bounds as B
from gridloom.functions import geometry as G
from gridloom.functions.bounds import Bounds
from gridloom.functions.pyramid import Pyramid
from gridloom.functions.raster import PIXEL, pixel_centre
from gridloom.operators.tiles import KEYS, cells, meets


def boxed(features: DataFrame, geom: str = "geom") -> DataFrame:
    return features.withColumn("box", G.box(F.col(geom)))


def in_bounds(features: DataFrame, bounds: Bounds, geom: str = "geom", keep_empty: bool = True) -> DataFrame:
    """Features whose box meets ``bounds``; features without geometry are kept."""
    hit = B.intersect(G.box(F.col(geom)), B.literal(bounds))
    return features.where(hit | F.col(geom).isNull() if keep_empty else hit)


def exploded(features: DataFrame, geom: str = "geom") -> DataFrame:
    """A row for each part of each geometry."""
    return features.withColumn(geom, F.explode(G.singleparts(F.col(geom))))


def resolved(features: DataFrame, geom: str = "geom") -> DataFrame:
    """GeometryCollections as a row for each of their parts; all else as it is."""
    is_collection = F.col(f"{geom}.type") == "GeometryCollection"
    parts = F.when(is_collection, G.singleparts(F.col(geom))).otherwise(F.array(F.col(geom)))
    return features.withColumn(geom, F.explode(parts))


def of_type(features: DataFrame, name: str, geom: str = "geom", single: bool = True, multi: bool = True, allow_multi: bool = True) -> DataFrame:
    """Features of a type; GeometryCollections are resolved into their parts first, and without ``allow_multi`` all are."""
    whole = resolved(features, geom) if allow_multi else exploded(features, geom)
    return whole.where(G.is_type(F.col(geom), name, single, multi))


def not_empty(features: DataFrame, geom: str = "geom") -> DataFrame:
    return features.where(~G.is_empty(F.col(geom)))


def checked_types(features: DataFrame, allowed: list[str], geom: str = "geom") -> DataFrame:
    """Fails on a geometry of another type."""
    ok = F.col(geom).isNull() | F.col(f"{geom}.type").isin(allowed)
    return features.where(F.assert_true(ok, F.concat(F.lit("geometry type not allowed: "), F.coalesce(F.col(f"{geom}.type"), F.lit("none")))).isNull())


def reprojected(features: DataFrame, src: str, dst: str, geom: str = "geom", clip_to_crs: bool = True, segmentize: float | None = None, error_on_clip: bool = False) -> DataFrame:
    """Geometries in another projection: repaired, given points at least every ``segmentize`` units, cut to where the
    projection is used (in degrees), and what is left by formulas. With ``error_on_clip`` a cut fails the query."""
    if src == dst:
        return features
    degrees = Bounds(*G.crs_bounds(dst))
    box = B.literal(degrees)

    def within(g):
        own = lambda b: (b["left"] >= degrees.left) & (b["right"] <= degrees.right) & (b["bottom"] >= degrees.bottom) & (b["top"] <= degrees.top)
        outside = F.raise_error(F.lit("a geometry lies outside the bounds of the projection")) if error_on_clip else G.clipped(g, box)
        return G.let(G.box(g), lambda b: F.when(own(b), g).otherwise(outside))

    # Each step's geometry is bound once; as plain expressions they would be put into one another many times over.
    steps = [G.repaired]
    if segmentize:
        steps.append(lambda g: G.segmentized(g, segmentize))
    if src != "EPSG:4326":
        steps.append(lambda g: G.to_latlon(g, src))
    if clip_to_crs and dst != "EPSG:4326":
        steps.append(within)
    out = F.col(geom)
    for step in [*steps, lambda g: G.map_points(g, lambda x, y: G.reproject_xy(x, y, "EPSG:4326", dst))]:
        out = G.let(out, step)
    return features.withColumn(geom, F.when(F.col(geom).isNotNull(), out))


def read_tiles(features: DataFrame, pyramid: Pyramid, zoom: int, tiles: DataFrame | None = None, target_type: str | None = None, clip: bool = True, geom: str = "geom") -> DataFrame:
    """zoom, row, col and the features of each tile, cut to the tile's (buffered) bounds; what a cut parts is parts.

    Box filter by cells, repair, cut, type filter, empties left out: each is an expression of one stage,
    and with ``tiles`` one equi-join on the keys.
    """
    from gridloom.operators.overlay import parted

    df = not_empty(features, geom).withColumn(geom, G.repaired(F.col(geom)))
    df = cells(boxed(df, geom), pyramid, zoom)
    if tiles is not None:
        df = df.join(tiles.select(*KEYS), KEYS)
    tile = pyramid.box(zoom, F.col("row"), F.col("col"))
    if clip:
        inside = (F.col("box.left") >= tile["left"]) & (F.col("box.right") <= tile["right"]) & (F.col("box.bottom") >= tile["bottom"]) & (F.col("box.top") <= tile["top"])
        whole, rest = df.where(inside), df.where(~inside)
        df = whole.unionByName(parted(not_empty(rest.withColumn(geom, G.clipped(F.col(geom), tile)), geom), geom))
        df = not_empty(df, geom)
    else:
        df = df.where(meets(F.col(geom), tile))
    if target_type:
        df = of_type(df, target_type, geom)
    return df.drop("box")


def cell_union(features: DataFrame, pyramid: Pyramid, zoom: int, geom: str = "geom") -> DataFrame:
    """zoom, row, and the sorted columns of cells that any feature meets: a union of areas as a set of cells."""
    tiles = cells(boxed(features, geom), pyramid, zoom).where(meets(F.col(geom), pyramid.box(zoom, F.col("row"), F.col("col"))))
    return tiles.groupBy("zoom", "row").agg(F.array_sort(F.collect_set("col")).alias("cols"))


def mask(pixels: DataFrame, features: DataFrame, pyramid: Pyramid, zoom: int, invert: bool = False, x: str = "x", y: str = "y", keys: list[str] = PIXEL, all_touched: bool = False, buffer: float = 0.0, pixel: float = 0.0) -> DataFrame:
    """``pixels`` with ``masked``: true outside all features (inside with ``invert``), by the pixel's centre.

    ``buffer``: features reach that much further; ``all_touched``: a pixel (``pixel`` wide) that a feature meets counts as
    inside. Pixels meet the features of their cell in one join, and the hits come back as one aggregation by
    pixel: only a pixel's keys and centre are shuffled besides its own row.
    """
    p = pixels.select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y")).withColumns({"_row": pyramid.row_of(F.col("_y"), zoom), "_col": pyramid.col_of(F.col("_x"), zoom)})
    reach = buffer + (pixel / 2 if all_touched else 0.0)
    f = boxed(features.select(F.col("geom")))
    f = f.withColumn("box", B.column(F.col("box.left") - reach, F.col("box.bottom") - reach, F.col("box.right") + reach, F.col("box.top") + reach)) if reach else f
    f = cells(f, pyramid, zoom).select("geom", F.col("row").alias("_row"), F.col("col").alias("_col"))
    cx, cy, g = F.col("_x"), F.col("_y"), F.col("geom")
    hit = G.holds(g, cx, cy)
    if all_touched:
        hit = hit | meets(g, B.column(cx - pixel / 2, cy - pixel / 2, cx + pixel / 2, cy + pixel / 2))
    if buffer:
        hit = hit | (G.distance(g, cx, cy) <= buffer)
    hits = p.join(f, ["_row", "_col"]).where(hit).select(*keys).distinct().withColumn("_in", F.lit(True))
    inside = F.coalesce("_in", F.lit(False))
    return pixels.join(hits, keys, "left").withColumn("masked", inside if invert else ~inside).drop("_in")


def presence(features: DataFrame, pyramid: Pyramid, zoom: int, width: int, all_touched: bool = False, buffer: float = 0.0) -> DataFrame:
    """zoom, row, col, py, px of the pixels that features cover: rasterized by the cells that each feature reaches into."""
    step = pyramid.tile_span(zoom) / width
    reached = boxed(features.select("geom"))
    grown = B.column(F.col("box.left") - buffer, F.col("box.bottom") - buffer, F.col("box.right") + buffer, F.col("box.top") + buffer)
    df = cells(reached.withColumn("box", grown), pyramid, zoom)
    n = F.sequence(F.lit(0), F.lit(width - 1))
    df = df.withColumn("py", F.explode(n)).withColumn("px", F.explode(n))
    cx, cy = pixel_centre(pyramid, zoom, width)
    g = F.col("geom")
    hit = G.holds(g, cx, cy)
    if all_touched:
        hit = hit | meets(g, B.column(cx - step / 2, cy - step / 2, cx + step / 2, cy + step / 2))
    if buffer:
        hit = hit | (G.distance(g, cx, cy) <= buffer)
    return df.where(hit).select(*KEYS, "py", "px").distinct()


def length_stats(features: DataFrame, geom: str = "geom") -> list[Column]:
    return [G.area(F.col(geom)).alias("area"), G.length(F.col(geom)).alias("length")]
