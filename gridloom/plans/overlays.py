"""Registered queries of polygon overlay and of windows of large files. Overlay runs over boxes derived from `supplier` and `customer`.

A box of whole numbers (u, v) is sheared by x = u + v / 2, y = v - u / 4, so that edges are slanted and yet all
coordinates are exact; areas grow by the determinant, 1.125, which is how SQL knows them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import geometry as G
from gridloom.operators import overlay, vector
from gridloom.plans.catalogue import _SHADED, FITTED, GEO, PIX, SPAN, WIDTH, Z, _config, _run, fitting_zoom, packed, read, register

#: Of the tables' keys: left, bottom, width, height in whole numbers.
_BOX = "CAST({k} * 37 % 190 - 95 AS DOUBLE) AS u, CAST({k} * 53 % 90 - 45 AS DOUBLE) AS v, CAST(1 + {k} % 5 AS DOUBLE) AS w, CAST(1 + {k} % 4 AS DOUBLE) AS h"
_TWO = f"s AS (SELECT s_suppkey, {_BOX.format(k='s_suppkey')} FROM supplier), c AS (SELECT c_custkey, c_nationkey, {_BOX.format(k='c_custkey')} FROM customer)"
_CELLS = "SELECT {what}, u + i AS x, v + j AS y FROM {of}, range(5) a(i), range(4) b(j) WHERE i < w AND j < h"


def _ring(*corners: tuple[Column, Column]) -> Column:
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in corners])


def _shape(kind: str, *rings: Column) -> Column:
    parts = F.array(*[F.lit(i if kind.startswith("Multi") else 0) for i in range(len(rings))])
    return F.struct(F.lit(kind).alias("type"), F.array(*rings).alias("rings"), parts.alias("part"))


def _boxes(spark: SparkSession, sf: str, name: str, key: str) -> DataFrame:
    df = read(spark, sf, name)
    k = F.col(key)
    return df.withColumns({"u": (k * 37 % 190 - 95).cast("double"), "v": (k * 53 % 90 - 45).cast("double"), "w": (1 + k % 5).cast("double"), "h": (1 + k % 4).cast("double")})


def _slanted() -> Column:
    u, v, w, h = (F.col(c) for c in "uvwh")
    at = lambda x, y: (x + y / 2, y - x / 4)
    return _shape("Polygon", _ring(at(u, v), at(u + w, v), at(u + w, v + h), at(u, v + h), at(u, v)))


def suppliers(spark: SparkSession, sf: str) -> DataFrame:
    df = _boxes(spark, sf, "supplier", "s_suppkey")
    return df.select("s_suppkey", _slanted().alias("geom"))


def customers(spark: SparkSession, sf: str) -> DataFrame:
    df = _boxes(spark, sf, "customer", "c_custkey")
    return df.select("c_custkey", "c_nationkey", _slanted().alias("geom"))


def _area() -> Column:
    return F.round(F.sum(G.area(F.col("geom"))), 6).alias("area")


@register("polygon_intersection", f"WITH {_TWO}, p AS (SELECT s_suppkey, (least(s.u + s.w, c.u + c.w) - greatest(s.u, c.u)) AS x, (least(s.v + s.h, c.v + c.h) - greatest(s.v, c.v)) AS y FROM s, c) SELECT s_suppkey, count(*) AS n, round(sum(x * y) * 1.125e0, 6) AS area FROM p WHERE x > 0 AND y > 0 GROUP BY s_suppkey")
def _(spark, sf):
    found = overlay.intersection_sums(suppliers(spark, sf), customers(spark, sf), GEO, 4, ["s_suppkey"])
    return found.select("s_suppkey", "n", F.round("area", 6).alias("area"))


@register("polygon_difference", f"WITH {_TWO}, x AS ({_CELLS.format(what='s_suppkey', of='s')}), y AS (SELECT DISTINCT x, y FROM ({_CELLS.format(what='c_custkey', of='c')})) SELECT s_suppkey, round(count(*) * 1.125e0, 6) AS area FROM x ANTI JOIN y ON x.x = y.x AND x.y = y.y GROUP BY s_suppkey")
def _(spark, sf):
    return overlay.differences(suppliers(spark, sf), customers(spark, sf), GEO, 4, ["s_suppkey"]).groupBy("s_suppkey").agg(_area())


@register("polygon_union", f"WITH {_TWO} SELECT c_nationkey, round(count(*) * 1.125e0, 6) AS area FROM (SELECT DISTINCT * FROM ({_CELLS.format(what='c_nationkey', of='c')})) GROUP BY c_nationkey")
def _(spark, sf):
    return overlay.dissolved(customers(spark, sf), GEO, 4, ["c_nationkey"]).groupBy("c_nationkey").agg(_area())


@register("polygon_repair", f"WITH {_TWO} SELECT s_suppkey, CAST(2 AS BIGINT) AS parts, round(w * h / 2, 6) AS area FROM s")
def _(spark, sf):
    """Bow ties over the boxes' corners: two triangles each."""
    u, v, w, h = (F.col(c) for c in "uvwh")
    tie = _shape("Polygon", _ring((u, v), (u + w, v + h), (u + w, v), (u, v + h), (u, v)))
    found = overlay.repaired(_boxes(spark, sf, "supplier", "s_suppkey").select("s_suppkey", tie.alias("geom")))
    return found.select("s_suppkey", F.size(F.array_distinct("geom.part")).cast("long").alias("parts"), F.round(G.area(F.col("geom")), 6).alias("area"))


_ROUND = "16e0 * sin(0.19634954084936207e0)"


@register("polygon_buffer", f"WITH {_TWO} SELECT s_suppkey, 'Polygon' AS kind, round(w * h + w + h + {_ROUND} / 4, 4) AS area FROM s UNION ALL SELECT s_suppkey, 'LineString', round(w + {_ROUND} / 4, 4) FROM s UNION ALL SELECT s_suppkey, 'Point', round({_ROUND} / 4, 4) FROM s")
def _(spark, sf):
    """Boxes, their lower sides and corners, widened by a half; circles have 32 corners."""
    u, v, w, h = (F.col(c) for c in "uvwh")
    shapes = [_shape("Polygon", _ring((u, v), (u + w, v), (u + w, v + h), (u, v + h), (u, v))), _shape("LineString", _ring((u, v), (u + w, v))), _shape("Point", _ring((u, v)))]
    df = _boxes(spark, sf, "supplier", "s_suppkey").select("s_suppkey", F.explode(F.array(*shapes)).alias("geom")).withColumn("kind", F.col("geom.type"))
    return overlay.buffered(df, 0.5).select("s_suppkey", "kind", F.round(G.area(F.col("geom")), 4).alias("area"))


@register("multiline_clip", f"WITH {_TWO}, l AS (SELECT s_suppkey, u, v + 0.3e0 AS y FROM s UNION ALL SELECT s_suppkey, u, v - 0.1e0 FROM s), t AS (SELECT s_suppkey, CAST(floor((90e0 - y) / 5.625e0) AS INT) AS row, col, least(u + 20, (col + 1) * 5.625e0 - 180) - greatest(u, col * 5.625e0 - 180) AS n FROM l, (SELECT CAST(range AS INT) AS col FROM range(64))) SELECT row, col, count(*) AS parts, round(sum(n), 6) AS length FROM t WHERE n > 0 GROUP BY row, col")
def _(spark, sf):
    """Two lines a feature, each cut in several by the tiles; every piece is a part of its own."""
    u, y = F.col("u"), F.col("v")
    lines = _shape("MultiLineString", _ring((u, y + 0.3), (u + 20, y + 0.3)), _ring((u, y - 0.1), (u + 20, y - 0.1)))
    found = vector.read_tiles(_boxes(spark, sf, "supplier", "s_suppkey").select("s_suppkey", lines.alias("geom")), GEO, Z)
    return vector.exploded(found).groupBy("row", "col").agg(F.count(F.lit(1)).alias("parts"), F.round(F.sum(G.length(F.col("geom"))), 6).alias("length"))


_CLIP = "k AS (SELECT n_nationkey * 14e0 - 175.3e0 AS l, n_nationkey * 14e0 - 167.3e0 AS r, (n_nationkey * 11) % 150 - 90.2e0 AS b, (n_nationkey * 11) % 150 - 65.2e0 AS t FROM nation)"
_TILES = f"tile AS (SELECT DISTINCT row, col, col * {SPAN} - 180 AS x0, 90 - row * {SPAN} AS y1 FROM pix), gated AS (SELECT tile.* FROM tile WHERE EXISTS (SELECT 1 FROM k WHERE l < x0 + {SPAN} AND r > x0 AND b < y1 AND t > y1 - {SPAN}))"


def _rectangles(spark: SparkSession, sf: str) -> DataFrame:
    """Rectangles that don't overlap."""
    left, bottom = F.col("n_nationkey") * 14.0 - 175.3, (F.col("n_nationkey") * 11) % 150 - 90.2
    ring = _ring((left, bottom), (left + 8, bottom), (left + 8, bottom + 25), (left, bottom + 25), (left, bottom))
    return read(spark, sf, "nation").select(_shape("Polygon", ring).alias("geom"))


@register("run_contours_clip", f"WITH {FITTED}, {_CLIP}, {_TILES}, c AS (SELECT row, col, e, x0 + ((e - 3) / 10 + 0.5e0) * ({SPAN} / 8) AS x, y1 - 7.5e0 * ({SPAN} / 8) AS low, y1 - 0.5e0 * ({SPAN} / 8) AS high FROM gated, (VALUES (20e0), (40e0), (60e0)) v(e)), o AS (SELECT row, col, e, high - low - coalesce(sum(CASE WHEN l IS NOT NULL THEN greatest(0e0, least(t, high) - greatest(b, low)) END), 0) AS n FROM c LEFT JOIN k ON l < x AND x < r GROUP BY row, col, e, low, high) SELECT row, col, e AS elev, round(n, 5) AS length FROM o WHERE n > 0.000001e0")
def _(spark, sf):
    """Contours of ramps, those outside the rectangles, cut at them; tiles without a rectangle have none."""
    z = fitting_zoom(spark, sf)
    ramp = packed(spark, sf, z).withColumn("pixels", F.transform("pixels", lambda v, i: (i % WIDTH) * 10.0 + 3.0))
    config = _config(spark, sf, "run", z, zoom_levels=z, process="contours", process_parameters={"interval": 20.0}, input={"dem": ramp, "clip": _rectangles(spark, sf)}, output={"format": "GeoJSON", "schema": {"geometry": "LineString"}})
    from gridloom.plans.engine import open_process

    p = open_process(spark, config, "overwrite")
    p.execute()
    return p.read(z).groupBy("row", "col", F.col("properties")["elev"].cast("double").alias("elev")).agg(F.round(F.sum(G.length(F.col("geom"))), 5).alias("length"))


@register("run_hillshade_clip", _SHADED + f", {_CLIP}, {_TILES}, s AS (SELECT row, col, py, px, 1.5707963267948966e0 - atan(sqrt(x * x + y * y)) AS sl, atan2(x, y) AS asp FROM g), h AS (SELECT row, col, py, px, trunc(greatest(least(255e0 * (sin(radians(45e0)) * sin(sl) + cos(radians(45e0)) * cos(sl) * cos(radians(225e0) - asp)), 255e0), 1e0)) AS shade FROM s) SELECT a.row, a.col, a.py, a.px, CAST(h.shade AS DOUBLE) AS value FROM (SELECT DISTINCT row, col, py, px FROM pix) a JOIN h ON h.row = a.row AND h.col = a.col AND h.py = least(greatest(a.py, 1), 6) AND h.px = least(greatest(a.px, 1), 6) JOIN gated ON gated.row = a.row AND gated.col = a.col WHERE h.shade < 255")
def _(spark, sf):
    """Tiles with a rectangle are shaded whole, the others are empty."""
    z = fitting_zoom(spark, sf)
    config = _config(spark, sf, "run", z, zoom_levels=z, process="hillshade", process_parameters={}, input={"dem": packed(spark, sf, z), "clip": _rectangles(spark, sf)}, output={"format": "PNG_hillshade"})
    return _run(spark, config).select("row", "col", "py", "px", "value")


@register("geotiff_window", f"WITH {PIX}, w AS (SELECT *, col * 5.625e0 - 180 + (px + 0.5e0) * 0.703125e0 AS x, 90 - row * 5.625e0 - (py + 0.5e0) * 0.703125e0 AS y FROM pix) SELECT row, col, py, px, value FROM w WHERE x > -100 AND x < 20 AND y > 30 AND y < 88")
def _(spark, sf):
    """A window (which is the feature) of one large file with all tiles: only its blocks are read."""
    from gridloom.functions import raster as R
    from gridloom.functions.bounds import Bounds
    from gridloom.sources import windows
    from gridloom.sources.paths import work_path
    from gridloom.sources.readers import raster_to_tiles
    from gridloom.sources.sinks import write_single

    path = f"{work_path(spark, 'window')}/all.tif"
    write_single(packed(spark, sf), path, GEO, Z, nodata=-99999.0)
    blocks = windows.read_blocks(windows.within(windows.block_index(spark, path), Bounds(-100.0, 30.0, 20.0, 88.0)))
    x, y = R.pixel_centre(GEO, Z, WIDTH)
    return raster_to_tiles(blocks, GEO, Z).where((x > -100) & (x < 20) & (y > 30) & (y < 88) & F.col("value").isNotNull()).select("row", "col", "py", "px", "value")
