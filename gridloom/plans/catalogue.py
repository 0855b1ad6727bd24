"""The registered queries of the tile engine and the SQL they are checked by.

The test tables hold no geodata, so a spatial layer is derived from them by arithmetic: points from
`events`, 8 x 8 pixel rasters from `embeddings` (one tile each at zoom 5), boxes and polygons from `nation`. Zoom 5 has
2048 tiles; queries whose results depend on tiles being in the pyramid take the first zoom from 5 with one for each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import bounds as B
from gridloom.functions import geometry as G
from gridloom.functions import raster as R
from gridloom.functions.bounds import Bounds
from gridloom.functions.pyramid import GEODETIC, MERCATOR, Pyramid, best_zoom, mercator_col, mercator_row, scale_denominator, task_id
from gridloom.operators import joins, process, tiles, vector

Query = Callable[[SparkSession, str], DataFrame]
Z, WIDTH = 5, 8
GEO = Pyramid(GEODETIC, tile_size=WIDTH)
META = Pyramid(GEODETIC, tile_size=WIDTH, metatiling=4)

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

PTS = "pts AS (SELECT event_id, user_id, value, event_type, ts, CAST((user_id * 7919) % 36000 AS DOUBLE) / 100e0 - 180e0 AS lon, CAST((event_id * 104729) % 18000 AS DOUBLE) / 100e0 - 90e0 AS lat FROM events)"
TILED = f"{PTS}, tiled AS (SELECT *, CAST(greatest(least(floor((lon + 180e0) / 11.25e0), 31), 0) AS INT) AS col4, CAST(greatest(least(floor((lon + 180e0) / 5.625e0), 63), 0) AS INT) AS col, CAST(greatest(least(floor((90e0 - lat) / 5.625e0), 31), 0) AS INT) AS row FROM pts)"
PIX = "pix AS (SELECT vec_id, label, 5 AS zoom, CAST(vec_id // 64 AS INT) AS row, CAST(vec_id % 64 AS INT) AS col, 1 AS band, CAST(i // 8 AS INT) AS py, CAST(i % 8 AS INT) AS px, CAST(round(CAST(embedding[i + 1] AS DOUBLE) * 1000) AS DOUBLE) + 0e0 AS value FROM embeddings, range(64) t(i))"
FITTED = PIX.replace("pix AS", "fit AS (SELECT CAST(min(k) AS INT) AS z, 2 << min(k) AS w, 180e0 / (1 << min(k)) AS s FROM range(5, 31) t(k) WHERE (CAST(2 AS BIGINT) << (2 * k)) > (SELECT max(vec_id) FROM embeddings)), pix AS").replace("5 AS zoom", "z AS zoom").replace("vec_id // 64", "vec_id // w").replace("vec_id % 64", "vec_id % w").replace("FROM embeddings, range(64)", "FROM embeddings, fit, range(64)")
SPAN = "(SELECT s FROM fit)"
BOX = "box AS (SELECT n_nationkey, n_name, n_regionkey, n_nationkey * 14e0 - 180e0 AS l, (n_nationkey * 11) % 150 - 90e0 AS b, n_nationkey * 14e0 - 150e0 AS r, (n_nationkey * 11) % 150 - 65e0 AS t FROM nation)"


def register(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        _queries[name] = f
        if sql is not None:
            _sql[name] = sql
        return f

    return put


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def points(spark: SparkSession, sf: str) -> DataFrame:
    lon = ((F.col("user_id") * 7919) % 36000).cast("double") / 100 - 180
    lat = ((F.col("event_id") * 104729) % 18000).cast("double") / 100 - 90
    return read(spark, sf, "events").withColumns({"lon": lon, "lat": lat})


def fitting_zoom(spark: SparkSession, sf: str) -> int:
    """The first zoom from 5 with a tile for each embedding."""
    last = read(spark, sf, "embeddings").agg(F.max("vec_id")).first()[0] or 0
    return next(z for z in range(Z, 31) if 2 * 4**z > last)


def packed(spark: SparkSession, sf: str, zoom: int = Z) -> DataFrame:
    pixels = F.transform("embedding", lambda v: F.round(v.cast("double") * 1000) + 0.0)
    return read(spark, sf, "embeddings").select(F.lit(zoom).alias("zoom"), F.expr(f"CAST(vec_id DIV {2 << zoom} AS INT)").alias("row"), F.expr(f"CAST(vec_id % {2 << zoom} AS INT)").alias("col"), F.lit(1).alias("band"), F.lit(WIDTH).alias("height"), F.lit(WIDTH).alias("width"), pixels.alias("pixels"))


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    return R.to_long(packed(spark, sf))


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    left, bottom = F.col("n_nationkey") * 14.0 - 180, (F.col("n_nationkey") * 11) % 150 - 90.0
    return read(spark, sf, "nation").withColumn("box", B.column(left, bottom, left + 30, bottom + 25))


def polygons(spark: SparkSession, sf: str) -> DataFrame:
    """A pentagon in each nation's box: a square with its upper right corner cut."""
    at = lambda x, y: F.struct((F.col("box.left") + x).alias("x"), (F.col("box.bottom") + y).alias("y"))
    ring = F.array(at(0, 0), at(30, 0), at(30, 10), at(10, 25), at(0, 25), at(0, 0))
    return boxes(spark, sf).withColumn("geom", F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("rings"), F.array(F.lit(0)).alias("part")))


def rectangles(spark: SparkSession, sf: str) -> DataFrame:
    """Each nation's box as a polygon."""
    b = F.col("box")
    ring = F.array(*[F.struct(b[x].alias("x"), b[y].alias("y")) for x, y in (("left", "bottom"), ("right", "bottom"), ("right", "top"), ("left", "top"), ("left", "bottom"))])
    return boxes(spark, sf).withColumn("geom", F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("rings"), F.array(F.lit(0)).alias("part")))


# Tiles

@register("tile_assign_geodetic", f"WITH {TILED} SELECT 5 AS zoom, row, col, count(*) AS n, min(value) AS low, max(value) AS high FROM tiled GROUP BY row, col")
def _(spark, sf):
    return tiles.assign(points(spark, sf), GEO, Z).groupBy("zoom", "row", "col").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


@register("tile_assign_mercator", "WITH p AS (SELECT CAST((user_id * 7919) % 36000 AS DOUBLE) / 100e0 - 180e0 AS lon, CAST((event_id * 104729) % 17000 AS DOUBLE) / 100e0 - 85e0 AS lat FROM events) SELECT CAST(greatest(least(floor((1e0 - ln(tan(radians(lat)) + 1e0 / cos(radians(lat))) / 3.141592653589793e0) / 2e0 * 32e0), 31), 0) AS INT) AS row, CAST(greatest(least(floor((lon + 180e0) / 360e0 * 32e0), 31), 0) AS INT) AS col, count(*) AS n FROM p GROUP BY 1, 2")
def _(spark, sf):
    df = points(spark, sf).withColumn("lat", ((F.col("event_id") * 104729) % 17000).cast("double") / 100 - 85)
    return df.groupBy(mercator_row(F.col("lat"), Z).alias("row"), mercator_col(F.col("lon"), Z).alias("col")).agg(F.count(F.lit(1)).alias("n"))


@register("tile_counts_by_zoom", f"WITH {TILED} SELECT z AS zoom, CAST(row // (1 << (5 - z)) AS INT) AS row, CAST(col // (1 << (5 - z)) AS INT) AS col, count(*) AS n FROM tiled, (SELECT CAST(unnest(range(0, 6)) AS INT) AS z) GROUP BY 1, 2, 3")
def _(spark, sf):
    leaf = tiles.assign(points(spark, sf), GEO, Z).groupBy("zoom", "row", "col").agg(F.count(F.lit(1)).alias("n"))
    return tiles.ancestors(leaf).groupBy("zoom", "row", "col").agg(F.sum("n").alias("n"))


@register("tile_parents", f"WITH {TILED} SELECT DISTINCT 4 AS zoom, CAST(row // 2 AS INT) AS row, CAST(col // 2 AS INT) AS col FROM tiled")
def _(spark, sf):
    return tiles.parents(tiles.assign(points(spark, sf), GEO, Z).select("zoom", "row", "col").distinct())


@register("tile_children", f"WITH {TILED}, t AS (SELECT DISTINCT row, col FROM tiled) SELECT 6 AS zoom, CAST(row * 2 + i AS INT) AS row, CAST(col * 2 + j AS INT) AS col FROM t, range(2) a(i), range(2) b(j)")
def _(spark, sf):
    return tiles.children(tiles.assign(points(spark, sf), GEO, Z).select("zoom", "row", "col").distinct(), GEO)


@register("tile_neighbors", f"WITH {TILED}, t AS (SELECT DISTINCT row, col FROM tiled) SELECT row, col, CAST(row + i AS INT) AS n_row, CAST((col + j + 64) % 64 AS INT) AS n_col FROM t, range(-1, 2) a(i), range(-1, 2) b(j) WHERE (i <> 0 OR j <> 0) AND row + i BETWEEN 0 AND 31")
def _(spark, sf):
    return tiles.neighbors(tiles.assign(points(spark, sf), GEO, Z).select("zoom", "row", "col").distinct(), GEO).select("row", "col", "n_row", "n_col")


@register("metatile_join", f"WITH {TILED}, t AS (SELECT DISTINCT CAST(row // 4 AS INT) AS row, CAST(col // 4 AS INT) AS col FROM tiled) SELECT row, col, CAST(row * 4 + i AS INT) AS o_row, CAST(col * 4 + j AS INT) AS o_col FROM t, range(4) a(i), range(4) b(j)")
def _(spark, sf):
    return tiles.cross_pyramid(tiles.assign(points(spark, sf), META, Z).select("zoom", "row", "col").distinct(), META, GEO).select("row", "col", "o_row", "o_col")


@register("tiles_from_bounds", "SELECT CAST(z AS INT) AS zoom, CAST(r AS INT) AS row, CAST(c AS INT) AS col FROM range(3, 7) t(z), range(128) a(r), range(256) b(c) WHERE c < (2 << z) AND r < (1 << z) AND c * (180e0 / (1 << z)) - 180 < 60.5 AND (c + 1) * (180e0 / (1 << z)) - 180 > -10.5 AND 90 - r * (180e0 / (1 << z)) > 20 AND 90 - (r + 1) * (180e0 / (1 << z)) < 70.25")
def _(spark, sf):
    return tiles.tiles_from_bounds(spark, GEO, Bounds(-10.5, 20, 60.5, 70.25), range(3, 7))


@register("tiles_from_boxes", f"WITH {BOX} SELECT DISTINCT n_nationkey, CAST(r0 AS INT) AS row, CAST(c AS INT) AS col FROM box, range(32) a(r0), range(64) b(c) WHERE c * 5.625e0 - 180 < least(r, 180) AND (c + 1) * 5.625e0 - 180 > l AND 90 - r0 * 5.625e0 > b AND 90 - (r0 + 1) * 5.625e0 < t AND l < 180")
def _(spark, sf):
    return tiles.cells(boxes(spark, sf).where("box.left < 180"), GEO, Z).select("n_nationkey", "row", "col")


@register("tile_bounds", f"WITH {TILED} SELECT DISTINCT row, col, col * 5.625e0 - 180e0 AS l, greatest(90e0 - (row + 1) * 5.625e0, -90e0) AS b, least((col + 1) * 5.625e0 - 180e0, 180e0) AS r, 90e0 - row * 5.625e0 AS t, printf('5-%d-%d', row, col) AS task FROM tiled")
def _(spark, sf):
    t = tiles.assign(points(spark, sf), GEO, Z).select("zoom", "row", "col").distinct()
    box = GEO.box(Z, F.col("row"), F.col("col"))
    return t.withColumn("x", box).select("row", "col", F.col("x.left").alias("l"), F.col("x.bottom").alias("b"), F.col("x.right").alias("r"), F.col("x.top").alias("t"), task_id(F.col("zoom"), F.col("row"), F.col("col")).alias("task"))


@register("feature_tile_counts", f"WITH {BOX} SELECT CAST(z AS INT) AS zoom, count(*) AS tiles FROM (SELECT DISTINCT z, r0, c FROM box, range(2, 6) zz(z), range(32) a(r0), range(64) b(c) WHERE c < (2 << z) AND r0 < (1 << z) AND l < 180 AND c * (180e0 / (1 << z)) - 180 < least(r, 180) AND (c + 1) * (180e0 / (1 << z)) - 180 > l AND 90 - r0 * (180e0 / (1 << z)) > b AND 90 - (r0 + 1) * (180e0 / (1 << z)) < t) GROUP BY z")
def _(spark, sf):
    return tiles.count_feature_tiles(polygons(spark, sf).where("box.left < 180"), GEO, range(2, 6), exact=False)


@register("combined_shape", f"WITH {TILED}, t AS (SELECT DISTINCT row, col FROM tiled) SELECT min(col) * 5.625e0 - 180e0 AS l, 90e0 - min(row) * 5.625e0 AS t, CAST((max(col) - min(col) + 1) * 8 AS INT) AS width, CAST((max(row) - min(row) + 1) * 8 AS INT) AS height FROM t")
def _(spark, sf):
    t = tiles.assign(points(spark, sf), GEO, Z).select("zoom", "row", "col").distinct()
    return tiles.combined_affine(t, GEO, Z).select(F.col("left").alias("l"), F.col("top").alias("t"), "width", "height")


# Bounds and geometry

@register("bounds_total", f"WITH {BOX} SELECT n_regionkey, min(l) AS l, min(b) AS b, max(r) AS r, max(t) AS t FROM box GROUP BY n_regionkey")
def _(spark, sf):
    return boxes(spark, sf).groupBy("n_regionkey").agg(*[c.alias(n) for c, n in zip(B.total("box"), "lbrt")])


@register("bounds_intersects", f"WITH {BOX} SELECT x.n_nationkey AS a, y.n_nationkey AS c, greatest(x.l, y.l) AS l, least(x.t, y.t) AS t FROM box x JOIN box y ON x.l <= y.r AND x.r >= y.l AND x.b <= y.t AND x.t >= y.b AND x.n_nationkey < y.n_nationkey")
def _(spark, sf):
    b = boxes(spark, sf).select("n_nationkey", "box")
    pairs = joins.range_join(b, b, GEO, 3).where("n_nationkey < r_n_nationkey")
    return pairs.select(F.col("n_nationkey").alias("a"), F.col("r_n_nationkey").alias("c"), F.greatest("box.left", "r_box.left").alias("l"), F.least("box.top", "r_box.top").alias("t"))


@register("polygon_area", f"WITH {BOX} SELECT n_nationkey, 30e0 * 25e0 - 20e0 * 15e0 / 2e0 AS area, round(30e0 + 10e0 + 25e0 + 10e0 + 25e0, 6) AS girth FROM box")
def _(spark, sf):
    return polygons(spark, sf).select("n_nationkey", F.round(G.area(F.col("geom")), 6).alias("area"), F.round(G.length(F.col("geom")), 6).alias("girth"))


@register("points_in_polygons", f"WITH {PTS}, {BOX} SELECT n_nationkey, count(*) AS n, min(event_id) AS first FROM pts JOIN box ON lon >= l AND lon < r AND lat >= b AND lat < t AND (lon - l < 10e0 OR lat - b < 10e0 OR lon < (10e0 - 30e0) * (lat - (b + 10e0)) / ((b + 25e0) - (b + 10e0)) + (l + 30e0)) GROUP BY n_nationkey")
def _(spark, sf):
    hit = joins.points_in_polygons(points(spark, sf).select("event_id", "lon", "lat"), polygons(spark, sf).select("n_nationkey", "geom"), GEO, Z)
    return hit.groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))


@register("spatial_range_join", f"WITH {PTS}, {BOX} SELECT n_nationkey, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM pts JOIN box ON lon >= l AND lon < r AND lat >= b AND lat < t GROUP BY n_nationkey")
def _(spark, sf):
    hit = joins.points_in_boxes(points(spark, sf).select("event_id", "lon", "lat"), boxes(spark, sf).select("n_nationkey", "box"), GEO, Z)
    return hit.groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@register("mixed_range_join", f"WITH {BOX}, c AS (SELECT c_custkey, (c_custkey * 37) % 3600 / 10e0 - 180e0 AS cl, (c_custkey * 91) % 1700 / 10e0 - 85e0 AS cb, CASE WHEN c_custkey % 50 = 0 THEN 90e0 ELSE 0.25e0 END AS w FROM customer) SELECT n_nationkey, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS ids FROM c JOIN box ON cl <= r AND cl + w >= l AND cb <= t AND cb + w / 2e0 >= b GROUP BY n_nationkey")
def _(spark, sf):
    # Small boxes and some a quarter of the world wide, at a zoom whose cells are much smaller than any.
    left, bottom, w = (F.col("c_custkey") * 37) % 3600 / 10.0 - 180, (F.col("c_custkey") * 91) % 1700 / 10.0 - 85, F.when(F.col("c_custkey") % 50 == 0, 90.0).otherwise(0.25)
    own = read(spark, sf, "customer").select("c_custkey", B.column(left, bottom, left + w, bottom + w / 2).alias("box"))
    pairs = joins.range_join(own, boxes(spark, sf).select("n_nationkey", "box"), GEO, 12)
    return pairs.groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("ids"))


@register("theta_join", f"WITH {BOX} SELECT x.n_nationkey AS a, y.n_nationkey AS c FROM box x JOIN box y ON x.l <= y.r AND x.r >= y.l AND x.b <= y.t AND x.t >= y.b")
def _(spark, sf):
    b = boxes(spark, sf)
    left, right = b.select(F.col("n_nationkey").alias("a"), F.col("box").alias("x")), b.select(F.col("n_nationkey").alias("c"), F.col("box").alias("y"))
    return joins.theta_boxes(left, right, F.col("x"), F.col("y")).select("a", "c")


@register("utm_zone", f"WITH {PTS} SELECT 'EPSG:' || CASE WHEN lat <= 0 THEN '327' ELSE '326' END || lpad(CAST(greatest(least(CAST(floor((lon + 180e0) / 6e0) AS INT) + 1, 60), 1) AS VARCHAR), 2, '0') AS crs, count(*) AS n FROM pts GROUP BY 1")
def _(spark, sf):
    return points(spark, sf).groupBy(G.utm_zone(F.col("lat"), F.col("lon")).alias("crs")).agg(F.count(F.lit(1)).alias("n"))


@register("antimeridian_shift", f"WITH {BOX} SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN CASE WHEN l < 0 THEN l + 360 ELSE l END ELSE l + 360 END AS first_x FROM box")
def _(spark, sf):
    g = F.when(F.col("n_nationkey") % 2 == 0, G.shift_longitude(F.col("geom"), only_negative=True)).otherwise(G.shift_longitude(F.col("geom")))
    return polygons(spark, sf).withColumn("g", g).select("n_nationkey", F.col("g.rings")[0][0]["x"].alias("first_x"))


@register("segmentize", f"WITH {BOX}, e(x0, y0, x1, y1) AS (VALUES (0e0, 0e0, 30e0, 0e0), (30e0, 0e0, 30e0, 10e0), (30e0, 10e0, 10e0, 25e0), (10e0, 25e0, 0e0, 25e0), (0e0, 25e0, 0e0, 0e0)), k AS (SELECT *, ceil(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) / 3e0) AS n FROM e), p AS (SELECT x0 + (x1 - x0) * i / n AS x, y0 + (y1 - y0) * i / n AS y FROM k, range(100) t(i) WHERE i < n UNION ALL SELECT 0e0, 0e0) SELECT n_nationkey, count(*) AS n_points, round(sum(l + x), 6) AS x, round(sum(b + y), 6) AS y FROM box, p GROUP BY n_nationkey")
def _(spark, sf):
    df = polygons(spark, sf).select("n_nationkey", F.explode(G.points(G.segmentized(F.col("geom"), 3.0))).alias("p"))
    return df.groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("n_points"), F.round(F.sum("p.x"), 6).alias("x"), F.round(F.sum("p.y"), 6).alias("y"))


@register("reproject_mercator", f"WITH {BOX} SELECT n_nationkey, CAST(round(radians(l) * 6378137e0) AS BIGINT) AS x, CAST(round(ln(tan(0.7853981633974483e0 + radians(b) / 2e0)) * 6378137e0) AS BIGINT) AS y FROM box WHERE b > -85")
def _(spark, sf):
    g = G.to_mercator(F.col("geom"))
    return polygons(spark, sf).where("box.bottom > -85").withColumn("g", g).select("n_nationkey", F.round(F.col("g.rings")[0][0]["x"]).cast("long").alias("x"), F.round(F.col("g.rings")[0][0]["y"]).cast("long").alias("y"))


@register("multipart_explode", f"WITH {BOX} SELECT n_nationkey, l + k AS x FROM box, range(3) t(k)")
def _(spark, sf):
    pts = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.array(F.struct((F.col("box.left") + k).alias("x"), F.col("box.bottom").alias("y"))))
    multi = F.struct(F.lit("MultiPoint").alias("type"), pts.alias("rings"), F.array(F.lit(0), F.lit(1), F.lit(2)).alias("part"))
    return vector.exploded(boxes(spark, sf).withColumn("geom", multi)).where("geom.type = 'Point'").select("n_nationkey", F.col("geom.rings")[0][0]["x"].alias("x"))


@register("geometry_type_filter", f"WITH {BOX} SELECT n_nationkey FROM box WHERE n_nationkey % 3 <> 0")
def _(spark, sf):
    kinds = F.when(F.col("n_nationkey") % 3 == 0, "Point").when(F.col("n_nationkey") % 3 == 1, "Polygon").otherwise("MultiPolygon")
    g = F.struct(kinds.alias("type"), F.col("geom.rings").alias("rings"), F.col("geom.part").alias("part"))
    return vector.of_type(vector.not_empty(polygons(spark, sf).withColumn("geom", g)), "Polygon").select("n_nationkey")


@register("features_by_tile", f"WITH {BOX} SELECT row, col, count(*) AS n, round(sum(greatest(least(r, (col + 1) * 5.625e0 - 180) - greatest(l, col * 5.625e0 - 180), 0) * greatest(least(t, 90 - row * 5.625e0) - greatest(b, 90 - (row + 1) * 5.625e0), 0)), 6) AS area FROM box, (SELECT CAST(range AS INT) AS row FROM range(32)), (SELECT CAST(range AS INT) AS col FROM range(64)) WHERE l < 180 AND col * 5.625e0 - 180 < r AND (col + 1) * 5.625e0 - 180 > l AND 90 - row * 5.625e0 > b AND 90 - (row + 1) * 5.625e0 < t GROUP BY row, col")
def _(spark, sf):
    b = F.col("box")
    ring = F.array(*[F.struct(b[x].alias("x"), b[y].alias("y")) for x, y in (("left", "bottom"), ("right", "bottom"), ("right", "top"), ("left", "top"), ("left", "bottom"))])
    df = boxes(spark, sf).where("box.left < 180").withColumn("geom", F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("rings"), F.array(F.lit(0)).alias("part"))).drop("box")
    return vector.read_tiles(df, GEO, Z).groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(G.area(F.col("geom"))), 6).alias("area"))


@register("cell_union", f"WITH {BOX} SELECT CAST(r0 AS INT) AS row, count(DISTINCT c) AS n FROM box, range(32) a(r0), range(64) b(c) WHERE l < 180 AND c * 5.625e0 - 180 < least(r, 180) AND (c + 1) * 5.625e0 - 180 > l AND 90 - r0 * 5.625e0 > b AND 90 - (r0 + 1) * 5.625e0 < t GROUP BY r0")
def _(spark, sf):
    return _cell_union(spark, sf)


def _cell_union(spark: SparkSession, sf: str) -> DataFrame:
    b = F.col("box")
    ring = F.array(*[F.struct(b[x].alias("x"), b[y].alias("y")) for x, y in (("left", "bottom"), ("right", "bottom"), ("right", "top"), ("left", "top"), ("left", "bottom"))])
    df = boxes(spark, sf).withColumn("geom", F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("rings"), F.array(F.lit(0)).alias("part"))).drop("box")
    return vector.cell_union(df, GEO, Z).select("row", F.size("cols").cast("long").alias("n"))


# Runs

@register("continue_mode_anti", f"WITH {TILED}, t AS (SELECT DISTINCT row, col FROM tiled), d AS (SELECT DISTINCT row, col FROM tiled WHERE event_type = 'click') SELECT row, col FROM t ANTI JOIN d USING (row, col)")
def _(spark, sf):
    t = tiles.assign(points(spark, sf), GEO, Z)
    return joins.missing(t.select("zoom", "row", "col").distinct(), t.where("event_type = 'click'")).select("row", "col")


@register("aoi_semi", f"WITH {TILED}, {BOX} SELECT DISTINCT row, col FROM tiled WHERE EXISTS (SELECT 1 FROM box WHERE n_nationkey < 4 AND col * 5.625e0 - 180 <= r AND (col + 1) * 5.625e0 - 180 >= l AND 90 - row * 5.625e0 >= b AND 90 - (row + 1) * 5.625e0 <= t)")
def _(spark, sf):
    t = tiles.assign(points(spark, sf), GEO, Z).select("zoom", "row", "col").distinct().withColumn("box", GEO.box(Z, F.col("row"), F.col("col")))
    return joins.range_join(t, boxes(spark, sf).where("n_nationkey < 4").select("box"), GEO, 3, how="left_semi").select("row", "col")


@register("process_tiles_done", f"WITH {TILED}, o AS (SELECT DISTINCT row, col FROM tiled WHERE row % 4 <> 3 OR col % 8 < 5) SELECT CAST(row // 4 AS INT) AS row, CAST(col // 4 AS INT) AS col FROM o GROUP BY row // 4, col // 4 HAVING count(*) = 16")
def _(spark, sf):
    t = tiles.assign(points(spark, sf), GEO, Z).select("zoom", "row", "col").distinct()
    have = t.where("row % 4 <> 3 OR col % 8 < 5")
    return joins.process_tiles_done(tiles.assign(points(spark, sf), META, Z).select("zoom", "row", "col").distinct(), META, GEO, have).select("row", "col")


@register("dependencies", f"WITH {TILED}, a AS (SELECT DISTINCT row, col FROM tiled) SELECT CAST(row // 2 AS INT) AS row, CAST(col // 2 AS INT) AS col, row AS c_row, col AS c_col FROM a")
def _(spark, sf):
    t = tiles.assign(points(spark, sf), GEO, Z).select("zoom", "row", "col").distinct()
    return joins.dependencies(t.unionByName(tiles.parents(t))).where("zoom = 4").select("row", "col", "c_row", "c_col")


@register("merge_new", "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, upper(c_name) FROM customer WHERE c_custkey % 3 <> 0")
def _(spark, sf):
    c = read(spark, sf, "customer").select("c_custkey", "c_name")
    return joins.merged(c.where("c_custkey % 3 = 0"), c.withColumn("c_name", F.upper("c_name")), "c_custkey")


@register("sync_copy", "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 7 = 0")
def _(spark, sf):
    c = read(spark, sf, "customer").select("c_custkey", "c_acctbal")
    target = c.where("c_custkey % 5 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return joins.to_copy(c, target, ["c_custkey"], compare="c_acctbal")


@register("incremental_overview", f"WITH {TILED}, n AS (SELECT DISTINCT row, col FROM tiled WHERE ts >= TIMESTAMP '2024-01-20'), k AS (SELECT DISTINCT z, row // (1 << (5 - z)) AS row, col // (1 << (5 - z)) AS col FROM n, (SELECT unnest(range(0, 5)) AS z)) SELECT CAST(k.z AS INT) AS zoom, CAST(k.row AS INT) AS row, CAST(k.col AS INT) AS col, count(*) AS n FROM k JOIN tiled ON tiled.row // (1 << (5 - z)) = k.row AND tiled.col // (1 << (5 - z)) = k.col GROUP BY 1, 2, 3")
def _(spark, sf):
    from gridloom.streaming.incremental import touched

    p = tiles.assign(points(spark, sf), GEO, Z)
    leaf = p.groupBy("zoom", "row", "col").agg(F.count(F.lit(1)).alias("n"))
    again = touched(p.where("ts >= TIMESTAMP '2024-01-20'").select("zoom", "row", "col").distinct())
    return tiles.ancestors(leaf).where("zoom < 5").join(again, ["zoom", "row", "col"], "left_semi").groupBy("zoom", "row", "col").agg(F.sum("n").alias("n"))


# Rasters

@register("mosaic_last_wins", f"WITH {PIX}, u AS (SELECT *, 0 AS ord FROM pix UNION ALL SELECT vec_id, label, zoom, row, col, band, py, px, CASE WHEN value > 0 THEN value + 1 END, 1 FROM pix WHERE col % 2 = 0) SELECT zoom, row, col, band, py, px, arg_max(value, ord) FILTER (value IS NOT NULL) AS value FROM u GROUP BY ALL")
def _(spark, sf):
    p = pixels(spark, sf)
    top = p.where("col % 2 = 0").withColumn("value", F.when(F.col("value") > 0, F.col("value") + 1))
    return R.mosaic(p.withColumn("ord", F.lit(0)).unionByName(top.withColumn("ord", F.lit(1))))


def _overview_sql(agg: str) -> str:
    return f"WITH {PIX} SELECT 4 AS zoom, CAST(row // 2 AS INT) AS row, CAST(col // 2 AS INT) AS col, band, CAST((row % 2 * 8 + py) // 2 AS INT) AS py, CAST((col % 2 * 8 + px) // 2 AS INT) AS px, {agg} AS value FROM pix GROUP BY ALL"


for _name, _agg in {"average": "sum(value) / count(value)", "min": "min(value)", "max": "max(value)", "sum": "sum(value)", "nearest": "arg_min(value, (row % 2 * 8 + py) * 100 + col % 2 * 8 + px)", "med": "median(value)"}.items():
    register(f"overview_{_name}", _overview_sql(_agg))(lambda spark, sf, m=_name: R.overview(pixels(spark, sf), WIDTH, m))


@register("overview_mode", f"WITH {PIX}, c AS (SELECT CAST(row // 2 AS INT) AS row, CAST(col // 2 AS INT) AS col, CAST((row % 2 * 8 + py) // 2 AS INT) AS py, CAST((col % 2 * 8 + px) // 2 AS INT) AS px, value // 100 AS value, count(*) AS n FROM (SELECT * REPLACE (CAST(floor(value / 100) * 100 AS DOUBLE) AS value) FROM pix) GROUP BY ALL) SELECT row, col, py, px, arg_min(value * 100, (-n, value)) AS value FROM c GROUP BY row, col, py, px")
def _(spark, sf):
    return R.overview(pixels(spark, sf).withColumn("value", F.floor(F.col("value") / 100) * 100.0), WIDTH, "mode").select("row", "col", "py", "px", "value")


@register("overview_pyramid", f"WITH {PIX} SELECT CAST(z AS INT) AS zoom, CAST((row * 8 + py) // (1 << (5 - z)) // 8 AS INT) AS row, CAST((col * 8 + px) // (1 << (5 - z)) // 8 AS INT) AS col, CAST((row * 8 + py) // (1 << (5 - z)) % 8 AS INT) AS py, CAST((col * 8 + px) // (1 << (5 - z)) % 8 AS INT) AS px, max(value) AS value FROM pix, range(0, 5) t(z) GROUP BY ALL")
def _(spark, sf):
    from gridloom.sources.paths import stored

    return R.overviews(pixels(spark, sf), WIDTH, Z, 0, "max", lambda df: stored(df, "level")).drop("band")


@register("resample_coarser", f"WITH {PIX} SELECT 2 AS zoom, CAST((row * 8 + py) // 64 AS INT) AS row, CAST((col * 8 + px) // 64 AS INT) AS col, CAST((row * 8 + py) // 8 % 8 AS INT) AS py, CAST((col * 8 + px) // 8 % 8 AS INT) AS px, sum(value) / count(value) AS value FROM pix GROUP BY ALL")
def _(spark, sf):
    return R.resample(pixels(spark, sf), GEO, Z, 2, WIDTH, "average").drop("band")


@register("resample_finer", f"WITH {PIX}, f AS (SELECT row * 16 + py * 2 + i AS y, col * 16 + px * 2 + j AS x, value FROM pix, range(2) a(i), range(2) b(j)) SELECT 6 AS zoom, CAST(y // 8 AS INT) AS row, CAST(x // 8 AS INT) AS col, CAST(y % 8 AS INT) AS py, CAST(x % 8 AS INT) AS px, value FROM f")
def _(spark, sf):
    return R.resample(pixels(spark, sf), GEO, Z, 6, WIDTH).select("zoom", "row", "col", "py", "px", "value")


@register("interpolate_bilinear", f"WITH {PIX}, o AS (SELECT row, col, y AS py, x AS px, value, greatest(0e0, 1e0 - abs((y - 2 * py + 0.5e0) / 2e0 - 0.5e0)) * greatest(0e0, 1e0 - abs((x - 2 * px + 0.5e0) / 2e0 - 0.5e0)) AS k FROM pix, (SELECT CAST(range AS INT) AS y FROM range(16)), (SELECT CAST(range AS INT) AS x FROM range(16)) WHERE abs(y - 2 * py) <= 4 AND abs(x - 2 * px) <= 4) SELECT row, col, py, px, round(sum(value * k) / sum(k), 6) AS value FROM o WHERE k <> 0 GROUP BY row, col, py, px")
def _(spark, sf):
    return R.interpolate(pixels(spark, sf), WIDTH, 2).select("row", "col", "py", "px", F.round("value", 6).alias("value"))


_W = ", ".join(f"max(CASE WHEN dy = {i // 3 - 1} AND dx = {i % 3 - 1} THEN v END) AS w{i}" for i in range(9))
_FOCAL = f"WITH {PIX}, nb AS (SELECT a.row, a.col, a.py, a.px, a.value, b.value AS v, dy, dx FROM pix a, (SELECT CAST(range - 1 AS INT) AS dy FROM range(3)), (SELECT CAST(range - 1 AS INT) AS dx FROM range(3)), pix b WHERE b.row = a.row AND b.col = a.col AND b.py = least(greatest(a.py + dy, 1 * 0), 7) AND b.px = least(greatest(a.px + dx, 0), 7)), w AS (SELECT row, col, py, px, {_W} FROM nb GROUP BY row, col, py, px), g AS (SELECT row, col, py, px, ((w0 + 2 * w3 + w6) - (w2 + 2 * w5 + w8)) / 8e0 AS x, ((w6 + 2 * w7 + w8) - (w0 + 2 * w1 + w2)) / -8e0 AS y FROM w)"


@register("slope_aspect", _FOCAL + " SELECT row, col, py, px, round(1.5707963267948966e0 - atan(sqrt(x * x + y * y)), 9) AS slope, round(atan2(x, y), 9) AS aspect FROM g")
def _(spark, sf):
    df = R.neighbourhood(pixels(spark, sf), ["zoom", "row", "col", "band"])
    slope, aspect = R.slope_aspect([F.col(f"w{i}") for i in range(9)], 1.0, -1.0)
    return df.select("row", "col", "py", "px", F.round(slope, 9).alias("slope"), F.round(aspect, 9).alias("aspect"))


@register("hillshade", _FOCAL + ", s AS (SELECT row, col, py, px, 1.5707963267948966e0 - atan(sqrt(x * x + y * y)) AS sl, atan2(x, y) AS asp FROM g), h AS (SELECT row, col, py, px, CAST(trunc(greatest(least(255e0 * (sin(radians(45e0)) * sin(sl) + cos(radians(45e0)) * cos(sl) * cos(radians(225e0) - asp)), 255e0), 1e0)) AS INT) AS shade FROM s) SELECT a.row, a.col, a.py, a.px, h.shade FROM (SELECT DISTINCT row, col, py, px FROM pix) a JOIN h ON h.row = a.row AND h.col = a.col AND h.py = least(greatest(a.py, 1), 6) AND h.px = least(greatest(a.px, 1), 6)")
def _(spark, sf):
    return R.hillshade(pixels(spark, sf)).select("row", "col", "py", "px", "shade")


@register("halo", f"WITH {PIX}, h AS (SELECT row + dr AS row, (col + dc + 64) % 64 AS col, py - dr * 8 AS py, px - dc * 8 AS px, value FROM pix, (SELECT CAST(range - 1 AS INT) AS dr FROM range(3)), (SELECT CAST(range - 1 AS INT) AS dc FROM range(3))) SELECT CAST(row AS INT) AS row, CAST(col AS INT) AS col, count(*) AS n, sum(value) AS total FROM h WHERE row BETWEEN 0 AND 31 AND py BETWEEN -2 AND 9 AND px BETWEEN -2 AND 9 GROUP BY row, col")
def _(spark, sf):
    return R.halo(pixels(spark, sf), GEO, Z, 2, WIDTH).groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@register("scale_offset_clip", f"WITH {PIX} SELECT row, col, py, px, CAST(trunc(greatest(least((value + 100e0) * 0.5e0, 255e0), 0e0)) AS SMALLINT) AS value FROM pix")
def _(spark, sf):
    return process.convert(pixels(spark, sf), 0.5, 100, "uint8").select("row", "col", "py", "px", "value")


@register("nodata_mask", f"WITH {PIX} SELECT row, col, count(nullif(value, 0)) AS valid, count(*) AS n FROM pix GROUP BY row, col")
def _(spark, sf):
    return pixels(spark, sf).groupBy("row", "col").agg(F.count(R.masked(F.col("value"), 0)).alias("valid"), F.count(F.lit(1)).alias("n"))


@register("clip_mask_polygon", f"WITH {PIX}, {BOX}, c AS (SELECT *, col * 5.625e0 - 180e0 + (px + 0.5e0) * 0.703125e0 AS x, 90e0 - row * 5.625e0 - (py + 0.5e0) * 0.703125e0 AS y FROM pix) SELECT row, col, py, px, CASE WHEN EXISTS (SELECT 1 FROM box WHERE x >= l AND x < r AND y >= b AND y < t AND (x - l < 10e0 OR y - b < 10e0 OR x < -20e0 * (y - (b + 10e0)) / 15e0 + (l + 30e0))) THEN value END AS value FROM c")
def _(spark, sf):
    return process.clip(pixels(spark, sf), polygons(spark, sf).select("geom"), GEO, Z, WIDTH).select("row", "col", "py", "px", "value")


@register("window_extract", f"WITH {PIX} SELECT row, col, CAST(py - 2 AS INT) AS py, CAST(px - 3 AS INT) AS px, value FROM pix WHERE py BETWEEN 2 AND 5 AND px BETWEEN 3 AND 6")
def _(spark, sf):
    return R.window(pixels(spark, sf), 4, 4, 2, 3).select("row", "col", "py", "px", "value")


@register("contour_levels", f"WITH {PIX}, m AS (SELECT row, col, min(value) AS lo, max(value) AS hi FROM pix GROUP BY row, col) SELECT row, col, 10e0 + k * 50e0 AS level FROM m, range(-200, 200) t(k) WHERE 10 + k * 50 >= lo AND 10 + k * 50 <= hi")
def _(spark, sf):
    m = pixels(spark, sf).groupBy("row", "col").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return m.select("row", "col", F.explode(R.contour_levels(F.col("lo"), F.col("hi"), 50, 10)).alias("level"))


_SQUARES = f"""WITH {FITTED}, t AS (SELECT row, col, list(value ORDER BY py * 8 + px) AS v FROM pix GROUP BY row, col),
s AS (SELECT row, col, k * 100e0 AS elev, v[y * 8 + x + 1] AS a, v[y * 8 + x + 2] AS b, v[y * 8 + x + 10] AS c, v[y * 8 + x + 9] AS d FROM t, range(7) p(y), range(7) q(x), range(-100, 101) r(k) WHERE k * 100 >= list_min(v) AND k * 100 <= list_max(v)),
e AS (SELECT *, (a >= elev) <> (b >= elev) AS top, (b >= elev) <> (c >= elev) AS rig, (c >= elev) <> (d >= elev) AS bot, (a >= elev) <> (d >= elev) AS lef,
  CASE WHEN a <> b THEN (elev - a) / (b - a) END AS tx, CASE WHEN b <> c THEN (elev - b) / (c - b) END AS ry, CASE WHEN c <> d THEN (elev - d) / (c - d) END AS bx, CASE WHEN a <> d THEN (elev - a) / (d - a) END AS ly FROM s),
n AS (SELECT *, top::INT + rig::INT + bot::INT + lef::INT AS n, sqrt((1 - tx) * (1 - tx) + ry * ry) AS tr, sqrt((tx - bx) * (tx - bx) + 1) AS tb, sqrt(tx * tx + ly * ly) AS tl, sqrt((1 - bx) * (1 - bx) + (1 - ry) * (1 - ry)) AS rb, sqrt((ry - ly) * (ry - ly) + 1) AS rl, sqrt(bx * bx + (1 - ly) * (1 - ly)) AS bl FROM e),
m AS (SELECT row, col, elev, n, CASE WHEN n = 4 THEN CASE WHEN ((a + b + c + d) / 4 >= elev) = (a >= elev) THEN tr + bl ELSE tl + rb END WHEN n = 2 THEN CASE WHEN top AND rig THEN tr WHEN top AND bot THEN tb WHEN top AND lef THEN tl WHEN rig AND bot THEN rb WHEN rig AND lef THEN rl ELSE bl END END AS l FROM n WHERE n > 0)
SELECT row, col, elev, CAST(sum(n // 2) AS BIGINT) AS pieces, round(sum(l) * ({SPAN} / 8), 6) AS length FROM m GROUP BY row, col, elev"""


@register("contours", _SQUARES)
def _(spark, sf):
    lines = process.contours(packed(spark, sf, fitting_zoom(spark, sf)), GEO, 100.0)
    return lines.groupBy("row", "col", "elev").agg(F.sum(F.size(G.points(F.col("geom"))) - 1).alias("pieces"), F.round(F.sum(G.length(F.col("geom"))), 6).alias("length"))


@register("png_rgba", f"WITH {PIX} SELECT row, col, py, px, CASE WHEN value > 0 THEN CAST(value AS INT) % 256 ELSE 0 END AS gray, CASE WHEN value > 0 THEN 255 ELSE 0 END AS alpha FROM pix")
def _(spark, sf):
    v = F.when(F.col("value") > 0, F.col("value").cast("int") % 256)
    bands = R.rgba(F.array(v), 1)
    return pixels(spark, sf).select("row", "col", "py", "px", bands[0].alias("gray"), bands[3].alias("alpha"))


@register("png_hillshade_alpha", f"WITH {PIX} SELECT row, col, py, px, 0 AS gray, 255 - abs(CAST(value AS INT)) % 256 AS alpha FROM pix")
def _(spark, sf):
    out = R.shade_alpha(F.abs(F.col("value").cast("int")) % 256)
    return pixels(spark, sf).select("row", "col", "py", "px", out[0].alias("gray"), out[1].alias("alpha"))


@register("shift_required", f"WITH {TILED}, c AS (SELECT DISTINCT col FROM tiled WHERE col < 5 OR col > 58), d AS (SELECT col, CASE WHEN col - lag(col) OVER (ORDER BY col) > 1 THEN 1 ELSE 0 END AS gap FROM c), k AS (SELECT col, sum(gap) OVER (ORDER BY col) AS g FROM d), s AS (SELECT g, min(col) AS a, max(col) AS b FROM k GROUP BY g) SELECT coalesce(count(*) > 1 AND min(a) = 0 AND max(b) = 63 AND arg_min(b, g) + 64 - arg_max(a, g) < arg_max(a, g) - arg_min(b, g), false) AS shift FROM s")
def _(spark, sf):
    t = tiles.assign(points(spark, sf), GEO, Z).select("zoom", "row", "col").distinct().where("col < 5 OR col > 58")
    return R.shift_required(t, GEO, Z)


@register("pack_round_trip", f"WITH {PIX} SELECT row, col, 8 AS height, 8 AS width, sum((py * 8 + px + 1) * value) AS check_sum FROM pix GROUP BY row, col")
def _(spark, sf):
    back = R.to_packed(pixels(spark, sf), WIDTH, WIDTH)
    return back.select("row", "col", "height", "width", F.aggregate(F.transform("pixels", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v).alias("check_sum"))


@register("group_mean", f"WITH {PIX} SELECT label, py, px, sum(value) / count(value) AS value FROM pix GROUP BY label, py, px")
def _(spark, sf):
    e = read(spark, sf, "embeddings").select("label", F.posexplode(F.transform("embedding", lambda v: F.round(v.cast("double") * 1000) + 0.0)).alias("i", "value"))
    return e.groupBy("label", F.expr("i DIV 8").cast("int").alias("py"), F.expr("i % 8").cast("int").alias("px")).agg(F.avg("value").alias("value"))


def _mercator(size: int) -> str:
    """Pixels of Web Mercator's zoom 3 in tiles of ``size``, with their place in degrees."""
    step = f"40075016.68557849e0 / {8 * size}e0"
    return f"g AS (SELECT CAST(y // {size} AS INT) AS row, CAST(x // {size} AS INT) AS col, CAST(y % {size} AS INT) AS py, CAST(x % {size} AS INT) AS px, degrees((-20037508.342789244e0 + (x + 0.5e0) * {step}) / 6378137e0) AS lon, degrees(2e0 * atan(exp((20037508.342789244e0 - (y + 0.5e0) * {step}) / 6378137e0)) - pi() / 2e0) AS lat FROM range({8 * size}) a(y), range({8 * size}) b(x))"


@register("cross_projection", f"WITH {PIX}, {_mercator(64)} SELECT g.row, g.col, g.py, g.px, value FROM g JOIN pix ON pix.row * 8 + pix.py = CAST(floor((90e0 - lat) / 0.703125e0) AS INT) AND pix.col * 8 + pix.px = CAST(floor((lon + 180e0) / 0.703125e0) AS INT)")
def _(spark, sf):
    return R.warp(pixels(spark, sf), GEO, Pyramid(MERCATOR, tile_size=64), Z, 3, WIDTH, 64).select("row", "col", "py", "px", "value")


@register("warp_bilinear", f"WITH {PIX}, {_mercator(32)}, f AS (SELECT row, col, py, px, (90e0 - lat) / 0.703125e0 - 0.5e0 AS fy, (lon + 180e0) / 0.703125e0 - 0.5e0 AS fx FROM g), o AS (SELECT f.row, f.col, f.py, f.px, value, (1e0 - abs(floor(fy) + i - fy)) * (1e0 - abs(floor(fx) + j - fx)) AS k FROM f, range(2) a(i), range(2) b(j), pix WHERE pix.row * 8 + pix.py = CAST(floor(fy) + i AS INT) AND pix.col * 8 + pix.px = (CAST(floor(fx) + j AS INT) + 512) % 512) SELECT row, col, py, px, round(sum(value * k) / sum(k), 5) AS value FROM o WHERE k > 0 GROUP BY row, col, py, px")
def _(spark, sf):
    return R.warp(pixels(spark, sf), GEO, Pyramid(MERCATOR, tile_size=32), Z, 3, WIDTH, 32, "bilinear").select("row", "col", "py", "px", F.round("value", 5).alias("value"))


@register("warp_average", f"WITH {PIX}, c AS (SELECT value, (col * 8 + px + 0.5e0) * 0.703125e0 - 180e0 AS lon, 90e0 - (row * 8 + py + 0.5e0) * 0.703125e0 AS lat FROM pix), d AS (SELECT value, CAST(floor((20037508.342789244e0 - ln(tan(pi() / 4e0 + radians(lat) / 2e0)) * 6378137e0) / (40075016.68557849e0 / 256e0)) AS INT) AS y, CAST(floor((radians(lon) * 6378137e0 + 20037508.342789244e0) / (40075016.68557849e0 / 256e0)) AS INT) AS x FROM c) SELECT CAST(y // 32 AS INT) AS row, CAST(x // 32 AS INT) AS col, CAST(y % 32 AS INT) AS py, CAST(x % 32 AS INT) AS px, round(sum(value) / count(value), 6) AS value FROM d WHERE y BETWEEN 0 AND 255 GROUP BY y, x")
def _(spark, sf):
    return R.warp(pixels(spark, sf), GEO, Pyramid(MERCATOR, tile_size=32), Z, 3, WIDTH, 32, "average").select("row", "col", "py", "px", F.round("value", 6).alias("value"))


def _kernel(method: str, d: str) -> str:
    return f"greatest(0e0, 1e0 - {d})" if method == "bilinear" else f"(CASE WHEN {d} < 1 THEN 1.5e0 * {d} * {d} * {d} - 2.5e0 * {d} * {d} + 1 WHEN {d} < 2 THEN -0.5e0 * {d} * {d} * {d} + 2.5e0 * {d} * {d} - 4e0 * {d} + 2 ELSE 0e0 END)"


def _coarser(method: str, reach: int) -> str:
    k = f"{_kernel(method, 'dy')} * {_kernel(method, 'dx')}"
    return (
        f"WITH {PIX}, o AS (SELECT value, y // 2 + i AS ty, x // 2 + j AS tx, abs((y + 0.5e0) / 2 - (y // 2 + i + 0.5e0)) AS dy, abs((x + 0.5e0) / 2 - (x // 2 + j + 0.5e0)) AS dx FROM (SELECT value, row * 8 + py AS y, col * 8 + px AS x FROM pix), range(-{reach}, {reach + 1}) a(i), range(-{reach}, {reach + 1}) b(j)), "
        f"w AS (SELECT ty, (tx + 256) % 256 AS tx, value, {k} AS k FROM o WHERE ty BETWEEN 0 AND 127), own AS (SELECT DISTINCT row // 2 AS r, col // 2 AS c FROM pix) "
        "SELECT CAST(ty // 8 AS INT) AS row, CAST(tx // 8 AS INT) AS col, CAST(ty % 8 AS INT) AS py, CAST(tx % 8 AS INT) AS px, round(sum(value * k) / sum(k), 5) AS value FROM w JOIN own ON r = ty // 8 AND c = tx // 8 WHERE k <> 0 GROUP BY ty, tx"
    )


@register("overview_bilinear", _coarser("bilinear", 1))
def _(spark, sf):
    return R.coarser(pixels(spark, sf), GEO, Z, WIDTH, "bilinear").select("row", "col", "py", "px", F.round("value", 5).alias("value"))


@register("overview_cubic", _coarser("cubic", 2))
def _(spark, sf):
    return R.coarser(pixels(spark, sf), GEO, Z, WIDTH, "cubic").select("row", "col", "py", "px", F.round("value", 5).alias("value"))


_CENTRES = "c AS (SELECT *, col * 5.625e0 - 180e0 + (px + 0.5e0) * 0.703125e0 AS x, 90e0 - row * 5.625e0 - (py + 0.5e0) * 0.703125e0 AS y FROM pix)"


@register("mask_buffer", f"WITH {PIX}, {BOX}, {_CENTRES} SELECT row, col, py, px, NOT EXISTS (SELECT 1 FROM box WHERE (greatest(l - x, 0, x - r) ** 2 + greatest(b - y, 0, y - t) ** 2) <= 2.1e0 * 2.1e0) AS masked FROM c")
def _(spark, sf):
    x, y = R.pixel_centre(GEO, Z, WIDTH)
    return vector.mask(pixels(spark, sf).withColumns({"x": x, "y": y}), rectangles(spark, sf), GEO, Z, buffer=2.1).select("row", "col", "py", "px", "masked")


@register("mask_all_touched", f"WITH {PIX}, {BOX}, {_CENTRES} SELECT row, col, py, px, NOT EXISTS (SELECT 1 FROM box WHERE l <= x + 0.3515625e0 AND r >= x - 0.3515625e0 AND b <= y + 0.3515625e0 AND t >= y - 0.3515625e0) AS masked FROM c")
def _(spark, sf):
    x, y = R.pixel_centre(GEO, Z, WIDTH)
    return vector.mask(pixels(spark, sf).withColumns({"x": x, "y": y}), rectangles(spark, sf), GEO, Z, all_touched=True, pixel=GEO.pixel_size(Z)).select("row", "col", "py", "px", "masked")


@register("rasterize_presence", f"WITH {BOX} SELECT CAST(y // 8 AS INT) AS row, CAST(x // 8 AS INT) AS col, count(*) AS n FROM range(256) p(y), range(512) q(x) WHERE EXISTS (SELECT 1 FROM box WHERE (x + 0.5e0) * 0.703125e0 - 180e0 > l AND (x + 0.5e0) * 0.703125e0 - 180e0 < r AND 90e0 - (y + 0.5e0) * 0.703125e0 > b AND 90e0 - (y + 0.5e0) * 0.703125e0 < t) GROUP BY 1, 2")
def _(spark, sf):
    return vector.presence(rectangles(spark, sf), GEO, Z, WIDTH).groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"))


@register("collection_parts", f"WITH {BOX} SELECT n_nationkey, 750e0 AS area FROM box")
def _(spark, sf):
    """Each nation's rectangle and its lower left corner as one collection, of which the polygon is asked for."""
    b = F.col("box")
    corner = F.array(F.struct(b["left"].alias("x"), b["bottom"].alias("y")))
    g = rectangles(spark, sf)
    both = F.struct(F.lit("GeometryCollection").alias("type"), F.concat(F.array(corner), F.col("geom.rings")).alias("rings"), F.array(F.lit(0), F.lit(1)).alias("part"))
    return vector.of_type(g.withColumn("geom", both), "Polygon").select("n_nationkey", F.round(G.area(F.col("geom")), 6).alias("area"))


@register("user_process_arrow", f"WITH {PIX} SELECT row, col, py, px, value * 2 + 1 AS value FROM pix")
def _(spark, sf):
    return _user_process(spark, sf)


def _user_process(spark: SparkSession, sf: str) -> DataFrame:
    t = packed(spark, sf).select("zoom", "row", "col")
    out = process.run(t, {"dem": packed(spark, sf)}, _double_plus, GEO, {"add": 1})
    return R.to_long(out.drop("tags")).select("row", "col", "py", "px", "value")


def _double_plus(dem, add):
    return dem.read() * 2 + add


@register("user_process_vector", f"WITH {TILED} SELECT row, col, count(*) AS n FROM tiled GROUP BY row, col")
def _(spark, sf):
    return _points_by_tile(spark, sf)


def _points_by_tile(spark: SparkSession, sf: str) -> DataFrame:
    p = tiles.assign(points(spark, sf), GEO, Z)
    ring = F.array(F.array(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y"))))
    f = p.select("zoom", "row", "col", F.struct(F.lit("Point").alias("type"), ring.alias("rings"), F.array(F.lit(0)).alias("part")).alias("geom"), F.create_map(F.lit("id"), F.col("event_id").cast("string")).alias("properties"))
    out = process.run(f.select("zoom", "row", "col"), {"inp": f}, _same, GEO, vector=True, vector_inputs=["inp"])
    return out.groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"))


def _same(inp):
    return inp.read()


# Metadata

@register("stac_tile_limits", f"WITH {TILED}, u AS (SELECT CAST(z AS INT) AS zoom, row // (1 << (5 - z)) AS row, col // (1 << (5 - z)) AS col FROM tiled, range(2, 6) t(z)) SELECT zoom, CAST(min(row) AS INT) AS min_row, CAST(max(row) AS INT) AS max_row, CAST(min(col) AS INT) AS min_col, CAST(max(col) AS INT) AS max_col FROM u GROUP BY zoom")
def _(spark, sf):
    from gridloom.sources.stac import tile_limits

    leaf = tiles.assign(points(spark, sf), GEO, Z).select("zoom", "row", "col").distinct()
    return tile_limits(tiles.ancestors(leaf, 2))


@register("zoom_index", f"WITH {TILED} SELECT DISTINCT printf('5-%d-%d', row, col) AS tile_id, 5 AS zoom, row, col, printf('5/%d/%d.parquet', row, col) AS location FROM tiled")
def _(spark, sf):
    from gridloom.sources.index import zoom_index

    return zoom_index(tiles.assign(points(spark, sf), GEO, Z).select("zoom", "row", "col").distinct(), "{zoom}/{row}/{col}.{extension}", "parquet").select("tile_id", "zoom", "row", "col", "location")


@register("scale_denominators", "SELECT CAST(z AS INT) AS zoom, round(111319.49079327358e0 * (360e0 / (2e0 * (1 << z) * 8e0)) / 0.00028e0, 6) AS denominator FROM range(0, 12) t(z)")
def _(spark, sf):
    rows = [(z, GEO.pixel_size(z)) for z in range(12)]
    return spark.createDataFrame(rows, "zoom int, px double").select("zoom", F.round(scale_denominator(F.col("px")), 6).alias("denominator"))


@register("best_zoom", "SELECT CAST(k AS INT) AS k, CAST(greatest(ceil(log2(22.5e0 / (0.9e0 / k))) - 1, 0) AS INT) AS zoom FROM range(1, 40) t(k)")
def _(spark, sf):
    return spark.createDataFrame([(k, best_zoom(GEO, 0.9 / k)) for k in range(1, 40)], "k int, zoom int")


@register("input_hash", "SELECT c_custkey, sha256(c_name || '|' || c_mktsegment) AS hash FROM customer")
def _(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", F.sha2(F.concat_ws("|", "c_name", "c_mktsegment"), 256).alias("hash"))


# Events as a stream's rows

@register("tile_window_counts", f"WITH {TILED} SELECT CAST(row // 8 AS INT) AS row, CAST(col // 8 AS INT) AS col, date_trunc('day', ts) AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM tiled GROUP BY 1, 2, 3")
def _(spark, sf):
    p = tiles.assign(points(spark, sf), GEO, 2).groupBy("row", "col", F.date_trunc("day", "ts").alias("day"))
    return p.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@register("overview_refresh", f"WITH {PIX}, n AS (SELECT * REPLACE (CASE WHEN row = 3 AND col < 20 THEN value + 7 ELSE value END AS value) FROM pix) SELECT CAST(z AS INT) AS zoom, CAST((row * 8 + py) // (1 << (5 - z)) // 8 AS INT) AS row, CAST((col * 8 + px) // (1 << (5 - z)) // 8 AS INT) AS col, CAST((row * 8 + py) // (1 << (5 - z)) % 8 AS INT) AS py, CAST((col * 8 + px) // (1 << (5 - z)) % 8 AS INT) AS px, max(value) AS value FROM n, range(2, 5) t(z) WHERE row // (1 << (5 - z)) = 3 // (1 << (5 - z)) AND col // (1 << (5 - z)) <= 19 // (1 << (5 - z)) GROUP BY ALL")
def _(spark, sf):
    from gridloom.streaming.incremental import refreshed

    old = pixels(spark, sf)
    new = old.withColumn("value", F.when((F.col("row") == 3) & (F.col("col") < 20), F.col("value") + 7).otherwise(F.col("value")))
    changed = old.where("row = 3 AND col < 20").select("zoom", "row", "col").distinct()
    return refreshed(new, R.overviews(old, WIDTH, Z, 2, "max"), changed, WIDTH, Z, 2, "max").drop("band")


# Sources and sinks: what is written is read back

@register("tile_directory_round_trip", f"WITH {PIX} SELECT row, col, py, px, value FROM pix")
def _(spark, sf):
    return _round_trip(spark, sf)


def _round_trip(spark: SparkSession, sf: str) -> DataFrame:
    from gridloom.sources.paths import work_path
    from gridloom.sources.readers import TileDirectory
    from gridloom.sources.sinks import write_metadata, write_tiles

    path = work_path(spark, "tiles")
    write_metadata(spark, path, GEO, {"format": "Parquet"})
    write_tiles(packed(spark, sf), path)
    return R.to_long(TileDirectory(spark, path).read(Z)).select("row", "col", "py", "px", "value")


@register("geotiff_round_trip", f"WITH {FITTED} SELECT zoom, row, col, band, py, px, value FROM pix")
def _(spark, sf):
    return _geotiffs(spark, sf)


def _geotiffs(spark: SparkSession, sf: str) -> DataFrame:
    from gridloom.sources.paths import work_path
    from gridloom.sources.readers import raster_files, raster_to_tiles
    from gridloom.sources.sinks import write_images

    path, z = work_path(spark, "geotiff"), fitting_zoom(spark, sf)
    write_images(packed(spark, sf, z), path, GEO, "GTiff", nodata=-9999.0).write.format("noop").mode("overwrite").save()
    return raster_to_tiles(raster_files(spark, f"{path}/*/*/*.tif"), GEO, z)


@register("geojson_round_trip", f"WITH {BOX} SELECT n_nationkey, l, b, 600e0 AS area FROM box")
def _(spark, sf):
    from gridloom.sources.paths import work_path
    from gridloom.sources.readers import vector_files
    from gridloom.sources.sinks import write_geojson_tiles

    path = work_path(spark, "geojson")
    f = polygons(spark, sf).withColumns({"zoom": F.lit(0), "row": F.lit(0), "col": F.col("n_nationkey") % 2, "properties": F.create_map(F.lit("id"), F.col("n_nationkey").cast("string"))})
    write_geojson_tiles(f, path).write.format("noop").mode("overwrite").save()
    back = vector_files(spark, f"{path}/*/*/*")
    box = G.box(F.col("geom"))
    return back.select(F.col("properties")["id"].cast("int").alias("n_nationkey"), box["left"].alias("l"), box["bottom"].alias("b"), F.round(G.area(F.col("geom")), 6).alias("area"))


def _config(spark: SparkSession, sf: str, name: str, z: int = Z, **more) -> dict:
    from gridloom.sources.paths import work_path

    output = {"format": "Parquet", "path": work_path(spark, name), **more.pop("output", {})}
    return {"pyramid": {"grid": "geodetic", "tile_size": WIDTH}, "zoom_levels": {"min": z - 1, "max": z}, "process": _double_plus, "process_parameters": {"add": 1}, "input": {"dem": packed(spark, sf, z)}, "output": output, **more}


def _run(spark: SparkSession, config: dict) -> DataFrame:
    """The pixels of a run's output, read back from where it was written."""
    from gridloom.plans.engine import open_process

    p = open_process(spark, config, "overwrite")
    p.execute()
    return R.to_long(p.read().select("zoom", "row", "col", "band", "height", "width", "pixels")).where("value IS NOT NULL")


_BASE = f"WITH {FITTED}, base AS (SELECT row, col, py, px, value * 2 + 1 AS value FROM pix) SELECT z AS zoom, row, col, py, px, value FROM base, fit UNION ALL SELECT z - 1, CAST(row // 2 AS INT), CAST(col // 2 AS INT), CAST((row % 2 * 8 + py) // 2 AS INT), CAST((col % 2 * 8 + px) // 2 AS INT), max(value) FROM base, fit GROUP BY ALL"


@register("process_run", _BASE)
def _(spark, sf):
    z = fitting_zoom(spark, sf)
    return _run(spark, _config(spark, sf, "run", z, baselevels={"min": z, "max": z, "lower": "max"})).select("zoom", "row", "col", "py", "px", "value")


@register("run_geotiff", _BASE)
def _(spark, sf):
    z = fitting_zoom(spark, sf)
    config = _config(spark, sf, "run", z, baselevels={"min": z, "max": z, "lower": "max"}, output={"format": "GTiff", "dtype": "float64", "nodata": -99999})
    return _run(spark, config).select("zoom", "row", "col", "py", "px", "value")


def _gray(dem):
    return abs(dem.read()) % 256


@register("run_png", f"WITH {FITTED} SELECT row, col, py, px, CAST(b AS INT) AS band, CAST(abs(value) % 256 AS DOUBLE) AS value FROM pix, range(1, 4) t(b)")
def _(spark, sf):
    z = fitting_zoom(spark, sf)
    config = _config(spark, sf, "run", z, zoom_levels=z, process=_gray, process_parameters={}, output={"format": "PNG"})
    return _run(spark, config).select("row", "col", "py", "px", "band", "value")


_SHADED = _FOCAL.replace(PIX, FITTED).replace("/ 8e0", f"/ {SPAN}").replace("/ -8e0", f"/ -{SPAN}")


@register("run_hillshade", _SHADED + ", s AS (SELECT row, col, py, px, 1.5707963267948966e0 - atan(sqrt(x * x + y * y)) AS sl, atan2(x, y) AS asp FROM g), h AS (SELECT row, col, py, px, trunc(greatest(least(255e0 * (sin(radians(45e0)) * sin(sl) + cos(radians(45e0)) * cos(sl) * cos(radians(225e0) - asp)), 255e0), 1e0)) AS shade FROM s) SELECT a.row, a.col, a.py, a.px, CAST(h.shade AS DOUBLE) AS value FROM (SELECT DISTINCT row, col, py, px FROM pix) a JOIN h ON h.row = a.row AND h.col = a.col AND h.py = least(greatest(a.py, 1), 6) AND h.px = least(greatest(a.px, 1), 6) WHERE h.shade < 255")
def _(spark, sf):
    """The built-in process by name, as black under the shade's alpha: a full shade has none and is no data."""
    z = fitting_zoom(spark, sf)
    config = _config(spark, sf, "run", z, zoom_levels=z, process="hillshade", process_parameters={}, output={"format": "PNG_hillshade"})
    return _run(spark, config).select("row", "col", "py", "px", "value")


@register("run_geojson", f"WITH {TILED} SELECT row, col, count(*) AS n, round(sum(lon), 6) AS x FROM tiled GROUP BY row, col")
def _(spark, sf):
    from gridloom.plans.engine import open_process

    ring = F.array(F.array(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y"))))
    f = tiles.assign(points(spark, sf), GEO, Z).select("zoom", "row", "col", F.struct(F.lit("Point").alias("type"), ring.alias("rings"), F.array(F.lit(0)).alias("part")).alias("geom"), F.create_map(F.lit("id"), F.col("event_id").cast("string")).alias("properties"))
    config = _config(spark, sf, "run", zoom_levels=5, process=_same, process_parameters={}, input={"inp": f}, output={"format": "GeoJSON", "schema": {"geometry": "Point"}})
    p = open_process(spark, config, "overwrite")
    p.execute()
    return p.read(5).groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("geom.rings")[0][0]["x"]), 6).alias("x"))


@register("run_higher_bilinear", f"WITH {FITTED}, o AS (SELECT value * 2 + 1 AS value, row * 8 + py AS y, col * 8 + px AS x FROM pix), f AS (SELECT value, 2 * y + i AS ty, (2 * x + j + 16 * w) % (16 * w) AS tx, greatest(0e0, 1e0 - abs((i + 0.5e0) / 2 - 0.5e0)) * greatest(0e0, 1e0 - abs((j + 0.5e0) / 2 - 0.5e0)) AS k FROM o, fit, range(-1, 3) a(i), range(-1, 3) b(j)), own AS (SELECT DISTINCT row AS r, col AS c FROM pix) SELECT CAST(ty // 8 AS INT) AS row, CAST(tx // 8 AS INT) AS col, CAST(ty % 8 AS INT) AS py, CAST(tx % 8 AS INT) AS px, round(sum(value * k) / sum(k), 5) AS value FROM f JOIN own ON r = ty // 16 AND c = tx // 16 WHERE k <> 0 AND ty >= 0 GROUP BY ty, tx")
def _(spark, sf):
    z = fitting_zoom(spark, sf)
    config = _config(spark, sf, "run", z, zoom_levels={"min": z, "max": z + 1}, baselevels={"min": z, "max": z, "higher": "bilinear"})
    return _run(spark, config).where(F.col("zoom") == z + 1).select("row", "col", "py", "px", F.round("value", 5).alias("value"))


@register("tile_directory_fallback", f"WITH {PIX}, n AS (SELECT * FROM pix WHERE label % 2 = 0), low AS (SELECT row // 2 AS row, col // 2 AS col, (row % 2 * 8 + py) // 2 AS py, (col % 2 * 8 + px) // 2 AS px, max(value) AS value FROM pix GROUP BY ALL), k AS (SELECT row * 16 + py * 2 + i AS y, col * 16 + px * 2 + j AS x, value FROM low, range(2) a(i), range(2) b(j)), u AS (SELECT CAST(y // 8 AS INT) AS row, CAST(x // 8 AS INT) AS col, CAST(y % 8 AS INT) AS py, CAST(x % 8 AS INT) AS px, value FROM k) SELECT row, col, py, px, value FROM n UNION ALL SELECT u.row, u.col, u.py, u.px, u.value FROM u ANTI JOIN n ON u.row = n.row AND u.col = n.col WHERE u.value IS NOT NULL")
def _(spark, sf):
    """Tiles with an even label at zoom 5, the others from zoom 4."""
    from gridloom.sources.paths import work_path
    from gridloom.sources.readers import TileDirectory
    from gridloom.sources.sinks import write_metadata, write_tiles

    path = work_path(spark, "tiles")
    write_metadata(spark, path, GEO, {"format": "Parquet"})
    even = read(spark, sf, "embeddings").where("label % 2 = 0").select(F.expr("CAST(vec_id DIV 64 AS INT)").alias("row"), F.expr("CAST(vec_id % 64 AS INT)").alias("col"))
    write_tiles(packed(spark, sf).join(even, ["row", "col"], "left_semi"), path)
    low = R.to_packed(R.overview(pixels(spark, sf), WIDTH, "max"), WIDTH, WIDTH)
    write_tiles(low.select(packed(spark, sf).columns), path)
    return R.to_long(TileDirectory(spark, path).read(Z, fallback=True)).where("value IS NOT NULL").select("row", "col", "py", "px", "value")


@register("tile_directory_other_pyramid", f"WITH {PIX}, g AS (SELECT row * 8 + py AS y, col * 8 + px AS x, value FROM pix) SELECT CAST(y // 16 AS INT) AS row, CAST(x // 16 AS INT) AS col, CAST(y % 16 AS INT) AS py, CAST(x % 16 AS INT) AS px, value FROM g")
def _(spark, sf):
    """The directory's tiles of 8 pixels read as tiles of 16: its zoom 5 has the pixels of the other's zoom 4."""
    from gridloom.sources.paths import work_path
    from gridloom.sources.readers import TileDirectory
    from gridloom.sources.sinks import write_metadata, write_tiles

    path = work_path(spark, "tiles")
    write_metadata(spark, path, GEO, {"format": "Parquet"})
    write_tiles(packed(spark, sf), path)
    return TileDirectory(spark, path).read_for(Pyramid(GEODETIC, tile_size=16), 4).select("row", "col", "py", "px", "value")


@register("single_geotiff", f"WITH {PIX} SELECT y, x, value FROM (SELECT row * 8 + py AS y, col * 8 + px AS x, value FROM pix)")
def _(spark, sf):
    """All tiles as one file, read back."""
    from gridloom.sources.paths import work_path
    from gridloom.sources.readers import raster_files
    from gridloom.sources.sinks import write_single

    path = f"{work_path(spark, 'single')}/all.tif"
    write_single(packed(spark, sf), path, GEO, Z, nodata=-99999.0)
    return R.to_long(raster_files(spark, path)).where("value IS NOT NULL").select(F.col("py").cast("int").alias("y"), F.col("px").cast("int").alias("x"), "value").withColumns({"y": F.col("y").cast("int"), "x": F.col("x").cast("int")})


@register("tiles_removed", f"WITH {PIX} SELECT DISTINCT row, col FROM pix WHERE NOT (row < 16 AND col < 32)")
def _(spark, sf):
    """What is left when the tiles of the upper left quarter are removed."""
    from gridloom.functions.bounds import Bounds
    from gridloom.plans.commands import existing_within, rm
    from gridloom.sources.paths import work_path
    from gridloom.sources.sinks import write_metadata, write_tiles

    path = work_path(spark, "tiles")
    write_metadata(spark, path, GEO, {"format": "Parquet"})
    write_tiles(packed(spark, sf), path)
    rm(spark, path, Z, Bounds(-179.9, 0.1, -0.1, 89.9))
    return existing_within(spark, path).select("row", "col")


@register("reproject_utm", f"WITH {PTS} SELECT event_id, round(lon, 5) AS lon, round(lat, 5) AS lat FROM pts WHERE lon BETWEEN 12 AND 18 AND lat BETWEEN 0 AND 84")
def _(spark, sf):
    """Points of a UTM zone (the filter is the zone) there and back."""
    p = points(spark, sf).where("lon BETWEEN 12 AND 18 AND lat BETWEEN 0 AND 84")
    x, y = G.reproject_xy(F.col("lon"), F.col("lat"), "EPSG:4326", "EPSG:32633")
    there = p.select("event_id", x.alias("x"), y.alias("y"))
    lon, lat = G.reproject_xy(F.col("x"), F.col("y"), "EPSG:32633", "EPSG:4326")
    return there.select("event_id", F.round(lon, 5).alias("lon"), F.round(lat, 5).alias("lat"))


from gridloom.plans import overlays  # noqa: E402,F401  (registers its queries)
