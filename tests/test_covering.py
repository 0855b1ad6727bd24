"""Coverings against the plain way: cells of one zoom, exploded and tested one by one; rows of world-wide features are bounded."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from gridloom.functions import bounds as B
from gridloom.functions import geometry as G
from gridloom.functions.pyramid import Pyramid
from gridloom.operators import covering as C
from gridloom.operators import joins, tiles

GEO = Pyramid()
META = Pyramid(metatiling=4)
BOX = "box struct<left:double,bottom:double,right:double,top:double>"


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in [*points, points[0]]]


def polygon(*rings):
    return {"type": "Polygon", "rings": [ring(r) for r in rings], "part": [0] * len(rings)}


def star(rng, x, y, size):
    return [(x + size * rng.uniform(0.3, 1) * math.cos(a), y + size * rng.uniform(0.3, 1) * math.sin(a)) for a in (i * math.pi / 6 for i in range(12))]


def shapes(rng):
    out = [polygon(star(rng, rng.uniform(-150, 150), rng.uniform(-60, 60), rng.choice([0.3, 4, 30]))) for _ in range(12)]
    out.append(polygon([(-90, -45), (90, -45), (90, 45), (-90, 45)], [(-45, -22.5), (45, -22.5), (45, 22.5), (-45, 22.5)]))
    out.append({"type": "LineString", "rings": [[{"x": -100.0, "y": -50.0}, {"x": 120.0, "y": 70.0}, {"x": 0.0, "y": 0.0}]], "part": [0]})
    out.append({"type": "MultiPoint", "rings": [[{"x": 0.0, "y": 0.0}], [{"x": 33.3, "y": 12.0}]], "part": [0, 1]})
    return [*out, out[0]]


@pytest.fixture(scope="module")
def features(spark):
    rng = random.Random(7)
    return spark.createDataFrame([(i, g) for i, g in enumerate(shapes(rng))] + [(99, None)], "id int, geom " + G.GEOMETRY.simpleString())


def one_by_one(features, pyramid, zoom, exact):
    """Cells of the boxes at one zoom, each tested by expressions."""
    df = tiles.cells(features.where("geom IS NOT NULL").withColumn("box", G.box(F.col("geom"))), pyramid, zoom)
    if exact:
        df = df.where(tiles.meets(F.col("geom"), pyramid.box(zoom, F.col("row"), F.col("col"))))
    return df.select("row", "col").distinct()


@pytest.mark.parametrize("pyramid", [GEO, META], ids=["plain", "metatiles"])
@pytest.mark.parametrize("exact", [True, False])
def test_counts_and_tiles_are_those_of_single_cells(features, pyramid, exact):
    zooms = [1, 4, 5]
    want = {z: one_by_one(features, pyramid, z, exact) for z in zooms}
    got = {r.zoom: r.tiles for r in tiles.count_feature_tiles(features, pyramid, zooms, exact).collect()}
    assert got == {z: want[z].count() for z in zooms}
    at = {(r.row, r.col) for r in tiles.tiles_from_features(features, pyramid, 5, exact).collect()}
    assert at == {(r.row, r.col) for r in want[5].collect()}


def test_counts_of_a_world_wide_feature_make_few_rows(spark):
    world = spark.createDataFrame([(polygon([(-180, -90), (180, -90), (180, 90), (-180, 90)]),), (polygon([(-170, -80), (170, -80), (170, 80), (-170, 80)]),)], "geom " + G.GEOMETRY.simpleString())
    got = {r.zoom: r.tiles for r in tiles.count_feature_tiles(world, GEO, [12], False).collect()}
    assert got == {12: 2 * 4**12}
    assert C.covering(world, GEO, 12, exact=False).count() < 100_000
    assert C.polygon_cells(world, GEO, 20).groupBy("geom").count().agg(F.max("count")).first()[0] <= 2 * C.BUDGET


def boxes(rng, n, step=None):
    out = []
    for i in range(n):
        w = rng.choice([0.001, 0.2, 3, 40, 360])
        x, y = rng.uniform(-180, 180), rng.uniform(-90, 90)
        if step:
            x, y, w = round(x / step) * step, round(y / step) * step, max(step, round(w / step) * step)
        out.append((i, (x, y, x + w, y + w / 2)))
    return out


@pytest.mark.parametrize("step", [None, 5.625], ids=["random", "on cell edges"])
@pytest.mark.parametrize("touching", [True, False])
def test_range_join_of_boxes_of_all_sizes(spark, step, touching):
    rng = random.Random(3)
    a, b = boxes(rng, 150, step), boxes(rng, 120, step)
    meet = lambda p, q: (p[0] <= q[2] and q[0] <= p[2] and p[1] <= q[3] and q[1] <= p[3]) if touching else (p[0] < q[2] and q[0] < p[2] and p[1] < q[3] and q[1] < p[3])
    want = sorted((i, j) for i, p in a for j, q in b if meet(p, q))
    left, right = spark.createDataFrame(a, "i int, " + BOX), spark.createDataFrame(b, "j int, " + BOX)
    for zoom in (0, 7, 12):
        got = joins.range_join(left, right, GEO, zoom, touching=touching).select("i", "j").collect()
        assert sorted(map(tuple, got)) == want
    semi = joins.range_join(left, right, GEO, 9, how="left_semi", touching=touching)
    assert sorted(r.i for r in semi.collect()) == sorted({i for i, _ in want})
    anti = joins.range_join(left, right, GEO, 9, how="left_anti", touching=touching)
    assert sorted(r.i for r in anti.collect()) == sorted({i for i, _ in a} - {i for i, _ in want})


def test_range_join_with_nothing_and_with_null_boxes(spark):
    some = spark.createDataFrame([(1, (0.0, 0.0, 9.0, 9.0)), (2, None)], "i int, " + BOX)
    none = some.where("i > 5").withColumnRenamed("i", "j")
    assert joins.range_join(some, none, GEO, 8).count() == 0
    assert joins.range_join(none, some, GEO, 8).count() == 0
    assert [r.i for r in joins.range_join(some, none, GEO, 8, how="left_anti").orderBy("i").collect()] == [1, 2]
    assert joins.range_join(some, some, GEO, 8).count() == 1


def test_a_wide_box_makes_no_more_rows_than_its_levels_allow(spark):
    world = spark.createDataFrame([((-180.0, -90.0, 180.0, 90.0),)], BOX)
    assert C.level_cells(world, GEO, 20, "box").count() <= C.MOST
    tiny = spark.createDataFrame([((1.0, 1.0, 1.0001, 1.0001),)], BOX)
    assert C.level_cells(tiny, GEO, 20, "box").count() <= C.MOST * len(C.levels(20))


def test_points_in_boxes_and_polygons(spark, features):
    rng = random.Random(5)
    points = [(i, rng.uniform(-180, 180), rng.uniform(-90, 90)) for i in range(1500)] + [(5000, 0.0, -45.0), (5001, -90.0, 0.0), (5002, 10.0, 95.0), (5003, 22.5, 22.5)]
    pts = spark.createDataFrame(points, "p int, lon double, lat double")
    own = boxes(rng, 60, 5.625) + boxes(rng, 60)
    got = joins.points_in_boxes(pts, spark.createDataFrame(own, "i int, " + BOX), GEO, 9).select("p", "i").collect()
    assert sorted(map(tuple, got)) == sorted((p, i) for p, x, y in points for i, b in own if b[0] <= x < b[2] and b[1] <= y < b[3])
    want = pts.crossJoin(features.where("geom.type = 'Polygon'")).where(G.holds(F.col("geom"), F.col("lon"), F.col("lat")))
    for zoom in (4, 11):
        got = joins.points_in_polygons(pts, features.where("geom.type = 'Polygon'"), GEO, zoom).select("p", "id").collect()
        assert sorted(map(tuple, got)) == sorted((r.p, r.id) for r in want.collect())


def test_a_table_joined_with_itself_keeps_all_fields_of_its_boxes(spark):
    df = spark.range(3).select("id", B.column(F.col("id") * 10.0, F.col("id") * 1.0, F.col("id") * 10.0 + 12, F.col("id") + 5.0).alias("box"))
    pairs = joins.range_join(df, df, Pyramid(), 3).where("id < r_id")
    got = pairs.select("id", "r_id", F.greatest("box.left", "r_box.left"), F.least("box.top", "r_box.top")).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 10.0, 5.0), (1, 2, 20.0, 6.0)]
