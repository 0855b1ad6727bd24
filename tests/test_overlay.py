"""Polygon overlay: areas add up, concave inputs come apart, unions close over tile borders, buffers by closed forms."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions import geometry as G
from gridloom.functions import overlay as O
from gridloom.functions.pyramid import GEODETIC, Pyramid
from gridloom.operators import overlay, vector

GEO = Pyramid(GEODETIC, tile_size=8)
U = [[0, 0], [12, 0], [12, 12], [8, 12], [8, 4], [4, 4], [4, 12], [0, 12], [0, 0]]


def area(parts):
    return sum(abs(O.signed_area(p[0])) - sum(abs(O.signed_area(h)) for h in p[1:]) for p in parts)


def star(rng, n):
    a, r, c = np.sort(rng.random(n)) * 2 * np.pi, rng.random(n) + 0.2, rng.random(2)
    return [[np.stack((c[0] + r * np.cos(a), c[1] + r * np.sin(a)), axis=1)]]


def box(x, y, w, h):
    return [[np.array([[x, y], [x + w, y], [x + w, y + h], [x, y + h]], dtype=float)]]


def test_areas_add_up():
    """Random stars, a third of them on a coarse grid, so that edges touch and overlap."""
    rng = np.random.default_rng(3)
    for k in range(200):
        a, b = (star(rng, int(rng.integers(3, 40))) for _ in range(2))
        if k % 3 == 0:
            a, b = ([[np.rint(r * 4) for r in p] for p in g] for g in (a, b))
        a, b = O.repaired(a), O.repaired(b)
        i, u, d, e = O.intersection(a, b), O.union(a + b), O.difference(a, b), O.difference(b, a)
        assert area(a) + area(b) == pytest.approx(area(i) + area(u), abs=1e-6)
        assert area(a) == pytest.approx(area(i) + area(d), abs=1e-6) and area(u) == pytest.approx(area(i) + area(d) + area(e), abs=1e-6)
        assert area(O.repaired(u)) == pytest.approx(area(u), abs=1e-9) and area(O.intersection(d, b)) == pytest.approx(0, abs=1e-6)
        assert all(O.signed_area(p[0]) > 0 and all(O.signed_area(h) < 0 for h in p[1:]) for g in (i, u, d) for p in g)


def test_by_hand():
    assert [len(p) for p in O.difference(box(0, 0, 3, 3), box(1, 1, 1, 1))] == [2]
    assert len(O.intersection([[np.array(U[:-1], dtype=float)]], box(-1, 8, 20, 20))) == 2
    bow = O.repaired([[np.array([[0, 0], [2, 2], [2, 0], [0, 2]], dtype=float)]])
    assert len(bow) == 2 and area(bow) == 2 and area(O.repaired(bow)) == 2
    # Corners that touch stay apart; a hole that touches its ring is a hole.
    assert len(O.union(box(0, 0, 1, 1) + box(1, 1, 1, 1))) == 2
    touching = O.difference(box(0, 0, 4, 4), [[np.array([[0, 2], [2, 1], [2, 3]], dtype=float)]])
    assert [len(p) for p in touching] == [2] and area(touching) == 14
    four = O.union(box(0, 0, 1, 1) + box(1, 0, 1, 1) + box(0, 1, 1, 1) + box(1, 1, 1, 1))
    assert len(four) == 1 and area(four) == 4
    assert O.intersection(box(0, 0, 1, 1), box(1, 0, 1, 1)) == [] and O.union([]) == [] and O.overlay([[], []], lambda w: w[0] > 0) == []
    # A third isn't on the grid: points keep the coordinates they came with, crossings are computed from them.
    third = O.intersection(box(0, 0, 1 / 3, 1), box(0, 1 / 7, 1, 1))
    assert area(third) == pytest.approx(1 / 3 * 6 / 7, abs=1e-15)


def test_lines_cut():
    line = np.array([[-1, 0.5], [4, 0.5]], dtype=float)
    out = O.cut_line(line, box(0, 0, 1, 1) + box(2, 0, 1, 1), False)
    assert [x.tolist() for x in out] == [[[-1, 0.5], [0, 0.5]], [[1, 0.5], [2, 0.5]], [[3, 0.5], [4, 0.5]]]
    assert len(O.cut_line(np.array([[0.2, 0.5], [0.5, 0.5], [0.5, 3]]), box(0, 0, 1, 1), True)) == 1
    assert O.cut_line(line, [], True) == [] and len(O.cut_line(line, [], False)) == 1
    # Along an edge, and through a corner.
    assert sum(np.hypot(*np.diff(x, axis=0).T).sum() for x in O.cut_line(np.array([[-1.0, 0], [2, 0]]), box(0, 0, 1, 1), False)) in (2.0, 3.0)
    assert sum(np.hypot(*np.diff(x, axis=0).T).sum() for x in O.cut_line(np.array([[-1.0, -1], [2, 2]]), box(0, 0, 1, 1), True)) == pytest.approx(math.sqrt(2))


def test_buffers():
    circle = lambda d, k: 2 * k * d * d * math.sin(math.pi / (2 * k))
    assert area(O.buffered([], [np.array([[0.0, 0], [10, 0]])], 1.0, 8)) == pytest.approx(20 + circle(1, 8), abs=1e-6)
    assert area(O.buffered(box(0, 0, 4, 4), [], 1.0, 8)) == pytest.approx(16 + 16 + circle(1, 8), abs=1e-6)
    ring = O.buffered([], [np.array([[0.0, 0], [10, 0], [10, 10], [0, 10], [0, 0]])], 1.0, 8)
    assert len(ring) == 1 and len(ring[0]) == 2 and area(ring) == pytest.approx(100 + 40 + circle(1, 8) - 64, abs=1e-6)


def frame(spark, *shapes):
    return spark.createDataFrame([(i, None if s is None else G.from_geojson(s)) for i, s in enumerate(shapes)], "i int, geom struct<type:string,rings:array<array<struct<x:double,y:double>>>,part:array<int>>")


def polygon(*rings):
    return {"type": "Polygon", "coordinates": [list(map(list, r)) for r in rings]}


def square(x, y, s):
    return polygon([(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)])


def test_union_closes_over_tiles(spark):
    """Many overlapping squares in two groups, one with two thirds of all; pieces by tile don't overlap and come together without seams."""
    rng = random.Random(2)
    shapes = [square(rng.randint(-40, 40), rng.randint(-40, 40), rng.randint(1, 9)) for _ in range(300)]
    df = frame(spark, *shapes, None).withColumn("g", F.when(F.col("i") % 3 == 0, "a").otherwise("b")).repartition(5)
    want = {g: {(x, y) for i, s in enumerate(shapes) if (i % 3 == 0) == (g == "a") for (x0, y0), (x1, y1) in [(s["coordinates"][0][0], s["coordinates"][0][2])] for x in range(x0, x1) for y in range(y0, y1)} for g in "ab"}
    tiles = overlay.union_by_tile(df, GEO, 4, ["g"])
    assert {r["g"]: round(r["a"], 6) for r in tiles.groupBy("g").agg(F.sum(G.area(F.col("geom"))).alias("a")).collect()} == {g: len(c) for g, c in want.items()}
    whole = {r["g"]: r["geom"] for r in overlay.dissolved(df, GEO, 4, ["g"]).collect()}
    for g, cells in want.items():
        # A part for each group of cells that share sides.
        parts, left = 0, set(cells)
        while left:
            stack, parts = [left.pop()], parts + 1
            while stack:
                x, y = stack.pop()
                for n in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                    if n in left:
                        left.remove(n)
                        stack.append(n)
        assert len(set(whole[g]["part"])) == parts


def test_joins_of_areas(spark):
    left = frame(spark, square(0, 0, 10), square(50, 50, 1), {"type": "Point", "coordinates": [1, 1]}, None)
    right = frame(spark, polygon(U), square(-5, 5, 8), square(100, 0, 5))
    got = {(r["i"], r["r_i"]): r["a"] for r in overlay.intersections(left, right, GEO, 3).select("i", "r_i", G.area(F.col("geom")).alias("a")).collect()}
    assert got == {(0, 0): pytest.approx(76), (0, 1): pytest.approx(15)}
    rest = {r["i"]: r["a"] for r in overlay.differences(left, right, GEO, 3, ["i"]).select("i", G.area(F.col("geom")).alias("a")).collect()}
    assert rest == {0: pytest.approx(100 - 76), 1: pytest.approx(1)}


def test_clips_part_concave_polygons_and_lines(spark):
    scaled = [[x - 0.01, y + 0.01] for x, y in U]
    lines = {"type": "MultiLineString", "coordinates": [[[1, 20], [1, 10], [2, 10], [2, 20]], [[3, 12], [3, 30]]]}
    df = frame(spark, polygon(scaled), lines)
    tiles = vector.read_tiles(df, GEO, 4)
    parts = {(r["i"], r["row"], r["col"]): r["geom"] for r in tiles.collect()}
    upper = next(v for (i, row, col), v in parts.items() if i == 0 and col == 16 and row == 6)
    assert upper["type"] in ("Polygon", "MultiPolygon")
    box_ = F.struct(F.lit(0.0).alias("left"), F.lit(5.0).alias("bottom"), F.lit(20.0).alias("right"), F.lit(15.0).alias("top"))
    cut = {r["i"]: r["c"] for r in overlay.parted(df.withColumn("c", G.clipped(F.col("geom"), box_)).select("i", F.col("c").alias("geom"))).select("i", F.col("geom").alias("c")).collect()}
    assert cut[0]["type"] == "MultiPolygon" and sorted(set(cut[0]["part"])) == [0, 1]
    assert cut[1]["part"] == [0, 1] and cut[1]["type"] == "MultiLineString"
    low = F.struct(F.lit(0.0).alias("left"), F.lit(11.0).alias("bottom"), F.lit(20.0).alias("right"), F.lit(15.0).alias("top"))
    three = df.where("i = 1").select(G.clipped(F.col("geom"), low).alias("c")).first()["c"]
    assert three["part"] == [0, 1, 2]
    assert G.clip_geometry(G.from_geojson(lines), 0.0, 11.0, 20.0, 15.0)["part"] == [0, 1, 2]
    single = vector.exploded(spark.createDataFrame([(three.asDict(recursive=True),)], "geom struct<type:string,rings:array<array<struct<x:double,y:double>>>,part:array<int>>")).collect()
    assert [len(r["geom"]["rings"]) for r in single] == [1, 1, 1]


def test_repair_keeps_other_types(spark):
    df = frame(spark, polygon([(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)]), {"type": "Point", "coordinates": [1, 1]}, polygon([(0, 0), (1, 0), (2, 0), (0, 0)]), None)
    got = {r["i"]: r["geom"] for r in overlay.repaired(df).collect()}
    assert sorted(got) == [0, 1, 3] and got[0]["type"] == "MultiPolygon" and got[1]["type"] == "Point" and got[3] is None


def test_buffers_in_metres(spark):
    """A kilometre around a point, a line and a box, and over the antimeridian."""
    df = frame(spark, {"type": "Point", "coordinates": [15, 48]}, {"type": "LineString", "coordinates": [[15, 48], [15.1, 48]]}, square(15, 48, 0.1), {"type": "Point", "coordinates": [179.999, 10]}, None)
    got = {r["i"]: r["geom"] for r in overlay.buffered_metres(df, 1000.0, corners=16).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    metres = lambda g: sum(abs(O.signed_area(np.array([G.reproject_point(p["x"], p["y"], "EPSG:4326", "EPSG:32633") for p in r[:-1]]))) for r in g["rings"])
    circle = 64 * math.sin(math.pi / 32) / 2 * 1e6
    width = 0.1 * math.cos(math.radians(48)) * 111_320
    assert metres(got[0]) == pytest.approx(circle, rel=1e-3)
    assert metres(got[1]) == pytest.approx(circle + 2000 * width, rel=5e-3)
    assert metres(got[2]) > metres(got[1])
    assert got[3]["type"] == "MultiPolygon" and {p["x"] > 0 for r in got[3]["rings"] for p in r} == {True, False}


def test_cuts_stay_on_both_edges():
    """Edges along one line that rounding has turned a little: where they cross on the grid may be far from where their lines meet."""
    rng = np.random.default_rng(7)
    for _ in range(40):
        x = np.sort(rng.uniform(0, 11, (12, 2)), axis=1)
        ends = np.stack((x, 3 - x / 4 + rng.uniform(-3e-8, 3e-8, x.shape)), axis=2)
        grid = O._Grid([ends.reshape(-1, 2)])
        p, q = grid.places(ends[:, 0]), grid.places(ends[:, 1])
        found = O._split(p, q, grid)
        if found is not None:
            a, b, of = found
            low, high = np.minimum(p, q)[of] - 2, np.maximum(p, q)[of] + 2
            assert ((a >= low) & (a <= high) & (b >= low) & (b <= high)).all()


def test_what_rounding_leaves_is_no_area():
    box = np.array([[0.0, 0.0], [11.0, -2.75], [13.0, 1.25], [2.0, 4.0]])
    assert O.difference([[box]], [[box + [0.0, 6e-8]]]) == []
    assert O.difference([[box]], [[box + [0.0, 1e-5]]]) != []


def test_equal_shapes_are_overlaid_once_and_joined_to_all_rows(spark):
    corners = lambda x: [{"x": float(a), "y": float(b)} for a, b in ((x, 0), (x + 2, 0), (x + 2, 2), (x, 2), (x, 0))]
    g = lambda x: {"type": "Polygon", "rings": [corners(x)], "part": [0]}
    a = spark.createDataFrame([(i, g(0)) for i in range(3)], T.StructType([T.StructField("k", T.LongType()), T.StructField("geom", G.GEOMETRY)]))
    b = spark.createDataFrame([(i, g(1)) for i in range(2)], T.StructType([T.StructField("k", T.LongType()), T.StructField("geom", G.GEOMETRY)]))
    assert overlay.shape_intersections(a, b, Pyramid(), 4).count() == 1
    assert sorted((r["k"], r["r_k"]) for r in overlay.intersections(a, b, Pyramid(), 4).collect()) == [(i, j) for i in range(3) for j in range(2)]
    assert sorted(map(tuple, overlay.intersection_sums(a, b, Pyramid(), 4, ["k"]).collect())) == [(i, 2, 4.0) for i in range(3)]
    assert [r["k"] for r in overlay.differences(a, b, Pyramid(), 4, ["k"]).orderBy("k").collect()] == [0, 1, 2]
