from __future__ import annotations

import json
import math

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions import arrays
from gridloom.functions import geometry as G
from gridloom.sources import readers

SQUARE = {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]}


def frame(spark, *shapes):
    return spark.createDataFrame([(i, G.parse(s)) for i, s in enumerate(shapes)], T.StructType([T.StructField("i", T.IntegerType()), T.StructField("geom", G.GEOMETRY)]))


def test_round_trips():
    shapes = [{"type": "Point", "coordinates": [1.0, 0.0]}, {"type": "MultiPoint", "coordinates": [[0.0, 0.0], [1.0, 1.0]]}, {"type": "LineString", "coordinates": [[0.0, 0.0], [1.0, 1.0]]}, {"type": "MultiPolygon", "coordinates": [SQUARE["coordinates"], [[[2.0, 2.0], [3.0, 2.0], [3.0, 3.0], [2.0, 2.0]]]]}]
    for s in shapes:
        assert G.to_geojson(G.from_geojson(s)) == s
    assert G.to_geojson(G.from_wkt("MULTIPOINT ((0 0), (1 1))")) == shapes[1]
    with pytest.raises(ValueError):
        G.from_wkt("nothing")


def test_expressions(spark):
    hole = {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [1, 2], [2, 2], [2, 1], [1, 1]]]}
    g = F.col("geom")
    rows = frame(spark, SQUARE, hole).select(G.area(g).alias("a"), G.length(g).alias("l"), G.holds(g, F.lit(1.5), F.lit(1.5)).alias("h"), F.size(G.points(G.segmentized(g, 0.5))).alias("n")).collect()
    assert [r["a"] for r in rows] == [1.0, 15.0] and rows[0]["l"] == 4.0 and not rows[1]["h"] and rows[0]["n"] == 9


def test_parts_types_repair(spark):
    multi = {"type": "MultiPolygon", "coordinates": [SQUARE["coordinates"], [[[2, 2], [2, 3], [3, 3], [2, 2]]]]}
    g = F.col("geom")
    parts = frame(spark, multi).select(F.explode(G.singleparts(g)).alias("geom")).select(g, G.is_type(g, "MultiPolygon").alias("m"), G.is_type(g, "MultiPolygon", single=False).alias("s")).collect()
    assert len(parts) == 2 and all(p["geom"]["type"] == "Polygon" and p["m"] and not p["s"] for p in parts)
    fixed = frame(spark, multi).select(G.signed_area(G.repaired(g)["rings"][1]).alias("x")).first()["x"]
    assert fixed > 0


def test_reprojection_round_trip(spark):
    g = F.col("geom")
    back = frame(spark, {"type": "Point", "coordinates": [16.3, 48.2]}).select(G.to_latlon(G.to_mercator(g)).alias("geom")).first()["geom"]["rings"][0][0]
    assert abs(back["x"] - 16.3) < 1e-9 and abs(back["y"] - 48.2) < 1e-9
    x, y = G.utm_forward(15.5, 48.0, 33, False)
    assert math.dist(G.utm_inverse(x, y, 33, False), (15.5, 48.0)) < 1e-7
    assert G.utm_crs(1, 0) == "EPSG:32631"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-20, 20), st.integers(-20, 20)), min_size=3, max_size=3, unique=True))
def test_clip_keeps_area(corners):
    """Cuts to four quadrants add up to the triangle."""
    g = G.parse({"type": "Polygon", "coordinates": [[*map(list, corners), list(corners[0])]]})
    total = 0.0
    for l, b in ((-30, -30), (0, -30), (-30, 0), (0, 0)):
        part = G.clip_geometry(g, l, b, l + 30, b + 30)
        total += sum(abs(G.signed_area_of(r)) for r in part["rings"]) if part else 0
    assert abs(total - abs(G.signed_area_of(g["rings"][0]))) < 1e-6


def test_antimeridian():
    g = G.split_antimeridian(G.parse((175, 0, 185, 5)))
    xs = sorted(p["x"] for r in g["rings"] for p in r)
    assert g["type"] == "MultiPolygon" and xs[0] == -180 and xs[-1] == 180
    assert G.buffer_point_metres(179.99, 10, 5000)["type"] == "MultiPolygon"


def test_geometry_and_map_columns_as_values():
    kind = arrays.arrow(f"{readers.FEATURE}")
    ring = lambda *xy: [{"x": float(x), "y": float(y)} for x, y in xy]
    geoms = [{"type": "Point", "rings": [ring((1, 2))], "part": [0]}, None, {"type": "MultiLineString", "rings": [ring((0, 0), (1, 1)), ring((3, 4), (5, 6), (7, 8))], "part": [0, 1]}, {"type": "Point", "rings": None, "part": None}, {"type": "MultiPoint", "rings": [], "part": []}, {"type": "Point", "rings": [ring((9, 9))], "part": [0]}]
    maps = [[("id", "1")], None, [], [("a", None), ("b", "2")], [("c", "3")], [("d", "4")]]
    table = pa.table({"geom": pa.array(geoms, kind.field("geom").type), "properties": pa.array(maps, kind.field("properties").type)})
    for some in table, table.slice(1, 4), table.slice(2), table.slice(0, 0), pa.concat_tables([table, table.slice(1), table]), table.filter(pa.array([False, True, True, False, True, True])):
        assert arrays.geometries(some["geom"]) == some["geom"].to_pylist()
        assert arrays.maps(some["properties"]) == some["properties"].to_pylist()
        for g, m in zip(some["geom"].chunks, some["properties"].chunks):
            assert arrays.geometries(g) == g.to_pylist() and arrays.maps(m) == m.to_pylist()
    holed = pa.array([{"type": "Point", "rings": [None, ring((1, 2))], "part": [0, 0]}, {"type": "Point", "rings": [[None]], "part": [0]}], kind.field("geom").type)
    assert arrays.geometries(holed) == holed.to_pylist()


def test_a_large_file_of_features_goes_on_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "FEATURES", 2)
    features = [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [i, -i]} if i else None, "properties": {"i": i, "s": "x", "none": None}} for i in range(5)]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    got = {r["feature_id"]: r for r in readers.vector_files(spark, str(tmp_path)).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4] and got[0]["geom"] is None and got[4]["geom"]["rings"][0][0].asDict() == {"x": 4.0, "y": -4.0}
    assert got[3]["properties"] == {"i": "3", "s": "x", "none": None}
