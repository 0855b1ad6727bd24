from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gridloom.functions import bounds as B
from gridloom.functions.bounds import Bounds, snap
from gridloom.functions.pyramid import GEODETIC, MERCATOR, Pyramid, Tile, best_zoom, matching_zoom
from gridloom.functions.zooms import ZoomLevels
from gridloom.operators import tiles


@pytest.mark.parametrize("metatiling", [1, 2, 4, 8, 16])
def test_count_is_matrix_size(spark, metatiling):
    p = Pyramid(MERCATOR, metatiling=metatiling)
    for zoom in range(15):
        assert tiles.count_tiles(spark, p, p.grid.bounds, [zoom]) == {zoom: p.matrix_width(zoom) * p.matrix_height(zoom)}


def test_snap_and_buffer():
    assert tuple(snap(Bounds(15.0064, 47.7604, 16.4863, 48.7485), Pyramid(), 5)) == (11.25, 45.0, 16.875, 50.625)
    b = Pyramid(pixelbuffer=64).tile_bounds(8, 0, 0)
    assert (b.left, b.top) == (-180.17578125, 90.0)


@pytest.mark.parametrize("metatiling,buffer", [(1, 0), (2, 5), (4, 10)])
def test_snap_is_union_of_tiles(metatiling, buffer):
    p, b = Pyramid(metatiling=metatiling, pixelbuffer=buffer), Bounds(-180, -90, -60, -30)
    for zoom in (3, 4):
        r0, r1, c0, c1 = p.cell_range(zoom, b)
        found = None
        for r in range(r0, r1 + 1):
            for c in range(c0, c1 + 1):
                t = p.tile_bounds(zoom, r, c)
                found = t if found is None else found + t
        assert tuple(found) == tuple(snap(b, p, zoom))


def test_zoom_match():
    m, g = Pyramid(MERCATOR), Pyramid(GEODETIC)
    assert [matching_zoom(Tile(9, r, 10), m, g, "gdal") for r in (0, 256, 511)] == [9, 9, 9]
    assert [matching_zoom(Tile(9, r, 10), m, g, "min") for r in (0, 256, 511)] == [12, 9, 12]
    assert matching_zoom(Tile(9, 256, 10), g, m, "min") == 10
    assert best_zoom(Pyramid(), 0.7) == 0


def test_neighbors_wrap_and_end_at_poles():
    p = Pyramid()
    assert len(p.neighbors(Tile(5, 5, 5))) == 8 and len(p.neighbors(Tile(5, 5, 5), 4)) == 4
    assert Tile(5, 0, 63) in p.neighbors(Tile(5, 0, 0)) and all(t.row >= 0 for t in p.neighbors(Tile(5, 0, 0)))
    assert p.children(Tile(3, 1, 1)) == [Tile(4, 2, 2), Tile(4, 2, 3), Tile(4, 3, 2), Tile(4, 3, 3)]
    assert p.parent(Tile(0, 0, 0)) is None


def test_edges_are_clamped(spark):
    df = spark.createDataFrame([(180.0, -90.0), (-180.0, 90.0)], "lon double, lat double")
    rows = tiles.assign(df, Pyramid(), 2).collect()
    assert [(r["row"], r["col"]) for r in rows] == [(3, 7), (0, 0)]


def test_bounds():
    a = Bounds(-135, 60, -90, 80)
    assert a.intersects(Bounds(-90, 80, 0, 90)) and not a.intersects(Bounds(-89, 80, 0, 90))
    assert tuple(Bounds(0, 0, 1, 1) + Bounds(2, 2, 3, 3)) == (0, 0, 3, 3) and Bounds(0, 1, 1, 3).height == 2
    with pytest.raises(ValueError):
        Bounds(1, 0, 0, 1)


def test_bounds_columns(spark):
    row = spark.range(1).select(B.intersect(B.column(0, 0, 1, 1), B.column(1, 1, 2, 2)).alias("touch"), B.overlap(B.column(0, 0, 1, 1), B.column(1, 1, 2, 2)).alias("over")).first()
    assert row["touch"] and not row["over"]


def test_zoom_levels():
    for value in (4, [2, 4], [4, 2], [2, 3, 4], {"min": 2, "max": 4}):
        z = ZoomLevels.of(value)
        assert z.max == 4 and z.min in (2, 4)
    assert list(ZoomLevels.of([3, 7]).difference(ZoomLevels.of([5, 6]))) == [3, 4, 7]
    assert list(ZoomLevels.of([0, 5]).intersection(ZoomLevels.of([4, 9]))) == [4, 5]
    for value in ("x", -1, {"min": 3}, {"min": 4, "max": 3}, [0, 2, 5]):
        with pytest.raises(ValueError):
            ZoomLevels.of(value)


def test_wrap_over_antimeridian(spark):
    found = {(r["row"], r["col"]) for r in tiles.tiles_from_bounds(spark, Pyramid(), Bounds(175, 0, 185, 5), [3]).collect()}
    assert found == {(3, 15), (3, 0)}


def test_custom_grid():
    p = Pyramid.of({"grid": {"shape": [12200, 1000], "bounds": [66021, 0, 834021, 9369600], "crs": "EPSG:32633"}, "tile_size": 256})
    assert p.pixel_size(0) == 3.0 and p.matrix_height(0) == 12200
    assert Pyramid.of(p.to_dict()) == p
