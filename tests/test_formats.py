"""Formats of runs, base levels by hand, warps, clips, single files, removal, and inputs of other pyramids and projections."""

from __future__ import annotations

import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions import arrays
from gridloom.functions import geometry as G
from gridloom.functions import raster as R
from gridloom.functions.bounds import Bounds
from gridloom.functions.pyramid import GEODETIC, MERCATOR, Affine, Pyramid
from gridloom.operators import process, vector
from gridloom.plans import commands
from gridloom.plans.config import ProcessConfig
from gridloom.plans.engine import open_process
from gridloom.sources import formats, images, readers, sinks
from gridloom.sources.paths import Location

P4 = Pyramid(GEODETIC, tile_size=4)


def twice(dem, add=0):
    return process.EMPTY if dem.is_empty() else dem.read() * 2 + add


@pytest.fixture
def raster(tmp_path):
    """16 x 16 pixels over the upper left eighth of the map."""
    path = tmp_path / "dem.tif"
    path.write_bytes(images.write_geotiff(np.arange(1, 257, dtype=float).reshape(1, 16, 16), Affine(5.625, 0.0, -180.0, 0.0, -5.625, 90.0), "EPSG:4326", -1))
    return str(path)


def config(raster, out, form, **more):
    return {"pyramid": {"grid": "geodetic", "tile_size": 4}, "zoom_levels": {"min": 2, "max": 3}, "bounds": [-180, 0, -90, 90], "process": twice, "input": {"dem": raster}, "output": {"format": form, "path": str(out)}, "process_parameters": {"add": 1}, **more}


def grid(df, n, zoom, width=4, band=1):
    out = np.full((n, n), np.nan)
    for r in R.to_long(df.select("zoom", "row", "col", "band", "height", "width", "pixels")).where(f"zoom = {zoom} AND band = {band}").collect():
        out[r["row"] * width + r["py"], r["col"] * width + r["px"]] = np.nan if r["value"] is None else r["value"]
    return out


# Formats

@pytest.mark.parametrize(("form", "ending"), [("GTiff", "tif"), ("Parquet", None), ("PNG", "png"), ("PNG_hillshade", "png")])
def test_a_run_writes_its_format(spark, tmp_path, raster, form, ending):
    out = tmp_path / "out"
    cfg = config(raster, out, form, baselevels={"min": 3, "max": 3, "lower": "max"}, process=lambda dem: dem.read() % 200, process_parameters={})
    if form == "GTiff":
        cfg["output"] |= {"dtype": "int16", "nodata": -1}
    open_process(spark, cfg, "overwrite").execute()
    want = np.arange(1, 257).reshape(16, 16) % 200
    files = sorted(str(p.relative_to(out)) for p in out.rglob("*.*") if not p.name.startswith((".", "_")) and p.name != "metadata.json")
    if ending:
        assert len(files) == 16 + 4 and all(f.endswith(ending) for f in files) and files[0] == f"2/0/0.{ending}"
    again = open_process(spark, str(out), "readonly")
    assert again.config.output["format"] == form == json.loads((out / "metadata.json").read_text())["driver"]["format"]
    assert np.array_equal(grid(again.read(3), 16, 3), want) and again.existing().count() == 20
    assert np.array_equal(grid(again.read(2), 8, 2), want.reshape(8, 2, 8, 2).max(axis=(1, 3)))
    seen = []
    open_process(spark, cfg, "continue", observers=[lambda what, more: seen.append(what)]).execute()
    assert "zoom" not in seen and "overview" not in seen


def test_unknown_formats_are_errors(spark, tmp_path, raster):
    with pytest.raises(ValueError, match="no writer"):
        open_process(spark, config(raster, tmp_path / "x", "FlatGeobuf"), "overwrite").execute()
    assert not (tmp_path / "x").exists()


def test_tiles_that_become_empty_lose_their_files(spark, tmp_path, raster):
    out = tmp_path / "out"
    open_process(spark, config(raster, out, "GTiff"), "overwrite").execute()
    assert (out / "3/0/0.tif").exists()
    open_process(spark, config(raster, out, "GTiff", process=lambda dem: np.ma.masked_less(dem.read(), 129), process_parameters={}), "overwrite").execute()
    assert not (out / "3/0/0.tif").exists() and (out / "3/3/3.tif").exists()


def test_tiles_are_held_in_their_type():
    got = sinks.in_type(np.array([[-5.0, 300.0, np.nan, 7.9]]), "uint8", 0)
    assert got.tolist() == [[0, 255, 0, 7]] and got.dtype == np.uint8


@pytest.mark.parametrize("form", ["GTiff", "Parquet"])
def test_copy_and_remove(spark, tmp_path, raster, form):
    out, other = str(tmp_path / "out"), str(tmp_path / "copy")
    open_process(spark, config(raster, out, form, zoom_levels=3), "overwrite").execute()
    assert commands.cp(spark, out, other, bounds=Bounds(-180, 45, -135, 90)) == 4 and commands.cp(spark, out, other) == 12
    assert np.array_equal(grid(open_process(spark, other, "readonly").read(3), 16, 3), np.arange(1, 257).reshape(16, 16) * 2 + 1)
    assert commands.rm(spark, other, 3, Bounds(-179, 46, -136, 89)) == 4 and commands.rm(spark, other, 3, Bounds(-179, 1, -91, 44)) == 8
    left = {(r["row"], r["col"]) for r in commands.existing_within(spark, other).collect()}
    assert left == {(0, 2), (0, 3), (1, 2), (1, 3)}


def test_a_failed_removal_loses_nothing(spark, tmp_path, raster, monkeypatch):
    out = str(tmp_path / "out")
    open_process(spark, config(raster, out, "Parquet", zoom_levels=3), "overwrite").execute()

    def fails(*_, **__):
        raise OSError("no space")

    with monkeypatch.context() as m:
        m.setattr(sinks, "write_tiles", fails)
        with pytest.raises(OSError, match="no space"):
            commands.rm(spark, out, 3, Bounds(-179, 46, -136, 89))
    assert open_process(spark, out, "readonly").existing().count() == 16


def test_rows_wider_than_a_task(spark, tmp_path):
    """One row of 300 tiles is dealt out, written, replaced in part and read back."""
    p = Pyramid(GEODETIC, tile_size=2)
    df = spark.range(300).select(F.lit(8).alias("zoom"), F.lit(3).alias("row"), F.col("id").cast("int").alias("col"), F.lit(1).alias("band"), F.lit(2).alias("height"), F.lit(2).alias("width"), F.array_repeat(F.col("id").cast("double"), 4).alias("pixels"))
    path = str(tmp_path / "wide")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_tiles(df, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "wide/zoom=8/row=3").glob("*.parquet"))) > 1
    sinks.write_tiles(df.where("col = 7").withColumn("pixels", F.array_repeat(F.lit(-1.0), 4)), path, replaced=df.where("col IN (7, 8)"))
    got = {r["col"]: r["pixels"][0] for r in sinks.tile_rows(spark, path).collect()}
    assert len(got) == 299 and got[7] == -1.0 and got[9] == 9.0 and 8 not in got and p


def test_single_file_by_tasks(spark, tmp_path):
    """Tiles with a gap, two bands and a narrow type."""
    rows = [(3, r, c, b, 4, 4, [float(100 * b + 10 * r + c + i) if i else None for i in range(16)]) for r in (1, 2) for c in (0, 1, 3) for b in (1, 2)]
    df = spark.createDataFrame(rows, "zoom int, row int, col int, band int, height int, width int, pixels array<double>").repartition(5)
    path = tmp_path / "one.tif"
    sinks.write_single(df, str(path), P4, 3, "int16", -1)
    got, meta = images.read_geotiff(path.read_bytes())
    assert got.shape == (2, 8, 16) and meta["nodata"] == -1 and meta["affine"].c == -180 and meta["affine"].f == 67.5
    assert (got[:, :, 8:12] == -1).all() and got[1, 5, 14] == 200 + 20 + 3 + 6 and got[0, 0, 0] == -1
    assert not list(tmp_path.glob("*.parts")) and not list(tmp_path.glob("*.part"))
    with pytest.raises(ValueError):
        sinks.write_single(df, str(path), P4, 4)


def test_64_bit_headers():
    head = images.tiled_start(8, 8, 4, 1, np.dtype("u1"), Affine(1, 0, 0, 0, -1, 8), "EPSG:3857", 0, [5 << 30, 1, 1, 1], [0, 5 << 30, 0, 0])
    h = images.geotiff_header(head)
    assert h[images.TILE_BYTES][0] == 5 << 30 and h[images.TILES][1] == len(head) + (5 << 30) and images.geotiff_place(head)[1] == "EPSG:3857"


def test_boxes_read_headers_only(spark, tmp_path, raster, monkeypatch):
    found = readers.raster_boxes(spark, raster).first()
    assert (found["crs"], found["box"]["left"], found["box"]["bottom"]) == ("EPSG:4326", -180.0, 0.0)
    monkeypatch.setattr(readers, "HEAD", 64)
    assert readers.raster_boxes(spark, raster).first()["box"]["top"] == 90.0
    assert readers.raster_files(spark, [raster, str(tmp_path / "none.tif")], skip_missing=True).count() == 1
    assert readers.raster_files(spark, [str(tmp_path / "none.tif")], skip_missing=True).count() == 0


# Base levels

def lower_by_hand(a, method):
    """Half as fine by a kernel twice as wide, weights of what is there."""
    def weight(d):
        d = abs(d)
        if method == "bilinear":
            return max(0.0, 1 - d)
        return 1.5 * d**3 - 2.5 * d**2 + 1 if d < 1 else -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2 if d < 2 else 0.0

    w = np.array([[weight((s + 0.5) / 2 - (t + 0.5)) for s in range(len(a))] for t in range(len(a) // 2)])
    k = np.outer(w.sum(axis=1), w.sum(axis=1))
    return w @ a @ w.T / k


@pytest.mark.parametrize("method", ["bilinear", "cubic"])
def test_lower_levels_by_kernels(spark, tmp_path, raster, method):
    cfg = config(raster, tmp_path / "out", "GTiff", zoom_levels={"min": 1, "max": 3}, baselevels={"min": 3, "max": 3, "lower": method})
    p = open_process(spark, cfg, "overwrite")
    p.execute()
    want = lower_by_hand(np.arange(1, 257).reshape(16, 16) * 2.0 + 1, method)
    assert np.allclose(grid(p.read(2), 8, 2), want) and np.allclose(grid(p.read(1), 4, 1), lower_by_hand(want, method))
    # A tile made anew changes its neighbours' overviews, too, and no others are written.
    commands.rm(spark, str(tmp_path / "out"), 3, Bounds(-179, 80, -170, 89))
    seen = []
    cfg["process_parameters"] = {"add": 1}
    open_process(spark, cfg, "continue", observers=[lambda what, more: seen.append((what, more.get("zoom")))]).execute()
    assert [s for s in seen if s[1]] == [("zoom", 3), ("overview", 2), ("overview", 1)]
    assert np.allclose(grid(p.read(2), 8, 2), want)


def test_finer_levels_are_not_made_again(spark, tmp_path, raster):
    cfg = config(raster, tmp_path / "out", "GTiff", zoom_levels={"min": 3, "max": 5}, baselevels={"min": 3, "max": 3})
    open_process(spark, cfg, "overwrite").execute()
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "out").glob("[45]/*/*.tif")}
    commands.rm(spark, str(tmp_path / "out"), 4, Bounds(-179.9, 85, -175, 89.9))
    open_process(spark, cfg, "continue").execute()
    after = {p: p.stat().st_mtime_ns for p in before}
    assert len(before) == 64 + 256 and [str(p.relative_to(tmp_path / "out")) for p in before if before[p] != after[p]] == ["4/0/0.tif"]


# Inputs of other pyramids and projections

def test_inputs_of_other_pyramids(spark, tmp_path, raster):
    out = str(tmp_path / "tiles")
    open_process(spark, config(raster, out, "GTiff", zoom_levels=3, process_parameters={}), "overwrite").execute()
    want = np.arange(1, 257).reshape(16, 16) * 4
    same = open_process(spark, config(out, tmp_path / "a", "GTiff", zoom_levels=3, process_parameters={}), "memory").execute()
    assert np.array_equal(grid(same, 16, 3), want)
    # Tiles of 8 pixels: the directory's zoom 3 has the pixels of zoom 2.
    cfg = config({"path": out}, tmp_path / "b", "GTiff", zoom_levels=2, process_parameters={}) | {"pyramid": {"grid": "geodetic", "tile_size": 8}}
    assert np.array_equal(grid(open_process(spark, cfg, "memory").execute(), 16, 2, 8), want)
    # A zoom that the directory lacks is resampled from the one it has.
    coarse = open_process(spark, config({"path": out, "resampling": "max"}, tmp_path / "c", "GTiff", zoom_levels=4, process_parameters={}), "memory").execute()
    assert np.array_equal(grid(coarse, 32, 4), np.repeat(np.repeat(want, 2, 0), 2, 1))


def test_process_files_as_inputs(spark, tmp_path, raster):
    (tmp_path / "first.py").write_text("def execute(dem):\n    return dem.read() * 3\n")
    cfg = config(raster, tmp_path / "first", "GTiff", zoom_levels=3, process="first.py", process_parameters={})
    Location(str(tmp_path / "first.yml"), spark).write_yaml(cfg)
    open_process(spark, str(tmp_path / "first.yml"), "overwrite").execute()
    second = open_process(spark, config(str(tmp_path / "first.yml"), tmp_path / "second", "GTiff", zoom_levels=3, process_parameters={}), "memory").execute()
    assert np.array_equal(grid(second, 16, 3), np.arange(1, 257).reshape(16, 16) * 6)


@pytest.mark.parametrize("method", ["nearest", "bilinear", "average"])
def test_rasters_in_another_projection(spark, tmp_path, method):
    """A Web Mercator raster whose values are its pixels' longitudes, read by a geodetic process."""
    n, left, step = 64, -4_000_000.0, 125_000.0
    lon = np.degrees((left + (np.arange(n) + 0.5) * step) / G.RADIUS)
    path = tmp_path / "m.tif"
    path.write_bytes(images.write_geotiff(np.broadcast_to(lon, (1, n, n)).copy(), Affine(step, 0, left, 0, -step, 4_000_000.0), "EPSG:3857", -999))
    p = Pyramid(GEODETIC, tile_size=64)
    got = readers.warped_to_tiles(readers.raster_files(spark, str(path)), p, 1, method).where("value IS NOT NULL").collect()
    px = p.pixel_size(1)
    assert len(got) > 500
    for r in got:
        x = -180 + (r["col"] * 64 + r["px"] + 0.5) * px
        assert abs(r["value"] - x) <= (0.6 if method == "bilinear" else px)
    cfg = {"pyramid": {"grid": "geodetic", "tile_size": 64}, "zoom_levels": 1, "process": "passthrough", "input": {"dem": {"path": str(path), "resampling": method}}, "output": {"format": "GTiff", "path": str(tmp_path / "o")}}
    assert open_process(spark, cfg, "memory").process_tiles(1).count() == 4
    assert not open_process(spark, cfg, "memory").execute().isEmpty()


@settings(max_examples=40, deadline=None)
@given(st.floats(-179, 179), st.floats(-80, 80))
def test_formulas_agree(lon, lat):
    crs = G.utm_crs(lat, lon)
    for there in ("EPSG:3857", crs):
        x, y = G.reproject_point(lon, lat, "EPSG:4326", there)
        back = G.reproject_point(x, y, there, "EPSG:4326")
        assert math.dist(back, (lon, lat)) < 1e-6


def test_columns_agree_with_numbers(spark):
    points = [(16.3, 48.2), (12.5, -33.0), (17.9, 0.5), (-70.0, 12.0)]
    for lon, lat in points:
        crs = G.utm_crs(lat, lon)
        x, y = G.reproject_xy(F.lit(lon), F.lit(lat), "EPSG:4326", crs)
        got = spark.range(1).select(x, y).first()
        assert math.dist(tuple(got), G.reproject_point(lon, lat, "EPSG:4326", crs)) < 1e-6
    with pytest.raises(ValueError):
        G.reproject_xy(F.lit(0), F.lit(0), "EPSG:4326", "EPSG:2154")


# Features

def frame(spark, *shapes):
    return spark.createDataFrame([(i, G.parse(s)) for i, s in enumerate(shapes)], T.StructType([T.StructField("i", T.IntegerType()), T.StructField("geom", G.GEOMETRY)]))


def test_clips_by_expressions_equal_plain_python(spark):
    import random

    rng = random.Random(5)
    ring = lambda n: [[rng.uniform(-20, 20), rng.uniform(-20, 20)] for _ in range(n)]
    closed = lambda n: (lambda r: [*r, r[0]])(ring(n))
    shapes = []
    for _ in range(40):
        shapes += [{"type": "Polygon", "coordinates": [closed(rng.randrange(3, 8))]}, {"type": "LineString", "coordinates": ring(rng.randrange(2, 9))}, {"type": "MultiLineString", "coordinates": [ring(3), ring(4)]}, {"type": "MultiPolygon", "coordinates": [[closed(3)], [closed(4), closed(3)]]}, {"type": "Point", "coordinates": ring(1)[0]}, {"type": "MultiPoint", "coordinates": ring(4)}]
    shapes += [{"type": "Polygon", "coordinates": [[[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]]]}, {"type": "LineString", "coordinates": [[-10, 0], [20, 0], [20, 5], [0, 5]]}, {"type": "LineString", "coordinates": [[-9, -9], [-8, -8]]}]
    box = F.struct(*[F.lit(v).alias(n) for n, v in zip(("left", "bottom", "right", "top"), (0.0, -5.0, 12.0, 9.0))])
    got = {r["i"]: r["c"] for r in frame(spark, *shapes).select("i", G.clipped(F.col("geom"), box).alias("c")).collect()}
    hits = 0
    for i, s in enumerate(shapes):
        want = G.clip_geometry(G.parse(s), 0.0, -5.0, 12.0, 9.0)
        if want is None:
            assert got[i] is None
            continue
        hits += 1
        found = got[i].asDict(recursive=True)
        assert found["type"] == want["type"] and found["part"] == want["part"], s
        for a, b in zip(found["rings"], want["rings"]):
            assert np.allclose([(p["x"], p["y"]) for p in a], [(p["x"], p["y"]) for p in b])
    assert hits > 80


def test_collections_are_resolved(spark):
    both = {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [1, 1]}, {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}, {"type": "LineString", "coordinates": [[0, 0], [2, 2]]}]}
    df = frame(spark, both, {"type": "Point", "coordinates": [5, 5]}, {"type": "MultiPoint", "coordinates": [[1, 2], [3, 4]]})
    kinds = lambda d: sorted(r["geom"]["type"] for r in d.collect())
    assert kinds(vector.of_type(df, "Polygon")) == ["Polygon"] and kinds(vector.of_type(df, "Point")) == ["MultiPoint", "Point", "Point"]
    assert kinds(vector.of_type(df, "Point", allow_multi=False)) == ["Point"] * 4
    with pytest.raises(Exception, match="not allowed"):
        vector.checked_types(df, ["Point"]).collect()
    assert vector.in_bounds(df, Bounds(4, 4, 6, 6)).count() == 1


def test_reprojection_cuts_to_the_projection(spark):
    df = frame(spark, {"type": "Polygon", "coordinates": [[[0, 80], [10, 80], [10, 89], [0, 89], [0, 80]]]}, {"type": "Point", "coordinates": [1, 1]})
    got = vector.reprojected(df, "EPSG:4326", "EPSG:3857").where("i = 0").select(G.box(F.col("geom")).alias("b")).first()["b"]
    assert got["top"] == pytest.approx(G.latlon_to_mercator(0, G.crs_bounds("EPSG:3857")[3])[1])
    with pytest.raises(Exception, match="outside the bounds"):
        vector.reprojected(df, "EPSG:4326", "EPSG:3857", error_on_clip=True).collect()
    back = vector.reprojected(vector.reprojected(df.where("i = 1"), "EPSG:4326", "EPSG:32631"), "EPSG:32631", "EPSG:3857")
    assert back.first()["geom"]["rings"][0][0]["x"] == pytest.approx(G.latlon_to_mercator(1, 1)[0], abs=1e-3)
    dense = vector.reprojected(df.where("i = 0"), "EPSG:4326", "EPSG:3857", segmentize=1.0).select(F.size(G.points(F.col("geom"))).alias("n")).first()["n"]
    assert dense > 20


def test_distances(spark):
    square = {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]]}
    at = lambda x, y: frame(spark, square).select(G.distance(F.col("geom"), F.lit(x), F.lit(y))).first()[0]
    assert at(7.0, 8.0) == 5.0 and at(2.0, -3.0) == 3.0 and at(2.0, 2.0) == 2.0 and at(4.0, 1.0) == 0.0


# Built-in processes by name

def test_built_in_processes_by_name(spark, tmp_path, raster):
    value = np.arange(1, 257).reshape(16, 16).astype(float)
    run = lambda name, **more: open_process(spark, config(raster, tmp_path / "o", more.pop("form", "GTiff"), zoom_levels=3, process=name, process_parameters=more.pop("params", {}), **more), "memory").execute()
    assert np.array_equal(grid(run("passthrough"), 16, 3), value)
    assert np.array_equal(grid(run("convert", params={"scale_ratio": 2.0, "scale_offset": 1.0, "clip_to_output_dtype": "uint8"}), 16, 3), np.minimum((value + 1) * 2, 255))
    shade = grid(run("hillshade", pyramid={"grid": "geodetic", "tile_size": 4, "pixelbuffer": 1}), 16, 3)
    inner = shade[1:-1, 1:-1]
    assert len(np.unique(inner)) == 1 and not np.isnan(inner).any()
    half = frame(spark, {"type": "Polygon", "coordinates": [[[-180, 0], [-135, 0], [-135, 90], [-180, 90], [-180, 0]]]})
    cut = grid(run("clip", input={"dem": raster, "clip": half}), 16, 3)
    assert np.isnan(cut[:, 8:]).all() and np.array_equal(cut[:, :8], value[:, :8])
    wider = grid(run("clip", input={"dem": raster, "clip": half}, params={"clip_pixelbuffer": 1}), 16, 3)
    assert np.array_equal(wider[:, :9], value[:, :9]) and np.isnan(wider[:, 9:]).all()
    lines = run("contours", form="GeoJSON", params={"interval": 50.0})
    assert {float(r["properties"]["elev"]) for r in lines.collect()} == {50.0, 100.0, 150.0, 200.0, 250.0}
    with pytest.raises(ValueError):
        run("clip")
    assert ProcessConfig.parse(config(raster, tmp_path / "o", "GTiff", process="hillshade")).function.plan


def test_contours_join_into_whole_lines():
    y, x = np.mgrid[0:30, 0:30]
    hill = 100 - (y - 14.5) ** 2 - (x - 14.5) ** 2
    (ring,) = process.marching_squares(hill.astype(float), 0.0)
    assert np.array_equal(ring[0], ring[-1]) and len(ring) > 50 and np.allclose(np.hypot(*(ring - 14.5).T), 10, atol=0.1)
    (line,) = process.marching_squares(np.add.outer(np.arange(5.0), np.zeros(5)), 1.5)
    assert len(line) == 5 and np.allclose(line[:, 1], 1.5)
    holed = hill.astype(float)
    holed[14, 4] = np.nan
    assert len(process.marching_squares(holed, 0.0)) == 1 and len(process.marching_squares(holed, 0.0)[0]) < len(ring)


def test_arrays_round_trip():
    a = [np.array([1.0, np.nan, 3.0]), np.zeros(0), np.array([np.nan])]
    back = arrays.blocks(arrays.lists(a))
    assert all(np.array_equal(x, y, equal_nan=True) for x, y in zip(a, back)) and arrays.lists(a).null_count == 0
    assert arrays.arrow(process.VECTOR_OUT).field("properties").type.key_type == "string"
    assert set(formats.FORMATS) == {"Parquet", "GTiff", "PNG", "PNG_hillshade", "GeoJSON"}
    assert MERCATOR.crs == "EPSG:3857"
