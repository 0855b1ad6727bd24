"""Functions of the engine that no query runs: each on a small case."""

from __future__ import annotations

import threading
import urllib.error
import urllib.request

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom import cli
from gridloom.functions import bounds as B
from gridloom.functions import geometry as G
from gridloom.functions import raster as R
from gridloom.functions.bounds import Bounds
from gridloom.functions.pyramid import GEODETIC, MERCATOR, Affine, Grid, Pyramid, Tile
from gridloom.functions.zooms import ZoomLevels
from gridloom.operators import joins, tiles, vector
from gridloom.plans import commands
from gridloom.plans.config import ProcessConfig, bounds_from_options, input_key
from gridloom.plans.engine import open_process
from gridloom.sources import images, index, readers, sinks, stac
from gridloom.sources.paths import Location

P4 = Pyramid(GEODETIC, tile_size=4)
BOX = "struct<left:double,bottom:double,right:double,top:double>"


@pytest.fixture
def run(spark, tmp_path):
    """A run of 16 tiles as GeoTIFF."""
    path = tmp_path / "dem.tif"
    path.write_bytes(images.write_geotiff(np.arange(1, 257, dtype=float).reshape(1, 16, 16), Affine(5.625, 0.0, -180.0, 0.0, -5.625, 90.0), "EPSG:4326", -1))
    cfg = {"pyramid": {"grid": "geodetic", "tile_size": 4}, "zoom_levels": 3, "bounds": [-180, 0, -90, 90], "process": "passthrough", "input": {"dem": str(path)}, "output": {"format": "GTiff", "path": str(tmp_path / "out"), "nodata": -1}}
    p = open_process(spark, cfg, "overwrite")
    p.execute()
    return p


def frame(spark, *shapes):
    return spark.createDataFrame([(i, G.parse(s)) for i, s in enumerate(shapes)], T.StructType([T.StructField("i", T.IntegerType()), T.StructField("geom", G.GEOMETRY)]))


def test_dependencies_are_attached(spark):
    t = spark.createDataFrame([(3, 0, 0), (3, 0, 1)], "zoom int, row int, col int")
    results = spark.createDataFrame([("a", (-180.0, 80.0, -170.0, 85.0))], f"name string, box {BOX}")
    got = {(r["col"], r["name"]) for r in joins.attach(t, results, P4, 3).collect()}
    assert got == {(0, "a"), (1, None)}


def test_tiles_with_input(spark, run, tmp_path):
    rasters = readers.raster_files(spark, str(tmp_path / "dem.tif"))
    every = tiles.tiles_from_bounds(spark, P4, Bounds(-180, -90, 180, 90), [3])
    assert readers.tiles_with_input(every, rasters, P4, 3).count() == 16


def test_wholes_and_centres(spark):
    split = {"type": "MultiPolygon", "coordinates": [[[[170, 0], [180, 0], [180, 5], [170, 5], [170, 0]]], [[[-180, 0], [-170, 0], [-170, 5], [-180, 5], [-180, 0]]]]}
    r = frame(spark, split).select(G.box(G.to_whole(F.col("geom"))).alias("b"), G.centroid(G.to_whole(F.col("geom"))).alias("c")).first()
    assert (r["b"]["left"], r["b"]["right"], r["c"]["x"], r["c"]["y"]) == (170.0, 190.0, 180.0, 2.5)
    assert Bounds(*[f(p[k] for ring in G.buffer_box(G.parse((0, 0, 1, 1)), 2)["rings"] for p in ring) for f, k in ((min, "x"), (min, "y"), (max, "x"), (max, "y"))]) == Bounds(-2, -2, 3, 3)


def test_output_schemas(spark):
    df = spark.createDataFrame([(1, "2")], "a int, b string")
    assert sinks.validated(df, {"b": "int"}).first()[0] == 2
    with pytest.raises(ValueError, match="lacks c"):
        sinks.validated(df, {"c": "int"})


def test_tiles_on_disk(spark, run):
    found = index.zoom_index(run.existing(), extension="tif", base=run.config.output["path"]).unionByName(spark.createDataFrame([("x", 3, 9, 9, "/no/such.tif")], "tile_id string, zoom int, row int, col int, location string"))
    got = found.select("location").mapInPandas(sinks.tiles_on_disk, "location string, exists boolean")
    assert got.where("exists").count() == 16 and got.where("NOT exists").count() == 1


def test_sessions(spark):
    from gridloom.streaming.incremental import sessions

    rows = [("2024-01-01 00:00:00", 1, 0, 0), ("2024-01-01 00:20:00", 1, 0, 0), ("2024-01-01 02:00:00", 1, 0, 0), ("2024-01-01 00:10:00", 1, 0, 1)]
    df = spark.createDataFrame(rows, "ts string, zoom int, row int, col int").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted((r["col"], r["n"]) for r in sessions(df).collect()) == [(0, 1), (0, 2), (1, 1)]


def test_options_and_keys():
    assert bounds_from_options(P4, wkt_geometry="POINT (3 4)") == Bounds(3, 4, 3, 4)
    assert bounds_from_options(P4, point=(-179, 89), zoom=3) == P4.tile_bounds(3, 0, 0) and bounds_from_options(P4, bounds=[1, 2, 3, 4]) == Bounds(1, 2, 3, 4) and bounds_from_options(P4) is None
    assert input_key({"a": 1}, "x") == input_key({"a": 1}, "x") != input_key({"a": 2}, "x")


def test_matrices_edges_and_other_pyramids():
    assert P4.matrix_affine(1) == Affine(90.0, 0.0, -180.0, 0.0, -90.0, 90.0)
    with pytest.raises(ValueError):
        Pyramid(GEODETIC, tile_size=4, pixelbuffer=1).matrix_affine(1)
    assert P4.is_on_edge(Tile(3, 2, 0)) and not P4.is_on_edge(Tile(3, 2, 5)) and Pyramid(GEODETIC, tile_size=4, pixelbuffer=1).is_on_edge(Tile(3, 2, 15))
    meta = Pyramid(GEODETIC, tile_size=4, metatiling=2)
    assert P4.intersecting(Tile(3, 0, 0), meta) == [Tile(3, r, c) for r in (0, 1) for c in (0, 1)]
    assert B.pixel_ranges(Bounds(-170, 70, -160, 80), Affine(5.0, 0, -180.0, 0, -5.0, 90.0)) == (2, 4, 2, 4)
    assert B.snap(Bounds(-179, 80, -170, 89), P4, 3) == P4.tile_bounds(3, 0, 0)


def test_windows_by_bounds(spark):
    long = spark.createDataFrame([(y, x, float(10 * y + x)) for y in range(6) for x in range(6)], "py int, px int, value double")
    got = {(r["py"], r["px"]): r["value"] for r in R.within(long, Affine(5.0, 0, -180.0, 0, -5.0, 90.0), Bounds(-170, 70, -160, 80)).collect()}
    assert got == {(0, 0): 22.0, (0, 1): 23.0, (1, 0): 32.0, (1, 1): 33.0}


def test_checksums_and_sync(spark, run, tmp_path):
    out, other = run.config.output["path"], str(tmp_path / "mirror")
    assert commands.sync(spark, out, other) == 17 and commands.sync(spark, out, other) == 0
    a, b = Location(f"{out}/3/0/0.tif", spark), Location(f"{other}/3/0/0.tif", spark)
    assert a.checksum() == b.checksum()
    b.write_bytes(bytes(len(a.read_bytes())))
    assert commands.sync(spark, out, other) == 0 and commands.sync(spark, out, other, "sha256") == 1 and a.checksum() == b.checksum()
    assert commands.sync_size(spark, out).endswith(("KB", "B", "kB"))
    with pytest.raises(ValueError):
        commands.sync(spark, out, other, "name")


def test_tiles_over_http(spark, run):
    server = commands.server(open_process(spark, run.config, "continue"), 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"
    try:
        with urllib.request.urlopen(f"{base}/wmts/3/0/1.png", timeout=120) as got:
            data = images.read_png(got.read())
        assert data.shape == (4, 4, 4) and data[0, 0].tolist() == [5, 6, 7, 8]
        for path in ("/3/0/900.png", "/9/0/0.png", "/x"):
            with pytest.raises(urllib.error.HTTPError):
                urllib.request.urlopen(base + path, timeout=120)
    finally:
        server.shutdown()


def test_index_grows(spark, run, tmp_path):
    out, at = run.config.output["path"], str(tmp_path / "index")
    Location(f"{out}/3/0/0.tif", spark).cp(str(tmp_path / "kept.tif"))
    Location(f"{out}/3/0/0.tif", spark).rm()
    commands.index(spark, out, at)
    Location(str(tmp_path / "kept.tif"), spark).cp(f"{out}/3/0/0.tif")
    commands.index(spark, out, at)
    found = index.read_geojson(spark, f"{at}/3.geojson")
    assert found.count() == 16 and found.select("tile_id").distinct().count() == 16
    assert found.where("row = 1 AND col = 2").first()["box"]["left"] == P4.tile_bounds(3, 1, 2).left
    commands.index(spark, out, at, "VRT")
    text = (tmp_path / "index/3.vrt").read_text()
    assert text.count("<ComplexSource>") == 16 and 'rasterXSize="16" rasterYSize="16"' in text and "/3/0/0.tif" in text
    commands.index(spark, out, at, "TXT")
    assert spark.read.text(f"{at}/3.txt").count() == 16
    with pytest.raises(ValueError):
        commands.index(spark, out, at, "GPKG")


def test_items_by_the_standards_names(spark):
    t = spark.createDataFrame([(3, 1, 2), (3, 2, 5), (4, 2, 4)], "zoom int, row int, col int")
    for p in (P4, Pyramid(MERCATOR, tile_size=256), Pyramid(GEODETIC, tile_size=64, metatiling=4), Pyramid(Grid("own", 0.0, 0.0, 1000.0, 500.0, 1, 2, "EPSG:32633"), tile_size=8)):
        if p.grid.crs == "EPSG:32633":
            continue
        item = stac.item("x", t, p, "s3://b/x", "tif")
        (name, own), = item["properties"]["tiles:tile_matrix_sets"].items()
        assert own["type"] == "TileMatrixSetType" and own["identifier"] == name and set(own["tileMatrix"][0]) == {"type", "identifier", "scaleDenominator", "topLeftCorner", "tileWidth", "tileHeight", "matrixWidth", "matrixHeight"}
        assert own["boundingBox"]["lowerCorner"] == [p.grid.left, p.grid.bottom]
        assert stac.pyramid_of(item) == p and list(stac.zooms_of(item)) == [3, 4] and item["asset_templates"]["bands"]["type"].startswith("image/tiff")
        assert stac.prototypes(item)[0] == "s3://b/x/3/1/2.tif"
    custom = {"properties": {"tiles:tile_matrix_sets": {"own": stac.matrix_set(Pyramid(Grid("own", 0.0, 0.0, 1000.0, 500.0, 1, 2, "EPSG:32633"), tile_size=8), [3])}}}
    back = stac.pyramid_of(custom)
    assert back.grid.crs == "EPSG:32633" and (back.grid.rows, back.grid.cols, back.tile_size) == (1, 2, 8)


def test_task_counts_and_zooms(spark, run):
    assert run.count_tiles() == {3: 16} and run.count_tasks() == 16
    assert [b.count() for b in run.batches("row")] == [16]
    levels = ZoomLevels.of({"min": 3, "max": 6})
    assert list(levels.descending()) == [6, 5, 4, 3] and list(levels.difference(ZoomLevels.of([4, 5]))) == [3, 6]
    cfg = ProcessConfig.parse({"pyramid": {"grid": "geodetic"}, "zoom_levels": {"min": 0, "max": 9}, "output": {"format": "GTiff", "path": "x"}, "baselevels": {"min": 4, "max": 6}})
    assert list(cfg.processing_levels()) == [4, 5, 6] and list(cfg.overview_levels()) == [0, 1, 2, 3, 7, 8, 9]


def test_stats_of_features(spark):
    square = {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]}
    r = frame(spark, square).select(*vector.length_stats(None)).first()
    assert (r["area"], r["length"]) == (4.0, 8.0)


def test_command_line(spark, run, tmp_path, capsys):
    out = run.config.output["path"]
    assert cli.main(["formats"]) == 0 and "PNG_hillshade" in capsys.readouterr().out
    assert cli.main(["sync", out, str(tmp_path / "m")]) == 0 and "17 files" in capsys.readouterr().out
    assert cli.main(["rm", str(tmp_path / "m"), "--zoom", "3", "--bounds=-179,46,-136,89"]) == 0 and "4 tiles" in capsys.readouterr().out
    assert cli.main(["cp", out, str(tmp_path / "m")]) == 0 and "4 tiles" in capsys.readouterr().out
    assert cli.main(["exists", f"{out}/none"]) == 1


def test_path_operations(spark, tmp_path):
    a = Location("s3://bucket/a/b/c.tif", spark)
    assert str(a.with_suffix(".png")) == "s3://bucket/a/b/c.png" and str(a.without_suffix()) == "s3://bucket/a/b/c" and str(a.with_protocol("gs")) == "gs://bucket/a/b/c.tif"
    assert str(Location("x/y.tif").absolute("/base")) == "/base/x/y.tif" and str(a.absolute("/base")) == str(a)
    assert a.crop(2) == "b/c.tif"
    folder = Location(str(tmp_path / "new/folder"), spark)
    folder.makedirs()
    (folder / "f.txt").write_text("x")
    assert folder.is_directory() and (folder / "f.txt").last_modified() > 1_500_000_000


def test_no_data_and_halos(spark):
    df = spark.createDataFrame([([None, None],), ([None, 0.0],)], "pixels array<double>")
    assert [r[0] for r in df.select(R.no_data(F.col("pixels"))).collect()] == [True, False]
    long = spark.createDataFrame([(3, 1, c, 1, y, x, 1.0) for c in (0, 1) for y in range(4) for x in range(4)], "zoom int, row int, col int, band int, py int, px int, value double")
    wide = R.halo(long, P4, 3, 1, 4)
    assert wide.count() > 32 and R.without_halo(wide, 4).count() == 32


def test_what_holds_at_a_zoom():
    cfg = ProcessConfig.parse({"pyramid": {"grid": "geodetic"}, "zoom_levels": {"min": 0, "max": 5}, "output": {"format": "GTiff", "path": "x"}, "input": {"a": {"zoom<3": "low.tif", "zoom>=3": "high.tif"}}, "process_parameters": {"n": {"zoom<=1": 1, "zoom>1": 2}}})
    assert cfg.raw_at(4)["input"] == {"a": "high.tif"} and cfg.raw_at(1)["process_parameters"] == {"n": 1}


def test_runs_and_commands_leave_nothing_stored(spark, run, tmp_path):
    from gridloom.sources import paths

    before = list(paths._stored)
    open_process(spark, run.config, "overwrite").execute()
    commands.cp(spark, run.config.output["path"], str(tmp_path / "c"))
    commands.rm(spark, str(tmp_path / "c"), 3)
    assert paths._stored == before
