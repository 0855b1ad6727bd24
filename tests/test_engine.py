from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import raster as R
from gridloom.functions.bounds import Bounds
from gridloom.functions.pyramid import GEODETIC, Affine, Pyramid, Tile
from gridloom.operators import process
from gridloom.plans import commands
from gridloom.plans.config import ConfigError, ProcessConfig, at_zoom, cast_option, flattened, unflattened, zooms_from
from gridloom.plans.engine import open_process
from gridloom.sources import images, index, readers, sinks, stac
from gridloom.sources.paths import Location


def twice(dem, add=0):
    return process.EMPTY if dem.is_empty() else dem.read() * 2 + add


def constant(value):
    return np.full((4, 4), value, dtype=float)


def broken(value):
    return None


@pytest.fixture
def raster(tmp_path):
    """A 16 x 16 GeoTIFF over the upper left eighth of the map."""
    data = np.arange(1, 257, dtype=np.float64).reshape(1, 16, 16)
    path = tmp_path / "dem.tif"
    path.write_bytes(images.write_geotiff(data, Affine(5.625, 0.0, -180.0, 0.0, -5.625, 90.0), "EPSG:4326", 0))
    return str(path)


def config(path, out, **more):
    return {"pyramid": {"grid": "geodetic", "tile_size": 4}, "zoom_levels": {"min": 1, "max": 4}, "process": twice, "input": {"dem": path}, "output": {"format": "GTiff", "path": str(out)}, "process_parameters": {"add": 1}, **more}


def test_base_levels_and_overviews(spark, tmp_path, raster):
    cfg = config(raster, tmp_path / "out", baselevels={"min": 3, "max": 3, "lower": "average"}, bounds=[-180, 0, -90, 90])
    p = open_process(spark, cfg, "overwrite")
    p.execute()
    got = {r["zoom"]: r["n"] for r in p.existing().groupBy("zoom").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {3: 16, 2: 4, 1: 1, 4: 64}
    long = R.to_long(p.read(3).drop("tags"))
    assert long.agg(F.sum("value")).first()[0] == sum(2 * v + 1 for v in range(1, 257))
    top = R.to_long(p.read(1).drop("tags")).where("value IS NOT NULL")
    assert top.agg(F.avg("value")).first()[0] == pytest.approx(2 * 128.5 + 1)
    # A second run in continue mode has nothing to do.
    seen = []
    again = open_process(spark, cfg, "continue", observers=[lambda what, more: seen.append((what, more))])
    assert again.skip_tiles().where("zoom = 3 AND skip").count() == 16
    again.execute()
    assert not any(w == "zoom" for w, _ in seen)
    # On demand, outside the zooms, and as an image.
    assert again.get_tile(Tile(9, 0, 0)).isEmpty()
    assert commands.serve_tile(again, 3, 0, 0)[:4] == b"\x89PNG"


def test_continue_redoes_what_lies_above(spark, tmp_path, raster):
    out = str(tmp_path / "out")
    cfg = config(raster, out, baselevels={"min": 3, "max": 4, "lower": "max"}, zoom_levels={"min": 2, "max": 3}, bounds=[-180, 0, -90, 90]) | {"baselevels": {"min": 3, "max": 3, "lower": "max"}}
    open_process(spark, cfg, "overwrite").execute()
    assert commands.rm(spark, out, 3, Bounds(-179, 80, -170, 89)) == 1
    seen = []
    open_process(spark, cfg, "continue", observers=[lambda what, more: seen.append(what)]).execute()
    assert "zoom" in seen and "overview" in seen
    assert open_process(spark, out, "readonly").existing().where("zoom = 3").count() == 16


def test_copy_index_stac(spark, tmp_path, raster):
    out, other = str(tmp_path / "out"), str(tmp_path / "copy")
    open_process(spark, config(raster, out, zoom_levels=3, bounds=[-180, 0, -90, 90]), "overwrite").execute()
    assert commands.cp(spark, out, other, bounds=Bounds(-180, 45, -135, 90)) == 4
    assert commands.cp(spark, out, other) == 12 and commands.cp(spark, out, other) == 0
    commands.index(spark, out, str(tmp_path / "index"), "GeoJSON")
    commands.index(spark, out, str(tmp_path / "index"), "VRT")
    assert len(spark.read.text(str(tmp_path / "index" / "3.geojson")).collect()) == 16
    assert (tmp_path / "index" / "3.vrt").read_text().count("<ComplexSource>") == 16
    item = open_process(spark, out, "readonly").write_stac()
    assert stac.pyramid_of(item) == Pyramid(GEODETIC, tile_size=4) and list(stac.zooms_of(item)) == [3]
    assert stac.updated(item, item)["bbox"] == item["bbox"] and stac.prototypes(item)[0].endswith("3/0/0.tif")
    with pytest.raises(PermissionError):
        open_process(spark, out, "readonly").execute()
    with pytest.raises(ValueError):
        sinks.write_metadata(spark, out, Pyramid(), {"format": "GTiff"})
    old = spark.createDataFrame([("a", 1)], "tile_id string, zoom int")
    assert index.append(old, spark.createDataFrame([("a", 2), ("b", 2)], "tile_id string, zoom int")).count() == 2


def test_convert(spark, tmp_path, raster):
    p = commands.convert(spark, raster, str(tmp_path / "tiles"), Pyramid(GEODETIC, tile_size=4), zoom=[2, 3], ratio=0.5, dtype="uint8")
    assert sorted(z for z in p.zooms) == [2, 3]
    assert R.to_long(p.read(3)).where("value IS NOT NULL").agg(F.max("value")).first()[0] == 128.0
    commands.convert(spark, raster, str(tmp_path / "one.tif"), Pyramid(GEODETIC, tile_size=4), zoom=3)
    got, meta = images.read_geotiff((tmp_path / "one.tif").read_bytes())
    assert (got[0] == np.arange(1, 257).reshape(16, 16)).all() and meta["affine"].a == 5.625
    assert commands.convert(spark, raster, str(tmp_path / "none"), Pyramid(GEODETIC, tile_size=4), zoom=3, bounds=[100, -80, 120, -70]) is None
    assert commands.InputInfo.of(spark, raster).resolution == 5.625


def test_images_of_tiles(spark, tmp_path, raster):
    p = open_process(spark, config(raster, tmp_path / "x", zoom_levels=3, bounds=[-180, 0, -90, 90]), "memory")
    done = sinks.write_images(p.execute(), str(tmp_path / "png"), p.pyramid, "PNG").collect()
    assert len(done) == 16 and images.read_png((tmp_path / "png/3/0/0.png").read_bytes()).shape == (4, 4, 4)
    sinks.write_images(p.execute(), str(tmp_path / "tif"), p.pyramid).collect()
    back = readers.raster_files(spark, str(tmp_path / "tif/3/0/*.tif"))
    assert back.count() == 4 and readers.boxes_total(back).left == -180


def test_vector_in_and_out(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [30, 0], [30, 30], [0, 30], [0, 0]]]}, "properties": {"name": "a"}}, {"type": "Feature", "geometry": None, "properties": {}}]}
    (tmp_path / "in.geojson").write_text(json.dumps(doc))
    commands.convert(spark, str(tmp_path / "in.geojson"), str(tmp_path / "out"), "geodetic", zoom=3)
    docs = [json.loads(p.read_text()) for p in (tmp_path / "out").glob("3/*/*.geojson")]
    assert len(docs) == 4 and all(f["properties"]["name"] == "a" for d in docs for f in d["features"])
    assert open_process(spark, str(tmp_path / "out"), "readonly").read(3).count() == 4
    assert commands.InputInfo.of(spark, str(tmp_path / "in.geojson")).bounds.right == 30


def test_user_function_contract(spark):
    p = Pyramid(GEODETIC, tile_size=4)
    t = spark.createDataFrame([(3, 0, 0), (3, 0, 1)], "zoom int, row int, col int")
    assert process.run(t, {}, constant, p, {"value": 5}).count() == 2
    with pytest.raises(Exception, match="returned None"):
        process.run(t, {}, broken, p, {"value": 5}).collect()
    with pytest.raises(ValueError):
        process.check_parameters(constant, [])
    with pytest.warns(UserWarning):
        process.check_parameters(constant, ["value", "other"])
    assert process.load_function(["def execute(x):", "    return x"])(3) == 3
    assert set(process.processes()) == {"clip", "contours", "convert", "hillshade", "passthrough"}


def test_config(tmp_path):
    base = {"pyramid": {"grid": "geodetic"}, "zoom_levels": {"min": 7, "max": 10}, "output": {"format": "GTiff", "path": "${OUT}/x"}, "input": {"g": {"zoom<9": "a.tif", "zoom>=9": "b.tif"}, "only": {"zoom=7": "c.tif"}}}
    c = ProcessConfig.parse(base, {"OUT": "/tmp"})
    assert c.output["path"] == "/tmp/x" and c.input_at(7) == {"g": "a.tif", "only": "c.tif"} and c.input_at(9) == {"g": "b.tif"}
    assert unflattened(flattened({"a": {"b": {"c": 1}}})) == {"a": {"b": {"c": 1}}}
    with pytest.raises(KeyError):
        ProcessConfig.parse(base, {})
    with pytest.raises(ConfigError):
        ProcessConfig.parse({k: v for k, v in base.items() if k != "pyramid"}, {"OUT": ""})
    with pytest.raises(ConfigError):
        ProcessConfig.parse({**base, "baselevels": {"min": 0, "max": 20}}, {"OUT": ""})
    with pytest.raises(ConfigError):
        zooms_from(c.zoom_levels, 3)
    with pytest.raises(ConfigError):
        at_zoom({"zoom=1": 1, "x": 2}, 1)
    assert [cast_option(x) for x in ("null", "true", "3", "2.5", "x")] == [None, True, 3, 2.5, "x"]
    assert c.processing_levels() == c.zoom_levels and not len(c.overview_levels())


def test_tile_source(spark):
    from gridloom.sources.datasource import register

    register(spark)
    df = spark.read.format("gridloom_tiles").option("minzoom", 0).option("maxzoom", 3).load()
    assert df.count() == 2 + 8 + 32 + 128


def test_tile_directory_fallback(spark, tmp_path):
    p = Pyramid(GEODETIC, tile_size=2)
    rows = [(0, 0, 0, 1, 2, 2, [1.0, 2.0, 3.0, 4.0]), (1, 0, 0, 1, 2, 2, [9.0, 9.0, 9.0, None])]
    path = str(tmp_path / "td")
    sinks.write_metadata(spark, path, p, {"format": "Parquet"})
    sinks.write_tiles(spark.createDataFrame(rows, "zoom int, row int, col int, band int, height int, width int, pixels array<double>"), path)
    got = {(r["row"], r["col"], r["py"], r["px"]): r["value"] for r in R.to_long(readers.TileDirectory(spark, path).read(1, fallback=True)).collect()}
    # The tile that is there stands as it is; the other three of the coarser tile are cut out of it.
    assert len(got) == 16 and got[0, 0, 0, 0] == 9.0 and got[0, 0, 1, 1] is None and got[1, 1, 0, 0] == 4.0 and got[0, 1, 1, 1] == 2.0


def test_paths(spark, tmp_path):
    a = Location(str(tmp_path), spark) / "a" / "b.json"
    a.write_json({"x": 1})
    assert a.read_json() == {"x": 1} and a.stem == "b" and a.suffix == ".json" and a.exists() and a.parent.is_directory()
    a.cp(str(tmp_path / "c.json"))
    with pytest.raises(FileExistsError):
        a.cp(str(tmp_path / "c.json"))
    assert sum(len(p) for p in Location(str(tmp_path), spark).paginate(1)) >= 2
    assert Location("s3://bucket/x.tif").as_vsi() == "/vsis3/bucket/x.tif" and Location("s3://b/x").is_remote


def test_overview_stream(spark, tmp_path):
    from gridloom.streaming.incremental import overview_stream, windowed_counts

    base = spark.createDataFrame([(2, 0, c, 1, y, x, float(c)) for c in range(4) for y in range(2) for x in range(2)], "zoom int, row int, col int, band int, py int, px int, value double")
    spark.createDataFrame([(2, 0, 1)], "zoom int, row int, col int").write.parquet(str(tmp_path / "changes"))
    found = []
    changes = spark.readStream.schema("zoom int, row int, col int").parquet(str(tmp_path / "changes"))
    q = overview_stream(changes, lambda: base, lambda: R.overviews(base, 2, 2, 0, "max"), lambda df: found.extend(df.collect()), 2, 2, 0, "max").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r["zoom"], r["row"], r["col"]) for r in found} == {(1, 0, 0), (0, 0, 0)}
    assert max(r["value"] for r in found if r["zoom"] == 0) == 3.0
    assert windowed_counts(spark.createDataFrame([], "ts timestamp, zoom int, row int, col int")).count() == 0


def test_tiles_beyond_inputs_are_left_out(spark, tmp_path, raster):
    p = open_process(spark, config(raster, tmp_path / "o", zoom_levels=3), "memory")
    assert p.process_tiles(3).count() == 16 and p.count_tasks() == 128


def test_measures(spark):
    from gridloom.functions.measure import Timer, observed, redacted

    with Timer() as t:
        df, o = observed(spark.createDataFrame([(3,), (5,)], "zoom int"))
        df.collect()
    assert t.seconds > 0 and o.get == {"rows": 2, "min_zoom": 3, "max_zoom": 5}
    assert redacted("aws_secret_access_key=abc, x=1") == "aws_secret_access_key=***, x=1"


def finer_by_hand(a, method):
    """Twice as fine, by weights of the neighbours that are there."""
    def weight(d):
        d = abs(d)
        if method == "bilinear":
            return max(0.0, 1 - d)
        return 1.5 * d**3 - 2.5 * d**2 + 1 if d < 1 else -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2 if d < 2 else 0.0

    w = np.array([[weight((t + 0.5) / 2 - 0.5 - s) for s in range(len(a))] for t in range(2 * len(a))])
    w /= w.sum(axis=1, keepdims=True)
    return w @ a @ w.T


@pytest.mark.parametrize("method", ["bilinear", "cubic"])
def test_higher_resampling_over_tile_edges(spark, tmp_path, raster, method):
    cfg = config(raster, tmp_path / "out", baselevels={"min": 3, "max": 3, "higher": method}, zoom_levels={"min": 3, "max": 4}, bounds=[-180, 0, -90, 90])
    # One of the values is 0, which GeoTIFF's usual no-data value would take away.
    cfg["output"]["nodata"] = -9999
    p = open_process(spark, cfg, "overwrite")
    p.execute()
    got = np.full((32, 32), np.nan)
    for r in R.to_long(p.read(4).drop("tags")).collect():
        got[r["row"] * 4 + r["py"], r["col"] * 4 + r["px"]] = r["value"]
    assert np.allclose(got, finer_by_hand(np.arange(1, 257).reshape(16, 16) * 2.0 + 1, method))


def test_unsupported_resampling_is_an_error(spark, tmp_path, raster):
    for side, name in (("lower", "gauss"), ("higher", "sum"), ("higher", "lanczos")):
        with pytest.raises(ConfigError):
            ProcessConfig.parse(config(raster, tmp_path / "out", baselevels={"min": 3, "max": 3, side: name}))
    with pytest.raises(ValueError):
        R.resample(spark.createDataFrame([(3, 0, 0, 1, 0, 0, 1.0)], "zoom int, row int, col int, band int, py int, px int, value double"), Pyramid(GEODETIC, tile_size=4), 3, 4, 4, "sum")
