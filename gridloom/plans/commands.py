"""Commands: execute, convert, cp, rm, index, and looking into inputs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import raster as R
from gridloom.functions.bounds import Bounds
from gridloom.functions.pyramid import Pyramid, Tile, best_zoom
from gridloom.operators import joins, tiles
from gridloom.operators.process import PROCESSES, convert as convert_pixels, processes
from gridloom.operators.tiles import KEYS
from gridloom.plans.engine import Process, open_process
from gridloom.sources import formats, readers, sinks
from gridloom.sources import index as index_files
from gridloom.sources.paths import Location, listing, pretty_bytes, stored, tidy


def execute(spark: SparkSession, config, mode: str = "continue", zoom=None, bounds=None, tile: tuple[int, int, int] | None = None, retries: int = 0, observers=None) -> DataFrame | None:
    """Run a process; a tile stands for its bounds and zoom."""
    if tile is not None:
        pyramid = open_process(spark, config, "memory").pyramid
        zoom, bounds = tile[0], pyramid.without_pixelbuffer().tile_bounds(*tile)
        px = pyramid.pixel_size(zoom) / 2
        bounds = Bounds(bounds.left + px, bounds.bottom + px, bounds.right - px, bounds.top - px)
    for left in range(retries, -1, -1):
        try:
            return open_process(spark, config, mode, zoom, bounds, observers).execute()
        except (ValueError, PermissionError):
            raise
        except Exception:
            if not left:
                raise
    return None


def existing_within(spark: SparkSession, path: str, zoom=None, bounds: Bounds | None = None) -> DataFrame:
    """Tiles of a directory by zooms and bounds; tiles that only touch the bounds are left out."""
    meta = sinks.load_metadata(spark, path)
    pyramid = Pyramid.of(meta["pyramid"])
    there = formats.of(meta["driver"]).existing(spark, path)
    if zoom is not None:
        there = there.where(F.col("zoom").isin([zoom] if isinstance(zoom, int) else list(zoom)))
    if bounds is not None:
        levels = sorted(r["zoom"] for r in there.select("zoom").distinct().collect())
        spans = [(z, found) for z in levels for part in tiles.wrapped(pyramid, Bounds.of(bounds)) if (found := pyramid.cell_range(z, part))]
        inside = F.lit(False)
        for z, (r0, r1, c0, c1) in spans:
            inside = inside | (F.col("zoom") == z) & F.col("row").between(r0, r1) & F.col("col").between(c0, c1)
        there = there.where(inside)
    return there


@tidy
def cp(spark: SparkSession, source: str, target: str, zoom=None, bounds=None, overwrite: bool = False) -> int:
    """Copy tiles that the target lacks (all with ``overwrite``) and the metadata; returns how many tiles."""
    meta = sinks.load_metadata(spark, source)
    to = Location(target, spark) / sinks.METADATA
    if to.exists():
        sinks.compare_metadata(to.read_json(), meta)
    form = formats.of(meta["driver"])
    want = stored(joins.to_copy(existing_within(spark, source, zoom, bounds), form.existing(spark, target), KEYS, overwrite), "copy")
    n = want.count()
    if n:
        rows = form.rows(spark, source, meta["driver"], None).join(want, KEYS, "left_semi")
        form.write(rows, target, Pyramid.of(meta["pyramid"]), meta["driver"], want)
    to.write_json(meta)
    return n


@tidy
def rm(spark: SparkSession, path: str, zoom=None, bounds=None) -> int:
    """Remove tiles; returns how many.

    Tiles that are files are deleted by tasks. Of Parquet rows, those that keep some tiles are written anew and
    replace the old ones when they are whole; only then the rows that keep none are deleted, by tasks too. A run
    that fails leaves tiles that should be gone, and loses none.
    """
    meta = sinks.load_metadata(spark, path)
    gone = stored(existing_within(spark, path, zoom, bounds), "gone")
    n = gone.count()
    form = formats.of(meta["driver"])
    if n and form.name != "Parquet":
        formats.remove(spark, path, gone, form.extension)
    elif n:
        touched = gone.select("zoom", "row").distinct()
        kept = sinks.tile_rows(spark, path).join(touched, ["zoom", "row"], "left_semi").join(gone, KEYS, "left_anti")
        kept = stored(kept, "kept")
        if not kept.isEmpty():
            sinks.write_tiles(kept, path)
        sinks.removed_rows(touched.join(kept.select("zoom", "row").distinct(), ["zoom", "row"], "left_anti"), path).write.format("noop").mode("overwrite").save()
    return n


@tidy
def index(spark: SparkSession, path: str, out: str, kind: str = "GeoJSON", zoom: int | None = None, base: str = "") -> None:
    """An index of a tile directory's zooms: GeoJSON, TXT or VRT. A GeoJSON index that is there gets the tiles that it lacks."""
    meta = sinks.load_metadata(spark, path)
    pyramid, form = Pyramid.of(meta["pyramid"]), formats.of(meta["driver"])
    there = stored(form.existing(spark, path), "there")
    levels = [zoom] if zoom is not None else sorted(r["zoom"] for r in there.select("zoom").distinct().collect())
    for z in levels:
        one = index_files.zoom_index(there.where(F.col("zoom") == z), extension=form.extension, base=base or path, pyramid=pyramid, zoom=z)
        if kind == "GeoJSON":
            at = f"{out}/{z}.geojson"
            if Location(at, spark).exists():
                one = stored(index_files.append(index_files.read_geojson(spark, at), one), "index")
            index_files.write_geojson(one, at)
        elif kind == "TXT":
            index_files.write_text(one, f"{out}/{z}.txt")
        elif kind == "VRT":
            index_files.write_lines(index_files.vrt(one, pyramid, z), f"{out}/{z}.vrt")
        else:
            raise ValueError(f"unknown index {kind!r}")


@dataclass(frozen=True)
class InputInfo:
    """What an input is: its kind, type, bounds, resolution and zooms."""

    kind: str
    data_type: str
    bounds: Bounds | None
    crs: str | None = None
    resolution: float | None = None
    pyramid: Pyramid | None = None
    zooms: tuple[int, ...] = ()

    @classmethod
    def of(cls, spark: SparkSession, path: str) -> InputInfo:
        driver = readers.driver_of(path)
        if driver.name == "TileDirectory":
            p = open_process(spark, path, "readonly")
            return cls("TileDirectory", "vector" if "schema" in p.config.output else "raster", p.config.effective_bounds(), p.pyramid.grid.crs, None, p.pyramid, tuple(p.zooms))
        df = readers.open_input(spark, path)
        if driver.data_type == "vector":
            from gridloom.operators.vector import boxed

            return cls(driver.name, "vector", readers.boxes_total(boxed(df)), "EPSG:4326")
        row = df.agg(F.first("crs"), F.min("px")).first()
        return cls(driver.name, "raster", readers.boxes_total(df), row[0], row[1])


def convert(spark: SparkSession, source: str, target: str, pyramid: Pyramid | str = "geodetic", zoom=None, output_format: str | None = None, ratio: float = 1.0, offset: float = 0.0, dtype: str | None = None, method: str = "nearest", bounds=None) -> Process | None:
    """A raster or vector into a tile directory or single GeoTIFF. Zooms default to all up to the best; None if nothing is within the bounds."""
    info = InputInfo.of(spark, source)
    single = target.endswith((".tif", ".tiff"))
    output_format = output_format or ("GTiff" if single else {"vector": "GeoJSON", "raster": "GTiff"}[info.data_type])
    if readers.DRIVERS[output_format].data_type != info.data_type:
        raise ValueError(f"{info.data_type} can't be written as {output_format}")
    pyramid = Pyramid.of(pyramid)
    top = best_zoom(pyramid, info.resolution) if info.resolution else 0
    levels = list(range(top + 1)) if zoom is None else [zoom] if isinstance(zoom, int) else list(zoom)
    if single and len(levels) != 1:
        levels = [max(levels)]
    area = info.bounds.intersection(Bounds.of(bounds)) if bounds is not None and info.bounds else info.bounds
    if area is None:
        return None
    df = readers.open_input(spark, source)
    if info.data_type == "vector":
        from gridloom.operators.vector import read_tiles

        out = None
        for z in levels:
            one = read_tiles(df, pyramid, z)
            out = one if out is None else out.unionByName(one)
        sinks.write_metadata(spark, target, pyramid, {"format": output_format})
        formats.of({"format": output_format}).write(out, target, pyramid, {"format": output_format}, None)
        return open_process(spark, target, "readonly")
    size = pyramid.tile_size * pyramid.metatiling
    long = convert_pixels(readers.warped_to_tiles(df, pyramid, max(levels), method), ratio, offset, dtype).withColumn("value", F.col("value").cast("double"))
    if bounds is not None:
        long = long.join(tiles.tiles_from_bounds(spark, pyramid, area, [max(levels)]), KEYS, "left_semi")
    pack = lambda d: R.to_packed(d, size, size)
    if single:
        sinks.write_single(pack(long), target, pyramid, max(levels), dtype or "float64")
        return None
    options = {"format": output_format, "dtype": dtype or "float64", "bands": 1}
    form = formats.of(options)
    sinks.write_metadata(spark, target, pyramid, options)
    form.write(pack(long), target, pyramid, options, None)
    for z in range(max(levels) - 1, min(levels) - 1, -1):
        above = R.to_long(form.rows(spark, target, options, z + 1).select(*KEYS, "band", "height", "width", "pixels"))
        lower = R.coarser(above, pyramid, z + 1, size, method) if method in ("bilinear", "cubic") else R.overview(above, size, method)
        form.write(pack(lower), target, pyramid, options, None)
    return open_process(spark, target, "readonly")


def create(folder: str, name: str = "process") -> None:
    """A new process's files: a configuration and a function to fill in."""
    at = Location(folder)
    (at / f"{name}.yml").write_yaml({"process": f"{name}.py", "zoom_levels": {"min": 0, "max": 5}, "pyramid": {"grid": "geodetic"}, "input": {"inp": "input.tif"}, "output": {"format": "GTiff", "path": "output", "dtype": "float32", "bands": 1}})
    (at / f"{name}.py").write_text('def execute(inp):\n    """Returns its input."""\n    return "empty" if inp.is_empty() else inp.read()\n')


def available_formats() -> dict[str, list[str]]:
    return {"input": readers.available_formats("r"), "output": sorted(formats.FORMATS)}


def sync_size(spark: SparkSession, path: str) -> str:
    """Total size of files under a folder."""
    return pretty_bytes(listing(spark, path).agg(F.sum("length")).first()[0] or 0)


def serve_tile(p: Process, zoom: int, row: int, col: int) -> bytes | None:
    """A tile of a process as PNG; None if it is empty."""
    import numpy as np

    from gridloom.sources.images import write_png

    rows = sorted(p.get_tile(Tile(zoom, row, col)).collect(), key=lambda r: r["band"])
    if not rows:
        return None
    data = np.stack([np.array([np.nan if v is None else v for v in r["pixels"]], dtype=float).reshape(r["height"], r["width"]) for r in rows])
    return write_png(sinks.to_rgba(data))


def server(p: Process, port: int = 5000, host: str = "127.0.0.1"):
    """An HTTP server of a process's tiles, made on demand: GET .../{zoom}/{row}/{col}.png. Its serve_forever() serves until shutdown()."""
    import re
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            m = re.search(r"/(\d+)/(\d+)/(\d+)\.png$", self.path.partition("?")[0])
            try:
                found = serve_tile(p, *map(int, m.groups())) if m else None
            except Exception as e:
                self.send_error(500, type(e).__name__)
                return
            if found is None:
                self.send_error(404)
                return
            self.send_response(200)
            self.send_header("Content-Type", "image/png")
            self.send_header("Content-Length", str(len(found)))
            self.end_headers()
            self.wfile.write(found)

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def serve(spark: SparkSession, config, port: int = 5000, mode: str = "continue") -> None:
    server(open_process(spark, config, mode), port).serve_forever()


@tidy
def sync(spark: SparkSession, source: str, target: str, compare: str = "length") -> int:
    """Copy the files under a folder that the target lacks, or that differ by ``compare`` (length or sha256); returns how many.

    Files are listed and compared as tables and copied by tasks, as streams.
    """
    from gridloom.sources.paths import copied

    if compare not in ("length", "sha256"):
        raise ValueError(f"files can't be compared by {compare!r}")
    files = lambda at: listing(spark, at, checksums=compare == "sha256").select(F.regexp_replace(F.substring_index("path", at.rstrip("/").split("://")[-1] + "/", -1), "^/+", "").alias("name"), compare)
    there = files(target) if Location(target, spark).exists() and Location(target, spark).ls() else spark.createDataFrame([], files(source).schema)
    want = stored(joins.to_copy(files(source), there, ["name"], compare=compare).select("name"), "sync")
    return copied(want, source, target).count()


__all__ = ["PROCESSES", "convert", "cp", "create", "available_formats", "execute", "index", "processes", "rm", "serve", "serve_tile", "server", "sync"]
