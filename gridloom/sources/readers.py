"""Inputs: raster files, vector files, tile directories, other processes' output; and the registry of drivers."""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import arrays
from gridloom.functions import bounds as B
from gridloom.functions import geometry as G
from gridloom.functions import raster as R
from gridloom.functions.pyramid import Pyramid, Tile, matching_zoom
from gridloom.operators.joins import range_join
from gridloom.operators.tiles import KEYS
from gridloom.sources import images
from gridloom.sources.paths import Location

RASTER = "path string, band int, height int, width int, dtype string, nodata double, crs string, px double, py double, box struct<left:double,bottom:double,right:double,top:double>, pixels array<double>"
#: Pixels and features that a reader hands on at once.
PIXELS = 1 << 18
FEATURES = 10_000
FEATURE = "feature_id long, geom struct<type:string,rings:array<array<struct<x:double,y:double>>>,part:array<int>>, properties map<string,string>"


def raster_files(spark: SparkSession, paths: str | list[str], bands: list[int] | None = None, skip_missing: bool = False) -> DataFrame:
    """A row for each band of each GeoTIFF or PNG: Spark reads the bytes, so any store will do; NULL where there is no data.

    ``skip_missing``: of listed paths those that aren't there are left out, else they are an error.
    """
    if skip_missing:
        paths = [p for p in ([paths] if isinstance(paths, str) else paths) if Location(p, spark).exists()]
        if not paths:
            return spark.createDataFrame([], RASTER)
    return decoded(spark.read.format("binaryFile").load(paths), bands)


def contents(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """path and bytes of files: a batch's own bytes, else they are read here, one file after the other; files that are gone are left out."""
    paths = batch.column(0).to_pylist()
    if batch.num_columns > 1:
        yield from zip(paths, batch.column(1).to_pylist())
        return
    for path in paths:
        try:
            yield path, read_start(path, None)
        except FileNotFoundError:
            continue


def with_content(files: DataFrame) -> DataFrame:
    """What `contents` needs of files."""
    return files.select("path", "content") if "content" in files.columns else files.select("path")


def decoded(files: DataFrame, bands: list[int] | None = None, change: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """The rasters in files (path, and content if Spark reads it); ``change`` makes other bands of a file's own."""
    names = [f.split(" ")[0] for f in RASTER.split(", ")]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[str, list] = {n: [] for n in names}
        held = 0
        for batch in batches:
            for path, content in contents(batch):
                if content[:4] == b"\x89PNG":
                    data, meta = images.read_png(content), {"affine": images.Affine(1, 0, 0, 0, -1, 0), "crs": None, "nodata": None, "dtype": "uint8"}
                else:
                    data, meta = images.read_geotiff(content)
                data = data if change is None else change(data)
                a, (n, h, w) = meta["affine"], data.shape
                box = {"left": a.c, "bottom": a.f + h * a.e, "right": a.c + w * a.a, "top": a.f}
                own = [i for i in range(n) if not bands or i + 1 in bands]
                values = data[own].astype(float)
                if meta["nodata"] is not None:
                    values[values == meta["nodata"]] = np.nan
                for i, band in zip(own, values):
                    for name, value in zip(names, (path, i + 1, h, w, meta["dtype"], meta["nodata"], meta["crs"], a.a, -a.e, box, band)):
                        rows[name].append(value)
                held += values.size
                if held >= PIXELS:
                    yield from arrays.table_of({**rows, "pixels": arrays.lists(rows["pixels"])}, RASTER).to_batches()
                    rows, held = {n: [] for n in names}, 0
        yield from arrays.table_of({**rows, "pixels": arrays.lists(rows["pixels"])}, RASTER).to_batches()

    return with_content(files).mapInArrow(decode, RASTER)


def raster_to_tiles(rasters: DataFrame, pyramid: Pyramid, zoom: int, method: str = "nearest", order: str = "path") -> DataFrame:
    """Long pixels of a pyramid's zoom from rasters in its projection; of several rasters the last by ``order`` that has data.

    Finer sources go to the pixel they fall in and are aggregated; coarser ones are taken at pixel centres:
    each source pixel is dealt to the target pixels whose centre it holds. Neither needs a join.
    """
    size = pyramid.pixel_size(zoom)
    width = pyramid.tile_size * pyramid.metatiling
    df = rasters.select(F.col(order).alias("_ord"), "band", "px", "py", F.col("width").alias("_w"), F.col("box.left").alias("_l"), F.col("box.top").alias("_t"), F.posexplode("pixels").alias("_i", "value"))
    df = df.withColumns({"_x": F.col("_i") % F.col("_w"), "_y": F.expr("_i DIV _w")})
    left, top = pyramid.grid.left, pyramid.grid.top
    x0, y0 = F.col("_l") + F.col("_x") * F.col("px") - left, F.lit(top) - F.col("_t") + F.col("_y") * F.col("py")
    # Target pixels whose centre lies in the source pixel; for a finer source at least the one its centre falls in.
    first_x, last_x = F.ceil(x0 / size - 0.5), F.ceil((x0 + F.col("px")) / size - 0.5) - 1
    first_y, last_y = F.ceil(y0 / size - 0.5), F.ceil((y0 + F.col("py")) / size - 0.5) - 1
    own_x, own_y = F.floor((x0 + F.col("px") / 2) / size), F.floor((y0 + F.col("py") / 2) / size)
    if method != "nearest":
        fine = F.col("px") < size
        first_x, last_x = F.when(fine, own_x).otherwise(first_x), F.when(fine, own_x).otherwise(last_x)
        first_y, last_y = F.when(fine, own_y).otherwise(first_y), F.when(fine, own_y).otherwise(last_y)
    df = df.withColumns({"_x0": first_x, "_x1": last_x, "_y0": first_y, "_y1": last_y}).where("_x1 >= _x0 AND _y1 >= _y0")
    df = df.withColumn("_gy", F.explode(F.sequence("_y0", "_y1"))).withColumn("_gx", F.explode(F.sequence("_x0", "_x1")))
    wide = pyramid.matrix_width(zoom) * width
    gx = F.pmod(F.col("_gx"), F.lit(wide)) if pyramid.grid.is_global else F.col("_gx")
    keys = [F.lit(zoom).alias("zoom"), F.floor(F.col("_gy") / width).cast("int").alias("row"), F.floor(gx / width).cast("int").alias("col"), "band", (F.col("_gy") % width).cast("int").alias("py"), (gx % width).cast("int").alias("px")]
    one = df.select("_ord", *keys, "value", "_i").groupBy("_ord", *R.PIXEL).agg(R.aggregate(method, F.col("value"), [F.col("_i")]).alias("value"))
    return R.mosaic(one.withColumnRenamed("_ord", "ord"))


#: Bytes of a file's start in which its header usually is.
HEAD = 64 << 10


def warped_to_tiles(rasters: DataFrame, pyramid: Pyramid, zoom: int, method: str = "nearest", order: str = "path") -> DataFrame:
    """`raster_to_tiles` for rasters in any projection that has formulas, each by its own: wanted pixels look back for the nearest
    or the weighted source pixels (nearest, bilinear, cubic), or source pixels are dealt to the wanted ones they fall in."""
    crs_of = F.coalesce("crs", F.lit(pyramid.grid.crs))
    kinds = [r[0] for r in rasters.select(crs_of).distinct().collect()]
    out = None
    for crs in sorted(kinds):
        own = rasters.where(crs_of == crs)
        one = raster_to_tiles(own, pyramid, zoom, method, order) if crs == pyramid.grid.crs and method not in ("bilinear", "cubic") else _warped(own, crs, pyramid, zoom, method, order)
        out = one if out is None else out.unionByName(one)
    if out is None:
        return rasters.sparkSession.createDataFrame([], "zoom int, row int, col int, band int, py int, px int, value double")
    return out if len(kinds) == 1 else R.mosaic(out.withColumn("ord", F.lit(0)))


def _warped(rasters: DataFrame, crs: str, pyramid: Pyramid, zoom: int, method: str, order: str) -> DataFrame:
    from gridloom.operators.tiles import cells

    width, size = a_width(pyramid), pyramid.pixel_size(zoom)
    df = rasters.select(F.col(order).alias("ord"), "band", "px", "py", "box", "width", "pixels")
    long = df.select("ord", "band", F.col("px").alias("_px"), F.col("py").alias("_py"), "box", F.col("width").alias("_w"), F.posexplode("pixels").alias("_i", "value"))
    long = long.withColumns({"_sy": F.expr("CAST(_i DIV _w AS BIGINT)"), "_sx": F.expr("CAST(_i % _w AS BIGINT)")})
    if method in ("nearest", "bilinear", "cubic"):
        places = df.select("ord", "px", "py", "box").distinct().withColumnsRenamed({"px": "_px", "py": "_py", "box": "_own"})
        reached = cells(places.withColumn("box", R.reprojected_box(F.col("_own"), crs, pyramid)), pyramid, zoom)
        n = F.sequence(F.lit(0), F.lit(width - 1))
        want = reached.withColumn("py", F.explode(n)).withColumn("px", F.explode(n))
        x, y = G.reproject_xy(*R.pixel_centre(pyramid, zoom, width), pyramid.grid.crs, crs)
        want = want.withColumns({"_fy": (F.col("_own.top") - y) / F.col("_py") - 0.5, "_fx": (x - F.col("_own.left")) / F.col("_px") - 0.5})
        found = R.looked_up(want.select("ord", *KEYS, "py", "px", "_fy", "_fx"), long.select("ord", "band", "_sy", "_sx", "value"), ["ord", *R.PIXEL], method, more=["ord"])
    else:
        x, y = F.col("box.left") + (F.col("_sx") + 0.5) * F.col("_px"), F.col("box.top") - (F.col("_sy") + 0.5) * F.col("_py")
        x, y = G.reproject_xy(x, y, crs, pyramid.grid.crs)
        gy, gx = F.floor((F.lit(pyramid.grid.top) - y) / size), F.floor((x - F.lit(pyramid.grid.left)) / size)
        dealt = long.select("ord", "band", "value", "_i", gy.alias("_y"), gx.alias("_x")).where((F.col("_y") >= 0) & (F.col("_y") < pyramid.matrix_height(zoom) * width) & (F.col("_x") >= 0) & (F.col("_x") < pyramid.matrix_width(zoom) * width))
        at = lambda v, op, name: F.expr(f"CAST({v} {op} {width} AS INT)").alias(name)
        keys = ["ord", F.lit(zoom).alias("zoom"), at("_y", "DIV", "row"), at("_x", "DIV", "col"), "band", at("_y", "%", "py"), at("_x", "%", "px")]
        found = dealt.groupBy(*keys).agg(R.aggregate(method, F.col("value"), [F.col("_i")]).alias("value"))
    return R.mosaic(found)


def raster_boxes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, crs, box of GeoTIFF files: files are listed by Spark, and of each only the start with the header is read (all, if its tags lie further on)."""
    schema = "path string, crs string, box struct<left:double,bottom:double,right:double,top:double>"
    listed = spark.read.format("binaryFile").load(paths).select("path", "length")
    with_hadoop = not _reachable(listed)

    def place(path: str, length: int, content: bytes | None) -> tuple:
        start = content if content is not None else read_start(path, HEAD)
        try:
            a, crs, h, w = images.geotiff_place(start)
        except (struct.error, IndexError, ValueError, KeyError):
            a, crs, h, w = images.geotiff_place(read_start(path, length) if content is None else content)
        return path, crs, {"left": a.c, "bottom": a.f + h * a.e, "right": a.c + w * a.a, "top": a.f}

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = batch.column(2).to_pylist() if with_hadoop else [None] * batch.num_rows
            found = [place(p, n, c) for p, n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), contents)]
            if found:
                yield from arrays.table_of(dict(zip(("path", "crs", "box"), map(list, zip(*found)))), schema).to_batches()

    # A store that only Spark reaches: its reader has to bring the bytes.
    files = spark.read.format("binaryFile").load(paths).select("path", "length", "content") if with_hadoop else listed
    return files.mapInArrow(decode, schema)


def _reachable(listed: DataFrame) -> bool:
    """Whether pyarrow's file systems reach the files."""
    row = listed.first()
    if row is None:
        return True
    try:
        read_start(row["path"], 8)
        return True
    except (OSError, pa.ArrowException):
        return False


def read_start(path: str, most: int | None) -> bytes:
    from gridloom.sources.sinks import file_system

    fs, at = file_system(path)
    with fs.open_input_stream(at, compression=None) as stream:
        return stream.read(most)


def footprints(rasters: DataFrame) -> DataFrame:
    return rasters.select("path", "crs", "box").distinct()


def vector_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Features of GeoJSON files, whole documents or a feature in each line."""
    return decoded_features(spark.read.format("binaryFile").load(paths).select("path", "content")).drop("path")


def decoded_features(files: DataFrame) -> DataFrame:
    """path and the features of GeoJSON files (path, and content if Spark reads it)."""

    schema = f"path string, {FEATURE}"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in contents(batch):
                text = content.decode()
                try:
                    docs = [json.loads(text)]
                except ValueError:
                    docs = [json.loads(line) for line in text.splitlines() if line.strip()]
                features = [f for d in docs for f in (d["features"] if d["type"] == "FeatureCollection" else [d])]
                # A large file's features go on in parts.
                for start in range(0, len(features), FEATURES):
                    some = features[start : start + FEATURES]
                    properties = [[(k, None if v is None else v if isinstance(v, str) else json.dumps(v)) for k, v in (f.get("properties") or {}).items()] for f in some]
                    columns = {"path": [path] * len(some), "feature_id": list(range(start, start + len(some))), "geom": [G.from_geojson(f.get("geometry")) for f in some], "properties": properties}
                    yield from arrays.table_of(columns, schema).to_batches()

    return with_content(files).mapInArrow(decode, schema)


@dataclass
class TileDirectory:
    """A directory of tiles with its metadata, in any format that can be read."""

    spark: SparkSession
    path: str

    @cached_property
    def metadata(self) -> dict:
        from gridloom.sources.sinks import load_metadata

        return load_metadata(self.spark, self.path)

    @property
    def pyramid(self) -> Pyramid:
        return Pyramid.of(self.metadata["pyramid"])

    def rows(self, zoom: int | None = None) -> DataFrame:
        from gridloom.sources import formats

        return formats.of(self.metadata["driver"]).rows(self.spark, self.path, self.metadata["driver"], zoom)

    def zooms(self) -> list[int]:
        from gridloom.sources import formats

        return sorted(r["zoom"] for r in formats.of(self.metadata["driver"]).existing(self.spark, self.path).select("zoom").distinct().collect())

    def read(self, zoom: int, max_zoom: int | None = None, fallback: bool = False) -> DataFrame:
        """Packed tiles of a zoom. ``max_zoom``: coarser tiles stand for what is finer; ``fallback``: tiles that are
        missing are made from the nearest coarser zoom that has them, only those."""
        zoom = min(zoom, max_zoom) if max_zoom is not None else zoom
        exact = self.rows(zoom)
        if not fallback:
            return exact
        pyramid, width = self.pyramid, self.pyramid.tile_size * self.pyramid.metatiling
        out, have = exact, exact.select(*KEYS).distinct()
        columns = [*KEYS, "band", "height", "width", "pixels"]
        out = out.select(columns)
        for z in reversed([z for z in self.zooms() if z < zoom]):
            k = 2 ** (zoom - z)
            steps = F.sequence(F.lit(0), F.lit(k - 1))
            rows = self.rows(z).select(columns)
            # Which finer tiles a coarse one stands for: keys first, then only what is missing is cut out of it.
            keys = rows.select(*KEYS).distinct().select(F.col("row").alias("_row"), F.col("col").alias("_col"), F.explode(steps).alias("_i")).select("*", F.explode(steps).alias("_j"))
            keys = keys.select("_row", "_col", F.lit(zoom).alias("zoom"), (F.col("_row") * k + F.col("_i")).cast("int").alias("row"), (F.col("_col") * k + F.col("_j")).cast("int").alias("col"))
            want = keys.join(have, KEYS, "left_anti")
            some = rows.drop("zoom").withColumnsRenamed({"row": "_row", "col": "_col"}).join(want, ["_row", "_col"])
            # Pixel (y, x) of the finer tile lies in this pixel of the coarse one.
            y0, x0 = (F.col("row") % k) * width, (F.col("col") % k) * width
            at = lambda i: F.expr("1") + F.floor((y0 + F.floor(i / width)) / k) * width + F.floor((x0 + i % width) / k)  # noqa: B023, E731
            cut = F.transform(F.sequence(F.lit(0), F.lit(width * width - 1)), lambda i: F.element_at("pixels", at(i).cast("int")))  # noqa: B023
            out = out.unionByName(some.withColumn("pixels", cut).select(columns))
            have = have.unionByName(want.select(*KEYS))
        return out

    def read_for(self, pyramid: Pyramid, zoom: int, method: str = "nearest", matching: str = "min", fallback: bool = False) -> DataFrame:
        """Long pixels at a zoom of any pyramid over the same or another projection: from the directory's own zoom
        that matches the wanted resolution best (or its finest, if that is coarser), resampled or warped."""
        own, there = self.pyramid, self.zooms()
        if not there:
            return self.spark.createDataFrame([], "zoom int, row int, col int, band int, py int, px int, value double")
        want = matching_zoom(Tile(zoom, pyramid.matrix_height(zoom) // 2, pyramid.matrix_width(zoom) // 2), pyramid.without_pixelbuffer(), own.without_pixelbuffer(), matching)
        # The directory's finest zoom that isn't finer than wanted, else its coarsest.
        z = max((x for x in there if x <= want), default=there[0])
        long = R.to_long(self.read(z, fallback=fallback).select(*KEYS, "band", "height", "width", "pixels"))
        if own.without_pixelbuffer() == pyramid.without_pixelbuffer():
            return R.resample(long, pyramid, z, zoom, a_width(pyramid), method)
        if own.grid == pyramid.grid and own.pixel_size(z) == pyramid.pixel_size(zoom):
            # The same pixels in tiles of another size.
            a, b = a_width(own), a_width(pyramid)
            df = long.withColumns({"_y": F.col("row") * a + F.col("py"), "_x": F.col("col") * a + F.col("px")})
            place = [F.expr(f"CAST({v} {op} {b} AS INT)").alias(n) for v, op, n in (("_y", "DIV", "row"), ("_x", "DIV", "col"), ("_y", "%", "py"), ("_x", "%", "px"))]
            return df.select(F.lit(zoom).alias("zoom"), *place[:2], "band", *place[2:], "value")
        return R.warp(long, own, pyramid, z, zoom, a_width(own), a_width(pyramid), method)


def a_width(pyramid: Pyramid) -> int:
    return pyramid.tile_size * pyramid.metatiling


def tiles_with_input(tiles: DataFrame, rasters: DataFrame, pyramid: Pyramid, zoom: int) -> DataFrame:
    """Tiles that a raster's footprint reaches; only boxes are looked at, not pixels."""
    boxed = tiles.where(F.col("zoom") == zoom).select(*KEYS).withColumn("box", pyramid.box(zoom, F.col("row"), F.col("col")))
    return range_join(boxed, footprints(rasters).select("box"), pyramid, max(0, zoom - 2), how="left_semi", touching=False).select(*KEYS)


def cached(df: DataFrame, where: str | None = None, keep: bool = False) -> DataFrame:
    """An input kept for several uses: in memory and on disk, or as a Parquet file that a next run finds again with ``keep``."""
    if where is None:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    df.write.mode("ignore" if keep else "overwrite").parquet(where)
    return df.sparkSession.read.parquet(where)


@dataclass(frozen=True)
class Driver:
    name: str
    data_type: str
    mode: str
    extensions: tuple[str, ...]
    reader: Callable | None = None


DRIVERS: dict[str, Driver] = {}


def register_driver(driver: Driver) -> None:
    DRIVERS[driver.name] = driver


for _d in (
    Driver("GTiff", "raster", "rw", ("tif", "tiff"), raster_files),
    Driver("PNG", "raster", "rw", ("png",), raster_files),
    Driver("PNG_hillshade", "raster", "w", ("png",)),
    Driver("GeoJSON", "vector", "rw", ("geojson", "json"), vector_files),
    Driver("Parquet", "raster", "rw", ("parquet",), lambda spark, path: spark.read.parquet(path)),
    Driver("TileDirectory", "raster", "r", (), lambda spark, path: TileDirectory(spark, path).rows()),
    Driver("Process", "any", "r", ("yml", "yaml")),
):
    register_driver(_d)


def available_formats(mode: str) -> list[str]:
    return sorted(d.name for d in DRIVERS.values() if mode in d.mode)


def driver_of(path: str) -> Driver:
    """By suffix; a path without one is a tile directory."""
    name = path.rstrip("/").rpartition("/")[2]
    if "." not in name:
        return DRIVERS["TileDirectory"]
    suffix = name.rpartition(".")[2].lower()
    for d in DRIVERS.values():
        if suffix in d.extensions and "r" in d.mode:
            return d
    raise ValueError(f"no driver reads .{suffix}")


def open_input(spark: SparkSession, path: str) -> DataFrame:
    d = driver_of(path)
    if d.reader is None:
        raise ValueError(f"{d.name} can't be opened without a configuration")
    return d.reader(spark, path)


def boxes_total(df: DataFrame) -> B.Bounds | None:
    row = df.agg(*B.total("box")).first()
    return None if row is None or row["left"] is None else B.Bounds(*row)
