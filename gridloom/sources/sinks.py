"""Outputs: tile directories (Parquet, GeoTIFF, PNG, GeoJSON), their metadata, single files, copies."""

from __future__ import annotations

import json
import urllib.parse
import zlib
from collections.abc import Iterator
from datetime import date, datetime

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import arrays
from gridloom.functions import geometry as G
from gridloom.functions.pyramid import Pyramid
from gridloom.functions.raster import RANGES
from gridloom.operators.tiles import KEYS, by_tile, cross_pyramid
from gridloom.sources import images
from gridloom.sources.index import SCHEMA
from gridloom.sources.paths import Location

METADATA = "metadata.json"
#: Tiles of a row that one task writes at most.
SPAN = 64


def write_tiles(df: DataFrame, path: str, mode: str = "overwrite", replaced: DataFrame | None = None) -> None:
    """Partitioned by zoom and row; only the partitions that are written are replaced. Empty tiles aren't written.

    ``replaced``: the tiles that ``df`` stands for; other tiles of the same rows that exist are kept. Without
    it, whole rows are replaced. New files are put in place once all are written.
    """
    if "pixels" in df.columns:
        df = df.where(F.exists("pixels", lambda v: v.isNotNull()))
    spark = df.sparkSession
    if replaced is not None and mode == "overwrite" and has_tiles(spark, path):
        replaced = replaced.select(*KEYS)
        stay = tile_rows(spark, path).join(replaced.select("zoom", "row").distinct(), ["zoom", "row"], "left_semi").join(replaced, KEYS, "left_anti")
        df = df.unionByName(stay.select(df.columns))
    # A row of a high zoom has more tiles than a task should hold, so it is dealt out by ranges of SPAN columns.
    (
        df.repartition("zoom", "row", F.expr(f"col DIV {SPAN}"))
        .sortWithinPartitions(*KEYS)
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("zoom", "row")
        .parquet(path)
    )


def has_tiles(spark: SparkSession, path: str) -> bool:
    at = Location(path, spark)
    return at.exists() and any(x.name.startswith("zoom=") for x in at.ls())


def tile_rows(spark: SparkSession, path: str) -> DataFrame:
    """A tile directory's rows; its metadata and items lie beside them."""
    return spark.read.option("pathGlobFilter", "*.parquet").parquet(path)


def existing_tiles(spark: SparkSession, path: str) -> DataFrame:
    """zoom, row, col of what is there; none if the directory isn't."""
    empty = spark.createDataFrame([], "zoom int, row int, col int")
    if not has_tiles(spark, path):
        return empty
    return tile_rows(spark, path).select(*[F.col(k).cast("int").alias(k) for k in KEYS]).distinct()


def _default(value):
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    raise TypeError(f"{type(value)} can't be written as JSON")


def dump_metadata(pyramid: Pyramid, driver: dict) -> dict:
    return {"pyramid": pyramid.to_dict(), "driver": driver}


def write_metadata(spark: SparkSession, path: str, pyramid: Pyramid, driver: dict) -> dict:
    """Writes metadata.json, or checks that the one that is there tells of the same pyramid and format."""
    new = json.loads(json.dumps(dump_metadata(pyramid, driver), default=_default))
    at = Location(path, spark) / METADATA
    if at.exists():
        compare_metadata(at.read_json(), new)
    at.write_json(new)
    return new


def load_metadata(spark: SparkSession, path: str) -> dict:
    found = (Location(path, spark) / METADATA).read_json()
    if "pyramid" not in found or "driver" not in found:
        raise ValueError(f"{path}/{METADATA} isn't a tile directory's metadata")
    return found


def compare_metadata(old: dict, new: dict) -> None:
    if Pyramid.of(old["pyramid"]) != Pyramid.of(new["pyramid"]):
        raise ValueError("the output holds tiles of another pyramid")
    if old["driver"].get("format") != new["driver"].get("format"):
        raise ValueError("the output holds tiles of another format")


def split_to_output(packed: DataFrame, process: Pyramid, output: Pyramid, zoom: int) -> DataFrame:
    """Packed process tiles (with their pixel buffer) as packed output tiles: cut by array slices, no pixel rows."""
    if process == output:
        return packed
    if output.metatiling > process.metatiling:
        raise ValueError("output metatiles must not be larger than process metatiles")
    k, size, buffer = process.metatiling // output.metatiling, output.tile_size * output.metatiling, process.pixelbuffer
    df = cross_pyramid(packed.where(F.col("zoom") == zoom), process.without_pixelbuffer(), output)
    # A tile at the top of the grid may come without a buffer above it.
    y0 = (F.col("o_row") - F.col("row") * k) * size + F.when((F.col("row") == 0) & (F.col("height") < k * size + 2 * buffer), 0).otherwise(buffer)
    x0 = (F.col("o_col") - F.col("col") * k) * size + buffer
    rows = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.slice("pixels", (y0 + i) * F.col("width") + x0 + 1, F.lit(size)))
    return df.withColumn("pixels", F.flatten(rows)).withColumns({"row": F.col("o_row"), "col": F.col("o_col"), "height": F.lit(size), "width": F.lit(size)}).drop("o_row", "o_col")


WRITTEN = "zoom int, row int, col int, location string, bytes long"


def write_images(packed: DataFrame, path: str, pyramid: Pyramid, kind: str = "GTiff", dtype: str = "float64", nodata: float = 0.0, schema: str = SCHEMA, replaced: DataFrame | None = None) -> DataFrame:
    """An image file for each tile, by tile path schema; returns zoom, row, col, location, bytes.

    Bands of a tile are grouped first, many tiles at a time. A file appears whole or not at all: it is written under another name and
    then moved, so a task that is run again does no harm. Tiles without data aren't written, and of tiles in
    ``replaced`` that have none now the file goes.
    """
    ending = "tif" if kind == "GTiff" else "png"
    columns = ["band", "height", "width", "pixels", *(["tags"] if "tags" in packed.columns else [])]
    packed = packed.select(*KEYS, *columns)
    if replaced is not None:
        packed = packed.unionByName(replaced.select(*KEYS).distinct(), allowMissingColumns=True)

    def put(key: tuple[int, int, int], rows: pa.Table) -> pa.Table:
        zoom, row, col = key
        place = f"{path.rstrip('/')}/" + schema.format(zoom=zoom, row=row, col=col, extension=ending)
        rows = rows.filter(rows["band"].is_valid())
        data = arrays.cubes(rows) if rows.num_rows else np.full((1, 1, 1), np.nan)
        if np.isnan(data).all():
            delete(place)
            return arrays.empty_table(WRITTEN)
        if kind == "GTiff":
            tags = json.loads(rows["tags"][0].as_py() or "{}") if "tags" in rows.column_names else None
            content = images.write_geotiff(in_type(data, dtype, nodata), pyramid.tile_affine(zoom, row, col), pyramid.grid.crs, nodata, tags)
        else:
            content = images.write_png(to_rgba(data) if kind == "PNG" else shade_to_alpha(data))
        save_whole(place, content)
        return arrays.table_of({"zoom": [zoom], "row": [row], "col": [col], "location": [place], "bytes": [len(content)]}, WRITTEN)

    return by_tile(packed, put, WRITTEN)


def in_type(data: np.ndarray, dtype: str, nodata: float) -> np.ndarray:
    """Floats in a pixel type, held within its range; NaN becomes the no-data value."""
    if dtype in RANGES:
        low, high = RANGES[dtype]
        data = np.clip(data, low, high)
    return np.where(np.isnan(data), nodata, data).astype(dtype)


def file_system(place: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(place if "://" in place else place if place.startswith("file:") else "file://" + urllib.parse.quote(place))


def put_in_place(fs: pafs.FileSystem, part: str, at: str) -> None:
    """A file that is whole gets its name. On a local disk Hadoop keeps a checksum beside files that it wrote; that of a file replaced here goes."""
    if isinstance(fs, pafs.LocalFileSystem):
        _forget_checksum(fs, at)
    fs.move(part, at)


def _forget_checksum(fs: pafs.FileSystem, at: str) -> None:
    folder, _, name = at.rpartition("/")
    beside = f"{folder}/.{name}.crc"
    if fs.get_file_info(beside).type == pafs.FileType.File:
        fs.delete_file(beside)


def save_whole(place: str, content: bytes) -> None:
    fs, at = file_system(place)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    part = f"{at}.{np.random.default_rng().integers(1 << 62)}.part"
    with fs.open_output_stream(part, compression=None) as out:
        out.write(content)
    put_in_place(fs, part, at)


def delete(place: str) -> bool:
    """Whether there was a file to delete."""
    fs, at = file_system(place)
    there = fs.get_file_info(at).type == pafs.FileType.File
    if there:
        fs.delete_file(at)
        if isinstance(fs, pafs.LocalFileSystem):
            _forget_checksum(fs, at)
    return there


def removed(tiles: DataFrame, path: str, extension: str, schema: str = SCHEMA) -> DataFrame:
    """zoom, row, col of the tiles whose files were there and are deleted, by tasks, when this is run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(*(c.to_pylist() for c in batch.columns))
            gone = [delete(f"{path.rstrip('/')}/" + schema.format(zoom=z, row=r, col=c, extension=extension)) for z, r, c in keys]
            yield batch.filter(pa.array(gone, pa.bool_()))

    return tiles.select(*KEYS).mapInArrow(run, "zoom int, row int, col int")


def removed_rows(rows: DataFrame, path: str) -> DataFrame:
    """zoom, row of the Parquet partitions that are deleted, by tasks, when this is run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for zoom, row in zip(*(c.to_pylist() for c in batch.columns)):
                fs, at = file_system(f"{path.rstrip('/')}/zoom={zoom}/row={row}")
                if fs.get_file_info(at).type == pafs.FileType.Directory:
                    fs.delete_dir(at)
            yield batch

    return rows.select("zoom", "row").mapInArrow(run, "zoom int, row int")


def to_rgba(data: np.ndarray) -> np.ndarray:
    """One band: gray and alpha; two: gray, alpha; three: colour and alpha; four as they are."""
    alpha = np.where(np.isnan(data[0]), 0, 255)
    full = np.clip(np.nan_to_num(data), 0, 255)
    if len(data) == 1:
        return np.stack([full[0], full[0], full[0], alpha])
    if len(data) == 2:
        return np.stack([full[0], full[0], full[0], full[1]])
    if len(data) == 3:
        return np.stack([*full, alpha])
    if len(data) == 4:
        return full
    raise ValueError("PNG has 1 to 4 bands")


def shade_to_alpha(data: np.ndarray) -> np.ndarray:
    """Black under an alpha of 255 less the shade."""
    alpha = np.where(np.isnan(data[0]), 0, 255 - np.clip(np.nan_to_num(data[0]), 0, 255))
    return np.stack([np.zeros_like(alpha), alpha])


def write_geojson_tiles(features: DataFrame, path: str, schema: str = SCHEMA, replaced: DataFrame | None = None) -> DataFrame:
    """A GeoJSON document for each tile with features; returns zoom, row, col, location, bytes. Tiles in ``replaced`` that have none lose theirs."""
    properties = F.col("properties") if "properties" in features.columns else F.lit(None).cast("map<string,string>")
    rows = features.where(F.col("geom").isNotNull()).select(*KEYS, "geom", properties.alias("properties"))
    if replaced is not None:
        rows = rows.unionByName(replaced.select(*KEYS).distinct(), allowMissingColumns=True)

    def put(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        zoom, row, col = (int(k.as_py()) for k in key)
        place = f"{path.rstrip('/')}/" + schema.format(zoom=zoom, row=row, col=col, extension="geojson")
        found = [{"type": "Feature", "geometry": G.to_geojson(g), "properties": dict(p or {})} for g, p in zip(arrays.geometries(rows["geom"]), arrays.maps(rows["properties"])) if g is not None]
        if not found:
            delete(place)
            return arrays.empty_table(WRITTEN)
        content = json.dumps({"type": "FeatureCollection", "features": found}).encode()
        save_whole(place, content)
        return arrays.table_of({"zoom": [zoom], "row": [row], "col": [col], "location": [place], "bytes": [len(content)]}, WRITTEN)

    return rows.groupBy(*KEYS).applyInArrow(put, WRITTEN)


def write_single(packed: DataFrame, path: str, pyramid: Pyramid, zoom: int, dtype: str = "float64", nodata: float = 0.0) -> None:
    """All tiles of one zoom as one GeoTIFF of tiles, of any size.

    Tasks deflate the tiles and write them end to end into part files. The driver gets a place and a size for
    each tile, which the file's own header holds too, writes the header and appends the parts as streams. The
    file appears when it is whole.
    """
    spark = packed.sparkSession
    rows = packed.where((F.col("zoom") == zoom) & F.exists("pixels", lambda v: v.isNotNull()))
    ends = rows.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col"), F.max("band")).first()
    if ends[0] is None:
        raise ValueError(f"no tiles at zoom {zoom}")
    r0, r1, c0, c1, bands = ends
    size = pyramid.tile_size * pyramid.metatiling
    down, across = r1 - r0 + 1, c1 - c0 + 1
    parts = f"{path}.{np.random.default_rng().integers(1 << 62)}.parts"
    held = "part string, tile long, place long, bytes long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, name = None, 0, f"{parts}/{np.random.default_rng().integers(1 << 62)}"
        for batch in batches:
            found: dict[str, list] = {"part": [], "tile": [], "place": [], "bytes": []}
            for row, col, band, height, width, pixels in zip(*(batch.column(i).to_pylist() for i in range(5)), arrays.blocks(batch.column(5))):
                block = np.full((size, size), np.nan)
                block[:height, :width] = pixels.reshape(height, width)
                data = zlib.compress(in_type(block, dtype, nodata).astype(np.dtype(dtype).newbyteorder("<")).tobytes(), 6)
                if out is None:
                    fs, place = file_system(name)
                    fs.create_dir(place.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(place, compression=None)
                out.write(data)
                for key, value in zip(found, (name, ((band - 1) * down + row - r0) * across + col - c0, at, len(data))):
                    found[key].append(value)
                at += len(data)
            yield from arrays.table_of(found, held).to_batches()
        if out is not None:
            out.close()

    from gridloom.sources.paths import stored

    written = stored(rows.select("row", "col", "band", "height", "width", "pixels").mapInArrow(run, held), "single").toPandas()
    sizes, places = np.zeros(bands * down * across, dtype=np.int64), np.zeros(bands * down * across, dtype=np.int64)
    order = written.groupby("part")["bytes"].sum().sort_index()
    start = order.cumsum() - order
    sizes[written["tile"]] = written["bytes"]
    places[written["tile"]] = written["place"] + written["part"].map(start)
    head = images.tiled_start(down * size, across * size, size, bands, dtype, pyramid.without_pixelbuffer().tile_affine(zoom, r0, c0), pyramid.grid.crs, nodata, sizes.tolist(), places.tolist())
    fs, at = file_system(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(f"{at}.part", compression=None) as out:
        out.write(head)
        for part in order.index:
            with fs.open_input_stream(file_system(part)[1], compression=None) as stream:
                while data := stream.read(8 << 20):
                    out.write(data)
    put_in_place(fs, f"{at}.part", at)
    Location(parts, spark).rm(True)


def validated(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Columns of a declared output schema, cast; raises if one is missing."""
    lacking = [n for n in fields if n not in df.columns]
    if lacking:
        raise ValueError(f"the output lacks {', '.join(lacking)}")
    return df.select(*[F.col(n).cast(t).alias(n) for n, t in fields.items()])


def tiles_on_disk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For mapInPandas: rows with a location, and whether it exists."""
    for rows in batches:
        yield rows.assign(exists=[_there(p) for p in rows["location"]])


def _there(place: str) -> bool:
    fs, at = file_system(place)
    return fs.get_file_info(at).type == pafs.FileType.File
