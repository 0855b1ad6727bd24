"""Formats of tile directories: how tiles are written, found and read again.

``output.format`` of a configuration names one; `register` adds another. Parquet keeps zoom and row as
partitions; the others write a file for each tile by the tile path schema, so that other programs find them.
Each has the same three operations, over packed rasters or features with zoom, row and col.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.pyramid import Pyramid
from gridloom.operators.tiles import KEYS, dealt
from gridloom.sources import readers, sinks

#: What tells a tile's zoom, row and col in its path.
_PLACE = r"/(\d+)/(\d+)/(\d+)\.[^/.]+$"


@dataclass(frozen=True)
class Format:
    """write(df, path, pyramid, options, replaced); rows(spark, path, options, zoom); existing(spark, path)."""

    name: str
    data_type: str
    extension: str
    write: Callable[[DataFrame, str, Pyramid, dict, DataFrame | None], None]
    rows: Callable[[SparkSession, str, dict, int | None], DataFrame]
    existing: Callable[[SparkSession, str], DataFrame]


FORMATS: dict[str, Format] = {}


def register(found: Format) -> None:
    FORMATS[found.name] = found


def of(options: dict) -> Format:
    """The format that an output names; raises for one that isn't written."""
    name = options.get("format")
    if name not in FORMATS:
        raise ValueError(f"no writer for {name!r}, only for {', '.join(sorted(FORMATS))}")
    return FORMATS[name]


def keyed(df: DataFrame, path: str = "path") -> DataFrame:
    """``df`` with zoom, row and col from its paths; files that aren't tiles are left out."""
    at = lambda i: F.regexp_extract(path, _PLACE, i)
    return df.where(F.col(path).rlike(_PLACE)).withColumns({k: at(i).cast("int") for i, k in enumerate(KEYS, 1)})


def _files(spark: SparkSession, path: str, extension: str, zoom: int | None) -> DataFrame | None:
    """path of a directory's tile files; None if there are no zooms. Tasks list the rows' folders, so the driver has no list of all files,
    and files are dealt to tasks by number: Spark's own reader takes an opened file for 4 MB, and so gives a task few small ones.
    It brings path and content from stores that only Spark reaches."""
    at = sinks.Location(path, spark)
    if not at.exists():
        return None
    zooms = [x.name for x in at.ls() if x.name.isdigit() and (zoom is None or int(x.name) == zoom)]
    if not zooms:
        return None
    if _reached(path):
        return _listed(spark, path.rstrip("/"), extension, zooms)
    reader = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{extension}").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true")
    return reader.load([f"{path.rstrip('/')}/{z}" for z in zooms])


def _reached(path: str) -> bool:
    """Whether pyarrow's file systems reach a folder."""
    try:
        fs, at = sinks.file_system(path)
        return fs.get_file_info(at).type == pafs.FileType.Directory
    except (OSError, pa.ArrowException):
        return False


def _listed(spark: SparkSession, path: str, extension: str, zooms: list[str]) -> DataFrame:
    def inside(kind: pafs.FileType, name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for folder in batch.column(0).to_pylist():
                    fs, at = sinks.file_system(folder)
                    found = fs.get_file_info(pafs.FileSelector(at, allow_not_found=True))
                    places = [f"{folder}/{x.base_name}" for x in found if x.type == kind and re.fullmatch(name, x.base_name)]
                    yield pa.RecordBatch.from_arrays([pa.array(places, pa.string())], names=["path"])

        return run

    rows = spark.createDataFrame([(f"{path}/{z}",) for z in zooms], "path string").mapInArrow(inside(pafs.FileType.Directory, r"\d+"), "path string")
    return dealt(rows, "path").mapInArrow(inside(pafs.FileType.File, rf"\d+\.{re.escape(extension)}"), "path string")


def _existing(extension: str) -> Callable[[SparkSession, str], DataFrame]:
    def existing(spark: SparkSession, path: str) -> DataFrame:
        files = _files(spark, path, extension, None)
        return spark.createDataFrame([], "zoom int, row int, col int") if files is None else keyed(files.select("path")).select(*KEYS)

    return existing


_TILE = "zoom int, row int, col int, band int, height int, width int, pixels array<double>, tags string"


def _image_rows(extension: str, change: Callable[[np.ndarray], np.ndarray] | None = None) -> Callable:
    def rows(spark: SparkSession, path: str, options: dict, zoom: int | None = None) -> DataFrame:
        files = _files(spark, path, extension, zoom)
        if files is None:
            return spark.createDataFrame([], _TILE)
        return keyed(readers.decoded(dealt(files, "path") if "content" not in files.columns else files, change=change)).select(*KEYS, "band", "height", "width", "pixels", F.lit("{}").alias("tags"))

    return rows


def _seen(data: np.ndarray) -> np.ndarray:
    """The bands of a PNG without its alpha, no data where that is 0."""
    return np.where(data[-1] > 0, data[:-1].astype(float), np.nan)


def _shade(data: np.ndarray) -> np.ndarray:
    """The shade that the alpha of a hillshade's PNG stands for."""
    return np.where(data[-1:] > 0, 255 - data[-1:].astype(float), np.nan)


def _write_images(kind: str) -> Callable:
    def write(df: DataFrame, path: str, pyramid: Pyramid, options: dict, replaced: DataFrame | None = None) -> None:
        done = sinks.write_images(df, path, pyramid, kind, options.get("dtype", "float64"), float(options.get("nodata", 0) or 0), replaced=replaced)
        done.write.format("noop").mode("overwrite").save()

    return write


def _write_parquet(df: DataFrame, path: str, pyramid: Pyramid, options: dict, replaced: DataFrame | None = None) -> None:
    if "dtype" in options and "pixels" in df.columns:
        from gridloom.functions.raster import clipped_to

        df = df.withColumn("pixels", F.transform("pixels", lambda v: clipped_to(v, options["dtype"]).cast("double")))
    sinks.write_tiles(df, path, replaced=replaced)


def _parquet_rows(spark: SparkSession, path: str, options: dict, zoom: int | None = None) -> DataFrame:
    if not sinks.has_tiles(spark, path):
        return spark.createDataFrame([], _TILE)
    df = sinks.tile_rows(spark, path)
    return df if zoom is None else df.where(F.col("zoom") == zoom)


def _write_features(df: DataFrame, path: str, pyramid: Pyramid, options: dict, replaced: DataFrame | None = None) -> None:
    sinks.write_geojson_tiles(df, path, replaced=replaced).write.format("noop").mode("overwrite").save()


def _feature_rows(spark: SparkSession, path: str, options: dict, zoom: int | None = None) -> DataFrame:
    files = _files(spark, path, "geojson", zoom)
    if files is None:
        return spark.createDataFrame([], f"zoom int, row int, col int, {readers.FEATURE}")
    return keyed(readers.decoded_features(files)).select(*KEYS, "feature_id", "geom", "properties")


for _f in (
    Format("Parquet", "raster", "parquet", _write_parquet, _parquet_rows, lambda spark, path: sinks.existing_tiles(spark, path)),
    Format("GTiff", "raster", "tif", _write_images("GTiff"), _image_rows("tif"), _existing("tif")),
    Format("PNG", "raster", "png", _write_images("PNG"), _image_rows("png", _seen), _existing("png")),
    Format("PNG_hillshade", "raster", "png", _write_images("PNG_hillshade"), _image_rows("png", _shade), _existing("png")),
    Format("GeoJSON", "vector", "geojson", _write_features, _feature_rows, _existing("geojson")),
):
    register(_f)


def remove(spark: SparkSession, path: str, gone: DataFrame, extension: str) -> None:
    """Delete tiles' files, by tasks."""
    sinks.removed(gone.select(*KEYS), path, extension).write.format("noop").mode("overwrite").save()
