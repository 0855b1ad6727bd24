"""Reading parts of large GeoTIFFs: an index of their blocks from headers alone, pruned by place, then ranged reads by tasks.

A block (an internal tile or strip) becomes a small raster of its own, so what follows is the same as for whole files,
a file of any size is spread over many tasks, and no task holds more than a block of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import arrays
from gridloom.functions import bounds as B
from gridloom.functions.bounds import Bounds
from gridloom.functions.pyramid import Pyramid
from gridloom.operators.joins import range_join
from gridloom.sources import images
from gridloom.sources.readers import RASTER

INDEX = "path string, block int, band int, inside int, height int, width int, rows int, stride int, offset long, size long, dtype string, packing int, predictor int, nodata double, crs string, px double, py double, box struct<left:double,bottom:double,right:double,top:double>"
#: Bytes that are read at once to look at a header.
PAGE = 64 << 10


class Ranged:
    """Bytes of a file by slices, read page by page as they are asked for."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read, self.pages = read, {}

    def __getitem__(self, part: slice) -> bytes:
        first, last = part.start or 0, part.stop
        out = []
        for page in range(first // PAGE, max(first, last - 1) // PAGE + 1):
            if page not in self.pages:
                self.pages[page] = self.read(page * PAGE, PAGE)
            out.append(self.pages[page])
        begin = first - first // PAGE * PAGE
        return b"".join(out)[begin : begin + last - first]


def reader(path: str) -> Callable[[int, int], bytes]:
    """(place, bytes) -> the bytes there, of a file in any store that pyarrow reaches."""
    from gridloom.sources.sinks import file_system

    fs, at = file_system(path)
    file = fs.open_input_file(at)
    return lambda place, n: file.read_at(n, place)


def index_rows(path: str, read: Callable[[int, int], bytes]) -> dict[str, list]:
    """The blocks of a file that hold anything."""
    f = images.Layout.of(images.geotiff_header(Ranged(read)))
    out: dict[str, list] = {n.split(" ")[0]: [] for n in INDEX.split(", ") if " " in n}
    for k, (offset, size) in enumerate(zip(f.offsets, f.sizes)):
        if not size:
            continue
        plane, y, x = f.place(k)
        h, w = min(f.block_height, f.height - y), min(f.block_width, f.width - x)
        left, top = f.affine.c + x * f.affine.a, f.affine.f + y * f.affine.e
        row = {
            "path": path, "block": k, "band": plane + 1, "inside": f.inside, "height": h, "width": w, "rows": f.block_height if f.tiled else h, "stride": f.block_width, "offset": offset, "size": size, "dtype": f.dtype,
            "packing": f.packing, "predictor": f.predictor, "nodata": f.nodata, "crs": f.crs, "px": f.affine.a, "py": -f.affine.e, "box": {"left": left, "bottom": top + h * f.affine.e, "right": left + w * f.affine.a, "top": top},
        }
        for name, values in out.items():
            values.append(row[name])
    return out


def block_index(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A row for each block of GeoTIFF files. Spark lists the files; of each the header is read, wherever it lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield from arrays.table_of(index_rows(path, reader(path)), INDEX).to_batches(max_chunksize=10_000)

    return spark.read.format("binaryFile").load(paths).select("path").mapInArrow(run, INDEX)


def decoded_blocks(rows: Iterable[dict], open_file: Callable[[str], Callable[[int, int], bytes]]) -> Iterator[dict[str, list]]:
    """Rasters (columns of RASTER) of index rows, block by block."""
    path, read = None, None
    for r in rows:
        if r["path"] != path:
            path, read = r["path"], open_file(r["path"])
        block = images.block_pixels(read(r["offset"], r["size"]), r["dtype"], r["packing"], r["predictor"], r["rows"], r["stride"], r["inside"])
        values = np.moveaxis(block[: r["height"], : r["width"]], 2, 0).astype(float)
        if r["nodata"] is not None:
            values[values == r["nodata"]] = np.nan
        k = r["inside"]
        same = {n: [r[n]] * k for n in ("path", "height", "width", "nodata", "crs", "px", "py", "box")}
        yield {**same, "band": [r["band"] + i for i in range(k)], "dtype": [np.dtype(r["dtype"]).newbyteorder("=").name] * k, "pixels": arrays.lists(values)}


def read_blocks(index: DataFrame) -> DataFrame:
    """The blocks of ``index`` as rasters, each a ranged read; blocks of one file are dealt out to all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in decoded_blocks(batch.to_pylist(), reader):
                yield from arrays.table_of(columns, RASTER).to_batches()

    return index.repartition("path", F.expr("block DIV 16")).sortWithinPartitions("path", "offset").mapInArrow(run, RASTER)


def within(index: DataFrame, bounds: Bounds) -> DataFrame:
    """Index rows whose block shares an area with ``bounds`` (in the files' projection)."""
    return index.where(B.overlap(F.col("box"), B.literal(bounds)))


def for_tiles(index: DataFrame, tiles: DataFrame, pyramid: Pyramid, zoom: int, buffer: float = 0.0) -> DataFrame:
    """Index rows whose block shares an area with one of ``tiles`` (widened by ``buffer``), by a join on cells."""
    box = pyramid.box(zoom, F.col("row"), F.col("col"))
    wide = B.column(box["left"] - buffer, box["bottom"] - buffer, box["right"] + buffer, box["top"] + buffer)
    return range_join(index, tiles.select(wide.alias("box")), pyramid, zoom, how="left_semi", touching=False)
