"""Indexes of tile directories: which tiles there are, and where."""

from __future__ import annotations

from collections.abc import Iterator
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.pyramid import Pyramid, task_id
from gridloom.operators.joins import merged

SCHEMA = "{zoom}/{row}/{col}.{extension}"


def location(schema: str, extension: str, base: str = ""):
    """The path of a tile as a column, from a schema of zoom, row, col and extension."""
    parts, rest = [], (base.rstrip("/") + "/" if base else "") + schema.replace("{extension}", extension)
    while rest:
        i = min((rest.find("{" + n + "}") for n in ("zoom", "row", "col") if "{" + n + "}" in rest), default=-1)
        if i < 0:
            parts.append(F.lit(rest))
            break
        name = rest[i + 1 : rest.index("}", i)]
        parts += [F.lit(rest[:i])] * bool(i) + [F.col(name).cast("string")]
        rest = rest[i + len(name) + 2 :]
    return F.concat(*parts)


def zoom_index(tiles: DataFrame, schema: str = SCHEMA, extension: str = "parquet", base: str = "", pyramid: Pyramid | None = None, zoom: int | None = None) -> DataFrame:
    """tile_id, zoom, row, col, location, and with a pyramid and zoom the tile's box."""
    cols = [task_id(F.col("zoom"), F.col("row"), F.col("col")).alias("tile_id"), "zoom", "row", "col", location(schema, extension, base).alias("location")]
    if pyramid is not None and zoom is not None:
        cols.append(pyramid.box(zoom, F.col("row"), F.col("col")).alias("box"))
    return tiles.select(*cols)


def append(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Only tiles whose id isn't in the index yet are added."""
    return merged(existing, new, "tile_id")


def write_text(index: DataFrame, path: str) -> None:
    """A location in each line."""
    index.select("location").write.mode("overwrite").text(path)


def write_geojson(index: DataFrame, path: str) -> None:
    """GeoJSON features, one in each line."""
    b = F.col("box")
    corners = [(b["left"], b["bottom"]), (b["right"], b["bottom"]), (b["right"], b["top"]), (b["left"], b["top"]), (b["left"], b["bottom"])]
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(F.array(*[F.array(x, y) for x, y in corners])).alias("coordinates"))
    properties = F.struct("tile_id", "zoom", "row", "col", "location")
    index.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties"))).alias("value")).write.mode("overwrite").text(path)


def vrt(index: DataFrame, pyramid: Pyramid, zoom: int, bands: int = 1, dtype: str = "Float64", nodata: float = 0.0) -> Iterator[str]:
    """A virtual mosaic of one zoom's tiles as the lines of an XML document, of any number of tiles: they come to the driver one partition at a time."""
    rows = index.where(F.col("zoom") == zoom).select("row", "col", "location")
    ends = rows.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()
    if ends[0] is None:
        raise ValueError(f"no tiles at zoom {zoom}")
    total = pyramid.tile_bounds(zoom, ends[0], ends[2]) + pyramid.tile_bounds(zoom, ends[1], ends[3])
    px = pyramid.pixel_size(zoom)
    yield f'<VRTDataset rasterXSize="{round(total.width / px)}" rasterYSize="{round(total.height / px)}">'
    yield f"  <SRS>{escape(pyramid.grid.crs)}</SRS>"
    yield f"  <GeoTransform>{total.left}, {px}, 0.0, {total.top}, 0.0, {-px}</GeoTransform>"
    for band in range(1, bands + 1):
        yield f'  <VRTRasterBand dataType="{dtype}" band="{band}">'
        yield f"    <NoDataValue>{nodata}</NoDataValue>"
        for r in rows.orderBy("row", "col").toLocalIterator():
            b = pyramid.tile_bounds(zoom, r["row"], r["col"])
            size = f'xSize="{round(b.width / px)}" ySize="{round(b.height / px)}"'
            x, y = round((b.left - total.left) / px), round((total.top - b.top) / px)
            yield "    <ComplexSource>"
            yield f'      <SourceFilename relativeToVRT="{0 if r["location"].startswith("/") or "://" in r["location"] else 1}">{escape(r["location"])}</SourceFilename>'
            yield f"      <SourceBand>{band}</SourceBand>"
            yield f'      <SrcRect xOff="0" yOff="0" {size}/>'
            yield f'      <DstRect xOff="{x}" yOff="{y}" {size}/>'
            yield f"      <NODATA>{nodata}</NODATA>"
            yield "    </ComplexSource>"
        yield "  </VRTRasterBand>"
    yield "</VRTDataset>"


def write_lines(lines: Iterator[str], path: str) -> None:
    """A document as a stream; it appears when it is whole."""
    from gridloom.sources.sinks import file_system, put_in_place

    fs, at = file_system(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(f"{at}.part", compression=None) as out:
        for line in lines:
            out.write(line.encode() + b"\n")
    put_in_place(fs, f"{at}.part", at)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """An index that `write_geojson` wrote, as `zoom_index` gives it."""
    point = "array<array<array<double>>>"
    shape = f"type string, geometry struct<type:string,coordinates:{point}>, properties struct<tile_id:string,zoom:int,row:int,col:int,location:string>"
    df = spark.read.schema(shape).json(path)
    ring = F.col("geometry.coordinates")[0]
    box = F.struct(ring[0][0].alias("left"), ring[0][1].alias("bottom"), ring[2][0].alias("right"), ring[2][1].alias("top"))
    return df.select("properties.*", box.alias("box"))
