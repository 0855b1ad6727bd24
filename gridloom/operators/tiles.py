"""Tiles as rows: assignment, hierarchy, cross-pyramid joins, counting."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import bounds as B
from gridloom.functions import geometry as G
from gridloom.functions.bounds import Bounds
from gridloom.functions.pyramid import Pyramid
from gridloom.operators import covering as C

KEYS = ["zoom", "row", "col"]


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by keys in a fixed number of partitions, for Python work that costs much more than its rows' bytes tell."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


def by_tile(df: DataFrame, call: Callable[[tuple[int, int, int], pa.Table], pa.Table], schema: str) -> DataFrame:
    """``call(key, rows)`` for each tile's rows, as `applyInArrow` but many tiles to an Arrow batch: small tiles don't each cost a stream of their own.

    Partitions are sorted by tile; what is kept from one batch to the next is the batch's last tile.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept, out = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in KEYS])
            starts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist()]
            for start, end, key in zip(starts, [*starts[1:], batch.num_rows], zip(*keys[:, starts].tolist())):
                if key != last and kept:
                    found = call(last, pa.Table.from_batches(kept))
                    out += [found] if found.num_rows else []
                    kept = []
                last = key
                kept.append(batch.slice(start, end - start))
            if out:
                yield from pa.concat_tables(out).combine_chunks().to_batches()
                out = []
        if kept:
            yield from call(last, pa.Table.from_batches(kept)).to_batches()

    return dealt(df, *KEYS).sortWithinPartitions(*KEYS).mapInArrow(run, schema)


def tiles_from_bounds(spark: SparkSession, pyramid: Pyramid, bounds: Bounds, zooms) -> DataFrame:
    """zoom, row, col of the tiles that share an area with ``bounds``: ranges are made in the JVM, rows in parallel.

    Bounds beyond +-180 on a global grid wrap around.
    """
    spans = []
    for zoom in zooms:
        for part in wrapped(pyramid, bounds):
            found = pyramid.cell_range(zoom, part)
            if found:
                spans.append((zoom, *found))
    ranges = spark.createDataFrame(spans or [(0, 0, -1, 0, -1)], "zoom int, r0 int, r1 int, c0 int, c1 int").where("r1 >= r0 AND c1 >= c0")
    rows = ranges.select("zoom", F.explode(F.sequence("r0", "r1")).alias("row"), "c0", "c1")
    return rows.select("zoom", "row", F.explode(F.sequence("c0", "c1")).alias("col"))


def wrapped(pyramid: Pyramid, b: Bounds) -> list[Bounds]:
    """Bounds as those within the grid that they mean: on a global grid what reaches beyond an edge comes in at the other."""
    g = pyramid.grid
    if not g.is_global or (b.left >= g.left and b.right <= g.right):
        return [b]
    width = g.right - g.left
    parts = [b.intersection(Bounds(g.left, b.bottom, g.right, b.top))]
    if b.left < g.left:
        parts.append(Bounds(max(b.left + width, g.left), b.bottom, g.right, b.top))
    if b.right > g.right:
        parts.append(Bounds(g.left, b.bottom, min(b.right - width, g.right), b.top))
    return [p for p in parts if p]


def cells(df: DataFrame, pyramid: Pyramid, zoom: int, box: str = "box") -> DataFrame:
    """``df`` with zoom, row and col of each cell that the row's box reaches into (an explode, no join)."""
    r0, r1, c0, c1 = pyramid.first_last(zoom, F.col(box))
    rows = df.withColumn("zoom", F.lit(zoom)).withColumn("row", F.explode(F.sequence(r0, r1)))
    return rows.withColumn("col", F.explode(F.sequence(c0, c1)))


def tiles_from_features(features: DataFrame, pyramid: Pyramid, zoom: int, exact: bool = False, geom: str = "geom") -> DataFrame:
    """Distinct tiles that the features' boxes reach into; ``exact``: those that the features themselves meet."""
    return C.feature_tiles(features, pyramid, zoom, exact, geom)


def meets(g: Column, box: Column) -> Column:
    """Whether a geometry meets a box: a point of it inside, a corner or the centre of the box inside it, or an edge through it."""
    inside = F.exists(G.points(g), lambda p: (p["x"] >= box["left"]) & (p["x"] <= box["right"]) & (p["y"] >= box["bottom"]) & (p["y"] <= box["top"]))
    corner = F.lit(False)
    for x, y in (("left", "bottom"), ("right", "bottom"), ("right", "top"), ("left", "top")):
        corner = corner | G.holds(g, box[x], box[y])

    def through(r: Column) -> Column:
        def edge(i: Column) -> Column:
            a, b = F.element_at(r, i), F.element_at(r, i + 1)
            # The edge passes the box if the box's corners aren't all on one side of it and their boxes meet.
            side = [(b["x"] - a["x"]) * (box[y] - a["y"]) - (b["y"] - a["y"]) * (box[x] - a["x"]) for x in ("left", "right") for y in ("bottom", "top")]
            near = (F.least(a["x"], b["x"]) <= box["right"]) & (F.greatest(a["x"], b["x"]) >= box["left"]) & (F.least(a["y"], b["y"]) <= box["top"]) & (F.greatest(a["y"], b["y"]) >= box["bottom"])
            return near & (F.least(*side) <= 0) & (F.greatest(*side) >= 0)

        return F.when(F.size(r) < 2, F.lit(False)).otherwise(F.exists(F.sequence(F.lit(1), F.size(r) - 1), edge))

    polygon = g["type"].isin("Polygon", "MultiPolygon")
    return inside | (polygon & corner) | F.exists(g["rings"], through)


def assign(points: DataFrame, pyramid: Pyramid, zoom: int, x: str = "lon", y: str = "lat") -> DataFrame:
    """``points`` with zoom, row, col."""
    return points.withColumns({"zoom": F.lit(zoom), "row": pyramid.row_of(F.col(y), zoom), "col": pyramid.col_of(F.col(x), zoom)})


def parents(tiles: DataFrame) -> DataFrame:
    return tiles.where("zoom > 0").select((F.col("zoom") - 1).alias("zoom"), F.expr("row DIV 2").cast("int").alias("row"), F.expr("col DIV 2").cast("int").alias("col")).distinct()


def children(tiles: DataFrame, pyramid: Pyramid) -> DataFrame:
    """Up to four each; fewer at the matrix's edge."""
    w, h = _matrix(pyramid)
    both = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    df = tiles.select((F.col("zoom") + 1).alias("zoom"), "row", "col", F.explode(both).alias("o"))
    df = df.select("zoom", (F.col("row") * 2 + F.col("o.i")).alias("row"), (F.col("col") * 2 + F.col("o.j")).alias("col"))
    return df.where((F.col("row") < h) & (F.col("col") < w))


def _matrix(pyramid: Pyramid) -> tuple[Column, Column]:
    """Matrix width and height for the column ``zoom``."""
    size = F.pow(F.lit(2.0), F.col("zoom")) / pyramid.metatiling
    return F.greatest(F.ceil(size * pyramid.grid.cols), F.lit(1)), F.greatest(F.ceil(size * pyramid.grid.rows), F.lit(1))


def neighbors(tiles: DataFrame, pyramid: Pyramid, connectedness: int = 8) -> DataFrame:
    """n_row, n_col of each tile's neighbours; columns wrap on a global grid."""
    steps = [(-1, 0), (0, 1), (1, 0), (0, -1)] + ([(-1, 1), (1, 1), (1, -1), (-1, -1)] if connectedness == 8 else [])
    w, h = _matrix(pyramid)
    offsets = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in steps])
    df = tiles.select("*", F.explode(offsets).alias("o"))
    col = F.pmod(F.col("col") + F.col("o.dc"), w) if pyramid.grid.is_global else F.col("col") + F.col("o.dc")
    df = df.withColumn("n_row", (F.col("row") + F.col("o.dr")).cast("int")).withColumn("n_col", col.cast("int")).drop("o")
    return df.where((F.col("n_row") >= 0) & (F.col("n_row") < h) & (F.col("n_col") >= 0) & (F.col("n_col") < w) & ~((F.col("n_row") == F.col("row")) & (F.col("n_col") == F.col("col")))).distinct()


def ancestors(df: DataFrame, top: int = 0) -> DataFrame:
    """``df`` once for each zoom from its own down to ``top``, with the keys of the tile above: a roll-up in one shuffle."""
    up = F.explode(F.sequence(F.lit(0), F.col("zoom") - top)).alias("_up")
    df = df.where(F.col("zoom") >= top).select("*", up)
    return df.withColumn("row", F.floor(F.col("row") / F.pow(F.lit(2), F.col("_up"))).cast("int")).withColumn("col", F.floor(F.col("col") / F.pow(F.lit(2), F.col("_up"))).cast("int")).withColumn("zoom", F.col("zoom") - F.col("_up")).drop("_up")


def cross_pyramid(tiles: DataFrame, own: Pyramid, other: Pyramid) -> DataFrame:
    """For each tile of ``own`` the tiles ``o_row, o_col`` of ``other`` (same grid and zoom) that share an area: metatile arithmetic, no join."""
    if own.grid != other.grid:
        raise ValueError("pyramids over different grids")
    a, b = own.metatiling, other.metatiling
    if a >= b:
        k = a // b
        w, h = _matrix(other)
        df = tiles.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_i")).select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_j"))
        df = df.withColumn("o_row", F.col("row") * k + F.col("_i")).withColumn("o_col", F.col("col") * k + F.col("_j")).drop("_i", "_j")
        return df.where((F.col("o_row") < h) & (F.col("o_col") < w))
    k = b // a
    return tiles.withColumn("o_row", F.floor(F.col("row") / k).cast("int")).withColumn("o_col", F.floor(F.col("col") / k).cast("int"))


def count_tiles(spark: SparkSession, pyramid: Pyramid, bounds: Bounds, zooms) -> dict[int, int]:
    """Number of tiles by zoom, in closed form: no tile is made."""
    out = {}
    for zoom in zooms:
        n = 0
        for part in wrapped(pyramid, bounds):
            found = pyramid.cell_range(zoom, part)
            n += 0 if found is None else (found[1] - found[0] + 1) * (found[3] - found[2] + 1)
        out[zoom] = n
    return out


def count_feature_tiles(features: DataFrame, pyramid: Pyramid, zooms, exact: bool = True) -> DataFrame:
    """zoom, tiles: how many tiles the features meet at each zoom, or their boxes; tiles inside are counted, not made."""
    return C.count_features(features, pyramid, zooms, exact)


def batches(tiles: DataFrame, by: str = "row", n: int = 200) -> DataFrame:
    """Tiles ranged by row or column, so that a task has neighbours."""
    if by not in ("row", "col"):
        raise ValueError("batches are by row or col")
    return tiles.repartitionByRange(n, "zoom", by).sortWithinPartitions("zoom", by, "col" if by == "row" else "row")


def combined_affine(tiles: DataFrame, pyramid: Pyramid, zoom: int) -> DataFrame:
    """left, top, width and height in pixels of the image that all tiles make up."""
    box = tiles.where(F.col("zoom") == zoom).select(pyramid.box(zoom, F.col("row"), F.col("col")).alias("box")).agg(*B.total("box"))
    px = pyramid.pixel_size(zoom)
    return box.select("left", "top", F.round((F.col("right") - F.col("left")) / px).cast("int").alias("width"), F.round((F.col("top") - F.col("bottom")) / px).cast("int").alias("height"))
