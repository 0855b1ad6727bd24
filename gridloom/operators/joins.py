"""Joins: spatial range joins by cell keys, semi and anti joins of runs, merges of old and new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import bounds as B
from gridloom.functions import geometry as G
from gridloom.functions.pyramid import Pyramid
from gridloom.operators import covering as C
from gridloom.operators.tiles import KEYS


def range_join(left: DataFrame, right: DataFrame, pyramid: Pyramid, zoom: int, left_box: str = "box", right_box: str = "box", how: str = "inner", touching: bool = True) -> DataFrame:
    """Rows whose boxes meet. Each box has a level, the finest up to ``zoom`` at which it reaches into few cells, so a wide
    box makes no more rows than a small one; both sides are dealt to cells, joined on the cell, and tested.

    A pair meets at the coarser of its two levels: the finer box is there by the cells above its own. Of several shared
    cells it is kept in that of the upper left corner of what the boxes share. So there is no distinct and no shuffle
    after the join, and Spark may split hot cells. Only levels that the other side has are dealt to; to know them, both
    sides' boxes are read once before the join. The columns of ``right`` that clash are prefixed with ``r_``. Semi and anti
    joins collapse equal rows of ``left``.
    """
    if how not in ("inner", "left_semi", "left_anti"):
        raise ValueError(how)
    # Column by column: of a struct with all of them, Spark's pruning of nested fields under two explodes loses fields.
    whole = lambda df, box, name: df.select(*[df[f"`{c}`"].alias(f"{name}{i}") for i, c in enumerate(df.columns)], F.col(box).alias("_b"))
    has_left, has_right = C.levels_in_use(left, pyramid, zoom, left_box, touching), C.levels_in_use(right, pyramid, zoom, right_box, touching)
    # Side 1: the left box's own cells, under which lie right boxes as fine or finer; side 2: finer left boxes under a right one's.
    a = C.level_cells(whole(left, left_box, "_left"), pyramid, zoom, "_b", touching)
    a = a.where(F.when(F.col("zoom") == F.col("_own"), F.array_max(has_right) >= F.col("zoom")).otherwise(F.array_contains(has_right, F.col("zoom"))))
    a = a.withColumn("_side", F.when(F.col("zoom") == F.col("_own"), 1).otherwise(2)).drop("_own").withColumnsRenamed({"_b": "_a", **{k: f"_{k}" for k in KEYS}})
    b = C.level_cells(whole(right, right_box, "_right"), pyramid, zoom, "_b", touching)
    b = b.withColumn("_s", F.explode(F.when(F.col("zoom") == F.col("_own"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    b = b.where(F.when(F.col("_s") == 1, F.array_contains(has_left, F.col("zoom"))).otherwise(F.array_max(has_left) > F.col("zoom"))).drop("_own")
    if how != "inner":
        b = b.select(*KEYS, "_s", "_b")
    test = B.intersect(F.col("_a"), F.col("_b")) if touching else B.overlap(F.col("_a"), F.col("_b"))
    x, y = F.greatest(F.col("_a.left"), F.col("_b.left")), F.least(F.col("_a.top"), F.col("_b.top"))
    row, col = C.cell_at(pyramid, F.col("_zoom"), x, y)
    same = (F.col("_side") == F.col("_s")) & (F.col("_zoom") == F.col("zoom")) & (F.col("_row") == F.col("row")) & (F.col("_col") == F.col("col"))
    joined = a.join(b, same & test & (row == F.col("_row")) & (col == F.col("_col")))
    own = [F.col(f"_left{i}").alias(c) for i, c in enumerate(left.columns)]
    if how == "inner":
        return joined.select(*own, *[F.col(f"_right{i}").alias(f"r_{c}" if c in left.columns else c) for i, c in enumerate(right.columns)])
    hits = joined.select(*own).distinct()
    return hits if how == "left_semi" else left.join(hits, [left[c].eqNullSafe(hits[c]) for c in left.columns], "left_anti")


def points_in_boxes(points: DataFrame, boxes: DataFrame, pyramid: Pyramid, zoom: int, x: str = "lon", y: str = "lat", box: str = "box") -> DataFrame:
    """Point rows with each box row that holds them (half open): an equi-join on the point's cell at each level that boxes have."""
    p = C.point_cells(points, pyramid, C.levels(zoom), C.levels_in_use(boxes, pyramid, zoom, box, True), x, y)
    b = C.level_cells(boxes, pyramid, zoom, box, True, above=False).drop("_own")
    on = _in_cell() & B.holds(F.col(box), F.col(x), F.col(y))
    return p.join(b, on).drop("_zoom", "_row", "_col", *KEYS)


def points_in_polygons(points: DataFrame, features: DataFrame, pyramid: Pyramid, zoom: int, x: str = "lon", y: str = "lat", geom: str = "geom") -> DataFrame:
    """Point rows with each feature that holds them, by the cells of the features' coverings; those wholly inside need no test."""
    b = C.polygon_cells(features, pyramid, zoom, geom)
    used = C.polygon_cells(features.select(geom), pyramid, zoom, geom).agg(F.collect_set("zoom")).scalar()
    p = C.point_cells(points, pyramid, list(range(zoom, -1, -1)), used, x, y)
    return p.join(b, _in_cell() & (F.col("whole") | G.holds(F.col(geom), F.col(x), F.col(y)))).drop("_zoom", "_row", "_col", "whole", *KEYS)


def _in_cell() -> Column:
    return (F.col("_zoom") == F.col("zoom")) & (F.col("_row") == F.col("row")) & (F.col("_col") == F.col("col"))


def theta_boxes(left: DataFrame, right: DataFrame, left_box: Column, right_box: Column, most_rows: int = 10_000) -> DataFrame:
    """The plain nested loop, for a right side of at most ``most_rows`` rows; raises beyond (use range_join there)."""
    if right.limit(most_rows + 1).count() > most_rows:
        raise ValueError(f"over {most_rows} rows on the right: use range_join")
    return left.join(F.broadcast(right), B.intersect(left_box, right_box))


def missing(tiles: DataFrame, existing: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Tiles without output: what a run that continues has to do."""
    return tiles.join(existing.select(*keys).distinct(), keys, "left_anti")


def present(tiles: DataFrame, existing: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return tiles.join(existing.select(*keys), keys, "left_semi")


def process_tiles_done(process: DataFrame, own: Pyramid, output: Pyramid, existing: DataFrame) -> DataFrame:
    """Process tiles all of whose output tiles exist."""
    from gridloom.operators.tiles import cross_pyramid

    want = cross_pyramid(process.select(*KEYS), own, output)
    have = existing.select(F.col("zoom"), F.col("row").alias("o_row"), F.col("col").alias("o_col"), F.lit(True).alias("_have")).distinct()
    joined = want.join(have, ["zoom", "o_row", "o_col"], "left")
    return joined.groupBy(*KEYS).agg(F.bool_and(F.coalesce("_have", F.lit(False))).alias("done")).where("done").select(*KEYS)


def dependencies(tiles: DataFrame) -> DataFrame:
    """zoom, row, col of parents with c_row, c_col of those of their children that are among the tiles."""
    up = tiles.select((F.col("zoom") + 0).alias("c_zoom"), F.col("row").alias("c_row"), F.col("col").alias("c_col"), F.expr("zoom - 1").alias("zoom"), F.expr("row DIV 2").cast("int").alias("row"), F.expr("col DIV 2").cast("int").alias("col"))
    return tiles.join(up, KEYS)


def attach(tiles: DataFrame, results: DataFrame, pyramid: Pyramid, zoom: int) -> DataFrame:
    """Tiles with the results whose box meets theirs, or no result."""
    boxed = tiles.withColumn("box", pyramid.box(zoom, F.col("row"), F.col("col")))
    hits = range_join(boxed.select(*[F.col(k).alias(f"t_{k}") for k in KEYS], "box"), results, pyramid, zoom)
    hits = hits.withColumnsRenamed({f"t_{k}": k for k in KEYS}).drop("box", "r_box")
    return tiles.join(hits, KEYS, "left")


def merged(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """What exists and the new rows whose key isn't there yet."""
    return existing.unionByName(new.join(existing.select(key), key, "left_anti").select(existing.columns))


def to_copy(source: DataFrame, target: DataFrame, keys: list[str], overwrite: bool = False, compare: str | None = None) -> DataFrame:
    """Source rows that a copy has to write: not in the target, or all with ``overwrite``, or with another value of ``compare``."""
    if overwrite:
        return source
    there = target.select(*keys, F.lit(True).alias("_there"), *([F.col(compare).alias("_other")] if compare else []))
    joined = source.join(there, keys, "left")
    want = F.col("_there").isNull()
    if compare:
        want = want | ~F.col(compare).eqNullSafe(F.col("_other"))
    return joined.where(want).select(source.columns)
