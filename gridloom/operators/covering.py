"""Coverings of geometries by tiles of several zooms, and what is counted and joined through them.

A cell that lies wholly inside a polygon stays as it is; only cells that its border passes are split, down to the
bottom zoom or until a feature has its budget of cells. So the rows that a feature makes follow the length of its
border, not its area, and with a budget they have a bound at any zoom. Boxes need less: each has one level, the
finest at which it reaches into few cells. Cells of different zooms meet through the keys of their ancestors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.pyramid import Pyramid

KEYS = ["zoom", "row", "col"]
#: Most cells of a box at its own level, and zooms between the levels of boxes.
MOST, STEP = 16, 2
#: Most cells of a feature's covering in a join.
BUDGET = 256
#: Pairs of a cell and an edge that are in work at once.
PAIRS = 1 << 18
#: Where outer cells end if they also hold what lies beyond the grid.
FAR = 1e9


# Boxes: one level each

def levels(zoom: int) -> list[int]:
    """From ``zoom`` up to 0, the levels that boxes may have."""
    return sorted({*range(zoom, -1, -STEP), 0}, reverse=True)


def reach(pyramid: Pyramid, zoom: int, box: Column, closed: bool = False) -> tuple[Column, Column, Column, Column]:
    """First and last row and column of a box; ``closed``: with the cells that it only touches on the right or below."""
    r0, r1, c0, c1 = pyramid.first_last(zoom, box)
    return (r0, F.greatest(r0, pyramid.row_of(box["bottom"], zoom)), c0, F.greatest(c0, pyramid.col_of(box["right"], zoom))) if closed else (r0, r1, c0, c1)


def _leveled(df: DataFrame, pyramid: Pyramid, zoom: int, box: str, closed: bool) -> DataFrame:
    """``df`` with _r0, _r1, _c0, _c1, the cells that the box reaches into at ``zoom``, and _own: the finest level with at
    most MOST of them, or 0; null for no box. Cells above are those numbers shifted."""
    df = df.withColumns(dict(zip(("_r0", "_r1", "_c0", "_c1"), reach(pyramid, zoom, F.col(box), closed))))
    n = lambda a, d: f"(shiftright(_{a}1, {d}) - shiftright(_{a}0, {d}) + 1L)"
    few = [f"WHEN {n('r', zoom - z)} * {n('c', zoom - z)} <= {MOST} THEN {z}" for z in levels(zoom)[:-1]]
    return df.withColumn("_own", F.expr(f"CASE WHEN _r0 IS NULL OR _r1 IS NULL OR _c0 IS NULL OR _c1 IS NULL THEN NULL {' '.join(few)} ELSE 0 END"))


def levels_in_use(df: DataFrame, pyramid: Pyramid, zoom: int, box: str, closed: bool = False) -> Column:
    """The levels of all boxes of ``df``, an array of a few numbers, for use in a filter of another table."""
    return _leveled(df.select(F.col(box).alias("_box")), pyramid, zoom, "_box", closed).agg(F.collect_set("_own")).scalar()


def level_cells(df: DataFrame, pyramid: Pyramid, zoom: int, box: str, closed: bool = False, above: bool = True) -> DataFrame:
    """``df`` with zoom, row, col of the cells at each row's own level and (``above``) at each coarser one, and ``_own``, its level."""
    df = _leveled(df, pyramid, zoom, box, closed).where("_own IS NOT NULL")
    if above:
        df = df.withColumn("zoom", F.explode(F.array(*map(F.lit, levels(zoom))))).where("zoom <= _own")
    else:
        df = df.withColumn("zoom", F.col("_own"))
    run = lambda a: F.explode(F.expr(f"sequence(shiftright(_{a}0, {zoom} - zoom), shiftright(_{a}1, {zoom} - zoom))"))
    return df.withColumn("row", run("r")).withColumn("col", run("c")).drop("_r0", "_r1", "_c0", "_c1")


def cell_at(pyramid: Pyramid, zoom: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """Row and column of a point at a zoom that differs by row."""
    g, scale = pyramid.grid, F.pow(F.lit(2.0), zoom)
    span = F.lit(pyramid.tile_span(0)) / scale
    last = lambda n: F.greatest(F.ceil(scale * n / pyramid.metatiling), F.lit(1)) - 1
    row, col = F.floor((F.lit(g.top) - y) / span), F.floor((x - F.lit(g.left)) / span)
    return F.greatest(F.least(row, last(g.rows)), F.lit(0)).cast("int"), F.greatest(F.least(col, last(g.cols)), F.lit(0)).cast("int")


def point_cells(points: DataFrame, pyramid: Pyramid, wanted: list[int], used: Column, x: str, y: str) -> DataFrame:
    """``points`` with _zoom, _row, _col of their cell at each of the ``wanted`` zooms that are ``used``."""
    rows = points.withColumn("_zoom", F.explode(F.array(*map(F.lit, wanted)))).where(F.array_contains(used, F.col("_zoom")))
    row, col = cell_at(pyramid, F.col("_zoom"), F.col(x), F.col(y))
    return rows.withColumns({"_row": row, "_col": col})


# Geometries: whole cells inside, split cells on the border

def _reach(pyramid: Pyramid, zoom: int, box: list[float], closed: bool) -> tuple[int, int, int, int]:
    g, span = pyramid.grid, pyramid.tile_span(zoom)
    h, w = pyramid.matrix_height(zoom) - 1, pyramid.matrix_width(zoom) - 1
    clamp = lambda v, most: int(max(0, min(v, most)))
    r0, c0 = clamp(np.floor((g.top - box[3]) / span), h), clamp(np.floor((box[0] - g.left) / span), w)
    end = np.floor if closed else lambda v: np.ceil(v) - 1
    return r0, max(r0, clamp(end((g.top - box[1]) / span), h)), c0, max(c0, clamp(end((box[2] - g.left) / span), w))


def _sides(pyramid: Pyramid, zoom: int, r: np.ndarray, c: np.ndarray, slack: float, far: bool) -> tuple[np.ndarray, ...]:
    g, span = pyramid.grid, pyramid.tile_span(zoom)
    left, top = g.left + c * span, g.top - r * span
    right, bottom = np.minimum(left + span, g.right), np.maximum(top - span, g.bottom)
    if far:
        left, right = np.where(c == 0, -FAR, left), np.where(c == pyramid.matrix_width(zoom) - 1, FAR, right)
        top, bottom = np.where(r == 0, FAR, top), np.where(r == pyramid.matrix_height(zoom) - 1, -FAR, bottom)
    return left - slack, bottom - slack, right + slack, top + slack


def _met(e: np.ndarray, box: tuple[np.ndarray, ...]) -> np.ndarray:
    """Whether an edge (ax, ay, bx, by) meets a closed box."""
    ax, ay, bx, by = e
    left, bottom, right, top = box
    near = (np.minimum(ax, bx) <= right) & (np.maximum(ax, bx) >= left) & (np.minimum(ay, by) <= top) & (np.maximum(ay, by) >= bottom)
    side = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x in (left, right) for y in (bottom, top)]
    return near & (np.minimum.reduce(side) <= 0) & (np.maximum.reduce(side) >= 0)


def _inside(edges: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Even-odd rule for points that lie on no edge, in blocks of bounded size."""
    out = np.zeros(len(x), dtype=bool)
    step = max(1, PAIRS // max(1, edges.shape[1]))
    ax, ay, bx, by = edges
    for i in range(0, len(x), step):
        px, py = x[i : i + step, None], y[i : i + step, None]
        spans = (ay > py) != (by > py)
        with np.errstate(divide="ignore", invalid="ignore"):
            right = px < (bx - ax) * (py - ay) / (by - ay) + ax
        out[i : i + step] = ((spans & right).sum(axis=1) % 2).astype(bool)
    return out


def edges_of(g: dict) -> np.ndarray:
    """ax, ay, bx, by of all edges; a point is an edge of no length."""
    found = []
    for ring in g["rings"]:
        p = np.array([(q["x"], q["y"]) for q in ring], dtype=float).reshape(-1, 2)
        if len(p):
            found.append(np.hstack((p, p)) if len(p) == 1 or "Point" in g["type"] else np.hstack((p[:-1], p[1:])))
    return np.vstack(found).T if found else np.zeros((4, 0))


def cover(g: dict, pyramid: Pyramid, bottom: int, emit: set[int], most: int | None = None, exact: bool = True, far: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """(zoom, rows, columns, whole) of cells that cover a geometry, in pieces of bounded size.

    Cells wholly inside come at the zoom at which they are found, border cells at the zooms of ``emit``; with a
    budget (``most``), at that where splitting them could exceed it instead. Not ``exact``: of the geometry's box.
    ``far``: outer cells hold what lies beyond the grid, and cells that are only touched count.
    """
    edges = edges_of(g)
    if not edges.shape[1]:
        return
    box = [edges[[0, 2]].min(), edges[[1, 3]].min(), edges[[0, 2]].max(), edges[[1, 3]].max()]
    polygon = "Polygon" in g["type"]
    slack = 1e-9 * pyramid.tile_span(bottom)
    R0, R1, C0, C1 = _reach(pyramid, bottom, box, far)
    h, w = pyramid.matrix_height(bottom), pyramid.matrix_width(bottom)
    r0, r1, c0, c1 = _reach(pyramid, 0, box, far)
    rr, cc = (a.ravel() for a in np.mgrid[r0 : r1 + 1, c0 : c1 + 1])
    n = edges.shape[1] if exact else 0
    stack = [(0, rr, cc, np.repeat(np.arange(len(rr)), n), np.tile(np.arange(n), len(rr)))]
    done = 0
    while stack:
        z, r, c, cell, edge = stack.pop()
        if len(cell) > PAIRS and len(r) > 1:
            half = len(r) // 2
            first = cell < half
            stack += [(z, r[half:], c[half:], cell[~first] - half, edge[~first]), (z, r[:half], c[:half], cell[first], edge[first])]
            continue
        d = 1 << (bottom - z)
        shown = None
        if exact:
            sides = _sides(pyramid, z, r, c, 0.0 if z == bottom and not far else slack, far)
            hit = np.zeros(len(cell), dtype=bool)
            for i in range(0, len(cell), PAIRS):
                s = slice(i, i + PAIRS)
                hit[s] = _met(edges[:, edge[s]], tuple(v[cell[s]] for v in sides))
            cell, edge = cell[hit], edge[hit]
            border = np.zeros(len(r), dtype=bool)
            border[cell] = True
            whole = ~border
            if most is None and z in emit:
                # Splitting goes by boxes a bit wider, so that no rounding loses a child; what is shown doesn't.
                true = _sides(pyramid, z, r, c, 0.0, far)
                shown = np.zeros(len(r), dtype=bool)
                for i in range(0, len(cell), PAIRS):
                    s = slice(i, i + PAIRS)
                    shown[cell[s][_met(edges[:, edge[s]], tuple(v[cell[s]] for v in true))]] = True
            if polygon:
                whole[whole] = _inside(edges, ((sides[0] + sides[2]) / 2)[whole], ((sides[1] + sides[3]) / 2)[whole])
            else:
                whole[:] = False
        else:
            last_r, last_c = np.minimum((r + 1) * d, h) - 1, np.minimum((c + 1) * d, w) - 1
            whole = (r * d >= R0) & (last_r <= R1) & (c * d >= C0) & (last_c <= C1)
            border = ~whole & (last_r >= R0) & (r * d <= R1) & (last_c >= C0) & (c * d <= C1)
        if whole.any():
            yield z, r[whole], c[whole], True
        done += int(whole.sum())
        k = np.flatnonzero(border)
        stop = z == bottom or (most is not None and done + 4 * len(k) + sum(len(s[1]) for s in stack) > most)
        if stop if most is not None else z in emit:
            seen = k if shown is None else np.flatnonzero(shown)
            if len(seen):
                yield z, r[seen], c[seen], False
            done += len(seen)
        if stop or not len(k):
            continue
        # Each border cell's four children; those beyond the matrix or the geometry's box don't count.
        kr, kc = (np.repeat(2 * a[k], 4) + np.tile(o, len(k)) for a, o in ((r, [0, 0, 1, 1]), (c, [0, 1, 0, 1])))
        a0, a1, b0, b1 = _reach(pyramid, z + 1, box, far)
        valid = (kr >= a0) & (kr <= a1) & (kc >= b0) & (kc <= b1)
        number = np.cumsum(valid) - 1
        at = np.zeros(len(r), dtype=np.int64)
        at[k] = np.arange(len(k)) * 4
        cell = (np.repeat(at[cell], 4) + np.tile(np.arange(4), len(cell))).astype(np.int64)
        edge, ok = np.repeat(edge, 4), valid[cell]
        stack.append((z + 1, kr[valid], kc[valid], number[cell[ok]], edge[ok]))


def covering(features: DataFrame, pyramid: Pyramid, zoom: int, geom: str = "geom", keep: list[str] | None = None, most: int | None = None, exact: bool = True, far: bool = False, emit: list[int] | None = None) -> DataFrame:
    """zoom, row, col, whole of the cells that cover each feature, with its columns ``keep``; see ``cover``.

    A null or empty geometry has no cell.
    """
    keep, wanted = keep or [], set(emit or [zoom])
    own = pa.schema([("zoom", pa.int32()), ("row", pa.int32()), ("col", pa.int32()), ("whole", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.select(list(range(len(keep))))
            for i, g in enumerate(batch.column(len(keep)).to_pylist()):
                for z, r, c, whole in cover(g, pyramid, zoom, wanted, most, exact, far) if g else ():
                    n = len(r)
                    same = rest.take(pa.array(np.full(n, i))).columns
                    cells = [pa.array(np.full(n, z), pa.int32()), pa.array(r, pa.int32()), pa.array(c, pa.int32()), pa.array(np.full(n, whole))]
                    yield pa.RecordBatch.from_arrays([*same, *cells], names=[*keep, *own.names])

    rows = features.select(*[F.col(f"`{c}`") for c in keep], F.col(geom).alias("_geom"))
    schema = T.StructType([*rows.drop("_geom").schema.fields, *(T.StructField(k, T.IntegerType()) for k in KEYS), T.StructField("whole", T.BooleanType())])
    return rows.mapInArrow(run, schema)


def spread(cells: DataFrame, pyramid: Pyramid, zoom: int) -> DataFrame:
    """zoom, row, col of the tiles at ``zoom`` that cells of coarser zooms hold."""
    r0, r1, c0, c1 = _held(pyramid, zoom)
    ints = lambda first, last: F.explode(F.sequence(first.cast("int"), last.cast("int")))
    rows = cells.select(ints(r0, r1).alias("row"), c0.alias("_c0"), c1.alias("_c1"))
    return rows.select(F.lit(zoom).alias("zoom"), "row", ints(F.col("_c0"), F.col("_c1")).alias("col"))


def _held(pyramid: Pyramid, zoom: int) -> tuple[Column, Column, Column, Column]:
    d = F.pow(F.lit(2.0), F.lit(zoom) - F.col("zoom")).cast("long")
    end = lambda name, n: F.least((F.col(name) + 1) * d, F.lit(n).cast("long")) - 1
    return F.col("row") * d, end("row", pyramid.matrix_height(zoom)), F.col("col") * d, end("col", pyramid.matrix_width(zoom))


def count_covered(cells: DataFrame, pyramid: Pyramid, zooms: list[int]) -> DataFrame:
    """zoom, tiles: the different tiles at each zoom under the cells of a covering, without making those inside whole cells."""
    each = cells.groupBy(*KEYS).agg(F.max("whole").alias("whole"))
    up = each.where("zoom > 0").select(*KEYS, F.explode(F.sequence(F.lit(1), F.col("zoom"))).alias("_up"))
    above = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_up"))).cast("int").alias(f"_{c}")
    up = up.select(*KEYS, (F.col("zoom") - F.col("_up")).alias("_zoom"), above("row"), above("col"))
    whole = each.where("whole").select(*[F.col(k).alias(f"_{k}") for k in KEYS])
    inside = up.join(whole, [f"_{k}" for k in KEYS], "left_semi").select(*KEYS).distinct()
    own = each.join(inside, KEYS, "left_anti")
    parts = []
    for z in zooms:
        r0, r1, c0, c1 = _held(pyramid, z)
        n = F.when(F.col("whole") & (F.col("zoom") <= z), (r1 - r0 + 1) * (c1 - c0 + 1)).when(~F.col("whole") & (F.col("zoom") == z), F.lit(1).cast("long"))
        parts.append(F.struct(F.lit(z).alias("zoom"), n.alias("n")))
    by = own.select(F.explode(F.array(*parts)).alias("p")).select("p.zoom", "p.n").where("n IS NOT NULL")
    return by.groupBy("zoom").agg(F.sum("n").alias("tiles"))


def feature_tiles(features: DataFrame, pyramid: Pyramid, zoom: int, exact: bool, geom: str) -> DataFrame:
    """Distinct tiles at ``zoom`` of the features; inner ones are made from whole cells, without the geometry."""
    return spread(covering(features, pyramid, zoom, geom, exact=exact).distinct(), pyramid, zoom).distinct()


def count_features(features: DataFrame, pyramid: Pyramid, zooms, exact: bool, geom: str = "geom") -> DataFrame:
    zooms = sorted(set(zooms))
    return count_covered(covering(features, pyramid, zooms[-1], geom, exact=exact, emit=zooms), pyramid, zooms)


def polygon_cells(features: DataFrame, pyramid: Pyramid, zoom: int, geom: str = "geom", most: int = BUDGET) -> DataFrame:
    """``features`` with zoom, row, col, whole of at most some ``most`` cells each, which meet points anywhere."""
    return covering(features, pyramid, zoom, geom, features.columns, most, far=True)
