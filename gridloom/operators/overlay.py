"""Polygon overlay as joins and grouped unions: intersection, difference, dissolve, repair, buffers, lines cut by areas.

Pairs come from joins on cells, never from a cross join. Unions are made in three steps: within the batches of a task before
anything moves, then tile by tile (or key by key) as a stream over sorted partitions, so no group is held whole, and if asked for
over the tiles' borders, where edges that run both ways cancel. Geometries cross to numpy as flat coordinate
arrays, a batch at a time.

Rows with equal geometries are one shape: pairs, covers and differences are made for each shape once and then joined to
the rows. A geometry costs far more time than bytes, by which Spark sizes its partitions, so rows are dealt out evenly.

Defined results: a null or empty geometry, and one that isn't a polygon where polygons are asked for, covers nothing;
rows whose result is empty go; inside is what any of the parts holds, so parts may overlap.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions import geometry as G
from gridloom.functions import overlay as O
from gridloom.functions.pyramid import Pyramid
from gridloom.operators.joins import range_join
from gridloom.operators.tiles import KEYS, cells

Parts = list[list[np.ndarray]]
#: Points of the parts that a union gathers before it is made.
GATHERED = 20_000
_XY = pa.struct([pa.field("x", pa.float64()), pa.field("y", pa.float64())])
_ARROW = pa.struct([pa.field("type", pa.string()), pa.field("rings", pa.list_(pa.list_(_XY))), pa.field("part", pa.list_(pa.int32()))])
POLYGONS, LINES = ("Polygon", "MultiPolygon"), ("LineString", "MultiLineString", "LinearRing")


def read(column: pa.Array, kinds: tuple[str, ...] = POLYGONS) -> list[Parts]:
    """Of each row of a geometry column its parts, each a list of rings (polygons without the repeated point); of other types none."""
    kind, rings, part = column.flatten()
    points = rings.values
    xy = np.stack([c.to_numpy(zero_copy_only=False) for c in points.values.flatten()], axis=1) if len(points.values) else np.zeros((0, 2))
    row_at, ring_at, part_at, numbers = rings.offsets.to_pylist(), points.offsets.to_pylist(), part.offsets.to_pylist(), part.values.to_pylist()
    out = []
    for i, k in enumerate(kind.to_pylist()):
        parts: dict[int, list[np.ndarray]] = {}
        if k in kinds:
            for r in range(row_at[i], row_at[i + 1]):
                ring = xy[ring_at[r] : ring_at[r + 1]]
                if k in POLYGONS and len(ring) > 1 and (ring[0] == ring[-1]).all():
                    ring = ring[:-1]
                if len(ring) > (2 if k in POLYGONS else 1):
                    parts.setdefault(numbers[part_at[i] + r - row_at[i]], []).append(ring)
        out.append(list(parts.values()))
    return out


def written(rows: Iterable[Parts], kind: str = "Polygon") -> pa.Array:
    """A geometry column of parts; null where there are none."""
    kinds, rings, part = [], [], []
    for parts in rows:
        kinds.append(None if not parts else kind if len(parts) == 1 else f"Multi{kind}")
        own = [np.concatenate((r, r[:1])) if kind == "Polygon" else r for p in parts for r in p]
        rings.append(own)
        part.append([i for i, p in enumerate(parts) for _ in p])
    flat = [r for own in rings for r in own]
    xy = np.concatenate([*flat, np.zeros((0, 2))])
    points = pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], fields=list(_XY))
    at = lambda sizes: pa.array(np.cumsum([0, *sizes]).astype(np.int32))
    lists = pa.ListArray.from_arrays(at(map(len, rings)), pa.ListArray.from_arrays(at(map(len, flat)), points))
    none = pa.array([k is None for k in kinds])
    return pa.StructArray.from_arrays([pa.array(kinds, pa.string()), lists, pa.ListArray.from_arrays(at(map(len, part)), pa.array([n for own in part for n in own], pa.int32()))], fields=list(_ARROW), mask=none)


def _tasks(df: DataFrame) -> int:
    """A number that is given isn't lowered by the rows' bytes."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def shape_key(geom: Column) -> Column:
    """Equal for equal geometries only: a digest of all that they hold; null for none."""
    return F.sha2(F.to_json(geom), 256)


def shapes(df: DataFrame, geom: str = "geom", by: list[str] = []) -> DataFrame:
    """``by``, ``geom`` and _key, its `shape_key`: each different geometry (of each value of ``by``) once."""
    rows = df.select(*[df[f"`{c}`"] for c in by], df[f"`{geom}`"].cast(G.GEOMETRY).alias(geom)).withColumn("_key", shape_key(F.col(geom)))
    return rows.where("_key IS NOT NULL").dropDuplicates([*by, "_key"])


def computed(df: DataFrame, geoms: list[str], f: Callable[..., Parts], out: str = "geom", kinds: tuple[str, ...] = POLYGONS, kind: str = "Polygon") -> DataFrame:
    """``df`` with ``out`` = f of the parts of the columns ``geoms`` (the first of ``kinds``, others polygons), less the columns ``geoms``; rows with nothing left go."""
    rest = [c for c in df.columns if c not in geoms and c != out]
    rows = df.select(F.struct(F.lit(True).alias("_"), *[df[f"`{c}`"] for c in rest]).alias("_row"), *[df[f"`{c}`"].cast(G.GEOMETRY).alias(f"_{i}") for i, c in enumerate(geoms)])
    rows = rows.repartition(_tasks(df))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = [read(batch.column(i + 1), kinds if i == 0 else POLYGONS) for i in range(len(geoms))]
            yield pa.RecordBatch.from_arrays([batch.column(0), written([f(*x) for x in zip(*given)], kind)], names=["_row", "_geom"])

    found = rows.mapInArrow(run, T.StructType([rows.schema["_row"], T.StructField("_geom", G.GEOMETRY)])).where("_geom IS NOT NULL")
    return found.select(*[F.col("_row").getField(c).alias(c) for c in rest], F.col("_geom").alias(out))


class _Gathered:
    """Parts of one key: united whenever many points have come together."""

    def __init__(self):
        self.parts: Parts = []
        self.points = 0
        self.limit = GATHERED

    def add(self, parts: Parts) -> None:
        self.parts += parts
        self.points += sum(len(r) for p in parts for r in p)
        if self.points > self.limit:
            self.parts = self.union()
            self.points = sum(len(r) for p in self.parts for r in p)
            self.limit = max(GATHERED, 2 * self.points)

    def union(self) -> Parts:
        return O.union(self.parts)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[tuple, Parts]]:
    keys = zip(*(c.to_pylist() for c in batch.columns[:-1])) if batch.num_columns > 1 else iter([()] * batch.num_rows)
    return zip(keys, read(batch.column(batch.num_columns - 1)))


def united(df: DataFrame, by: list[str], geom: str = "geom") -> DataFrame:
    """``by`` and the union of the polygons of each value of it.

    Batches are united where they are; then rows are dealt out by key and each key's are a stream. A key that a large
    part of all rows has comes to the shuffle as one row for each batch.
    """
    rows = df.select(*[df[f"`{c}`"] for c in by], df[f"`{geom}`"].cast(G.GEOMETRY).alias(geom))
    schema = rows.schema
    types = [pa.field(n, t) for n, t in zip(by, _arrow_types(schema, by))] + [pa.field(geom, _ARROW)]

    def table(found: list[tuple[tuple, Parts]]) -> pa.RecordBatch:
        columns = [pa.array([k[i] for k, _ in found], types[i].type) for i in range(len(by))]
        return pa.RecordBatch.from_arrays([*columns, written([p for _, p in found])], schema=pa.schema(types))

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[tuple, _Gathered] = {}
            for key, parts in _rows(batch):
                held.setdefault(key, _Gathered()).add(parts)
            yield table([(k, g.union() if len(g.parts) > 1 else g.parts) for k, g in held.items()])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, done = None, None, []
        for batch in batches:
            for key, parts in _rows(batch):
                if held is None or key != last:
                    if held is not None:
                        done.append((last, held.union()))
                    last, held = key, _Gathered()
                held.add(parts)
            if done:
                yield table(done)
                done = []
        if held is not None:
            yield table([(last, held.union())])

    partial = rows.mapInArrow(within, schema)
    dealt = partial.repartition(_tasks(df), *[F.col(f"`{c}`") for c in by]).sortWithinPartitions(*[F.col(f"`{c}`") for c in by]) if by else partial.coalesce(1)
    return dealt.mapInArrow(across, schema).where(F.col(geom).isNotNull())


def _arrow_types(schema: T.StructType, names: list[str]) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(schema[n].dataType) for n in names]


def cut_to_tiles(features: DataFrame, pyramid: Pyramid, zoom: int, geom: str = "geom") -> DataFrame:
    """zoom, row, col and the polygons' pieces in each tile. A concave polygon's pieces may still hang together by the tile's border; the overlays part them."""
    boxed = cells(features.withColumn("_box", G.box(F.col(geom))), pyramid, zoom, "_box")
    tile, box = pyramid.box(zoom, F.col("row"), F.col("col")), F.col("_box")
    inside = (box["left"] >= tile["left"]) & (box["right"] <= tile["right"]) & (box["bottom"] >= tile["bottom"]) & (box["top"] <= tile["top"])
    return boxed.withColumn(geom, F.when(inside, F.col(geom)).otherwise(G.clipped(F.col(geom), tile))).drop("_box").where(F.col(geom).isNotNull())


def union_by_tile(features: DataFrame, pyramid: Pyramid, zoom: int, by: list[str] = [], geom: str = "geom") -> DataFrame:
    """zoom, row, col, ``by`` and the union of the features in each tile: areas that don't overlap, as many rows as tiles."""
    return united(cut_to_tiles(shapes(features, geom, by).drop("_key"), pyramid, zoom, geom), [*KEYS, *by], geom)


def dissolved(features: DataFrame, pyramid: Pyramid, zoom: int, by: list[str], geom: str = "geom") -> DataFrame:
    """``by`` and one geometry for each value: the union of its features, made by tile and then put together over the tiles' borders."""
    return united(union_by_tile(features, pyramid, zoom, by, geom), by, geom)


def shape_intersections(left: DataFrame, right: DataFrame, pyramid: Pyramid, zoom: int, geom: str = "geom") -> DataFrame:
    """_a, _b (`shape_key`) and what they share: pairs of shapes of both sides whose areas share an area, each once."""
    boxed = lambda df, name: shapes(df, geom).select(F.col("_key").alias(f"_{name}"), F.col(geom).alias(f"_of_{name}"), G.box(F.col(geom)).alias("_box"))
    pairs = range_join(boxed(left, "a"), boxed(right, "b"), pyramid, zoom, "_box", "_box", touching=False).drop("_box", "r__box")
    return computed(pairs, ["_of_a", "_of_b"], O.intersection, geom)


def intersections(left: DataFrame, right: DataFrame, pyramid: Pyramid, zoom: int, geom: str = "geom") -> DataFrame:
    """Pairs of rows whose areas share an area, with what they share; clashing columns of ``right`` are prefixed with ``r_``."""
    own, other = ([c for c in df.columns if c != geom] for df in (left, right))
    keyed = lambda df, names, name: df.select(*[df[f"`{c}`"].alias(f"_{name}{i}") for i, c in enumerate(names)], shape_key(df[f"`{geom}`"].cast(G.GEOMETRY)).alias(f"_{name}"))
    pairs = shape_intersections(left, right, pyramid, zoom, geom).join(keyed(left, own, "a"), "_a").join(keyed(right, other, "b"), "_b")
    return pairs.select(*[F.col(f"_a{i}").alias(c) for i, c in enumerate(own)], *[F.col(f"_b{i}").alias(f"r_{c}" if c in own else c) for i, c in enumerate(other)], geom)


def intersection_sums(left: DataFrame, right: DataFrame, pyramid: Pyramid, zoom: int, by: list[str], geom: str = "geom") -> DataFrame:
    """``by`` (of ``left``), n and area: number and area of all `intersections`, added up by shapes, so that no pair of rows is made."""
    keyed = lambda df, *more: df.select(*more, shape_key(df[f"`{geom}`"].cast(G.GEOMETRY)).alias("_key"))
    many = keyed(right).groupBy(F.col("_key").alias("_b")).agg(F.count(F.lit(1)).alias("_m"))
    found = shape_intersections(left, right, pyramid, zoom, geom).select("_a", "_b", G.area(F.col(geom)).alias("_area")).join(many, "_b")
    sums = found.groupBy(F.col("_a").alias("_key")).agg(F.sum("_m").alias("_n"), F.sum(F.col("_m") * F.col("_area")).alias("_area"))
    return keyed(left, *by).join(sums, "_key").groupBy(*by).agg(F.sum("_n").alias("n"), F.sum("_area").alias("area"))


def differences(left: DataFrame, right: DataFrame, pyramid: Pyramid, zoom: int, key: list[str], geom: str = "geom") -> DataFrame:
    """``key`` (which tells rows of ``left``) and what of each area no area of ``right`` covers.

    The shapes of both are cut to tiles; a tile has one row of ``right``, the union of its areas, so no row meets many. Pieces are put together by shape.
    """
    tiles = cut_to_tiles(shapes(left, geom), pyramid, zoom, geom).withColumnRenamed(geom, "_a")
    cover = union_by_tile(right.select(geom), pyramid, zoom, geom=geom).withColumnRenamed(geom, "_b")
    pieces = computed(tiles.join(cover, KEYS, "left"), ["_a", "_b"], lambda a, b: O.difference(a, b) if b else O.union(a), geom)
    rows = left.select(*key, shape_key(left[f"`{geom}`"].cast(G.GEOMETRY)).alias("_key"))
    return rows.join(united(pieces, ["_key"], geom), "_key").select(*key, geom)


def repaired(features: DataFrame, geom: str = "geom") -> DataFrame:
    """Polygons whose rings cross or touch themselves or each other as valid parts, inside by the even-odd rule; what has no area goes. Other types stay."""
    polygon = F.coalesce(F.col(f"{geom}.type").isin(*POLYGONS), F.lit(False))
    fixed = computed(features.where(polygon), [geom], O.repaired, geom)
    return features.where(~polygon).unionByName(fixed.select(*features.columns))


def parted(features: DataFrame, geom: str = "geom") -> DataFrame:
    """Polygons that a clip has left hanging together by edges of no area as separate parts; convex rings and other types aren't touched."""
    def apart(parts: Parts) -> Parts:
        return parts if all(_convex(r) for p in parts for r in p) else O.union(parts)

    polygon = F.coalesce(F.col(f"{geom}.type").isin(*POLYGONS), F.lit(False))
    return features.where(~polygon).unionByName(computed(features.where(polygon), [geom], apart, geom).select(*features.columns))


def _convex(ring: np.ndarray) -> bool:
    d = np.roll(ring, -1, axis=0) - ring
    e = np.roll(d, -1, axis=0)
    turn = d[:, 0] * e[:, 1] - d[:, 1] * e[:, 0]
    return bool((turn >= 0).all() or (turn <= 0).all())


def buffered(features: DataFrame, by: float, geom: str = "geom", corners: int = 8) -> DataFrame:
    """Everything within ``by`` units of points, lines or polygons; ``corners`` edges for a quarter of a circle."""
    everything = (*POLYGONS, *LINES, "Point", "MultiPoint")
    is_area = F.col(f"{geom}.type").isin(*POLYGONS)
    areas = computed(features.where(is_area), [geom], lambda parts: O.buffered(parts, [], by, corners), geom)
    rest = features.where(~is_area)
    # A point is a line of one point.
    doubled = F.transform(F.col(f"{geom}.rings"), lambda r: F.when(F.size(r) == 1, F.concat(r, r)).otherwise(r))
    line = F.struct(F.lit("MultiLineString").alias("type"), doubled.alias("rings"), F.col(f"{geom}.part").alias("part"))
    lines = computed(rest.withColumn(geom, line), [geom], lambda parts: O.buffered([], [r for p in parts for r in p], by, corners), geom, kinds=everything)
    return areas.unionByName(lines.select(*areas.columns)).select(*features.columns)


def buffered_metres(features: DataFrame, metres: float, geom: str = "geom", corners: int = 8) -> DataFrame:
    """Buffers of geometries in degrees, drawn in the UTM zone of each one's middle and split at the antimeridian."""
    rest = [c for c in features.columns if c != geom]
    everything = (*POLYGONS, *LINES, "Point", "MultiPoint")
    rows = features.select(F.struct(F.lit(True).alias("_"), *rest).alias("_row"), F.col(geom).cast(G.GEOMETRY).alias("_g"))

    def one(kind: str, parts: Parts) -> Parts:
        rings = [r for p in parts for r in p]
        low, high = np.concatenate(rings).min(axis=0), np.concatenate(rings).max(axis=0)
        lon, lat = (low + high) / 2
        crs = G.utm_crs(lat, (lon + 180) % 360 - 180)
        zone, south = int(crs[-2:]), crs[-4] == "7"
        off = 0.0 if -180 <= lon < 180 else 360.0 * np.floor((lon + 180) / 360)
        to = lambda r: np.stack(G.utm_forward(r[:, 0] - off, r[:, 1], zone, south, _Numpy), axis=1)
        back = lambda r: np.stack(G.utm_inverse(r[:, 0], r[:, 1], zone, south, _Numpy), axis=1)
        drawn = O.buffered([[to(r) for r in p] for p in parts], [], metres, corners) if kind in POLYGONS else O.buffered([], [to(r) for r in rings], metres, corners)
        degrees = [[back(r) for r in p] for p in drawn]
        over = [r for p in degrees for r in p]
        if over and (max(r[:, 0].max() for r in over) > 180 or min(r[:, 0].min() for r in over) < -180):
            world = [[np.array([[-180.0, -90.0], [180.0, -90.0], [180.0, 90.0], [-180.0, 90.0]])]]
            moved = lambda d: [[r + [d, 0.0] for r in p] for p in degrees]
            degrees = [p for d in (0.0, 360.0, -360.0) for p in O.intersection(moved(d), world)]
        return degrees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column(1).flatten()[0].to_pylist()
            found = [one(k, p) if p else [] for k, p in zip(kinds, _points_too(batch.column(1), everything))]
            yield pa.RecordBatch.from_arrays([batch.column(0), written(found)], names=["_row", "_geom"])

    found = rows.mapInArrow(run, T.StructType([rows.schema["_row"], T.StructField("_geom", G.GEOMETRY)])).where("_geom IS NOT NULL")
    return found.select(*[F.col("_row").getField(c).alias(c) for c in rest], F.col("_geom").alias(geom)).select(*features.columns)


def _points_too(column: pa.Array, kinds: tuple[str, ...]) -> list[Parts]:
    out = read(column, kinds)
    for i, g in enumerate(column.to_pylist() if any(not p for p in out) else []):
        if g is not None and g["type"] in ("Point", "MultiPoint") and not out[i]:
            out[i] = [[np.array([[p["x"], p["y"]]])] for r in g["rings"] for p in r]
    return out


class _Numpy:
    """The functions that the projection's formulas call, of arrays."""

    sin, cos, sinh, cosh, sqrt, radians, degrees = np.sin, np.cos, np.sinh, np.cosh, np.sqrt, np.radians, np.degrees
    atan2, asin, atanh = np.arctan2, np.arcsin, np.arctanh


def lines_cut(lines: DataFrame, areas: DataFrame, keep_inside: bool, on: list[str] = KEYS, geom: str = "geom") -> DataFrame:
    """``lines`` cut exactly at the ``areas`` of the same key (one row each, as `united` gives): what is inside or outside. Lines without an area of their key go."""
    pairs = lines.join(areas.select(*on, F.col(geom).alias("_b")), on)
    cut = lambda parts, area: [[piece] for p in parts for line in p for piece in O.cut_line(line, area, keep_inside)]
    return computed(pairs, [geom, "_b"], cut, geom, kinds=LINES, kind="LineString")
