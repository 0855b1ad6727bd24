"""Geometry as data: a struct of a type and rings of points, with expressions over it.

    STRUCT<type STRING, rings ARRAY<ARRAY<STRUCT<x DOUBLE, y DOUBLE>>>>

Points, lines and rings of polygons are all lists in ``rings``; ``parts`` of a multipart geometry are told
apart by ``part`` (an index for each ring). Only simple polygons are clipped; what isn't supported raises.
"""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
GEOMETRY = T.StructType([T.StructField("type", T.StringType()), T.StructField("rings", T.ArrayType(T.ArrayType(POINT))), T.StructField("part", T.ArrayType(T.IntegerType()))])

#: Geometry types and their multipart forms.
MULTI = {"Point": "MultiPoint", "LineString": "MultiLineString", "Polygon": "MultiPolygon"}
SINGLE = {v: k for k, v in MULTI.items()}
TYPES = [*MULTI, *SINGLE, "LinearRing", "GeometryCollection"]
#: Bounds in degrees within which a projection is used.
CRS_BOUNDS = {"EPSG:4326": (-180.0, -90.0, 180.0, 90.0), "EPSG:3857": (-180.0, -85.0511, 180.0, 85.0511), "EPSG:3035": (-10.6700, 34.5000, 31.5500, 71.0500)}
RADIUS = 6378137.0


def multipart_type(name: str) -> str:
    return MULTI.get(name, name)


def singlepart_type(name: str) -> str:
    return SINGLE.get(name, name)


def geometry_type(name: str) -> str:
    """The type called so, whatever its case."""
    for t in TYPES:
        if t.lower() == name.lower():
            return t
    raise ValueError(f"unknown geometry type {name!r}")


# Python values

def from_geojson(g: dict | None) -> dict | None:
    """A GeoJSON geometry as the struct's value; GeometryCollections as what they hold, if of one kind."""
    if g is None:
        return None
    kind, xy = g["type"], lambda ps: [{"x": float(p[0]), "y": float(p[1])} for p in ps]
    if kind == "GeometryCollection":
        parts = [from_geojson(x) for x in g["geometries"]]
        rings = [r for p in parts for r in p["rings"]]
        return {"type": kind, "rings": rings, "part": [i for i, p in enumerate(parts) for _ in p["rings"]]}
    c = g["coordinates"]
    groups = {"Point": lambda: [[[c]]], "MultiPoint": lambda: [[[p]] for p in c], "LineString": lambda: [[c]], "LinearRing": lambda: [[c]], "MultiLineString": lambda: [[x] for x in c], "Polygon": lambda: [c], "MultiPolygon": lambda: c}[kind]()
    return {"type": kind, "rings": [xy(r) for part in groups for r in part], "part": [i for i, part in enumerate(groups) for _ in part]}


def to_geojson(g: dict | None) -> dict | None:
    if g is None:
        return None
    parts: dict[int, list] = {}
    for ring, i in zip(g["rings"], g["part"]):
        parts.setdefault(i, []).append([[p["x"], p["y"]] for p in ring])
    p, kind = list(parts.values()), g["type"]
    make = {"Point": lambda: p[0][0][0], "MultiPoint": lambda: [x[0][0] for x in p], "LineString": lambda: p[0][0], "LinearRing": lambda: p[0][0], "MultiLineString": lambda: [x[0] for x in p], "Polygon": lambda: p[0], "MultiPolygon": lambda: p}
    if kind not in make:
        raise ValueError(f"{kind} can't be written")
    return {"type": kind, "coordinates": make[kind]()}


def from_wkt(text: str) -> dict:
    """A geometry from well-known text."""
    m = re.match(r"\s*([A-Za-z]+)\s*(\(.*\)|EMPTY)\s*$", text, re.S)
    if not m:
        raise ValueError(f"not well-known text: {text[:60]!r}")
    kind = geometry_type(m[1])
    if m[2] == "EMPTY":
        return {"type": kind, "rings": [], "part": []}
    number = r"[-+0-9.eE]+"
    nested = re.sub(rf"({number})\s+({number})(?:\s+{number})?", r"[\1,\2]", m[2]).replace("(", "[").replace(")", "]")
    c = json.loads(nested)
    c = c[0] if kind == "Point" else [x[0] if isinstance(x[0], list) else x for x in c] if kind == "MultiPoint" else c
    return from_geojson({"type": kind, "coordinates": c})


def parse(value) -> dict:
    """A geometry from well-known text, GeoJSON text or mapping, or four bounds."""
    if isinstance(value, dict):
        if "rings" in value:
            return value
        if value.get("type") == "Feature":
            return from_geojson(value["geometry"])
        if value.get("type") == "FeatureCollection":
            return from_geojson({"type": "GeometryCollection", "geometries": [f["geometry"] for f in value["features"]]})
        return from_geojson(value)
    if isinstance(value, str):
        return parse(json.loads(value)) if value.lstrip().startswith("{") else from_wkt(value)
    left, bottom, right, top = value
    return from_geojson({"type": "Polygon", "coordinates": [[[left, bottom], [right, bottom], [right, top], [left, top], [left, bottom]]]})


def latlon_to_mercator(lon: float, lat: float) -> tuple[float, float]:
    if not -90 < lat < 90:
        raise ValueError("poles have no place in Web Mercator")
    return math.radians(lon) * RADIUS, math.log(math.tan(math.pi / 4 + math.radians(lat) / 2)) * RADIUS


def mercator_to_latlon(x: float, y: float) -> tuple[float, float]:
    return math.degrees(x / RADIUS), math.degrees(2 * math.atan(math.exp(y / RADIUS)) - math.pi / 2)


def utm_forward(lon, lat, zone: int, south: bool, m=math):
    """Transverse Mercator on WGS 84 by Krüger's series to the third order; of numbers, or of columns with ``m`` = Spark's functions."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    big = RADIUS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3, 13 / 48 * n**2 - 3 / 5 * n**3, 61 / 240 * n**3)
    phi, lam = m.radians(lat), m.radians(lon - (6 * zone - 183))
    e = 2 * math.sqrt(n) / (1 + n)
    t = m.sinh(m.atanh(m.sin(phi)) - e * m.atanh(e * m.sin(phi)))
    xi, eta = m.atan2(t, m.cos(lam)), m.atanh(m.sin(lam) / m.sqrt(1 + t * t))
    x = eta + sum(a * m.cos(2 * j * xi) * m.sinh(2 * j * eta) for j, a in enumerate(alpha, 1))
    y = xi + sum(a * m.sin(2 * j * xi) * m.cosh(2 * j * eta) for j, a in enumerate(alpha, 1))
    return 500000 + 0.9996 * big * x, (10000000 if south else 0) + 0.9996 * big * y


def utm_inverse(x, y, zone: int, south: bool, m=math):
    f = 1 / 298.257223563
    n = f / (2 - f)
    big = RADIUS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 / 3 * n**2 + 37 / 96 * n**3, n**2 / 48 + n**3 / 15, 17 / 480 * n**3)
    delta = (2 * n - 2 / 3 * n**2 - 2 * n**3, 7 / 3 * n**2 - 8 / 5 * n**3, 56 / 15 * n**3)
    xi, eta = (y - (10000000 if south else 0)) / (0.9996 * big), (x - 500000) / (0.9996 * big)
    xi0 = xi - sum(b * m.sin(2 * j * xi) * m.cosh(2 * j * eta) for j, b in enumerate(beta, 1))
    eta0 = eta - sum(b * m.cos(2 * j * xi) * m.sinh(2 * j * eta) for j, b in enumerate(beta, 1))
    chi = m.asin(m.sin(xi0) / m.cosh(eta0))
    phi = chi + sum(d * m.sin(2 * j * chi) for j, d in enumerate(delta, 1))
    return 6 * zone - 183 + m.degrees(m.atan2(m.sinh(eta0), m.cos(xi0))), m.degrees(phi)


def reproject_xy(x: Column, y: Column, src: str, dst: str) -> tuple[Column, Column]:
    """Columns between EPSG:4326, EPSG:3857 and the UTM zones (EPSG:326zz, 327zz)."""
    if src == dst:
        return x, y
    if src == "EPSG:3857":
        x, y = F.degrees(x / RADIUS), F.degrees(F.lit(2.0) * F.atan(F.exp(y / RADIUS)) - F.lit(math.pi / 2))
    elif m := re.fullmatch(r"EPSG:32([67])(\d\d)", src):
        x, y = utm_inverse(x, y, int(m[2]), m[1] == "7", F)
    elif src != "EPSG:4326":
        raise ValueError(f"no formula for {src}")
    if dst == "EPSG:3857":
        return F.radians(x) * RADIUS, F.log(F.tan(F.lit(math.pi / 4) + F.radians(y) / 2)) * RADIUS
    if m := re.fullmatch(r"EPSG:32([67])(\d\d)", dst):
        return utm_forward(x, y, int(m[2]), m[1] == "7", F)
    if dst != "EPSG:4326":
        raise ValueError(f"no formula for {dst}")
    return x, y


def crs_bounds(crs: str) -> tuple[float, float, float, float]:
    """The degrees within which a projection is used."""
    if m := re.fullmatch(r"EPSG:32([67])(\d\d)", crs):
        left = 6.0 * int(m[2]) - 186
        return (left, -80.0, left + 6, 0.0) if m[1] == "7" else (left, 0.0, left + 6, 84.0)
    if crs not in CRS_BOUNDS:
        raise ValueError(f"no formula for {crs}")
    return CRS_BOUNDS[crs]


def reproject_point(x: float, y: float, src: str, dst: str) -> tuple[float, float]:
    """Between EPSG:4326, EPSG:3857 and the UTM zones (EPSG:326zz, 327zz)."""
    if src == dst:
        return x, y
    if src == "EPSG:3857":
        x, y = mercator_to_latlon(x, y)
    elif m := re.fullmatch(r"EPSG:32([67])(\d\d)", src):
        x, y = utm_inverse(x, y, int(m[2]), m[1] == "7")
    elif src != "EPSG:4326":
        raise ValueError(f"no formula for {src}")
    if dst == "EPSG:4326":
        return x, y
    if dst == "EPSG:3857":
        return latlon_to_mercator(x, y)
    if m := re.fullmatch(r"EPSG:32([67])(\d\d)", dst):
        return utm_forward(x, y, int(m[2]), m[1] == "7")
    raise ValueError(f"no formula for {dst}")


def utm_crs(lat: float, lon: float) -> str:
    zone = min(max(math.floor((lon + 180) / 6) + 1, 1), 60)
    return f"EPSG:{327 if lat <= 0 else 326}{zone:02d}"


# Columns

def utm_zone(lat: Column, lon: Column) -> Column:
    zone = F.greatest(F.least(F.floor((lon + 180) / 6) + 1, F.lit(60)), F.lit(1))
    return F.concat(F.lit("EPSG:"), F.when(lat <= 0, "327").otherwise("326"), F.lpad(zone.cast("string"), 2, "0"))


def map_points(g: Column, f) -> Column:
    """``g`` with each point's x and y replaced by f(x, y): the base of reprojection and shifts."""

    def point(p: Column) -> Column:
        x, y = f(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.struct(g["type"].alias("type"), F.transform(g["rings"], lambda r: F.transform(r, point)).alias("rings"), g["part"].alias("part"))


def to_mercator(g: Column) -> Column:
    return map_points(g, lambda x, y: reproject_xy(x, y, "EPSG:4326", "EPSG:3857"))


def to_latlon(g: Column, src: str = "EPSG:3857") -> Column:
    return map_points(g, lambda x, y: reproject_xy(x, y, src, "EPSG:4326"))


def shift_longitude(g: Column, by: float = 360.0, only_negative: bool = False) -> Column:
    """Shifted to the east; ``only_negative``: only points west of 0, so that what spans the antimeridian is whole."""
    return map_points(g, lambda x, y: (F.when(x < 0, x + by).otherwise(x) if only_negative else x + by, y))


def points(g: Column) -> Column:
    return F.flatten(g["rings"])


def box(g: Column) -> Column:
    xs, ys = F.transform(points(g), lambda p: p["x"]), F.transform(points(g), lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("left"), F.array_min(ys).alias("bottom"), F.array_max(xs).alias("right"), F.array_max(ys).alias("top"))


def spans_antimeridian(g: Column) -> Column:
    b = box(g)
    return (b["right"] - b["left"]) > 180


def to_whole(g: Column) -> Column:
    """A geometry in degrees that is over 180 wide as one that passes the antimeridian to the east."""
    return F.when(spans_antimeridian(g), shift_longitude(g, only_negative=True)).otherwise(g)


def segmentized(g: Column, most: float) -> Column:
    """With points put in so that no edge is longer than ``most``."""

    def ring(r: Column) -> Column:
        def edge(i: Column) -> Column:
            a, b = F.element_at(r, i), F.element_at(r, i + 1)
            n = F.greatest(F.ceil(F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"])) / most), F.lit(1)).cast("int")
            return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct((a["x"] + (b["x"] - a["x"]) * k / n).alias("x"), (a["y"] + (b["y"] - a["y"]) * k / n).alias("y")))

        inner = F.flatten(F.transform(F.sequence(F.lit(1), F.size(r) - 1), edge))
        return F.when(F.size(r) < 2, r).otherwise(F.concat(inner, F.slice(r, -1, 1)))

    return F.struct(g["type"].alias("type"), F.transform(g["rings"], ring).alias("rings"), g["part"].alias("part"))


def signed_area(r: Column) -> Column:
    """A closed ring's area by the shoelace formula, positive if counter-clockwise."""
    parts = F.transform(F.sequence(F.lit(1), F.size(r) - 1), lambda i: F.element_at(r, i)["x"] * F.element_at(r, i + 1)["y"] - F.element_at(r, i + 1)["x"] * F.element_at(r, i)["y"])
    return F.when(F.size(r) < 4, F.lit(0.0)).otherwise(F.aggregate(parts, F.lit(0.0), lambda s, v: s + v) / 2)


def area(g: Column) -> Column:
    """Of polygons: each part's first ring less its others; 0 for other types."""
    sizes = F.transform(g["rings"], lambda r, i: F.when((i > 0) & (F.get(g["part"], i) == F.get(g["part"], i - 1)), -F.abs(signed_area(r))).otherwise(F.abs(signed_area(r))))
    return F.when(g["type"].isin("Polygon", "MultiPolygon"), F.aggregate(sizes, F.lit(0.0), lambda s, v: s + v)).otherwise(F.lit(0.0))


def length(g: Column) -> Column:
    def ring(r: Column) -> Column:
        d = F.transform(F.sequence(F.lit(1), F.size(r) - 1), lambda i: F.hypot(F.element_at(r, i + 1)["x"] - F.element_at(r, i)["x"], F.element_at(r, i + 1)["y"] - F.element_at(r, i)["y"]))
        return F.when(F.size(r) < 2, F.lit(0.0)).otherwise(F.aggregate(d, F.lit(0.0), lambda s, v: s + v))

    return F.aggregate(F.transform(g["rings"], ring), F.lit(0.0), lambda s, v: s + v)


def centroid(g: Column) -> Column:
    """Mean of the points of the bounding box: cheap and enough to deal features out."""
    b = box(g)
    return F.struct(((b["left"] + b["right"]) / 2).alias("x"), ((b["bottom"] + b["top"]) / 2).alias("y"))


def ring_holds(r: Column, x: Column, y: Column) -> Column:
    """Even-odd rule: how often a ray to the east crosses the ring; half-open edges, so no point is counted twice."""

    def crosses(i: Column) -> Column:
        a, b = F.element_at(r, i), F.element_at(r, i + 1)
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"])

    return F.when(F.size(r) < 4, F.lit(False)).otherwise(F.size(F.filter(F.sequence(F.lit(1), F.size(r) - 1), crosses)) % 2 == 1)


def holds(g: Column, x: Column, y: Column) -> Column:
    """Whether a polygon holds a point (holes are left out by the even-odd rule over all rings)."""
    return F.size(F.filter(g["rings"], lambda r: ring_holds(r, x, y))) % 2 == 1


def distance(g: Column, x: Column, y: Column) -> Column:
    """From a point to the nearest segment or point of a geometry's rings (0 on them; a polygon's inside isn't 0)."""

    def of_segment(a: Column, b: Column) -> Column:
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        span = dx * dx + dy * dy
        t = F.when(span > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - a["x"]) * dx + (y - a["y"]) * dy) / span))).otherwise(F.lit(0.0))
        return F.hypot(x - a["x"] - t * dx, y - a["y"] - t * dy)

    def of_ring(r: Column) -> Column:
        return F.array_min(F.transform(r, lambda p, i: of_segment(p, F.coalesce(F.get(r, i + 1), p))))

    return F.array_min(F.transform(g["rings"], of_ring))


def is_type(g: Column, name: str, single: bool = True, multi: bool = True) -> Column:
    """Whether ``g`` has the type, or with ``single`` / ``multi`` its single or multipart form."""
    names = {name} | ({singlepart_type(name)} if single else set()) | ({multipart_type(name)} if multi else set())
    return g["type"].isin(sorted(names))


def is_empty(g: Column) -> Column:
    return g.isNull() | (F.size(points(g)) == 0)


def singleparts(g: Column) -> Column:
    """An array with a geometry for each part. A collection's parts tell their type by their first ring: one point, a closed ring, or else a line."""
    known = F.when(g["type"].isin(*SINGLE), F.replace(g["type"], F.lit("Multi"), F.lit(""))).otherwise(g["type"])

    def shape(r: Column) -> Column:
        closed = (F.size(r) > 3) & (F.element_at(r, 1) == F.element_at(r, -1))
        return F.when(F.size(r) == 1, "Point").when(closed, "Polygon").otherwise("LineString")

    def one(i: Column) -> Column:
        mine = F.filter(F.arrays_zip(g["rings"].alias("rings"), g["part"].alias("part")), lambda z: z["part"] == i)
        kind = F.when(g["type"] == "GeometryCollection", shape(F.get(mine, F.lit(0))["rings"])).otherwise(known)
        return F.struct(kind.alias("type"), F.transform(mine, lambda z: z["rings"]).alias("rings"), F.transform(mine, lambda z: F.lit(0)).alias("part"))

    return F.transform(F.array_distinct(g["part"]), one)


def repaired(g: Column) -> Column:
    """Polygons with closed rings, outer rings counter-clockwise and holes clockwise."""

    def ring(r: Column, i: Column) -> Column:
        closed = F.when((F.size(r) > 0) & (F.element_at(r, 1) != F.element_at(r, -1)), F.concat(r, F.slice(r, 1, 1))).otherwise(r)
        hole = (i > 0) & (F.get(g["part"], i) == F.get(g["part"], i - 1))
        return F.when((signed_area(closed) < 0) != hole, F.reverse(closed)).otherwise(closed)

    fixed = F.struct(g["type"].alias("type"), F.transform(g["rings"], ring).alias("rings"), g["part"].alias("part"))
    return F.when(g["type"].isin("Polygon", "MultiPolygon"), fixed).otherwise(g)


def geojson(g: Column) -> Column:
    """GeoJSON text of a geometry."""
    import pyspark.sql.functions as S

    @S.pandas_udf("string")
    def text(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([None if r["type"] is None else json.dumps(to_geojson(r)) for r in rows.to_dict("records")])

    return text(g)


def clip_ring(ring: list[tuple[float, float]], left: float, bottom: float, right: float, top: float) -> list[tuple[float, float]]:
    """A ring cut to a rectangle, side by side (Sutherland and Hodgman's way)."""
    sides = [(0, left, 1), (0, right, -1), (1, bottom, 1), (1, top, -1)]
    for axis, at, sign in sides:
        if not ring:
            break
        out, before = [], ring[-1]
        for p in ring:
            inside, was = (p[axis] - at) * sign >= 0, (before[axis] - at) * sign >= 0
            if inside != was:
                t = (at - before[axis]) / (p[axis] - before[axis])
                cut = [before[0] + (p[0] - before[0]) * t, before[1] + (p[1] - before[1]) * t]
                cut[axis] = at
                out.append(tuple(cut))
            if inside:
                out.append(p)
            before = p
        ring = out
    return ring


def clip_geometry(g: dict, left: float, bottom: float, right: float, top: float) -> dict | None:
    """A point, line or polygon cut to a rectangle; None if nothing is left."""
    rings, part = [], []
    for ring, i in zip(g["rings"], g["part"]):
        xy = [(p["x"], p["y"]) for p in ring]
        if g["type"] in ("Polygon", "MultiPolygon"):
            found = clip_ring(xy[:-1] if len(xy) > 1 and xy[0] == xy[-1] else xy, left, bottom, right, top)
            pieces = [[*found, found[0]]] if len(found) > 2 else []
        elif g["type"] in ("LineString", "MultiLineString", "LinearRing"):
            pieces = clip_line(xy, left, bottom, right, top)
        elif g["type"] in ("Point", "MultiPoint"):
            pieces = [xy] if left <= xy[0][0] <= right and bottom <= xy[0][1] <= top else []
        else:
            raise ValueError(f"{g['type']} can't be clipped")
        rings += [[{"x": x, "y": y} for x, y in p] for p in pieces]
        # Lines and points: each piece is a part; a polygon's ring stays with its part.
        part += [i if g["type"] in ("Polygon", "MultiPolygon") else len(part) + k for k in range(len(pieces))]
    if not rings:
        return None
    kind = multipart_type(g["type"]) if len(set(part)) > 1 else singlepart_type(g["type"])
    return {"type": kind, "rings": rings, "part": part}


def clip_line(xy: list[tuple[float, float]], left: float, bottom: float, right: float, top: float) -> list[list[tuple[float, float]]]:
    """Pieces of a line within a rectangle (Liang and Barsky's way, edge by edge)."""
    out: list[list[tuple[float, float]]] = []
    for (x0, y0), (x1, y1) in zip(xy, xy[1:]):
        t0, t1, dx, dy = 0.0, 1.0, x1 - x0, y1 - y0
        for p, q in ((-dx, x0 - left), (dx, right - x0), (-dy, y0 - bottom), (dy, top - y0)):
            if p == 0:
                if q < 0:
                    t0, t1 = 1.0, 0.0
            elif p < 0:
                t0 = max(t0, q / p)
            else:
                t1 = min(t1, q / p)
        if t0 < t1:
            a, b = (x0 + t0 * dx, y0 + t0 * dy), (x0 + t1 * dx, y0 + t1 * dy)
            if out and out[-1][-1] == a:
                out[-1].append(b)
            else:
                out.append([a, b])
    return out


def let(value: Column, f) -> Column:
    """f(value) with the value computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def _cut_ring(ring: Column, box: Column) -> Column:
    """An open ring cut side by side, as `clip_ring` does."""
    for axis, other, name, sign in (("x", "y", "left", 1), ("x", "y", "right", -1), ("y", "x", "bottom", 1), ("y", "x", "top", -1)):
        ring = let(ring, _cut_side(axis, other, box[name], sign))
    return ring


def _cut_side(axis: str, other: str, at: Column, sign: int):
    def pair(p: Column, q: Column) -> Column:
        inside, was = (p[axis] - at) * sign >= 0, (q[axis] - at) * sign >= 0
        across = q[other] + (p[other] - q[other]) * ((at - q[axis]) / F.nullif(p[axis] - q[axis], F.lit(0.0)))
        cut = _point(at, across) if axis == "x" else _point(across, at)
        empty = F.filter(F.array(p), lambda _: F.lit(False))
        return F.concat(F.when(inside != was, F.array(cut)).otherwise(empty), F.when(inside, F.array(p)).otherwise(empty))

    def side(r: Column) -> Column:
        steps = F.transform(r, lambda p, i: let(F.element_at(r, F.when(i == 0, F.size(r)).otherwise(i)), lambda q: pair(p, q)))
        return F.when(F.size(r) > 0, F.flatten(steps)).otherwise(r)

    return side


def _cut_polygon(ring: Column, box: Column) -> Column:
    is_closed = (F.size(ring) > 1) & (F.element_at(ring, 1) == F.element_at(ring, -1))
    opened = F.when(is_closed, F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0)))).otherwise(ring)
    return let(_cut_ring(opened, box), lambda r: F.filter(F.array(F.concat(r, F.slice(r, 1, 1))), lambda x: F.size(x) > 3))


def _cut_line(ring: Column, box: Column) -> Column:
    """Pieces of a line, as `clip_line` does."""

    def segment(i: Column) -> Column:
        a, b = F.element_at(ring, i), F.element_at(ring, i + 1)
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        pq = [(-dx, a["x"] - box["left"]), (dx, box["right"] - a["x"]), (-dy, a["y"] - box["bottom"]), (dy, box["top"] - a["y"])]
        t0 = F.greatest(F.lit(0.0), *[F.when(p < 0, q / F.nullif(p, F.lit(0.0))) for p, q in pq])
        t1 = F.least(F.lit(1.0), *[F.when(p > 0, q / F.nullif(p, F.lit(0.0))) for p, q in pq])
        beside = (dx == 0) & ((pq[0][1] < 0) | (pq[1][1] < 0)) | (dy == 0) & ((pq[2][1] < 0) | (pq[3][1] < 0))
        cut = F.array(_point(a["x"] + t0 * dx, a["y"] + t0 * dy), _point(a["x"] + t1 * dx, a["y"] + t1 * dy))
        return F.when((t0 < t1) & ~beside, F.array(cut)).otherwise(F.filter(F.array(cut), lambda _: F.lit(False)))

    pieces = F.flatten(F.transform(F.sequence(F.lit(1), F.size(ring) - 1), segment))

    def join(out: Column, s: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        goes_on = F.coalesce(F.try_element_at(last, F.lit(-1)) == F.element_at(s, 1), F.lit(False))
        return F.when(goes_on, F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.concat(last, F.slice(s, 2, 1))))).otherwise(F.concat(out, F.array(s)))

    return F.when(F.size(ring) > 1, F.aggregate(pieces, F.filter(F.array(ring), lambda _: F.lit(False)), join)).otherwise(F.filter(F.array(ring), lambda _: F.lit(False)))


def clipped(g: Column, box: Column) -> Column:
    """``g`` cut to a box; null if nothing is left. All is done by expressions, so features don't leave the JVM."""
    polygon, line = g["type"].isin("Polygon", "MultiPolygon"), g["type"].isin("LineString", "MultiLineString", "LinearRing")
    within = lambda p: (p["x"] >= box["left"]) & (p["x"] <= box["right"]) & (p["y"] >= box["bottom"]) & (p["y"] <= box["top"])

    def pieces(ring: Column) -> Column:
        return F.when(polygon, _cut_polygon(ring, box)).when(line, _cut_line(ring, box)).otherwise(F.filter(F.array(ring), lambda r: within(F.element_at(r, 1))))

    def numbered(ring: Column, i: Column) -> Column:
        return F.transform(pieces(ring), lambda r: F.struct(r.alias("ring"), i.alias("part")))

    def whole(ps: Column) -> Column:
        # Each piece of a line is a part, whichever line it comes from; a polygon's ring stays with its part.
        part = F.transform(ps, lambda p, k: F.when(polygon, p["part"]).otherwise(k))
        multi = F.size(F.array_distinct(part)) > 1
        single = F.replace(g["type"], F.lit("Multi"), F.lit(""))
        kind = F.when(multi & single.isin(*MULTI), F.concat(F.lit("Multi"), single)).when(~multi, single).otherwise(g["type"])
        return F.when(F.size(ps) > 0, F.struct(kind.alias("type"), F.transform(ps, lambda p: p["ring"]).alias("rings"), part.alias("part")))

    return let(F.flatten(F.zip_with(g["rings"], g["part"], numbered)), whole)


def split_antimeridian(g: dict) -> dict:
    """A polygon in degrees that reaches beyond 180 as one on both sides of the antimeridian."""
    east = clip_geometry(g, -180.0, -90.0, 180.0, 90.0)
    out = {"type": "MultiPolygon", "rings": list(east["rings"]) if east else [], "part": [0] * len(east["rings"]) if east else []}
    for lo, hi, by in ((180.0, 540.0, -360.0), (-540.0, -180.0, 360.0)):
        rest = clip_geometry(g, lo, -90.0, hi, 90.0)
        if rest:
            moved = [[{"x": p["x"] + by, "y": p["y"]} for p in r] for r in rest["rings"]]
            if all(abs(signed_area_of(r)) > 0 for r in moved):
                out["rings"] += moved
                out["part"] += [max(out["part"], default=-1) + 1] * len(moved)
    if len(set(out["part"])) < 2:
        out["type"] = "Polygon"
    return out


def signed_area_of(ring: list[dict]) -> float:
    return sum(a["x"] * b["y"] - b["x"] * a["y"] for a, b in zip(ring, ring[1:])) / 2


def buffer_box(g: dict, by: float) -> dict:
    """The geometry's bounding box widened by ``by`` on all sides: a superset of a buffer, for choosing tiles."""
    xs, ys = [p["x"] for r in g["rings"] for p in r], [p["y"] for r in g["rings"] for p in r]
    return parse((min(xs) - by, min(ys) - by, max(xs) + by, max(ys) + by))


def buffer_point_metres(lon: float, lat: float, metres: float, corners: int = 32) -> dict:
    """A circle around a point, drawn in its UTM zone and cut at the antimeridian."""
    crs = utm_crs(lat, lon)
    x, y = reproject_point(lon, lat, "EPSG:4326", crs)
    ring = [reproject_point(x + metres * math.cos(2 * math.pi * i / corners), y + metres * math.sin(2 * math.pi * i / corners), crs, "EPSG:4326") for i in range(corners)]
    ring.append(ring[0])
    g = from_geojson({"type": "Polygon", "coordinates": [ring]})
    return split_antimeridian(g) if max(p[0] for p in ring) > 180 or min(p[0] for p in ring) < -180 else g
