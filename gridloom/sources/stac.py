"""STAC items of tile directories."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.bounds import Bounds
from gridloom.functions.pyramid import GRIDS, Grid, Pyramid, scale_denominator
from gridloom.functions.zooms import ZoomLevels

#: OGC's names of the two grids: identifier, title, supported projection, scale set.
MATRIX_SETS = {
    "geodetic": ("WorldCRS84Quad", "CRS84 for the World", "http://www.opengis.net/def/crs/OGC/1.3/CRS84", "http://www.opengis.net/def/wkss/OGC/1.0/GoogleCRS84Quad"),
    "mercator": ("WebMercatorQuad", "Google Maps Compatible for the World", "http://www.opengis.net/def/crs/EPSG/0/3857", "http://www.opengis.net/def/wkss/OGC/1.0/GoogleMapsCompatible"),
}
#: Metres of a projection's unit, and media types of tiles.
UNIT = {"EPSG:4326": 111319.49079327358, "EPSG:3857": 1.0}
MEDIA = {"tif": "image/tiff; application=geotiff", "png": "image/png", "geojson": "application/geo+json", "parquet": "application/vnd.apache.parquet"}
EXTENSIONS = ["https://stac-extensions.github.io/tiled-assets/v1.0.0/schema.json", "https://stac-extensions.github.io/eo/v1.1.0/schema.json"]


def tile_limits(tiles: DataFrame) -> DataFrame:
    """The range of rows and columns at each zoom."""
    return tiles.groupBy("zoom").agg(F.min("row").alias("min_row"), F.max("row").alias("max_row"), F.min("col").alias("min_col"), F.max("col").alias("max_col"))


def timestamp(value: str | datetime | None) -> str | None:
    if value is None:
        return None
    value = datetime.fromisoformat(value.replace("Z", "+00:00")) if isinstance(value, str) else value
    value = value if value.tzinfo else value.replace(tzinfo=timezone.utc)
    return value.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def matrix_set(pyramid: Pyramid, zooms: list[int]) -> dict:
    """A pyramid's zooms as a tile matrix set, by the names of OGC's schema."""
    g = pyramid.grid
    epsg = f"http://www.opengis.net/def/crs/EPSG/0/{g.crs.rpartition(':')[2]}"
    known = MATRIX_SETS.get(g.name)
    span = pyramid.tile_size * pyramid.metatiling
    unit = UNIT.get(g.crs, 1.0)
    matrices = [
        {"type": "TileMatrixType", "identifier": str(z), "scaleDenominator": scale_denominator(pyramid.pixel_size(z), unit), "topLeftCorner": [g.left, g.top], "tileWidth": span, "tileHeight": span, "matrixWidth": pyramid.matrix_width(z), "matrixHeight": pyramid.matrix_height(z)}
        for z in zooms
    ]
    box = {"type": "BoundingBoxType", "crs": known[2] if known else epsg, "lowerCorner": [g.left, g.bottom], "upperCorner": [g.right, g.top]}
    named = {"identifier": known[0], "title": known[1], "supportedCRS": known[2], "wellKnownScaleSet": known[3]} if known else {"identifier": g.name, "supportedCRS": epsg}
    return {"type": "TileMatrixSetType", **named, "boundingBox": box, "tileMatrix": matrices}


def item(item_id: str, tiles: DataFrame, pyramid: Pyramid, base: str, extension: str = "parquet", media_type: str | None = None, metadata: dict | None = None, bands: list[dict] | None = None, schema: str = "{TileMatrix}/{TileRow}/{TileCol}") -> dict:
    """A STAC item with the tiled-assets extension. What comes to the driver is one row for each zoom."""
    metadata = dict(metadata or {})
    limits = sorted(tile_limits(tiles).collect(), key=lambda r: r["zoom"])
    if not limits:
        raise ValueError("a tile directory without tiles has no item")
    last = limits[-1]
    box = pyramid.tile_bounds(last["zoom"], last["min_row"], last["min_col"], 0) + pyramid.tile_bounds(last["zoom"], last["max_row"], last["max_col"], 0)
    latlon = box.latlon() if pyramid.grid.crs == "EPSG:3857" else Bounds(*box)
    own = matrix_set(pyramid, [r["zoom"] for r in limits])
    asset = {"href": f"{base}/{schema}.{extension}", "type": media_type or MEDIA[extension], **({"eo:bands": bands} if bands else {})}
    start, end = timestamp(metadata.pop("start_datetime", None)), timestamp(metadata.pop("end_datetime", None))
    when = timestamp(metadata.pop("datetime", None)) if not (start and end) else None
    name = own["identifier"]
    properties = {
        **metadata,
        "datetime": when or (None if start and end else timestamp(datetime.now(timezone.utc))),
        **({"start_datetime": start, "end_datetime": end} if start and end else {}),
        "tiles:tile_matrix_links": {name: {"url": f"#{name}", "limits": {str(r["zoom"]): {"min_tile_col": r["min_col"], "max_tile_col": r["max_col"], "min_tile_row": r["min_row"], "max_tile_row": r["max_row"]} for r in limits}}},
        "tiles:tile_matrix_sets": {name: own},
    }
    return {"type": "Feature", "stac_version": "1.0.0", "stac_extensions": EXTENSIONS[: 1 + bool(bands)], "id": item_id, "bbox": list(latlon), "geometry": {"type": "Polygon", "coordinates": [[list(p) for p in latlon.ring]]}, "properties": properties, "asset_templates": {"bands": asset}, "assets": {}, "links": []}


def updated(old: dict, new: dict) -> dict:
    """A newer item with the zooms, limits and bounds of both."""
    out = {**new, "properties": dict(new["properties"])}
    links_old, links = old["properties"]["tiles:tile_matrix_links"], {}
    for name, link in new["properties"]["tiles:tile_matrix_links"].items():
        limits = dict(links_old.get(name, {}).get("limits", {}))
        for zoom, now in link["limits"].items():
            was = limits.get(zoom)
            limits[zoom] = now if was is None else {k: (min if k.startswith("min") else max)(v, was[k]) for k, v in now.items()}
        links[name] = {**link, "limits": dict(sorted(limits.items(), key=lambda x: int(x[0])))}
    out["properties"]["tiles:tile_matrix_links"] = links
    sets = {}
    for name, own in new["properties"]["tiles:tile_matrix_sets"].items():
        both = {m["identifier"]: m for m in [*old["properties"]["tiles:tile_matrix_sets"].get(name, {}).get("tileMatrix", []), *own["tileMatrix"]]}
        sets[name] = {**own, "tileMatrix": [both[k] for k in sorted(both, key=int)]}
    out["properties"]["tiles:tile_matrix_sets"] = sets
    out["bbox"] = list(Bounds(*old["bbox"]) + Bounds(*new["bbox"]))
    out["geometry"] = {"type": "Polygon", "coordinates": [[list(p) for p in Bounds(*out["bbox"]).ring]]}
    return out


def pyramid_of(found: dict) -> Pyramid:
    """The pyramid that an item describes. Metatiles show in a matrix that is narrower than the grid's own; of a grid that isn't known they are taken for tiles."""
    own = next(iter(found["properties"]["tiles:tile_matrix_sets"].values()))
    last = own["tileMatrix"][-1]
    z = int(last["identifier"])
    for name, known in MATRIX_SETS.items():
        if own.get("identifier") == known[0] or own.get("wellKnownScaleSet") == known[3]:
            grid = GRIDS[name]
            metatiling = 1
            while metatiling < 256 and -(-grid.cols * 2**z // metatiling) > last["matrixWidth"]:
                metatiling *= 2
            return Pyramid(grid, tile_size=last["tileWidth"] // metatiling, metatiling=metatiling)
    box = own["boundingBox"]
    rows, cols = (max(1, round(last[k] / 2**z)) for k in ("matrixHeight", "matrixWidth"))
    crs = f"EPSG:{own['supportedCRS'].replace('::', '/').rpartition('/')[2]}"
    return Pyramid(Grid(own["identifier"], *box["lowerCorner"], *box["upperCorner"], rows, cols, crs), tile_size=last["tileWidth"])


def zooms_of(found: dict) -> ZoomLevels:
    limits = next(iter(found["properties"]["tiles:tile_matrix_links"].values()))["limits"]
    return ZoomLevels(tuple(sorted(map(int, limits))))


def prototypes(found: dict) -> list[str]:
    """One existing tile's path for each zoom, from the limits."""
    link = next(iter(found["properties"]["tiles:tile_matrix_links"].values()))
    href = found["asset_templates"]["bands"]["href"]
    return [href.replace("{TileMatrix}", z).replace("{TileRow}", str(v["min_tile_row"])).replace("{TileCol}", str(v["min_tile_col"])) for z, v in link["limits"].items()]
