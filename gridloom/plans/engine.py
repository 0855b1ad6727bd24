"""A process over its tiles: what is to be done, doing it, and reading what was done.

Each zoom of the base levels is one plan: tiles, their inputs, the function, the write. Overviews are made
from the base zoom by aggregation, or from the children that are stored, never by running the function again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import geometry as G
from gridloom.functions import raster as R
from gridloom.functions.bounds import Bounds
from gridloom.functions.pyramid import Pyramid, Tile
from gridloom.functions.zooms import ZoomLevels
from gridloom.operators import joins, process, tiles
from gridloom.operators.tiles import KEYS
from gridloom.operators.vector import reprojected
from gridloom.plans.config import Mode, ProcessConfig, zooms_from
from gridloom.sources import formats, readers, sinks, stac
from gridloom.sources.paths import scratch, stored
from gridloom.streaming.incremental import touched

Observer = Callable[[str, dict], None]


@dataclass
class Process:
    """A configured process, and a run's zooms and bounds."""

    spark: SparkSession
    config: ProcessConfig
    mode: Mode
    zooms: ZoomLevels
    bounds: Bounds | None
    observers: list[Observer]

    def _tell(self, what: str, **more) -> None:
        for o in self.observers:
            o(what, more)

    @cached_property
    def pyramid(self) -> Pyramid:
        return self.config.pyramid

    @cached_property
    def base_levels(self) -> list[int]:
        return [z for z in self.zooms if z in self.config.processing_levels()]

    # Tiles

    def process_area(self) -> Bounds | None:
        area = self.config.effective_area()
        return area.intersection(self.bounds) if area and self.bounds else area

    def process_tiles(self, zoom: int | None = None) -> DataFrame:
        """Tiles of the run, by zoom descending if all are asked for; an area's shape is tested, not only its box."""
        area = self.process_area()
        levels = [zoom] if zoom is not None else self.zooms.descending()
        if area is None:
            return self.spark.createDataFrame([], "zoom int, row int, col int")
        df = tiles.tiles_from_bounds(self.spark, self.pyramid, area, levels)
        if self.config.area:
            shape = self.spark.createDataFrame([(self.config.area,)], G.T.StructType([G.T.StructField("geom", G.GEOMETRY)])).select("geom")
            met = None
            for z in levels:
                one = tiles.tiles_from_features(shape, self.pyramid, z, exact=True)
                met = one if met is None else met.unionAll(one)
            df = df.join(met, KEYS, "left_semi")
        for z in levels:
            boxes = self.input_boxes(z) if z in self.config.processing_levels() else None
            if boxes is not None:
                own = df.where(F.col("zoom") == z).withColumn("box", self.pyramid.box(z, F.col("row"), F.col("col")))
                df = df.where(F.col("zoom") != z).unionByName(joins.range_join(own, boxes, self.pyramid, max(0, z - 2), how="left_semi", touching=False).select(*KEYS))
        return df

    def input_boxes(self, zoom: int) -> DataFrame | None:
        """Boxes of what the inputs hold at a zoom: tiles beyond them have nothing to do. None if there is no input, or one whose place isn't known."""
        key = repr(sorted((k, id(v) if isinstance(v, (DataFrame, Process)) else v) for k, v in self.config.input_at(zoom).items()))
        if key not in self._boxes:
            self._boxes[key] = self._find_boxes(zoom)
        return self._boxes[key]

    @cached_property
    def _boxes(self) -> dict[str, DataFrame | None]:
        return {}

    def _find_boxes(self, zoom: int) -> DataFrame | None:
        out = None
        for source in self.config.input_at(zoom).values():
            place = source["path"] if isinstance(source, dict) else source
            if isinstance(place, str) and readers.driver_of(place).name == "GTiff":
                boxes = readers.raster_boxes(self.spark, place).select(F.coalesce("crs", F.lit(self.pyramid.grid.crs)).alias("crs"), "box").distinct()
                crs = {r["crs"] for r in boxes.select("crs").distinct().collect()}
                one = boxes.select("box") if crs <= {self.pyramid.grid.crs} else None
                for c in sorted(crs - {self.pyramid.grid.crs}):
                    moved = boxes.where(F.col("crs") == c).select(R.reprojected_box(F.col("box"), c, self.pyramid).alias("box"))
                    same = boxes.where(F.col("crs") == self.pyramid.grid.crs).select("box")
                    one = moved.unionByName(same if one is None else one)
            elif isinstance(place, DataFrame) and "geom" in place.columns and "zoom" not in place.columns:
                one = place.select(G.box(F.col("geom")).alias("box"))
            else:
                return None
            out = one if out is None else out.unionByName(one)
        return out.persist() if out is not None else None

    def count_tiles(self) -> dict[int, int]:
        if self.config.area:
            return {r["zoom"]: r["n"] for r in self.process_tiles().groupBy("zoom").agg(F.count(F.lit(1)).alias("n")).collect()}
        area = self.process_area()
        return tiles.count_tiles(self.spark, self.pyramid, area, self.zooms) if area else {}

    def count_tasks(self) -> int:
        return sum(self.count_tiles().values()) + len(self.preprocessing)

    def batches(self, by: str = "row") -> Iterator[DataFrame]:
        """A frame for each zoom, tiles ranged by row or column."""
        for zoom in self.zooms.descending():
            yield tiles.batches(self.process_tiles(zoom), by)

    @cached_property
    def format(self) -> formats.Format:
        """The output's format; one that isn't written is an error."""
        return formats.of(self.config.output)

    def existing(self) -> DataFrame:
        return self.format.existing(self.spark, self.config.output["path"])

    def write(self, df: DataFrame, replaced: DataFrame | None = None) -> None:
        self.format.write(df, self.config.output["path"], self.config.output_pyramid, self.config.output, replaced)

    def skip_tiles(self) -> DataFrame:
        """zoom, row, col, skip, message: which tiles a run in continue mode has no need of."""
        done = joins.process_tiles_done(self.process_tiles(), self.pyramid.without_pixelbuffer(), self.config.output_pyramid, self.existing()).withColumn("_done", F.lit(True))
        df = self.process_tiles().join(done, KEYS, "left")
        skip = F.coalesce("_done", F.lit(False)) if self.mode is Mode.CONTINUE else F.lit(False)
        return df.select(*KEYS, skip.alias("skip"), F.when(skip, "output exists").alias("message"))

    # Inputs

    @cached_property
    def preprocessing(self) -> dict[str, Callable[[], DataFrame]]:
        """Things made once for all tiles: inputs whose configuration says ``cache``."""
        out = {}
        for zoom in self.base_levels:
            for name, source in self.config.input_at(zoom).items():
                if isinstance(source, dict) and source.get("cache"):
                    out[name] = lambda s=source: readers.cached(readers.open_input(self.spark, s["path"]), None if s["cache"] == "memory" else s["cache"]["path"], s["cache"] != "memory" and s["cache"].get("keep", False))
        return out

    @cached_property
    def preprocessed(self) -> dict[str, DataFrame]:
        return {k: make() for k, make in self.preprocessing.items()}

    def inputs(self, zoom: int) -> tuple[dict[str, DataFrame], set[str]]:
        """Packed rasters and features by tile of each input at a zoom, and which are vectors."""
        found, vectors = {}, set()
        size = self.pyramid.tile_size * self.pyramid.metatiling
        for name, source in self.config.input_at(zoom).items():
            more = source if isinstance(source, dict) else {}
            place = more.get("path", source)
            method = more.get("resampling", "nearest")
            if isinstance(source, DataFrame):
                df = source
            elif name in self.preprocessed:
                df = self.preprocessed[name]
            elif isinstance(source, Process):
                df = source.read(zoom)
            elif place.endswith((".yml", ".yaml")):
                df = open_process(self.spark, place, "readonly").read(zoom)
            elif readers.driver_of(place).name == "TileDirectory":
                df = self._from_directory(readers.TileDirectory(self.spark, place), zoom, method, more, size)
            else:
                df = readers.open_input(self.spark, place)
            name = name.replace("/", "_")
            if "geom" in df.columns:
                vectors.add(name)
                if "zoom" not in df.columns:
                    df = self._features(reprojected(df, more.get("crs", self.pyramid.grid.crs), self.pyramid.grid.crs), zoom)
            elif "zoom" not in df.columns:
                df = self._packed(readers.warped_to_tiles(df, self.pyramid.without_pixelbuffer(), zoom, method), zoom, size)
            found[name] = df
        return found, vectors

    def _packed(self, pixels: DataFrame, zoom: int, size: int) -> DataFrame:
        whole = size + 2 * self.pyramid.pixelbuffer
        return R.to_packed(self._buffered(pixels, zoom, size), whole, whole)

    def _from_directory(self, found: readers.TileDirectory, zoom: int, method: str, more: dict, size: int) -> DataFrame:
        """A tile directory's tiles: as they are if its pyramid is the process's, else from its zoom that matches."""
        own, fallback = self.pyramid.without_pixelbuffer(), bool(more.get("fallback_to_higher_zoom"))
        if formats.of(found.metadata["driver"]).data_type == "vector":
            rows = found.rows(zoom)
            return rows if found.pyramid.without_pixelbuffer() == own else self._features(rows.drop(*KEYS).distinct(), zoom)
        if found.pyramid.without_pixelbuffer() == own and (zoom in found.zooms() or fallback):
            df = found.read(zoom, more.get("max_zoom"), fallback)
            return df if not self.pyramid.pixelbuffer else self._packed(R.to_long(df.select(*KEYS, "band", "height", "width", "pixels")), zoom, size)
        return self._packed(found.read_for(own, zoom, method, more.get("matching_method", "min"), fallback), zoom, size)

    def _features(self, df: DataFrame, zoom: int) -> DataFrame:
        from gridloom.operators.vector import read_tiles

        return read_tiles(df, self.pyramid, zoom)

    def _buffered(self, pixels: DataFrame, zoom: int, size: int) -> DataFrame:
        b = self.pyramid.pixelbuffer
        if not b:
            return pixels
        df = R.halo(pixels, self.pyramid, zoom, b, size).where((F.col("py") >= -b) & (F.col("px") >= -b) & (F.col("py") < size + b) & (F.col("px") < size + b))
        return df.withColumns({"py": F.col("py") + b, "px": F.col("px") + b})

    # Doing it

    def compute(self, zoom: int, only: DataFrame | None = None) -> DataFrame:
        """The function's output at a zoom of the base levels, cut to output tiles."""
        todo = self.process_tiles(zoom) if only is None else only
        given, vectors = self.inputs(zoom)
        vector = self.format.data_type == "vector"
        function = self.config.function
        if getattr(function, "plan", False):
            out = function(todo, given, self.pyramid, zoom, **self.config.params_at(zoom))
        else:
            out = process.run(todo, given, function, self.pyramid, self.config.params_at(zoom), vector, vectors)
        return out if vector else sinks.split_to_output(out, self.pyramid, self.config.output_pyramid, zoom)

    def execute(self) -> DataFrame | None:
        """Run: base levels, then overviews. In memory mode the base output is returned, else it is written."""
        if self.mode is Mode.READONLY:
            raise PermissionError("the process is opened for reading only")
        vector, path = self.format.data_type == "vector", self.config.output["path"]
        if self.mode is Mode.MEMORY:
            out = None
            for zoom in sorted(self.base_levels, reverse=True):
                one = self.compute(zoom)
                out = one if out is None else out.unionByName(one)
            return out
        sinks.write_metadata(self.spark, path, self.config.output_pyramid, {k: v for k, v in self.config.output.items() if k != "path"})
        self._tell("start", zooms=list(self.zooms))
        with scratch(self.spark):
            redo = self._base_levels()
            if not vector and self.config.baselevels:
                self._resampled(redo)
        if self.config.output.get("stac"):
            self.write_stac()
        for boxes in self._boxes.values():
            if boxes is not None:
                boxes.unpersist()
        self._boxes.clear()
        self._tell("done")
        return None

    def _base_levels(self) -> DataFrame | None:
        """Write the zooms of the function; the output tiles that were made, if any."""
        redo = None
        for zoom in sorted(self.base_levels, reverse=True):
            todo = self.process_tiles(zoom)
            if self.mode is Mode.CONTINUE:
                done = self.skip_tiles().where("skip").select(*KEYS)
                todo = todo.join(done, KEYS, "left_anti")
            todo = stored(todo, "todo")
            if todo.isEmpty():
                continue
            out_keys = tiles.cross_pyramid(todo, self.pyramid.without_pixelbuffer(), self.config.output_pyramid).select("zoom", F.col("o_row").alias("row"), F.col("o_col").alias("col"))
            self.write(self.compute(zoom, todo), out_keys)
            redo = out_keys if redo is None else redo.unionByName(out_keys)
            self._tell("zoom", zoom=zoom)
        return redo

    def _long(self, zoom: int) -> DataFrame:
        return R.to_long(self.read(zoom).select(*KEYS, "band", "height", "width", "pixels"))

    def _resampled(self, redo: DataFrame | None) -> None:
        """Zooms outside the base levels, each from the zoom beside it: only tiles over or under what was made, or that are missing."""
        if not self.base_levels:
            return
        base, pyramid = self.config.baselevels, self.config.output_pyramid.without_pixelbuffer()
        size = pyramid.tile_size * pyramid.metatiling
        low, high = min(self.base_levels), max(self.base_levels)
        pack = lambda df: R.to_packed(df, size, size).withColumn("tags", F.lit("{}"))
        above = stored(touched(redo, min(self.zooms)), "above") if redo is not None else None
        for zoom in range(low - 1, min(self.zooms) - 1, -1):
            there = stored(self.existing().where(F.col("zoom").isin(zoom, zoom + 1)), "there")
            again = joins.missing(tiles.parents(there.where(F.col("zoom") == zoom + 1)), there.where(F.col("zoom") == zoom))
            if above is not None:
                again = again.unionByName(above.where(F.col("zoom") == zoom)).distinct()
            keys = stored(again, "again")
            if keys.isEmpty():
                continue
            kernel = base["lower"] in ("bilinear", "cubic")
            # A kernel also looks at the children of neighbours.
            near = tiles.neighbors(keys, pyramid).select(F.col("n_row").alias("_row"), F.col("n_col").alias("_col")).unionByName(keys.select(F.col("row").alias("_row"), F.col("col").alias("_col"))).distinct() if kernel else keys.select(F.col("row").alias("_row"), F.col("col").alias("_col"))
            children = self._long(zoom + 1).withColumns({"_row": F.expr("row DIV 2").cast("int"), "_col": F.expr("col DIV 2").cast("int")}).join(near, ["_row", "_col"], "left_semi").drop("_row", "_col")
            made = R.coarser(children, pyramid, zoom + 1, size, base["lower"]).join(keys, KEYS, "left_semi") if kernel else R.overview(children, size, base["lower"])
            self.write(pack(made), keys)
            self._tell("overview", zoom=zoom)
        below = redo.where(F.col("zoom") == high).select(*KEYS) if redo is not None else None
        for zoom in range(high + 1, max(self.zooms) + 1):
            there = stored(self.existing().where(F.col("zoom").isin(zoom, zoom - 1)), "there")
            want = tiles.children(there.where(F.col("zoom") == zoom - 1), pyramid).select(*KEYS)
            again = joins.missing(want, there.where(F.col("zoom") == zoom))
            if below is not None:
                below = tiles.children(below, pyramid).select(*KEYS)
                again = again.unionByName(below).distinct()
            keys = stored(again, "again")
            if keys.isEmpty():
                continue
            parents = tiles.parents(keys)
            near = tiles.neighbors(parents, pyramid).select(F.col("zoom"), F.col("n_row").alias("row"), F.col("n_col").alias("col")).unionByName(parents).distinct() if base["higher"] in ("bilinear", "cubic") else parents
            made = R.resample(self._long(zoom - 1).join(near, KEYS, "left_semi"), pyramid, zoom - 1, zoom, size, base["higher"]).join(keys, KEYS, "left_semi")
            self.write(pack(made), keys)
            self._tell("overview", zoom=zoom)

    # Reading

    def read(self, zoom: int | None = None, tile: Tile | None = None) -> DataFrame:
        """Output rows, pruned to a zoom or a tile."""
        df = self.format.rows(self.spark, self.config.output["path"], self.config.output, tile.zoom if tile is not None else zoom)
        if tile is not None:
            df = df.where((F.col("zoom") == tile.zoom) & (F.col("row") == tile.row) & (F.col("col") == tile.col))
        return df

    def get_tile(self, tile: Tile) -> DataFrame:
        """A tile on demand: nothing outside the zooms; what exists, else it is computed (and written, unless in memory)."""
        if tile.zoom not in self.zooms:
            return self.spark.createDataFrame([], process.RASTER_OUT)
        one = self.spark.createDataFrame([(tile.zoom, tile.row, tile.col)], "zoom int, row int, col int")
        stored = self.mode is not Mode.MEMORY and not joins.present(one, self.existing()).isEmpty()
        if self.mode is Mode.READONLY or (stored and self.mode is Mode.CONTINUE):
            return self.read(tile=tile) if stored else self.spark.createDataFrame([], process.RASTER_OUT)
        own = tiles.cross_pyramid(one, self.config.output_pyramid, self.pyramid.without_pixelbuffer()).select("zoom", F.col("o_row").alias("row"), F.col("o_col").alias("col"))
        out = self.compute(tile.zoom, own)
        if self.mode is Mode.MEMORY:
            return out.where((F.col("row") == tile.row) & (F.col("col") == tile.col))
        keys = tiles.cross_pyramid(own, self.pyramid.without_pixelbuffer(), self.config.output_pyramid).select("zoom", F.col("o_row").alias("row"), F.col("o_col").alias("col"))
        self.write(out, keys)
        return self.read(tile=tile)

    def write_stac(self) -> dict:
        path, own = self.config.output["path"], dict(self.config.output.get("stac") or {})
        item = stac.item(own.get("id", path.rstrip("/").rpartition("/")[2]), self.existing(), self.config.output_pyramid, path, self.format.extension, metadata=own.get("properties"), bands=own.get("eo:bands"))
        at = sinks.Location(path, self.spark) / f"{item['id']}.json"
        if at.exists():
            item = stac.updated(at.read_json(), item)
        at.write_json(item)
        return item


def open_process(spark: SparkSession, source, mode: str = "continue", zoom=None, bounds=None, observers: list[Observer] | None = None) -> Process:
    """A process from a configuration or its file, or a tile directory (for reading only)."""
    if isinstance(source, str) and not source.endswith((".yml", ".yaml")):
        found = sinks.load_metadata(spark, source)
        zooms = readers.TileDirectory(spark, source).zooms()
        config = ProcessConfig(Pyramid.of(found["pyramid"]), {**found["driver"], "path": source}, ZoomLevels.of(zooms or 0))
        return Process(spark, config, Mode.READONLY, config.zoom_levels, None, observers or [])
    config = source if isinstance(source, ProcessConfig) else ProcessConfig.parse(source)
    if Mode(mode) is not Mode.READONLY:
        config.check()
    return Process(spark, config, Mode(mode), zooms_from(config.zoom_levels, zoom), Bounds.of(bounds) if bounds is not None else None, observers or [])
