"""A Python data source: ``spark.read.format("gridloom_tiles")`` lists the tiles of a pyramid."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridloom.functions.bounds import Bounds
from gridloom.functions.pyramid import Pyramid


class _Rows(InputPartition):
    def __init__(self, zoom: int, first: int, last: int, c0: int, c1: int):
        self.zoom, self.first, self.last, self.c0, self.c1 = zoom, first, last, c0, c1


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.pyramid = Pyramid.of(json.loads(options["pyramid"]) if options.get("pyramid", "").startswith("{") else options.get("pyramid", "geodetic"))
        self.zooms = range(int(options.get("minzoom", 0)), int(options.get("maxzoom", options.get("minzoom", 0))) + 1)
        self.bounds = Bounds(*map(float, options["bounds"].split(","))) if "bounds" in options else self.pyramid.grid.bounds
        self.step = int(options.get("rows", 512))

    def partitions(self) -> list[InputPartition]:
        out = []
        for z in self.zooms:
            found = self.pyramid.cell_range(z, self.bounds)
            if found:
                r0, r1, c0, c1 = found
                out += [_Rows(z, r, min(r + self.step - 1, r1), c0, c1) for r in range(r0, r1 + 1, self.step)]
        return out

    def read(self, partition: _Rows) -> Iterator[tuple]:
        for row in range(partition.first, partition.last + 1):
            for col in range(partition.c0, partition.c1 + 1):
                yield partition.zoom, row, col, *self.pyramid.tile_bounds(partition.zoom, row, col)


class TileSource(DataSource):
    """Options: pyramid (a grid's name or JSON), minzoom, maxzoom, bounds, rows (of tiles in a partition)."""

    @classmethod
    def name(cls) -> str:
        return "gridloom_tiles"

    def schema(self) -> str:
        return "zoom int, row int, col int, left double, bottom double, right double, top double"

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TileSource)
