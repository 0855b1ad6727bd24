"""Runs that only do what is missing, in batches and over a stream.

New leaf tiles invalidate the tiles above them, even if those exist: `touched` gives their keys, and only
those are computed again. `overview_stream` does it for each micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from gridloom.functions import raster as R
from gridloom.operators.tiles import KEYS, ancestors
from gridloom.sources.paths import stored


def touched(leaves: DataFrame, bottom: int = 0) -> DataFrame:
    """Distinct keys of all tiles above the leaves."""
    top = F.col("zoom").alias("_top")
    return ancestors(leaves.select(*KEYS, top), bottom).where("zoom < _top").select(*KEYS).distinct()


def refreshed(base: DataFrame, existing: DataFrame, changed: DataFrame, width: int, top: int, bottom: int, method: str = "average") -> DataFrame:
    """Overview pixels of the tiles above ``changed``, and of no others.

    ``base``: pixels of zoom ``top`` as they are now; ``existing``: overview pixels as they were. Each touched
    tile is made from its children: those made just before, and for untouched siblings those that exist.
    The touched keys and each level are stored and read again, so that the plan of a level is as long at
    zoom 0 as at the top.
    """
    again = stored(touched(changed.where(F.col("zoom") == top), bottom), "touched")
    fresh, out = None, None
    for zoom in range(top - 1, bottom - 1, -1):
        if fresh is None:
            children = base.where(F.col("zoom") == top)
        else:
            old = existing.where(F.col("zoom") == zoom + 1).join(again, KEYS, "left_anti")
            children = old.select(fresh.columns).unionByName(fresh)
        mine = again.where(F.col("zoom") == zoom).select(F.col("row").alias("_row"), F.col("col").alias("_col"))
        need = children.select("*", F.expr("row DIV 2").cast("int").alias("_row"), F.expr("col DIV 2").cast("int").alias("_col"))
        fresh = stored(R.overview(need.join(mine, ["_row", "_col"], "left_semi").drop("_row", "_col"), width, method), "overview")
        out = fresh if out is None else out.unionByName(fresh)
    return out


def overview_stream(changes: DataFrame, base: Callable[[], DataFrame], existing: Callable[[], DataFrame], write: Callable[[DataFrame], None], width: int, top: int, bottom: int = 0, method: str = "average") -> DataStreamWriter:
    """A stream of changed tile keys: each micro-batch refreshes the overviews above them. ``write`` must replace tiles, so a batch that is repeated does no harm."""

    def batch(df: DataFrame, number: int) -> None:
        df = df.select(*KEYS).distinct()
        if not df.isEmpty():
            write(refreshed(base(), existing(), df, width, top, bottom, method))

    return changes.writeStream.foreachBatch(batch)


def windowed_counts(events: DataFrame, time: str = "ts", late: str = "1 hour", size: str = "1 day", slide: str | None = None) -> DataFrame:
    """Rows by tile and event-time window, late rows up to ``late`` behind."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return events.withWatermark(time, late).groupBy(window.alias("window"), *KEYS).agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Rows by tile and session: a pause of ``gap`` ends one."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("window"), *KEYS).agg(F.count(F.lit(1)).alias("n"))
