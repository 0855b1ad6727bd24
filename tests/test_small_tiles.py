"""Many small tiles: how they are put into batches, listed, read and packed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.functions import arrays
from gridloom.functions import raster as R
from gridloom.functions.pyramid import GEODETIC, Pyramid
from gridloom.operators import process
from gridloom.operators.tiles import by_tile
from gridloom.sources import formats, sinks


@pytest.fixture
def setting(spark):
    """Sets a configuration of the session until the test ends."""
    old = {}

    def put(name, value):
        old[name] = spark.conf.get(name)
        spark.conf.set(name, value)

    yield put
    for name, value in old.items():
        spark.conf.set(name, value)


def tiles_of(spark, n):
    at = [F.lit(7).alias("zoom"), F.expr("CAST(id DIV 20 AS INT)").alias("row"), F.expr("CAST(id % 20 AS INT)").alias("col")]
    return spark.range(n).select(*at, F.lit(1).alias("band"), F.lit(2).alias("height"), F.lit(2).alias("width"), F.array(*[F.col("id") + 0.25 * (i + 1) for i in range(4)]).alias("pixels"))


@pytest.mark.parametrize("most", [1, 3, 7, 10_000])
def test_tiles_are_whole_whatever_batches_they_come_in(spark, setting, most):
    setting("spark.sql.execution.arrow.maxRecordsPerBatch", most)
    rows = spark.range(60).select(F.lit(1).alias("zoom"), F.expr("CAST(id % 4 AS INT)").alias("row"), F.expr("CAST(id % 3 AS INT)").alias("col"), "id")
    schema = "zoom int, row int, col int, ids array<bigint>"
    call = lambda key, found: pa.table({"zoom": pa.array([key[0]], pa.int32()), "row": pa.array([key[1]], pa.int32()), "col": pa.array([key[2]], pa.int32()), "ids": pa.array([sorted(found["id"].to_pylist())], pa.list_(pa.int64()))})
    got = {(r["zoom"], r["row"], r["col"]): r["ids"] for r in by_tile(rows, call, schema).collect()}
    assert got == {(1, r, c): [i for i in range(60) if i % 4 == r and i % 3 == c] for r in range(4) for c in range(3)}


def test_tasks_of_a_read_do_not_grow_with_the_files(spark, setting, tmp_path):
    """300 files of a few bytes; Spark takes each for 4 MB, and gave a task four."""
    setting("spark.sql.files.maxPartitionBytes", "16m")
    pyramid, path = Pyramid(GEODETIC, tile_size=2), str(tmp_path / "out")
    assert sinks.write_images(tiles_of(spark, 300), path, pyramid, nodata=-1.0).count() == 300
    (tmp_path / "out/7/3/note.tif").write_bytes(b"")
    (tmp_path / "out/7/3/5.tif.77.part").write_bytes(b"")
    found = formats.FORMATS["GTiff"]
    rows = found.rows(spark, path, {}, 7)
    assert rows.rdd.getNumPartitions() <= 16
    want = {(r["row"], r["col"]): r["pixels"] for r in tiles_of(spark, 300).collect()}
    assert {(r["row"], r["col"]): r["pixels"] for r in rows.collect()} == want and rows.count() == 300
    assert {(r["zoom"], r["row"], r["col"]) for r in found.existing(spark, path).collect()} == {(7, *k) for k in want}
    assert found.rows(spark, path, {}, 6).count() == 0


def test_run_spreads_its_tiles_over_tasks(spark):
    """Few bytes, but a call of the function each: they stayed in one task."""
    tiles = tiles_of(spark, 300)
    done = process.run(tiles.select("zoom", "row", "col"), {"dem": tiles.where("col > 0")}, lambda dem: "empty" if dem.is_empty() else dem.read() * 2, Pyramid(GEODETIC, tile_size=2))
    used = done.select("row", "col", "pixels", F.spark_partition_id().alias("task")).collect()
    assert len({r["task"] for r in used}) > 8
    assert {(r["row"], r["col"]): r["pixels"] for r in used} == {(r["row"], r["col"]): [2 * v for v in r["pixels"]] for r in tiles.where("col > 0").collect()}


def test_a_tiles_pixels_are_looked_up_in_one_map(spark, capsys):
    px = spark.range(64).where("id <> 9").select(F.lit(5).alias("zoom"), F.lit(1).alias("row"), F.lit(2).alias("col"), F.lit(1).alias("band"), F.expr("CAST(id DIV 8 AS INT)").alias("py"), F.expr("CAST(id % 8 AS INT)").alias("px"), F.col("id").cast("double").alias("value"))
    df = R.to_packed(px.unionAll(px.limit(3)), 8, 8)
    df.explain("extended")
    assert "lambdafunction(element_at(map_from_entries(" not in capsys.readouterr().out
    assert df.first()["pixels"] == [None if i == 9 else float(i) for i in range(64)]


def test_blocks_of_a_part_of_a_column():
    column = pa.array([[1.0, None], [2.0], [], [3.0, 4.0, 5.0]])
    for some, want in ((column[1:], [[2.0], [], [3.0, 4.0, 5.0]]), (column[:1], [[1.0, np.nan]]), (column[4:], [])):
        assert all(np.array_equal(a, b, equal_nan=True) for a, b in zip(arrays.blocks(some), want, strict=True))
