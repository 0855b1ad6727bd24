"""Queries over more embeddings than zoom 5 has tiles, against their SQL; flat pixels."""

from __future__ import annotations

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from gridloom.functions import raster as R
from gridloom.plans import catalogue


@pytest.mark.parametrize("name", ["contours", "geotiff_round_trip", "process_run"])
def test_embeddings_beyond_zoom_5(spark, tmp_path, name):
    at = tmp_path / "embeddings.parquet"
    duckdb.sql(f"COPY (SELECT * REPLACE (vec_id * 700 AS vec_id) FROM '/root/testdata/sf0.001/embeddings.parquet' WHERE vec_id < 4) TO '{at}'")
    df = catalogue.queries()[name](spark, str(tmp_path))
    columns = sorted(df.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{at}'")
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(columns).collect()))) == sorted(map(repr, want))


def test_flat_pixels_have_an_aspect(spark):
    df = spark.range(1).select(*[F.lit(3.0).alias(f"w{i}") for i in range(9)])
    aspect = lambda y: df.select(R.slope_aspect([F.col(f"w{i}") for i in range(9)], 1.0, y)[1]).first()[0]
    assert aspect(-1.0) == math.pi and aspect(1.0) == 0.0


@pytest.mark.parametrize("name", ["run_contours_clip", "run_geotiff", "run_higher_bilinear", "run_hillshade", "run_hillshade_clip", "run_png"])
def test_runs_beyond_zoom_5(spark, tmp_path, name):
    """Embeddings on both sides of zoom 5's last tile (2047), also in tiles with a clip's rectangle."""
    at = tmp_path / "embeddings.parquet"
    duckdb.sql(f"COPY (SELECT * REPLACE ([0, 579, 2047, 2048, 2049][vec_id + 1] AS vec_id) FROM '/root/testdata/sf0.001/embeddings.parquet' WHERE vec_id < 5) TO '{at}'")
    duckdb.sql(f"COPY (SELECT * FROM '/root/testdata/sf0.001/nation.parquet') TO '{tmp_path}/nation.parquet'")
    df = catalogue.queries()[name](spark, str(tmp_path))
    columns = sorted(df.columns)
    con = duckdb.connect()
    for table in ("embeddings", "nation"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    assert want and sorted(map(repr, map(tuple, df.select(columns).collect()))) == sorted(map(repr, want))
