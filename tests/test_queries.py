"""Each registered query of the engine against its SQL, at the smallest scale."""

from __future__ import annotations

import os

import duckdb
import pytest

from gridloom.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def rows(cursor, columns):
    return sorted(repr(tuple(r)) for r in cursor)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(columns).collect()]
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("name", ["user_process_arrow", "tile_directory_round_trip", "geotiff_round_trip"])
def test_all_embeddings_are_covered(spark, name):
    df = catalogue.queries()[name](spark, SF)
    assert df.select("row", "col").distinct().count() == spark.read.parquet(f"{SF}/embeddings.parquet").count()


def test_all_points_nations_and_customers_are_covered(spark):
    q = catalogue.queries()
    count = lambda name: spark.read.parquet(f"{SF}/{name}.parquet").count()
    assert q["merge_new"](spark, SF).count() == count("customer")
    assert q["user_process_vector"](spark, SF).agg({"n": "sum"}).first()[0] == count("events")
    assert q["tile_children"](spark, SF).count() == 4 * q["tile_assign_geodetic"](spark, SF).count()
