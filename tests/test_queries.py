"""Every registered query of the main library against its SQL, at the smallest scale."""

import os

import duckdb
import pytest

import foliolens.plans.dynamics_queries
import foliolens.plans.frame_queries
import foliolens.plans.model_queries
import foliolens.plans.panel_queries
import foliolens.plans.reference_queries
import foliolens.plans.table_queries  # noqa: F401
from foliolens.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def key(row):
    return tuple(f"{x:.6g}" if isinstance(x, float) else str(x) for x in row)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    sql = ORACLES[name]
    assert sorted(duck.sql(sql).columns) == columns
    mine = sorted(map(tuple, df.select(*columns).collect()), key=key)
    theirs = sorted(duck.sql(f"select {', '.join(columns)} from ({sql})").fetchall(), key=key)
    assert [key(r) for r in mine] == [key(r) for r in theirs]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
