"""Every movement query against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from trailweave.plans import queries as plans


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in os.listdir(sf_dir):
        connection.execute(f"create view {name.removesuffix('.parquet')} as select * from '{sf_dir}/{name}'")
    return connection


def rows_of(frame):
    def tidy(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return ""
        return f"{v:.7g}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(tidy, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


SLOW = {"bridge_time", "bridge_mixed"}


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_same_as_sql(spark, duck, sf_dir, name):
    got = plans.QUERIES[name](spark, sf_dir).toPandas()
    want = duck.execute(plans.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_gives_rows(spark, sf_dir, name):
    assert plans.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    got = entry_points.entry(spark)
    assert got.columns[:6] == ["animal_id", "seg", "t", "x", "y", "status"]
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
