"""Names with a box rounded to a tenth: Spark's against C's and DuckDB's."""

import math
import random

import duckdb

from trailweave.functions import geo


def test_tenths(spark):
    """Ties of the double go to even; what only looks like one, as 0.35 does, goes where the double lies."""
    rng = random.Random(1)
    near = [k / 20 for k in range(-3600, 3601)]
    values = near + [math.nextafter(v, s * 1e9) for v in near for s in (-1, 1)] + [rng.uniform(-180, 180) for _ in range(2000)] + [-0.0, 1e-300, -0.04, 0.03125]
    got = spark.createDataFrame([(float(v),) for v in values], "v double").selectExpr("v", f"{geo.tenth('v')} as s").collect()
    assert [r.s for r in got] == [f"{v:.1f}" for v in values]


def test_names(spark):
    rows = [("7", -52.25, -22.65, 52.35, 0.45), ("8", 0.25, 0.75, -0.05, 2.5), (None, 1.0, 2.0, 3.0, 4.0)]
    box = ("lon_min", "lat_min", "lon_max", "lat_max")
    got = spark.createDataFrame(rows, "animal_id string, lon_min double, lat_min double, lon_max double, lat_max double").selectExpr(f"{geo.file_name_exact('landcover', box)} as name").collect()
    values = ", ".join(f"({'null' if a is None else repr(a)}, {', '.join(f'{v}::double' for v in b)})" for a, *b in rows)
    want = duckdb.sql(f"select {geo.file_name('landcover', box)} as name from (values {values}) t(animal_id, lon_min, lat_min, lon_max, lat_max)").fetchall()
    assert [r.name for r in got] == [w for (w,) in want]
