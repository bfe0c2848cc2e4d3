"""Files and connectors."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.schemas import DAILY_WEATHER, HOURLY_WEATHER, TRACK_CSV


def _files(spark: SparkSession, folder: str, suffix: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(path):
        raise FileNotFoundError(folder)
    return sorted(s.getPath().toString() for s in fs.listStatus(path) if s.getPath().getName().endswith(suffix))


def track_csv(spark: SparkSession, path: str, schema=TRACK_CSV) -> DataFrame:
    """A tracking table with header: ``event_id, animal_id, ts, lon, lat`` and the file's other columns."""
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    names = {"event-id": "event_id", "tag-local-identifier": "animal_id", "timestamp": "ts", "location-long": "lon", "location-lat": "lat"}
    return raw.select(*(F.col(f"`{c}`").alias(names.get(c, c.replace("-", "_"))) for c in raw.columns))


def study(spark: SparkSession, folder: str) -> DataFrame:
    """The one CSV of a study's folder; FileNotFoundError unless there is exactly one."""
    found = _files(spark, folder, ".csv")
    if len(found) != 1:
        raise FileNotFoundError(f"{folder} has {len(found)} CSV files, not one")
    return track_csv(spark, found[0])


def terrain_text(spark: SparkSession, path: str, delimiter: str = " ") -> DataFrame:
    """``(x, y, cls)`` of a text grid, rows from north to south; a trailing delimiter is ignored.

    The file is one grid: it is read whole.  ValueError for an empty or ragged grid.
    """
    if len(delimiter) != 1:
        raise ValueError("the delimiter is one character")
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.filter(F.split("value", r"\r?\n"), lambda s: F.trim(s) != "")).alias("y", "line"))
    cells = lines.select("y", F.posexplode(F.filter(F.split(F.trim("line"), "\\" + delimiter), lambda s: F.trim(s) != "")).alias("x", "v"))
    out = cells.select(F.col("x").cast("int"), F.col("y").cast("int"), F.trim("v").cast("int").alias("cls"))
    widths = out.groupBy("y").agg(F.count("*").alias("n")).agg(F.min("n"), F.max("n")).first()
    if widths[0] is None or widths[0] != widths[1]:
        raise ValueError(f"{path} is empty or its rows differ in length")
    return out


def constant_terrain(spark: SparkSession, cls: int, width: int, height: int) -> DataFrame:
    return spark.range(width * height).select(
        (F.col("id") % width).cast("int").alias("x"), F.floor(F.col("id") / width).cast("int").alias("y"), F.lit(cls).alias("cls")
    )


def weather_grid(spark: SparkSession, folder: str, daily: bool = False) -> DataFrame:
    """``weather_grid_y*_x*.csv`` files as one table with ``gy`` (northward) and ``gx``."""
    raw = spark.read.schema(DAILY_WEATHER if daily else HOURLY_WEATHER).option("header", True).option("enforceSchema", False).csv(f"{folder}/weather_grid_y*_x*.csv")
    name = F.col("_metadata.file_name")
    return raw.select(
        F.regexp_extract(name, r"_y(\d+)_x(\d+)", 1).cast("int").alias("gy"), F.regexp_extract(name, r"_y(\d+)_x(\d+)", 2).cast("int").alias("gx"), "*"
    )


def covariate_csv(spark: SparkSession, path: str, lat: str = "latitude", lon: str = "longitude", ts: str = "timestamp") -> DataFrame:
    """Any weather or ocean CSV; its place and time columns become ``lat, lon, ts``."""
    raw = spark.read.option("header", True).option("inferSchema", True).csv(path)
    missing = [c for c in (lat, lon, ts) if c not in raw.columns]
    if missing:
        raise ValueError(f"{path} has no column {missing}")
    return raw.withColumnsRenamed({lat: "lat", lon: "lon"}).withColumn(ts, F.to_timestamp(ts)).withColumnRenamed(ts, "ts")


def series_json(rows: DataFrame, column: str, time_field: str = "time", variables: Iterable[str] = ("temperature_2m",)) -> DataFrame:
    """Weather answers ``{"hourly": {"time": [...], "v": [...]}}``, one row a time; short series are padded with null, long ones cut."""
    variables = list(variables)
    kinds = ", ".join([f"{time_field}: array<string>", *(f"{v}: array<double>" for v in variables)])
    got = rows.withColumn("__h", F.from_json(column, f"hourly struct<{kinds}>")["hourly"])
    at = got.select(*(c for c in rows.columns if c != column), "__h", F.posexplode(F.col("__h")[time_field]).alias("__i", "__t"))
    return at.select(
        *(c for c in rows.columns if c != column), F.to_timestamp("__t").alias("ts"), *(F.get(F.col("__h")[v], F.col("__i")).alias(v) for v in variables)
    )


def walk_json(spark: SparkSession, path: str) -> DataFrame:
    """``(t, x, y)`` of a walk document."""
    kind = "Terrain array<array<int>>, Walk array<struct<x:int,y:int>>, Steps array<struct<x:int,y:int>>"
    return spark.read.schema(kind).json(path, multiLine=True).select(F.posexplode("Walk").alias("t", "p")).select("t", "p.x", "p.y")


def kernels(spark: SparkSession, path: str, **where: int) -> DataFrame:
    """Kernels written by ``sinks.writers.kernels``; ``t, y, x`` given here are pushed to the scan."""
    out = spark.read.parquet(path)
    for column, value in where.items():
        out = out.where(F.col(column) == value)
    return out


def with_retry(fetch: Callable[[], dict], attempts: int = 3, wait: Callable[[float], None] = time.sleep) -> dict | None:
    """``fetch()``, again after 1, 2, ... seconds while it raises ConnectionError; None when it never succeeds."""
    for k in range(attempts):
        try:
            return fetch()
        except ConnectionError:
            if k + 1 < attempts:
                wait(2.0**k)
    return None


def remote_credentials(user_variable: str = "TRACK_USER", password_variable: str = "TRACK_PASSWORD") -> tuple[str, str]:
    """Credentials from the environment only."""
    user, password = os.environ.get(user_variable), os.environ.get(password_variable)
    if not user or not password:
        raise PermissionError(f"set {user_variable} and {password_variable}")
    return user, password


def raster_text(spark: SparkSession, path: str, transform: tuple[float, float, float, float], delimiter: str = " ") -> DataFrame:
    """``(x, y, cls, lon, lat)`` of a text grid with its place: ``transform`` is west, north, and the cell's width and height."""
    west, north, dx, dy = transform
    return terrain_text(spark, path, delimiter).withColumns({"lon": west + (F.col("x") + 0.5) * dx, "lat": north - (F.col("y") + 0.5) * dy})


def raster_parquet(spark: SparkSession, path: str, band: str = "band_1") -> DataFrame:
    """``(x, y, cls)`` of a raster kept as rows ``col, row`` and a column a band."""
    return spark.read.parquet(path).select(F.col("col").cast("int").alias("x"), F.col("row").cast("int").alias("y"), F.col(band).cast("int").alias("cls"))


def layers(spark: SparkSession, path: str, t: int | None = None) -> DataFrame:
    """Forward probabilities written by ``sinks.writers.layers``; one point in time reads one folder."""
    out = spark.read.parquet(path)
    return out if t is None else out.where(F.col("t") == t)


def matrix(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
