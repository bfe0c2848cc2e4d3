"""Fixes, terrain, weather and mapping derived from the driver tables, with the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.functions.kernels import KernelParams, mapping_frame
from trailweave.schemas import LANDCOVER

# Both dialects read these.
_LON = "case when event_type = 'error' then null else -524e-1 + ((event_id * 7919 + user_id * 104729) % 20000) / 100000e0 end"
_LAT = "case when event_type = 'error' then null else -226e-1 + ((event_id * 15485863 + user_id * 32452843) % 30000) / 100000e0 end"
FIXES = f"select event_id, cast(user_id as varchar(20)) as animal_id, ts, {_LON} as lon, {_LAT} as lat from events"
WIDTH, HEIGHT = 64, 48
FORBIDDEN = 80

TERRAIN_SQL = (
    "select x::int as x, y::int as y, [10,20,30,40,50,60,70,80,90,95,100][((x*31 + y*17 + (x*y)%7) % 11) + 1] as cls"
    " from range(64) a(x), range(48) b(y)"
)
WEATHER_SQL = (
    "select gx::int as gx, gy::int as gy, timestamp '2024-01-01' + to_hours(h::int) as ts, ((h*37+gy*11+gx*7)%400)/10e0 as temperature,"
    " ((h*13+gx*3+gy)%101)::int as humidity, ((h*29+gx*17)%360)::int as wind_direction, ((h*7+gy*5)%200)/10e0 as wind_speed,"
    " ((h*19+gx+gy)%101)::int as cloud_cover, case when (h+gx*gy)%6=0 then 5e-1 else 0e0 end as precipitation"
    " from range(5) a(gx), range(5) b(gy), range(720) c(h)"
)


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fix for each event; coordinates of error events are null."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(
        "event_id", F.col("user_id").cast("string").alias("animal_id"), "ts", F.expr(_LON).alias("lon"), F.expr(_LAT).alias("lat")
    )


def terrain(spark: SparkSession) -> DataFrame:
    """64 by 48 cells of eleven classes."""
    cell = spark.range(WIDTH * HEIGHT).select((F.col("id") % WIDTH).cast("int").alias("x"), F.floor(F.col("id") / WIDTH).cast("int").alias("y"))
    number = (F.col("x") * 31 + F.col("y") * 17 + (F.col("x") * F.col("y")) % 7) % 11
    return cell.withColumn("cls", F.element_at(F.array(*map(F.lit, LANDCOVER)), number + 1))


def weather(spark: SparkSession) -> DataFrame:
    """5 by 5 points, 720 hours from 2024-01-01."""
    row = spark.range(5 * 5 * 720).selectExpr("cast(id % 5 as int) as gx", "cast(floor(id / 5) % 5 as int) as gy", "cast(floor(id / 25) as int) as h")
    return row.selectExpr(
        "gx", "gy", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, h) as ts", "((h*37+gy*11+gx*7)%400)/10e0 as temperature",
        "(h*13+gx*3+gy)%101 as humidity", "(h*29+gx*17)%360 as wind_direction", "((h*7+gy*5)%200)/10e0 as wind_speed",
        "(h*19+gx+gy)%101 as cloud_cover", "case when (h+gx*gy)%6=0 then 5e-1 else 0e0 end as precipitation",
    )


def mapping() -> dict[int, KernelParams]:
    """Water forbidden, grassland correlated, trees Brownian with step 5, others with step 3."""
    out = {c: KernelParams(S=3, forbidden=c == FORBIDDEN) for c in LANDCOVER}
    return out | {30: KernelParams(False, 5, 6), 10: KernelParams(S=5)}


def mapping_table(spark: SparkSession) -> DataFrame:
    return mapping_frame(spark, mapping())


MAPPING_SQL = (
    "select c::int as cls, c = 80 as forbidden, c != 30 as is_brownian, (case when c in (10, 30) then 5 else 3 end)::int as S,"
    " (case when c = 30 then 6 else 1 end)::int as D, 1.0::float as diffusity, 0::int as bias_x, 0::int as bias_y"
    " from unnest([10,20,30,40,50,60,70,80,90,95,100]) t(c)"
)
