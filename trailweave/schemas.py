"""Fixed schemas; animal keys are strings everywhere."""

from __future__ import annotations

from pyspark.sql import types as T

TRACK_CSV = T.StructType([
    T.StructField("event-id", T.LongType()), T.StructField("visible", T.BooleanType()), T.StructField("timestamp", T.TimestampType()),
    T.StructField("location-long", T.DoubleType()), T.StructField("location-lat", T.DoubleType()), T.StructField("sensor-type", T.StringType()),
    T.StructField("individual-taxon-canonical-name", T.StringType()), T.StructField("tag-local-identifier", T.StringType()),
    T.StructField("individual-local-identifier", T.StringType()), T.StructField("study-name", T.StringType()),
])

HOURLY_WEATHER = "latitude double, longitude double, timestamp timestamp, temperature_2m double, relative_humidity_2m int, precipitation double, wind_speed_10m double, wind_direction_10m int, snowfall double, weather_code int, cloud_cover int"
DAILY_WEATHER = "latitude double, longitude double, timestamp date, temperature_2m_mean double, relative_humidity_2m_mean double, precipitation_sum double, wind_speed_10m_max double, wind_direction_10m_dominant int, snowfall_sum double, weather_code int, cloud_cover_mean double"
WALK = "animal_id string, seg int, t int, x int, y int, status string"
KERNEL_DATA = ["t", "x", "y", "terrain", "is_brownian", "S", "D", "diffusity", "bias_x", "bias_y"]

# Landcover classes with their names.
LANDCOVER = {
    10: "Tree cover", 20: "Shrubland", 30: "Grassland", 40: "Cropland", 50: "Built-up", 60: "Bare / sparse vegetation",
    70: "Snow and ice", 80: "Permanent water bodies", 90: "Herbaceous wetland", 95: "Mangroves", 100: "Moss and lichen",
}
# Animal types.
ANIMAL_TYPES = {"AIRBORNE": 0, "AMPHIBIAN": 1, "LIGHT": 2, "MEDIUM": 3, "HEAVY": 4}
