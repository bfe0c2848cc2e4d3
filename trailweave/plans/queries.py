"""Movement queries by name, over fixes derived from the events table, with SQL of the same results."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.functions import geo
from trailweave.functions.kernels import (
    correlated, correlated_from, default_mapping, forbid, gaussian, gaussian_frame, kernel_frame, mapping_frame, normalised, sector_masks, with_class,
)
from trailweave.operators import behaviour, landscape, track, walks
from trailweave.operators.bridge import biased_field, bridge, brownian_field, correlated_field, terrain_array, terrain_field
from trailweave.sinks import writers
from trailweave.sources import fixtures as fx
from trailweave.sources import readers

RESOLUTION, SAMPLE, EVERY_MINUTES = 24, 7, 360

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _r(columns: dict[str, str], digits: int) -> str:
    return ", ".join(f"round({v}, {digits}) as {k}" for k, v in columns.items())


# common table expressions of the SQL, in the order in which they build on each other
_V = f"with fixes as ({fx.FIXES}), v as (select * from fixes where ts is not null and lon is not null and lat is not null)"
_B = _V + ", b as (select animal_id, min(lon) as lon_min, max(lon) as lon_max, min(lat) as lat_min, max(lat) as lat_max from v group by animal_id)"
_PA, _PB = geo.padded("lon_min", "lon_max", 0.2, 180.0)
_PC, _PD = geo.padded("lat_min", "lat_max", 0.2, 90.0)
_P = _B + f", p as (select animal_id, {_PA} as lon_min, {_PB} as lon_max, {_PC} as lat_min, {_PD} as lat_max from b)"
_W, _H = geo.resolution("lon_min", "lon_max", "lat_min", "lat_max", RESOLUTION, "round_even")
_E = geo.utm_epsg("((lon_min + lon_max) / 2e0)", "((lat_min + lat_max) / 2e0)")
_AX, _AY = geo.to_utm("lon_min", "lat_min", "epsg")
_BX, _BY = geo.to_utm("lon_max", "lat_max", "epsg")
_D = _P + (
    f", q as (select *, {_E} as epsg from p),"
    f" d as (select *, {_AX} as x_min, {_AY} as y_min, {_BX} as x_max, {_BY} as y_max, {_W} as width, {_H} as height from q)"
)
_FE, _FN = geo.to_utm("lon", "lat", "epsg")
_C = _D + (
    f", e as (select v.*, epsg, x_min, y_min, x_max, y_max, width, height, {_FE} as east, {_FN} as north from v join d using (animal_id)),"
    f" c as (select *, {geo.grid_index('east', 'x_min', 'x_max', 'width')} as x, {geo.grid_index('north', 'y_min', 'y_max', 'height', True)} as y from e)"
)
_TRACK = "over (partition by animal_id order by ts, event_id)"
_S = _C + (
    f", l as (select animal_id, (row_number() {_TRACK} - 1)::int as seg, x as x0, y as y0, lead(x) {_TRACK} as x1, lead(y) {_TRACK} as y1,"
    f" ts as ts0, lead(ts) {_TRACK} as ts1, count(*) over (partition by animal_id) as n from c),"
    " s as (select animal_id, seg, x0, y0, x1, y1, ts0, ts1,"
    f" (case when x0 = x1 and y0 = y1 then 1 else {geo.budget('x0', 'y0', 'x1', 'y1')} end)::int as T from l where n >= 2 and x1 is not null)"
)
_T = f"terrain as ({fx.TERRAIN_SQL})"
_M = f"mapping as ({fx.MAPPING_SQL})"
_WX = f"weather as ({fx.WEATHER_SQL})"


def _dims(spark, sf_dir):
    return track.dimensions(fx.fixes(spark, sf_dir), RESOLUTION)


def _cells(spark, sf_dir):
    return track.to_cells(fx.fixes(spark, sf_dir), _dims(spark, sf_dir))


def _segments(spark, sf_dir):
    return track.segments(_cells(spark, sf_dir))


@query(fx.FIXES)
def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.fixes(spark, sf_dir)


@query(_V + " select distinct animal_id from fixes")
def animals_distinct(spark, sf_dir):
    return track.animals(fx.fixes(spark, sf_dir))


@query(_V + " select * from v where lon between -5235e-2 and -5225e-2 and lat between -225e-1 and -224e-1")
def bbox_filter(spark, sf_dir):
    return track.within(fx.fixes(spark, sf_dir), -52.35, -52.25, -22.5, -22.4)


@query(_B + " select * from b")
def bbox_raw(spark, sf_dir):
    return track.boxes(fx.fixes(spark, sf_dir))


_BOX = {k: k for k in ("lon_min", "lon_max", "lat_min", "lat_max")}


@query(_P + f" select animal_id, {_r(_BOX, 9)} from p")
def bbox_padded(spark, sf_dir):
    return track.padded_boxes(fx.fixes(spark, sf_dir)).select("animal_id", *(F.round(c, 9).alias(c) for c in _BOX))


@query(
    _V + " select animal_id, strftime(min(ts), '%Y-%m-%d') as start_date, strftime(max(ts), '%Y-%m-%d') as end_date,"
    " date_diff('day', min(ts)::date, max(ts)::date)::int as days, date_diff('day', min(ts)::date, max(ts)::date) < 20 as hourly from fixes group by animal_id"
)
def track_dates(spark, sf_dir):
    return track.dates(fx.fixes(spark, sf_dir))


_DAY = " select event_id, animal_id, ts, lon, lat from (select event_id, animal_id, date_trunc('day', ts)::timestamp + interval 12 hours as ts, lon, lat, row_number() over (partition by {key} order by ts, event_id) as n from v) where n = 1"


@query(_V + _DAY.format(key="animal_id, date_trunc('day', ts)"))
def one_fix_per_day(spark, sf_dir):
    return track.one_a_day(fx.fixes(spark, sf_dir))


@query(_V + _DAY.format(key="date_trunc('day', ts)"))
def one_fix_per_day_global(spark, sf_dir):
    """One fix a day over all animals: a window for each day."""
    return track.one_a_day(fx.fixes(spark, sf_dir), ())


@query(_D + " select animal_id, width, height, epsg from d")
def grid_resolution(spark, sf_dir):
    return _dims(spark, sf_dir).select("animal_id", "width", "height", "epsg")


@query(
    _V + f", o as (select event_id, animal_id, (row_number() {_TRACK} - 1)::int as t, count(*) over (partition by animal_id) as n from v)"
    f" select event_id, animal_id, t from o where t % greatest(1, n // {SAMPLE}) = 0 and t // greatest(1, n // {SAMPLE}) < {SAMPLE}"
)
def systematic_sample(spark, sf_dir):
    return track.sample(fx.fixes(spark, sf_dir), SAMPLE).select("event_id", "animal_id", "t")


@query(_V + f" select event_id, animal_id, (row_number() {_TRACK} - 1)::int as t from v")
def time_index(spark, sf_dir):
    return track.ordered(track.valid(fx.fixes(spark, sf_dir))).select("event_id", "animal_id", "t")


@query(_V + f" select event_id, {geo.utm_epsg('lon', 'lat')} as epsg from v")
def utm_epsg(spark, sf_dir):
    return track.valid(fx.fixes(spark, sf_dir)).selectExpr("event_id", f"{geo.utm_epsg('lon', 'lat')} as epsg")


_FE0, _FN0 = geo.to_utm("lon", "lat", "32722")


@query(_V + f" select event_id, round({_FE0}, 3) as east, round({_FN0}, 3) as north from v")
def utm_forward(spark, sf_dir):
    return track.valid(fx.fixes(spark, sf_dir)).selectExpr("event_id", f"round({_FE0}, 3) as east", f"round({_FN0}, 3) as north")


_IX, _IY = geo.from_utm("east", "north", "32722")


@query(_V + f", u as (select event_id, {_FE0} as east, {_FN0} as north from v) select event_id, round({_IX}, 7) as lon, round({_IY}, 7) as lat from u")
def utm_inverse(spark, sf_dir):
    there = track.valid(fx.fixes(spark, sf_dir)).selectExpr("event_id", f"{_FE0} as east", f"{_FN0} as north")
    return there.selectExpr("event_id", f"round({_IX}, 7) as lon", f"round({_IY}, 7) as lat")


_UTM = {k: k for k in ("x_min", "y_min", "x_max", "y_max")}


@query(_D + f" select animal_id, {_r(_UTM, 3)} from d")
def bbox_utm(spark, sf_dir):
    return _dims(spark, sf_dir).select("animal_id", *(F.round(c, 3).alias(c) for c in _UTM))


@query(_C + " select event_id, animal_id, x, y from c")
def grid_cells(spark, sf_dir):
    return _cells(spark, sf_dir).select("event_id", "animal_id", "x", "y")


_GX, _GY = geo.grid_index_plain("lon", "lon_min", "lon_max", "width"), geo.grid_index_plain("lat", "lat_min", "lat_max", "height", True)


@query(_D + f" select event_id, {_GX} as x, {_GY} as y from v join d using (animal_id)")
def grid_degree(spark, sf_dir):
    joined = track.valid(fx.fixes(spark, sf_dir)).join(_dims(spark, sf_dir), "animal_id")
    return joined.selectExpr("event_id", f"{_GX} as x", f"{_GY} as y")


_CX, _CY = geo.grid_coordinate("x", "x_min", "x_max", "width"), geo.grid_coordinate("y", "y_min", "y_max", "height", True)


@query(_C + f", g as (select event_id, epsg, {_CX} as east, {_CY} as north from c) select event_id, round({geo.from_utm('east', 'north', 'epsg')[0]}, 7) as lon, round({geo.from_utm('east', 'north', 'epsg')[1]}, 7) as lat from g")
def grid_to_geodetic(spark, sf_dir):
    cells = _cells(spark, sf_dir).select("event_id", "animal_id", "x", "y")
    return track.to_degrees(cells, _dims(spark, sf_dir)).select("event_id", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"))


@query(
    _P + " select animal_id, gy::int as gy, gx::int as gx, round(lon_min + (gx + 5e-1) * (lon_max - lon_min) / 5, 9) as lon,"
    " round(lat_min + (gy + 5e-1) * (lat_max - lat_min) / 5, 9) as lat from p, range(5) a(gx), range(5) c(gy)"
)
def weather_points(spark, sf_dir):
    got = landscape.weather_points(track.padded_boxes(fx.fixes(spark, sf_dir)))
    return got.select("animal_id", "gy", "gx", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"))


@query(
    f"with {_T}, g as (select i::int as i, j::int as j, (5 + floor(i * 49 / 29e0))::int as x, (3 + floor(j * 39 / 19e0))::int as y from range(30) a(i), range(20) b(j))"
    " select i as x, j as y, cls from g join terrain using (x, y)"
)
def raster_resample(spark, sf_dir):
    return landscape.resample(fx.terrain(spark), (43, 3, 5, 55), 30, 20)


@query(_S + " select animal_id, seg, x0, y0, x1, y1, T from s")
def segments(spark, sf_dir):
    return _segments(spark, sf_dir).drop("ts0", "ts1")


@query(_C + f", {_T} select event_id, c.x, c.y, cls as terrain from c left join terrain t on c.x = t.x and c.y = t.y")
def terrain_lookup(spark, sf_dir):
    return landscape.terrain_at(_cells(spark, sf_dir).select("event_id", "x", "y"), fx.terrain(spark)).select("event_id", "x", "y", "terrain")


@query(_C + f", {_T}, {_M} select event_id, cls as terrain, forbidden, is_brownian, S, D, diffusity, bias_x, bias_y from c join terrain t on c.x = t.x and c.y = t.y join mapping m using (cls)")
def mapping_lookup(spark, sf_dir):
    cells = landscape.terrain_at(_cells(spark, sf_dir).select("event_id", "x", "y"), fx.terrain(spark))
    return landscape.params_of(cells, fx.mapping_table(spark)).select("event_id", "terrain", "forbidden", "is_brownian", "S", "D", "diffusity", "bias_x", "bias_y")


@query(_C + f", {_T}, {_M} select event_id, c.x, c.y from c join terrain t on c.x = t.x and c.y = t.y join mapping m using (cls) where forbidden")
def forbidden_cells(spark, sf_dir):
    cells = landscape.terrain_at(_cells(spark, sf_dir).select("event_id", "x", "y"), fx.terrain(spark))
    return landscape.forbidden(cells, fx.mapping_table(spark)).select("event_id", "x", "y")


@query(_V + f", {_WX} select event_id, gx, gy, temperature, humidity from v join weather w on w.ts = date_trunc('hour', v.ts) and gx = event_id % 5 and gy = event_id // 5 % 5")
def weather_hour_join(spark, sf_dir):
    at = track.valid(fx.fixes(spark, sf_dir)).selectExpr("event_id", "ts", "cast(event_id % 5 as int) as gx", "cast(floor(event_id / 5) % 5 as int) as gy")
    return landscape.weather_hour(at, fx.weather(spark)).select("event_id", "gx", "gy", "temperature", "humidity")


_CELL = "least(4, floor(x * 5 / width::double))::int as gx, (4 - least(4, floor(y * 5 / height::double)))::int as gy"


@query(
    _C + f", {_WX}, h as (select event_id, {_CELL}, date_trunc('hour', ts) as hour from c)"
    " select event_id, h.gx, h.gy, wind_speed, cloud_cover from h left join weather w on w.gx = h.gx and w.gy = h.gy and w.ts = h.hour"
)
def weather_cell_join(spark, sf_dir):
    got = landscape.weather_cell(_cells(spark, sf_dir).select("event_id", "x", "y", "width", "height", "ts"), fx.weather(spark))
    return got.select("event_id", "gx", "gy", "wind_speed", "cloud_cover")


@query(
    _C + f", {_WX}, {_T}, h as (select *, {_CELL}, date_trunc('hour', ts) as hour from c),"
    " k as (select h.*, wind_speed, wind_direction, cloud_cover, precipitation from h join weather w on w.gx = h.gx and w.gy = h.gy and w.ts = h.hour),"
    f" o as (select *, (row_number() {_TRACK} - 1)::int as t from k)"
    " select animal_id, t, o.x, o.y, cls as terrain, true as is_brownian, wind_speed / 2 as S, (wind_direction // 45)::int as D, cloud_cover / 100e0 as diffusity,"
    " (precipitation > 1e-1)::int as bias_x, (cls in (50, 80))::int as bias_y from o left join terrain t on o.x = t.x and o.y = t.y"
)
def covariate_kernel_params(spark, sf_dir):
    rows = landscape.weather_cell(_cells(spark, sf_dir), fx.weather(spark))
    return landscape.kernel_data(rows, fx.terrain(spark), landscape.worked_resolver())


_STEP = (
    f", g as (select animal_id, ts, event_id, x - lag(x) {_TRACK} as dx, y - lag(y) {_TRACK} as dy,"
    f" epoch(date_trunc('second', ts))::bigint - epoch(date_trunc('second', lag(ts) {_TRACK}))::bigint as dt from c),"
    " h as (select *, sqrt(dx * dx + dy * dy) as step, atan2(dy, dx) as bearing from g where dx is not null),"
    f" k as (select *, bearing - lag(bearing) {_TRACK} as turned from h)"
)


def _steps(spark, sf_dir):
    return behaviour.steps(_cells(spark, sf_dir))


@query(_C + _STEP + " select event_id, dx, dy, round(step, 9) as step from k")
def step_lengths(spark, sf_dir):
    return _steps(spark, sf_dir).select("event_id", "dx", "dy", F.round("step", 9).alias("step"))


@query(_C + _STEP + " select event_id, round(bearing, 9) as bearing, round(cos(turned), 9) + 0e0 as turn_cos, round(abs(atan2(sin(turned), cos(turned))), 9) as turn from k")
def turning_angles(spark, sf_dir):
    return _steps(spark, sf_dir).select("event_id", F.round("bearing", 9).alias("bearing"), (F.round(F.cos("turn"), 9) + 0.0).alias("turn_cos"), F.round(F.abs("turn"), 9).alias("turn"))


@query(_C + _STEP + " select event_id, dt from k")
def intervals(spark, sf_dir):
    return _steps(spark, sf_dir).select("event_id", "dt")


_KAPPA = (
    "case when r < 53e-2 then 2 * r + r**3 + 5 * r**5 / 6 when r < 85e-2 then -4e-1 + 139e-2 * r + 43e-2 / nullif(1 - r, 0)"
    " else 1 / nullif(r**3 - 4 * r**2 + 3 * r, 0) end"
)
_SUMMARY = {k: k for k in ("r", "kappa", "speed", "min_speed", "max_speed", "diffusivity", "mean_dt", "std_dt")}


@query(
    _C + _STEP + ", z as (select *, step / nullif(dt, 0) as v, atan2(sin(turned), cos(turned)) as turn from k),"
    " m as (select animal_id, count(*) as n_steps, sqrt(pow(avg(cos(turn)), 2) + pow(avg(sin(turn)), 2)) as r, median(case when v > 0 then v end) as speed,"
    " min(v) as min_speed, max(v) as max_speed, avg(step * step) / nullif(4 * median(dt), 0) as diffusivity, avg(dt) as mean_dt, stddev_pop(dt) as std_dt,"
    " count(case when v > 5 then 1 end) as n_fast, count(case when v < 1e-1 then 1 end) as n_slow from z group by animal_id),"
    f" w as (select *, {_KAPPA} as kappa from m)"
    f" select animal_id, n_steps, n_fast, n_slow, {_r(_SUMMARY, 7)},"
    " case when speed between 67e-2 and 134e-2 then 'REALISTIC' when speed is not null then 'TOO HIGH' end as status from w"
)
def behaviour_summary(spark, sf_dir):
    got = behaviour.summary(_steps(spark, sf_dir))
    return got.select("animal_id", "n_steps", "n_fast", "n_slow", *(F.round(c, 7).alias(c) for c in _SUMMARY), "status")


@query(
    _V + ", f as (select animal_id, date_trunc('hour', ts) as ts, min(event_id) as event_id from v group by all),"
    " i as (select f.animal_id, f.ts, min(v.lon) as lon, min(v.lat) as lat from f join v using (event_id) group by all),"
    f" g as (select animal_id, unnest(generate_series(min(ts), max(ts), interval {EVERY_MINUTES} minutes)) as ts from i group by animal_id),"
    " n as (select g.*, lon, lat, row_number() over (partition by animal_id order by g.ts) as k from g left join i using (animal_id, ts)),"
    " a as (select *, last_value(case when lon is not null then k end ignore nulls) over b as k0, last_value(lon ignore nulls) over b as lon0, last_value(lat ignore nulls) over b as lat0,"
    " first_value(case when lon is not null then k end ignore nulls) over f as k1, first_value(lon ignore nulls) over f as lon1, first_value(lat ignore nulls) over f as lat1"
    " from n window b as (partition by animal_id order by ts rows between unbounded preceding and current row), f as (partition by animal_id order by ts rows between current row and unbounded following))"
    " select animal_id, ts, round(case when k1 is null or k1 = k0 then lon0 else lon0 + (lon1 - lon0) * (k - k0) / (k1 - k0) end, 9) as lon,"
    " round(case when k1 is null or k1 = k0 then lat0 else lat0 + (lat1 - lat0) * (k - k0) / (k1 - k0) end, 9) as lat from a where k0 is not null"
)
def interpolate_regular(spark, sf_dir):
    """Tracks brought to the hour, then every six hours from their first on."""
    w = track.valid(fx.fixes(spark, sf_dir)).withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    hourly = w.groupBy("animal_id", "ts").agg(F.min_by("lon", "event_id").alias("lon"), F.min_by("lat", "event_id").alias("lat"))
    return track.regular(hourly, ["lon", "lat"], EVERY_MINUTES).select("animal_id", "ts", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"))


@query(
    "with g as (select y::int as dy, x::int as dx, exp(-(x * x + y * y) / 245e-1) as g from range(-7, 8) a(x), range(-7, 8) b(y))"
    " select dy, dx, round(g / (select sum(g) from g), 9) as w from g"
)
def gaussian_kernel(spark, sf_dir):
    return gaussian_frame(spark, 7).select("dy", "dx", F.round("w", 9).alias("w"))


@query(
    "with k as (select d::int as d, i::int as i, (d * 7 + i * 3) % 11 + 1 as v from range(4) a(d), range(49) b(i))"
    " select d, i, round(v / sum(v) over (partition by d), 9) as w from k"
)
def kernel_normalised(spark, sf_dir):
    raw = spark.range(4 * 49).selectExpr("cast(id % 4 as int) as d", "cast(floor(id / 4) as int) as i").withColumn("w", (F.expr("(d * 7 + i * 3) % 11") + 1).cast("double"))
    return normalised(raw, ["d"]).select("d", "i", F.round("w", 9).alias("w"))


@query()
def sector_mask(spark, sf_dir):
    return kernel_frame(spark, sector_masks(8, 3))


@query()
def correlated_kernels(spark, sf_dir):
    return kernel_frame(spark, correlated(8, 3))


@query(fx.MAPPING_SQL)
def mapping_table(spark, sf_dir):
    return mapping_frame(spark, fx.mapping())


_BINOMIAL = [(dy, dx, (2 - abs(dy)) * (2 - abs(dx))) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


def integer_layers(cells: DataFrame, moves: int, allowed: DataFrame) -> DataFrame:
    """Exact weights after ``moves`` moves of the 1-2-1 kernel over the ``allowed`` cells; nothing is renormalised."""
    spark = cells.sparkSession
    kernel = F.broadcast(spark.createDataFrame(_BINOMIAL, "dy int, dx int, k long"))  # nine rows
    for _ in range(moves):
        moved = cells.join(kernel).select((F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), (F.col("p") * F.col("k")).alias("p"))
        cells = moved.join(allowed, ["x", "y"], "left_semi").groupBy("x", "y").agg(F.sum("p").alias("p"))
    return cells


_RECURSIVE = (
    "with recursive {terrain}k(dy, dx, k) as (select y, x, (2 - abs(y)) * (2 - abs(x)) from range(-1, 2) a(y), range(-1, 2) b(x)),"
    " a(t, x, y, p) as (select 0, {x}::bigint, {y}::bigint, 1::hugeint union all"
    " select t + 1, x + dx, y + dy, sum(p * k)::hugeint from a, k where t < {n} and {where} group by t + 1, x + dx, y + dy)"
    " select x::int as x, y::int as y, p::bigint as p from a where t = {n}"
)


@query(_RECURSIVE.format(terrain="", x=5, y=5, n=6, where="x + dx between 0 and 10 and y + dy between 0 and 10"))
def dp_integer(spark, sf_dir):
    grid = spark.range(121).selectExpr("cast(id % 11 as int) as x", "cast(floor(id / 11) as int) as y")
    return integer_layers(spark.createDataFrame([(5, 5, 1)], "x int, y int, p long"), 6, grid)


@query(_RECURSIVE.format(
    terrain=_T + ", ", x=10, y=10, n=5, where="exists (select 1 from terrain c where c.x = a.x + dx and c.y = a.y + dy and cls != 80)"
))
def dp_terrain_integer(spark, sf_dir):
    free = fx.terrain(spark).where(F.col("cls") != fx.FORBIDDEN).select("x", "y")
    return integer_layers(spark.createDataFrame([(10, 10, 1)], "x int, y int, p long"), 5, free)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brownian bridges between all consecutive fixes, with their places in degrees."""
    return walks.track_walks(fx.fixes(spark, sf_dir), RESOLUTION)


@query()
def bridge_brownian(spark, sf_dir):
    return entry(spark, sf_dir)


def _gridded(spark, sf_dir):
    """All segments with the size of their animal's grid."""
    return track.segments(_cells(spark, sf_dir), keep=("width", "height"))


def _cut(terrain, width, height):
    """The terrain under an animal's grid; cells beyond it have a class outside the mapping, which is closed."""
    out = np.full((height, width), -1, terrain.dtype)
    part = terrain[:height, :width]
    out[: part.shape[0], : part.shape[1]] = part
    return out


@query()
def bridge_correlated(spark, sf_dir):
    return bridge(_gridded(spark, sf_dir), walks.ByGrid(lambda width, height: correlated_field(width, height, 4, 3)))


@query()
def bridge_biased(spark, sf_dir):
    drift = lambda row: [((-1) ** t, 0) for t in range(row["T"])]
    return bridge(_gridded(spark, sf_dir), lambda row: biased_field(int(row["width"]), int(row["height"]), drift(row), 3))


@query()
def bridge_mixed(spark, sf_dir):
    """Through the terrain, water closed; ends in water can't be reached and say so."""
    grid = terrain_array(fx.terrain(spark))
    return bridge(_gridded(spark, sf_dir), walks.ByGrid(lambda width, height: terrain_field(_cut(grid, width, height), fx.mapping())))


@query()
def bridge_time(spark, sf_dir):
    """Through terrain and hourly weather, each segment over its own time."""
    grid, weather = terrain_array(fx.terrain(spark)), walks.weather_table(fx.weather(spark))
    return bridge(_gridded(spark, sf_dir), walks.ByHour(lambda width, height: _cut(grid, width, height), fx.mapping(), weather))


@query("select * from (values ('length', 0::bigint), ('start', 0), ('end', 0), ('step', 0), ('outside', 0)) t(kind, violations)")
def bridge_invariants(spark, sf_dir):
    """Violations in all Brownian bridges: a walk has T points, its ends, steps of the kernel's size, cells of the grid."""
    segs = _segments(spark, sf_dir)
    parts = segs.join(_dims(spark, sf_dir).select("animal_id", "width", "height"), "animal_id")
    walk = bridge(parts, walks.ByGrid(lambda width, height: brownian_field(width, height, 3)))
    from pyspark.sql import Window

    w = Window.partitionBy("animal_id", "seg").orderBy("t")
    far = F.greatest(F.abs(F.col("x") - F.lag("x").over(w)), F.abs(F.col("y") - F.lag("y").over(w)))
    rows = walk.withColumn("far", far).join(parts.select("animal_id", "seg", F.col("T").alias("points"), "x0", "y0", "x1", "y1", "width", "height"), ["animal_id", "seg"])
    each = rows.groupBy("animal_id", "seg").agg(
        (F.count("x") != F.first("points")).cast("long").alias("length"),
        F.max(F.when(F.col("t") == 0, ((F.col("x") != F.col("x0")) | (F.col("y") != F.col("y0"))).cast("long"))).alias("start"),
        F.max(F.when(F.col("t") == F.col("points") - 1, ((F.col("x") != F.col("x1")) | (F.col("y") != F.col("y1"))).cast("long"))).alias("end"),
        F.count_if(F.col("far") > 3).alias("step"),
        F.count_if(~(F.col("x").between(0, F.col("width") - 1) & F.col("y").between(0, F.col("height") - 1))).alias("outside"),
    )
    kinds = ["length", "start", "end", "step", "outside"]
    total = each.agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in kinds))
    return total.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("violations")) for k in kinds))).alias("r")).select("r.*")


@query(
    _S + " select 'both_ends' as kind, sum(T)::bigint as points from s union all select 'drop_last', sum(greatest(T - 1, 1))::bigint from s"
    " union all select 'with_final', (sum(greatest(T - 1, 1)) + (select count(*) from (select T, row_number() over (partition by animal_id order by seg desc) as n from s) where n = 1 and T > 1))::bigint from s"
)
def multistep_lengths(spark, sf_dir):
    """Points of the stitched walks under each convention."""
    parts = _segments(spark, sf_dir).join(_dims(spark, sf_dir).select("animal_id", "width", "height"), "animal_id")
    walk = bridge(parts, walks.ByGrid(lambda width, height: brownian_field(width, height, 3)))
    count = lambda kind, rows: rows.agg(F.lit(kind).alias("kind"), F.count("x").alias("points"))
    return count("both_ends", walk).union(count("drop_last", walks.stitch(walk))).union(count("with_final", walks.stitch(walk, append_final=True)))


@query(
    _C + ", n as (select animal_id, event_id, ts, x, y from c) select animal_id,"
    " '{\"Walk\":[' || string_agg('{\"x\":' || x || ',\"y\":' || y || '}', ',' order by ts, event_id) || ']}' as json from n group by animal_id"
)
def walk_json(spark, sf_dir):
    return writers.walk_json(_cells(spark, sf_dir), ["animal_id"], order=("ts", "event_id"))


@query(
    _V + " select animal_id, '{\"type\":\"Feature\",\"properties\":{\"animal_id\":\"' || animal_id || '\"},\"geometry\":{\"type\":\"LineString\",\"coordinates\":['"
    " || string_agg('[' || lon || ',' || lat || ']', ',' order by ts, event_id) || ']}}' as json from v group by animal_id"
)
def walk_geojson(spark, sf_dir):
    return writers.walk_geojson(track.valid(fx.fixes(spark, sf_dir)), ["animal_id"], order=("ts", "event_id"))


@query(
    _V + f" select animal_id, {list(writers.PALETTE)!r}[(rn - 1) % 19 + 1] as colour from"
    " (select animal_id, row_number() over (order by animal_id) as rn from (select distinct animal_id from v))"
)
def map_palette(spark, sf_dir):
    return writers.palette(track.valid(fx.fixes(spark, sf_dir)), "animal_id")


@query(
    _V + f", i as (select animal_id, lat, lon, (row_number() {_TRACK} - 1)::int as idx from v),"
    " s as (select animal_id, idx as step, lat + 4e-6 as lat, lon - 4e-6 as lon from i where idx % 3 = 0)"
    " select s.animal_id, step, min(i.idx)::int as idx from s join i on i.animal_id = s.animal_id and abs(i.lat - s.lat) <= 1e-5 and abs(i.lon - s.lon) <= 1e-5 group by s.animal_id, step"
)
def step_boxes(spark, sf_dir):
    path = track.ordered(track.valid(fx.fixes(spark, sf_dir))).select("animal_id", F.col("t").alias("idx"), "lat", "lon")
    steps = path.where("idx % 3 = 0").select("animal_id", F.col("idx").alias("step"), (F.col("lat") + 4e-6).alias("lat"), (F.col("lon") - 4e-6).alias("lon"))
    return writers.step_boxes(path, steps, ["animal_id"])


@query(_V + " select min(lon) as lon_min, max(lon) as lon_max, min(lat) as lat_min, max(lat) as lat_max from v")
def bbox_global(spark, sf_dir):
    return track.extent(fx.fixes(spark, sf_dir))


_EXTENT = "min(lon) as lon_min, max(lon) as lon_max, min(lat) as lat_min, max(lat) as lat_max"


@query(
    _V + f", o as ({_DAY.format(key="date_trunc('day', ts)")}), x as (select {_EXTENT} from o), q as (select *, {_E} as epsg from x)"
    f" select epsg, {_r(_BOX, 9)}, round({_AX}, 3) as x_min, round({_AY}, 3) as y_min, round({_BX}, 3) as x_max, round({_BY}, 3) as y_max from q"
)
def one_fix_per_day_box(spark, sf_dir):
    box = track.one_a_day_with_extent(fx.fixes(spark, sf_dir))[1]
    return box.select("epsg", *(F.round(c, 9).alias(c) for c in _BOX), *(F.round(c, 3).alias(c) for c in _UTM))


_TOP = "(select min(animal_id) from fixes)"


@query(_V + f" select event_id, ts from fixes where animal_id = {_TOP}")
def animal_filter(spark, sf_dir):
    fixes = fx.fixes(spark, sf_dir)
    first = fixes.agg(F.min("animal_id")).first()[0]
    return track.animal(fixes, first).select("event_id", "ts")


@query(_V + " select event_id, animal_id, ts, lon, lat from v where ts between timestamp '2024-01-08 06:00:00' and timestamp '2024-01-20 18:00:00' and lon between -60 and 0 and lat between -60 and 0")
def time_range_filter(spark, sf_dir):
    return track.within(track.valid(fx.fixes(spark, sf_dir)), -60, 0, -60, 0, "2024-01-08 06:00:00", "2024-01-20 18:00:00")


@query(
    _D + f", u as (select animal_id, {geo.from_utm('x_min', 'y_min', 'epsg')[0]} as lon_min, {geo.from_utm('x_min', 'y_min', 'epsg')[1]} as lat_min,"
    f" {geo.from_utm('x_max', 'y_max', 'epsg')[0]} as lon_max, {geo.from_utm('x_max', 'y_max', 'epsg')[1]} as lat_max from d) select animal_id, {_r(_BOX, 7)} from u"
)
def bbox_from_utm(spark, sf_dir):
    return track.degree_box(_dims(spark, sf_dir)).select("animal_id", *(F.round(c, 7).alias(c) for c in _BOX))


_LOOSE = geo.grid_index_loose("east", "north", ("x_min", "y_min", "x_max", "y_max"), "width", "height")


@query(
    _D + f", e as (select f.event_id, f.lon, f.lat, d.*, {geo.to_utm('f.lon', 'f.lat', 'epsg')[0]} as east, {geo.to_utm('f.lon', 'f.lat', 'epsg')[1]} as north from fixes f join d using (animal_id))"
    f" select event_id, {_LOOSE[0]} as x, {_LOOSE[1]} as y from e"
)
def grid_cells_loose(spark, sf_dir):
    """Fixes without a place land in the first cell."""
    dims = _dims(spark, sf_dir).drop("lon_min", "lon_max", "lat_min", "lat_max")
    east, north = geo.to_utm("lon", "lat", "epsg")
    at = fx.fixes(spark, sf_dir).join(dims, "animal_id").selectExpr("*", f"{east} as east", f"{north} as north")
    return at.selectExpr("event_id", f"{_LOOSE[0]} as x", f"{_LOOSE[1]} as y")


_RASTER, _ROI = (-52.5, -22.25, 1 / 128, 1 / 128), (-52.42, -22.55, -52.1, -22.3)


@query(
    f"with {_T}, g as (select i::int as i, j::int as j, 10 + floor(i * 41 / 24e0)::int as x, 6 + floor(j * 32 / 17e0)::int as y from range(25) a(i), range(18) b(j))"
    " select i as x, j as y, cls from g join terrain using (x, y)"
)
def raster_window(spark, sf_dir):
    """A raster's part under a box in degrees, on 25 by 18 cells."""
    return landscape.resample_box(fx.terrain(spark), _ROI, _RASTER, 25, 18)


@query(_P + f" select animal_id, {geo.file_name('landcover', ('lon_min', 'lat_min', 'lon_max', 'lat_max'))} as name from p")
def landcover_names(spark, sf_dir):
    name = geo.file_name_exact("landcover", ("lon_min", "lat_min", "lon_max", "lat_max"))
    return track.padded_boxes(fx.fixes(spark, sf_dir)).selectExpr("animal_id", f"{name} as name")


_KEY = geo.layers_key("4", "width", "height", "T", "x0", "y0", "0")


@query(_S + f" select animal_id, seg, {_KEY} as key from s join d using (animal_id)")
def layers_keys(spark, sf_dir):
    return _gridded(spark, sf_dir).selectExpr("animal_id", "seg", f"{_KEY} as key")


@query(f"with {_T}, {_M} select x, y, is_brownian, S, D, diffusity, bias_x, bias_y from terrain join mapping using (cls) where not forbidden")
def terrain_kernel_map(spark, sf_dir):
    cells, catalogue = landscape.kernel_map(fx.terrain(spark), fx.mapping_table(spark))
    return cells.join(catalogue, "kernel_id").select("x", "y", "is_brownian", "S", "D", "diffusity", "bias_x", "bias_y")


@query(f"with {_T}, {_M} select case when cls in (20, 40) then 'open' end as tensor, count(*) as cells from terrain join mapping using (cls) where not forbidden group by 1")
def terrain_kernel_map_own(spark, sf_dir):
    own = spark.createDataFrame([(20, "open"), (40, "open")], "cls int, name string")
    cells, catalogue = landscape.kernel_map(fx.terrain(spark), fx.mapping_table(spark), own)
    return cells.join(catalogue, "kernel_id").groupBy("tensor").agg(F.count("*").alias("cells"))


_BIAS = "select t::int as t, (t % 3 - 1)::int as bias_x, (t % 2)::int as bias_y from range(6) r(t)"


@query(f"with {_T}, {_M}, b as ({_BIAS}) select t, x, y, S, b.bias_x, b.bias_y from terrain join mapping m using (cls), b where not forbidden")
def biased_kernel_map(spark, sf_dir):
    cells, catalogue = landscape.kernel_map(fx.terrain(spark), fx.mapping_table(spark))
    series = spark.range(6).selectExpr("cast(id as int) as t", "cast(id % 3 - 1 as int) as bias_x", "cast(id % 2 as int) as bias_y")
    return landscape.biased_kernel_map(cells, series).join(catalogue.select("kernel_id", "S"), "kernel_id").select("t", "x", "y", "S", "bias_x", "bias_y")


@query(
    f"with {_T}, {_M}, {_WX}, c as (select *, floor(x * 5 / 64e0)::int as gx, 4 - floor(y * 5 / 48e0)::int as gy from terrain join mapping using (cls) where not forbidden),"
    " b as (select gx, gy, epoch(ts - timestamp '2024-01-01')::int // 3600 as t, (wind_speed > 10)::int as bx, (precipitation > 1e-1)::int as bz from weather)"
    " select t::int as t, x, y, bx as bias_x, bz as bias_y from c join b using (gx, gy) where t < 4"
)
def biased_grid_map(spark, sf_dir):
    """Biases from the weather of each cell's grid point over four hours."""
    cells, _ = landscape.kernel_map(fx.terrain(spark), fx.mapping_table(spark))
    cells = cells.selectExpr("*", f"cast(floor(x * 5 / {fx.WIDTH}) as int) as gx", f"4 - cast(floor(y * 5 / {fx.HEIGHT}) as int) as gy")
    hours = fx.weather(spark).where("ts < timestamp_ntz'2024-01-01 04:00:00'").selectExpr(
        "gy", "gx", "hour(ts) as t", "cast(wind_speed > 10 as int) as bias_x", "cast(precipitation > 0.1 as int) as bias_y"
    )
    return landscape.biased_kernel_map(cells, hours).select("t", "x", "y", "bias_x", "bias_y")


@query(
    "with g as (select y::int as dy, x::int as dx, exp(-(x * x + y * y) / (2 * 2e0 * 2e0)) as g from range(-2, 3) a(x), range(-2, 3) b(y))"
    " select dy, dx, round(g / (select sum(g) from g), 9) as w from g"
)
def gaussian_floored(spark, sf_dir):
    """A spread of 1 brought up to the floor of 2."""
    return kernel_frame(spark, gaussian(2, 1.0, floor=2.0)[None]).select("dy", "dx", F.round("w", 9).alias("w"))


def _mapping_sql(closed: str, straight: str, S: int) -> str:
    return (
        f"select c::int as cls, c in ({closed}) as forbidden, c not in ({straight}) as is_brownian, {S}::int as S, (case when c in ({straight}) then 8 else 1 end)::int as D,"
        " 1.0::float as diffusity, 0::int as bias_x, 0::int as bias_y from unnest([10,20,30,40,50,60,70,80,90,95,100]) t(c)"
    )


@query(_mapping_sql("80", "30, 40, 60, 100", 7))
def mapping_default(spark, sf_dir):
    return mapping_frame(spark, default_mapping("mixed", "MEDIUM", 7))


@query(_mapping_sql("70", "30, 40, 60, 100", 4))
def mapping_amphibian(spark, sf_dir):
    return mapping_frame(spark, default_mapping("mixed", "AMPHIBIAN", 4))


@query(f"select cls, forbidden or cls = 10 as forbidden, is_brownian or cls = 30 as is_brownian, (case when cls = 30 then 9 else S end)::int as S, (case when cls = 30 then 1 else D end)::int as D, diffusity, bias_x, bias_y from ({_mapping_sql('80', '30, 40, 60, 100', 7)})")
def mapping_changed(spark, sf_dir):
    """One class Brownian with a longer step, one forbidden."""
    return mapping_frame(spark, forbid(with_class(default_mapping("mixed", "MEDIUM", 7), 30, is_brownian=True, S=9), 10))


@query("select (i % 12)::int as x, (i // 12)::int as y, 30 as cls from range(12 * 7) t(i)")
def constant_terrain(spark, sf_dir):
    return readers.constant_terrain(spark, 30, 12, 7)


@query(
    "with b as (select round(exp(-(x * x + y * y) / 45e-1), 6) + x * 1e-2 + y * 3e-2 + 1 as v, y, x from range(-3, 4) a(x), range(-3, 4) c(y))"
    " select (case d when 0 then y when 1 then x when 2 then -y else -x end)::int as dy, (case d when 0 then x when 1 then -y when 2 then -x else y end)::int as dx,"
    " d::int as d, round(v / (select sum(v) from b), 9) as w from b, range(4) r(d)"
)
def kernels_turned(spark, sf_dir):
    """A kernel turned by quarters, which is exact."""
    base = np.array([[round(float(np.exp(-(x * x + y * y) / 4.5)), 6) + x * 0.01 + y * 0.03 + 1 for x in range(-3, 4)] for y in range(-3, 4)])
    return kernel_frame(spark, correlated_from(base / base.sum(), 4)).select("d", "dy", "dx", F.round("w", 9).alias("w"))


@query(
    _C + _STEP + " select animal_id, round(case when s < 0 then s + 2 * pi() else s end, 7) as mean_bearing from (select animal_id, atan2(sum(sin(bearing)), sum(cos(bearing))) as s from k group by animal_id)"
)
def mean_bearing(spark, sf_dir):
    return behaviour.summary(_steps(spark, sf_dir)).select("animal_id", F.round("mean_bearing", 7).alias("mean_bearing"))


@query(
    _C + _STEP + ", z as (select animal_id, median(case when step / nullif(dt, 0) > 0 then step / nullif(dt, 0) end) as m from k group by animal_id)"
    " select animal_id, round(75e-2 * m + 25e-2 * 1005e-3, 7) as speed, round((75e-2 * m + 25e-2 * 1005e-3) * 36e-1, 6) as speed_kmh from z"
)
def speed_with_prior(spark, sf_dir):
    got = behaviour.summary(_steps(spark, sf_dir), prior_weight=0.25, use_prior=True)
    return got.select("animal_id", F.round("speed", 7).alias("speed"), F.round("speed_kmh", 6).alias("speed_kmh"))


@query(_S + " select count(*) as segments, count(*) filter (x0 < 0 or x0 >= width or y0 < 0 or y0 >= height or x1 < 0 or x1 >= width or y1 < 0 or y1 >= height) as outside from s join d using (animal_id)")
def segments_in_bounds(spark, sf_dir):
    at = lambda k: F.col(f"x{k}").between(0, F.col("width") - 1) & F.col(f"y{k}").between(0, F.col("height") - 1)
    return _gridded(spark, sf_dir).agg(F.count("*").alias("segments"), F.count_if(~(at(0) & at(1))).alias("outside"))
