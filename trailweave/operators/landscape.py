"""Joins of cells with terrain, mapping and weather; raster resampling; kernel parameters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailweave.operators.track import complete, ordered, within
from trailweave.schemas import KERNEL_DATA


def terrain_at(cells: DataFrame, terrain: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Cells with their class as ``terrain``; null outside the grid."""
    return cells.join(terrain.select(*keys, "x", "y", F.col("cls").alias("terrain")), [*keys, "x", "y"], "left")


def params_of(cells: DataFrame, mapping: DataFrame) -> DataFrame:
    """Cells with the parameters of their class; a mapping is small, which Spark sees for itself."""
    return cells.join(mapping.withColumnRenamed("cls", "terrain"), "terrain", "left")


def forbidden(cells: DataFrame, mapping: DataFrame) -> DataFrame:
    return params_of(cells, mapping).where("forbidden")


def weather_cell(cells: DataFrame, weather: DataFrame, grid: int = 5) -> DataFrame:
    """Cells ``x, y, width, height, ts`` with the weather of their hour at their grid point; the grid goes northward.

    Where the hour is missing the last earlier one of the point is taken;
    before the first there is none (left join).
    """
    at = cells.withColumns({
        "gx": F.least(F.lit(grid - 1), F.floor(F.col("x") * grid / F.col("width"))).cast("int"),
        "gy": (grid - 1 - F.least(F.lit(grid - 1), F.floor(F.col("y") * grid / F.col("height")))).cast("int"),
        "hour": F.date_trunc("hour", "ts").cast(dict(weather.dtypes)["ts"]),
    })
    w = Window.partitionBy("gx", "gy").orderBy("from")
    values = [c for c in weather.columns if c not in ("gx", "gy", "ts")]
    spells = weather.withColumn("from", F.col("ts")).select("gx", "gy", "from", F.lead("from").over(w).alias("until"), *values)
    # hours between two entries are few; each is a row, so that this stays an equi-join
    step = F.expr("interval 1 hour")
    last = F.when(F.col("until").isNull(), F.col("from")).otherwise(F.greatest(F.col("from"), F.col("until") - step))
    hours = spells.select("gx", "gy", F.explode(F.sequence("from", last, step)).alias("hour"), *values)
    return at.join(hours, ["gx", "gy", "hour"], "left")


def weather_hour(fixes: DataFrame, weather: DataFrame, keys: tuple[str, ...] = ("gx", "gy")) -> DataFrame:
    """Fixes with the weather of the same hour at the same point; the first entry of an hour; others have none and go."""
    w = Window.partitionBy(*keys, F.date_trunc("hour", "ts")).orderBy("ts")
    first = weather.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    kind = dict(weather.dtypes)["ts"]
    first = first.withColumn("hour", F.date_trunc("hour", "ts").cast(kind)).drop("ts")
    return fixes.withColumn("hour", F.date_trunc("hour", "ts").cast(kind)).join(first, [*keys, "hour"])


def weather_points(boxes: DataFrame, grid: int = 5) -> DataFrame:
    """Centres of a ``grid`` x ``grid`` raster of each box, from the south-west; a box without extent has one."""
    flat = (F.col("lon_max") == F.col("lon_min")) & (F.col("lat_max") == F.col("lat_min"))
    axis = F.sequence(F.lit(0), F.when(flat, 0).otherwise(grid - 1))
    rows = boxes.withColumn("gy", F.explode(axis)).withColumn("gx", F.explode(axis))
    n = F.when(flat, 1).otherwise(grid)
    return rows.select(
        "animal_id", "gy", "gx", (F.col("lon_min") + (F.col("gx") + 0.5) * (F.col("lon_max") - F.col("lon_min")) / n).alias("lon"),
        (F.col("lat_min") + (F.col("gy") + 0.5) * (F.col("lat_max") - F.col("lat_min")) / n).alias("lat"),
    )


def resample(raster: DataFrame, roi: tuple[int, int, int, int], width: int, height: int) -> DataFrame:
    """Nearest cells of a raster's window ``(row0, row1, col0, col1)``, ends excluded, on ``width`` x ``height`` cells.

    The window's corners may come in either order and are cut to the raster.
    """
    rows, cols = raster.agg(F.max("y") + 1, F.max("x") + 1).first()
    r0, r1 = sorted(roi[:2])
    c0, c1 = sorted(roi[2:])
    r0, r1, c0, c1 = max(0, r0), min(rows or 0, r1), max(0, c0), min(cols or 0, c1)
    if r0 >= r1 or c0 >= c1:
        raise ValueError("the window has no cell of the raster")
    spark = raster.sparkSession
    step = lambda extent, n: f"cast(floor({{}} * {extent - 1} / {n - 1}e0) as int)" if n > 1 else "0"
    target = spark.range(width * height).selectExpr(f"cast(id % {width} as int) as i", f"cast(floor(id / {width}) as int) as j")
    at = target.selectExpr("i", "j", f"{c0} + {step(c1 - c0, width).format('i')} as x", f"{r0} + {step(r1 - r0, height).format('j')} as y")
    return at.join(raster, ["x", "y"], "left").selectExpr("i as x", "j as y", "cls")


def raster_window(box: tuple[float, float, float, float], transform: tuple[float, float, float, float], size: tuple[int, int]) -> tuple[int, int, int, int]:
    """``(row0, row1, col0, col1)`` of a box ``(lon_min, lat_min, lon_max, lat_max)`` on a raster of ``size`` (width, height).

    ``transform`` is west, north, and the cell's width and height.  Both
    corners are cut to the raster's cells; ValueError if that leaves nothing.
    """
    west, north, dx, dy = transform
    lon0, lat0, lon1, lat1 = box
    cut = lambda v, n: max(0, min(math.floor(v), n - 1))
    c0, c1 = sorted((cut((lon0 - west) / dx, size[0]), cut((lon1 - west) / dx, size[0])))
    r0, r1 = sorted((cut((north - lat1) / dy, size[1]), cut((north - lat0) / dy, size[1])))
    if r0 == r1 and c0 == c1:
        raise ValueError("the box does not overlap the raster")
    return r0, r1, c0, c1


def resample_box(raster: DataFrame, box: tuple[float, float, float, float], transform: tuple[float, float, float, float], width: int, height: int) -> DataFrame:
    """Nearest cells of a raster's part under a box in its own coordinates, on ``width`` x ``height`` cells."""
    w, h = raster.agg(F.max("x") + 1, F.max("y") + 1).first()
    if w is None:
        raise ValueError("the raster is empty")
    r0, r1, c0, c1 = raster_window(box, transform, (w, h))
    step = lambda i, extent, n: f"cast(floor({i} * {extent} / {n - 1}e0) as int)" if n > 1 else "0"
    target = raster.sparkSession.range(width * height).selectExpr(f"cast(id % {width} as int) as i", f"cast(floor(id / {width}) as int) as j")
    at = target.selectExpr("i", "j", f"{c0} + {step('i', c1 - c0, width)} as x", f"{r0} + {step('j', r1 - r0, height)} as y")
    return at.join(raster.select("x", "y", "cls"), ["x", "y"], "left").selectExpr("i as x", "j as y", "cls")


def kernel_map(terrain: DataFrame, mapping: DataFrame, tensors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(x, y, kernel_id)`` for the cells that aren't forbidden, and the catalogue ``kernel_id`` with its parameters, one row a different kernel.

    ``tensors`` ``(cls, name)`` are the user's own sets, which stand before the mapping's.
    """
    params = ["is_brownian", "S", "D", "diffusity", "bias_x", "bias_y"]
    of = mapping.where("not forbidden")
    if tensors is not None:
        of = of.join(tensors.select("cls", F.col("name").alias("tensor")), "cls", "left")
    else:
        of = of.withColumn("tensor", F.lit(None).cast("string"))
    own = F.when(F.col("tensor").isNull(), F.concat_ws(":", *(F.col(p).cast("string") for p in params))).otherwise(F.concat(F.lit("own:"), F.col("tensor")))
    of = of.withColumn("kernel_id", own)
    cells = terrain.join(of.select("cls", "kernel_id"), "cls").select("x", "y", "kernel_id")
    return cells, of.select("kernel_id", "tensor", *params).dropDuplicates(["kernel_id"])


def biased_kernel_map(cells: DataFrame, biases: DataFrame) -> DataFrame:
    """``(t, x, y, kernel_id, bias_x, bias_y)``: a kernel map with one series ``(t, bias_x, bias_y)``, or one for each grid point ``(gy, gx, t, ...)`` of cells that have ``gy, gx``.

    Each cell is joined with the series by its grid point; one series is a grid of one point.
    """
    if "gy" not in biases.columns:
        biases, cells = biases.withColumns({"gy": F.lit(0), "gx": F.lit(0)}), cells.withColumns({"gy": F.lit(0), "gx": F.lit(0)})
    series = biases.groupBy("gy", "gx").agg(F.collect_list(F.struct("t", "bias_x", "bias_y")).alias("b"))
    return cells.join(series, ["gy", "gx"]).select("x", "y", "kernel_id", F.explode("b").alias("b")).select("b.t", "x", "y", "kernel_id", "b.bias_x", "b.bias_y")


def worked_resolver(wind: str = "wind_speed", direction: str = "wind_direction", clouds: str = "cloud_cover", rain: str = "precipitation") -> dict[str, Column]:
    """Parameters from weather: step from wind, directions from its sector, spread from clouds, bias from rain and class."""
    return {
        "is_brownian": F.lit(True), "S": F.col(wind) / 2, "D": F.floor(F.col(direction) / 45).cast("int"), "diffusity": F.col(clouds) / 100.0,
        "bias_x": (F.col(rain) > 0.1).cast("int"), "bias_y": F.col("terrain").isin(50, 80).cast("int"),
    }


def kernel_data(rows: DataFrame, terrain: DataFrame, resolver: dict[str, Column], box: tuple | None = None) -> DataFrame:
    """``animal_id`` and the ten kernel-data columns for rows of a place, a cell and covariates.

    Rows with any null go, then those outside ``box``; ``t`` is the place on
    the track.  ``resolver`` names a column for each parameter.
    """
    rows = complete(rows)
    rows = within(rows, *box) if box else rows
    return terrain_at(ordered(rows), terrain).withColumns(resolver).select("animal_id", *KERNEL_DATA)
