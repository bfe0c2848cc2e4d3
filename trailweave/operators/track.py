"""Tracks: boxes, dates, samples, order, segments, regular grids in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailweave.functions import geo


def valid(fixes: DataFrame) -> DataFrame:
    """Rows with a time and a place; NaN counts as none."""
    return fixes.na.drop(subset=["ts", "lon", "lat"]).where(~F.isnan("lon") & ~F.isnan("lat"))


def complete(frame: DataFrame) -> DataFrame:
    """Rows without any null."""
    return frame.na.drop("any")


def within(fixes: DataFrame, lon_min, lon_max, lat_min, lat_max, start=None, end=None) -> DataFrame:
    """Rows of a box and, if given, of a span of time, ends included; pushed to the scan."""
    out = fixes.where(F.col("lon").between(lon_min, lon_max) & F.col("lat").between(lat_min, lat_max))
    out = out.where(F.col("ts") >= F.lit(start)) if start is not None else out
    return out.where(F.col("ts") <= F.lit(end)) if end is not None else out


def animals(fixes: DataFrame) -> DataFrame:
    return fixes.select("animal_id").distinct()


def boxes(fixes: DataFrame) -> DataFrame:
    """Each animal's extent; animals without a valid fix are left out."""
    return valid(fixes).groupBy("animal_id").agg(
        F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"), F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max")
    )


def extent(fixes: DataFrame) -> DataFrame:
    """One row: the extent of all tracks."""
    return valid(fixes).agg(F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"), F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"))


def one_a_day_with_extent(fixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One fix a day over all animals, and the extent of what is left with its corners in metres."""
    daily = one_a_day(fixes, ())
    box = extent(daily).withColumn("epsg", F.expr(geo.utm_epsg("((lon_min + lon_max) / 2e0)", "((lat_min + lat_max) / 2e0)")))
    return daily, utm_box(box)


def utm_box(box: DataFrame) -> DataFrame:
    """A box with its two corners in metres of its zone ``epsg``."""
    ax, ay = geo.to_utm("lon_min", "lat_min", "epsg")
    bx, by = geo.to_utm("lon_max", "lat_max", "epsg")
    return box.selectExpr("*", f"{ax} as x_min", f"{ay} as y_min", f"{bx} as x_max", f"{by} as y_max")


def degree_box(box: DataFrame) -> DataFrame:
    """A box in metres back in degrees, by its two corners."""
    ax, ay = geo.from_utm("x_min", "y_min", "epsg")
    bx, by = geo.from_utm("x_max", "y_max", "epsg")
    names = ("lon_min", "lat_min", "lon_max", "lat_max")
    return box.drop(*names).selectExpr("*", *(f"{e} as {n}" for e, n in zip((ax, ay, bx, by), names, strict=True)))


def animal(fixes: DataFrame, animal_id: str) -> DataFrame:
    """One animal's rows; pushed to the scan."""
    return fixes.where(F.col("animal_id") == animal_id)


def padded_boxes(fixes: DataFrame, padding: float = 0.2) -> DataFrame:
    """Extents with ``padding`` on either side, on the globe."""
    a, b = geo.padded("lon_min", "lon_max", padding, 180.0)
    c, d = geo.padded("lat_min", "lat_max", padding, 90.0)
    return boxes(fixes).selectExpr("animal_id", f"{a} as lon_min", f"{b} as lon_max", f"{c} as lat_min", f"{d} as lat_max")


def dates(fixes: DataFrame, hourly_below: int = 20) -> DataFrame:
    """First and last day of each animal, days between, and whether weather is wanted by the hour."""
    span = fixes.where("ts is not null").groupBy("animal_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    days = F.datediff(F.to_date("b"), F.to_date("a"))
    return span.select(
        "animal_id", F.date_format("a", "yyyy-MM-dd").alias("start_date"), F.date_format("b", "yyyy-MM-dd").alias("end_date"),
        days.alias("days"), (days < hourly_below).alias("hourly"),
    )


def one_a_day(fixes: DataFrame, keys: tuple[str, ...] = ("animal_id",)) -> DataFrame:
    """The first fix of each day, its time set to noon; ``keys`` () takes one a day over all animals."""
    day = F.date_trunc("day", "ts")
    w = Window.partitionBy(*keys, day).orderBy("ts", "event_id")
    first = valid(fixes).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return first.withColumn("ts", (day + F.expr("interval 12 hours")).cast(dict(fixes.dtypes)["ts"]))


def ordered(fixes: DataFrame) -> DataFrame:
    """``t``: the place of a fix on its animal's track, from 0."""
    return fixes.withColumn("t", F.row_number().over(Window.partitionBy("animal_id").orderBy("ts", "event_id")).cast("int") - 1)


def sample(fixes: DataFrame, k: int | None) -> DataFrame:
    """Every ``max(1, n // k)``-th fix of an animal, ``k`` at most; all if ``k`` is None or not positive."""
    rows = ordered(valid(fixes))
    if not k or k <= 0:
        return rows
    step = F.greatest(F.lit(1), F.floor(F.count("*").over(Window.partitionBy("animal_id")) / k))
    return rows.withColumn("__s", step).where((F.col("t") % F.col("__s") == 0) & (F.col("t") / F.col("__s") < k)).drop("__s")


def dimensions(fixes: DataFrame, resolution: int, padding: float = 0.2) -> DataFrame:
    """One row an animal: padded box, zone, box in metres by its two corners, and cells across and down."""
    box = padded_boxes(fixes, padding).withColumn("epsg", F.expr(geo.utm_epsg("((lon_min + lon_max) / 2e0)", "((lat_min + lat_max) / 2e0)")))
    ax, ay = geo.to_utm("lon_min", "lat_min", "epsg")
    bx, by = geo.to_utm("lon_max", "lat_max", "epsg")
    w, h = geo.resolution("lon_min", "lon_max", "lat_min", "lat_max", resolution, "bround")
    return box.selectExpr("*", f"{ax} as x_min", f"{ay} as y_min", f"{bx} as x_max", f"{by} as y_max", f"{w} as width", f"{h} as height")


def to_cells(fixes: DataFrame, dims: DataFrame) -> DataFrame:
    """Fixes with ``x, y`` cells of their animal's grid, x east and y south; joined with one row an animal."""
    east, north = geo.to_utm("lon", "lat", "epsg")
    placed = valid(fixes).join(dims.select("animal_id", "epsg", "x_min", "y_min", "x_max", "y_max", "width", "height"), "animal_id")
    placed = placed.selectExpr("*", f"{east} as east", f"{north} as north")
    return placed.selectExpr(
        *fixes.columns, "epsg", "width", "height",
        f"{geo.grid_index('east', 'x_min', 'x_max', 'width')} as x", f"{geo.grid_index('north', 'y_min', 'y_max', 'height', True)} as y",
    )


def to_degrees(cells: DataFrame, dims: DataFrame) -> DataFrame:
    """``lon, lat`` of walk cells ``animal_id, x, y``."""
    east = geo.grid_coordinate("x", "x_min", "x_max", "width")
    north = geo.grid_coordinate("y", "y_min", "y_max", "height", True)
    lon, lat = geo.from_utm("__east", "__north", "epsg")
    joined = cells.join(dims.select("animal_id", "epsg", "x_min", "y_min", "x_max", "y_max", "width", "height"), "animal_id")
    return joined.selectExpr(*cells.columns, "epsg", f"{east} as __east", f"{north} as __north").selectExpr(*cells.columns, f"{lon} as lon", f"{lat} as lat")


def segments(cells: DataFrame, least_steps: int = 2, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each fix with the next: ``seg, x0, y0, x1, y1, T, ts0, ts1`` and the first fix's columns ``keep``; a pair in one cell has T 1."""
    w = Window.partitionBy("animal_id").orderBy("ts", "event_id")
    rows = cells.select(
        "animal_id", (F.row_number().over(w) - 1).cast("int").alias("seg"), F.col("x").alias("x0"), F.col("y").alias("y0"),
        F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1"), F.col("ts").alias("ts0"), F.lead("ts").over(w).alias("ts1"), *keep,
        # a fix with a next one is one of two
        *([F.count("*").over(Window.partitionBy("animal_id")).alias("__n")] if least_steps > 2 else []),
    )
    rows = rows.where("x1 is not null")
    rows = rows.where(F.col("__n") >= least_steps).drop("__n") if least_steps > 2 else rows
    budget = F.expr(f"cast(case when x0 = x1 and y0 = y1 then 1 else {geo.budget('x0', 'y0', 'x1', 'y1')} end as int)")
    first = ["animal_id", "seg", "x0", "y0", "x1", "y1", "ts0", "ts1"]
    return rows.select(*first, budget.alias("T"), *keep)


def regular(track: DataFrame, values: list[str], minutes: int, keys: tuple[str, ...] = ("animal_id",)) -> DataFrame:
    """Values on a regular grid in time, from each track's first time on.

    A grid time takes the row of exactly that time; between such times values
    are interpolated by position, after the last they are carried on, and
    grid times before the first are left out.
    """
    w = Window.partitionBy(*keys).orderBy("ts")
    span = track.groupBy(*keys).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    grid = span.select(*keys, F.explode(F.sequence("a", "b", F.expr(f"interval {minutes} minutes"))).alias("ts"))
    exact = track.groupBy(*keys, "ts").agg(*(F.min(v).alias(v) for v in values))
    rows = grid.join(exact, [*keys, "ts"], "left").withColumn("__i", F.row_number().over(w))
    # what follows is what precedes in the other order: both frames grow with the row, none is computed again
    before = w.rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*keys).orderBy(F.desc("ts")).rowsBetween(Window.unboundedPreceding, 0)

    def between(v: str) -> Column:
        at = F.when(F.col(v).isNotNull(), F.col("__i"))
        i0, v0 = F.last(at, True).over(before), F.last(v, True).over(before)
        i1, v1 = F.last(at, True).over(after), F.last(v, True).over(after)
        return F.when(i1.isNull() | (i1 == i0), v0).otherwise(v0 + (v1 - v0) * (F.col("__i") - i0) / (i1 - i0))

    return rows.select(*keys, "ts", *(between(v).alias(v) for v in values)).na.drop("any")
