"""Walks, terrains, weather and kernels as files; walks as JSON and maps."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The colours of walks on a map, in order.
PALETTE = [
    "red", "blue", "green", "purple", "orange", "darkred", "lightred", "beige", "darkblue", "darkgreen", "cadetblue", "darkpurple",
    "white", "pink", "lightblue", "lightgreen", "gray", "black", "lightgray",
]


def _listed(walk: DataFrame, keys: list[str], order: list[str], point: list[str], name: str) -> DataFrame:
    """Points of each walk in order; a walk is one track's, which its budget bounds."""
    got = F.array_sort(F.collect_list(F.struct(*order, *point)))
    return walk.groupBy(*keys).agg(F.transform(got, lambda p: F.struct(*(p[c].alias(c) for c in point))).alias(name))


def walk_json(walk: DataFrame, keys: list[str], steps: DataFrame | None = None, terrain: DataFrame | None = None, order: tuple[str, ...] = ("seg", "t")) -> DataFrame:
    """``keys, json``: ``{"Terrain", "Walk", "Steps"}``, the first and last only where they are given."""
    out = _listed(walk, keys, list(order), ["x", "y"], "Walk")
    parts = ["Walk"]
    if steps is not None:
        out, parts = out.join(_listed(steps, keys, ["seq"], ["x", "y"], "Steps"), keys, "left"), [*parts, "Steps"]
    if terrain is not None:
        rows = terrain.groupBy("y").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "cls"))), lambda p: p["cls"]).alias("row"))
        grid = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "row"))), lambda p: p["row"]).alias("Terrain"))
        out, parts = out.crossJoin(F.broadcast(grid)), ["Terrain", *parts]  # one row
    return out.select(*keys, F.to_json(F.struct(*parts)).alias("json"))


def walk_geojson(walk: DataFrame, keys: list[str], order: tuple[str, ...] = ("seg", "t")) -> DataFrame:
    """``keys, json``: a LineString feature of each walk, longitude first."""
    line = F.transform(F.array_sort(F.collect_list(F.struct(*order, "lon", "lat"))), lambda p: F.array(p["lon"], p["lat"]))
    geometry = F.struct(F.lit("LineString").alias("type"), F.col("line").alias("coordinates"))
    properties = F.struct(*keys)
    return walk.groupBy(*keys).agg(line.alias("line")).select(
        *keys, F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry"))).alias("json")
    )


def palette(names: DataFrame, key: str) -> DataFrame:
    """``key, colour``: colours in turn, by the order of the keys.

    The order is over distinct keys: one row a track.
    """
    from pyspark.sql import Window

    number = F.dense_rank().over(Window.orderBy(key)) - 1
    return names.select(key).distinct().select(key, F.element_at(F.lit(PALETTE), (F.pmod(number, F.lit(len(PALETTE))) + 1).cast("int")).alias("colour"))


def step_boxes(path: DataFrame, steps: DataFrame, keys: list[str], tolerance: float = 1e-5) -> DataFrame:
    """First index of each step on its path, both within ``tolerance`` in both axes.

    Coordinates are dealt into cells of the tolerance and a step looks into
    its own and the eight around, so that this is an equi-join.
    """
    cell = lambda c: F.floor(F.col(c) / tolerance)
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    near = steps.select(*keys, "step", F.col("lat").alias("slat"), F.col("lon").alias("slon"), F.explode(around).alias("o"))
    near = near.select(*keys, "step", "slat", "slon", (F.floor(F.col("slat") / tolerance) + F.col("o.a")).alias("ca"), (F.floor(F.col("slon") / tolerance) + F.col("o.b")).alias("cb"))
    there = path.select(*keys, "idx", "lat", "lon", cell("lat").alias("ca"), cell("lon").alias("cb"))
    met = near.join(there, [*keys, "ca", "cb"]).where((F.abs(F.col("lat") - F.col("slat")) <= tolerance) & (F.abs(F.col("lon") - F.col("slon")) <= tolerance))
    return met.groupBy(*keys, "step").agg(F.min("idx").alias("idx"))


def map_html(features: list[str], title: str = "walks", colours: list[str] | None = None) -> str:
    """A page that draws GeoJSON lines with start and end marks; ValueError without a line.  For a report's few walks."""
    lines = [json.loads(f)["geometry"]["coordinates"] for f in features]
    if not any(lines):
        raise ValueError("no walk to draw")
    points = [p for line in lines for p in line]
    x0, x1 = min(p[0] for p in points), max(p[0] for p in points)
    y0, y1 = min(p[1] for p in points), max(p[1] for p in points)
    scale = 800 / max(x1 - x0, y1 - y0, 1e-12)
    place = lambda p: f"{(p[0] - x0) * scale:.1f},{(y1 - p[1]) * scale:.1f}"
    body = []
    for k, line in enumerate(lines):
        colour = (colours or PALETTE)[k % len(colours or PALETTE)]
        body.append(f'<polyline fill="none" stroke="{colour}" points="{" ".join(map(place, line))}"/>')
        for p, mark in ((line[0], "green"), (line[-1], "red")):
            x, y = place(p).split(",")
            body.append(f'<circle cx="{x}" cy="{y}" r="4" fill="{mark}"/>')
    return f"<!doctype html><title>{html.escape(title)}</title><svg viewBox='-10 -10 820 820'>{''.join(body)}</svg>"


def plot_frame(walk: DataFrame) -> DataFrame:
    """All points of all walks, each walk's in order and in one part, for plots drawn elsewhere."""
    return walk.repartition("animal_id").sortWithinPartitions("animal_id", "seg", "t")


def terrain_text(terrain: DataFrame, path: str) -> None:
    """A grid as one text file, rows from north to south, classes set apart by spaces."""
    row = F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("x", "cls"))), lambda p: p["cls"].cast("string")))
    terrain.groupBy("y").agg(row.alias("value")).coalesce(1).sortWithinPartitions("y").select("value").write.text(path)


def weather_csv(weather: DataFrame, path: str, columns: list[str]) -> None:
    """Weather by grid point; columns that are missing are written empty."""
    have = [F.col(c) if c in weather.columns else F.lit(None).cast("string").alias(c) for c in columns]
    weather.select("gy", "gx", *have).repartition("gy", "gx").write.partitionBy("gy", "gx").option("header", True).csv(path)


def kernel_data(frame: DataFrame, path: str) -> None:
    """Kernel parameters along tracks, a folder for each animal."""
    frame.repartition("animal_id").write.partitionBy("animal_id").option("header", True).csv(path)


def kernels(frame: DataFrame, path: str, partition: tuple[str, ...] = ("t",)) -> None:
    """A kernel catalogue or a table of forward probabilities, by time."""
    frame.write.partitionBy(*partition).parquet(path)


def layers(frame: DataFrame, path: str) -> None:
    """Forward probabilities ``(animal_id, seg, t, d, x, y, p)``, a folder for each point in time, ordered by cell within."""
    frame.repartition("t").sortWithinPartitions("t", "animal_id", "seg", "y", "x").write.partitionBy("t").parquet(path)


def matrix(frame: DataFrame, path: str) -> None:
    """A matrix ``(y, x, v)`` or a tensor ``(d, y, x, v)``."""
    frame.write.parquet(path)


def matrix_text(rows: list, digits: int = 4) -> str:
    """A small matrix ``(y, x, v)`` as lines of numbers."""
    cells = {(r["y"], r["x"]): r["v"] for r in rows}
    ys, xs = sorted({y for y, _ in cells}), sorted({x for _, x in cells})
    return "\n".join(" ".join(f"{cells.get((y, x), 0.0):.{digits}f}" for x in xs) for y in ys)


def weather_track_csv(frame: DataFrame, path: str) -> None:
    """Weather along tracks with the index of each row on its track in front, a folder for each animal."""
    from trailweave.operators.track import ordered

    rows = ordered(frame) if "t" not in frame.columns else frame
    rest = [c for c in rows.columns if c not in ("t", "animal_id")]
    rows.select("animal_id", F.col("t").alias("index"), *rest).repartition("animal_id").sortWithinPartitions("animal_id", "index").write.partitionBy("animal_id").option(
        "header", True
    ).csv(path)
