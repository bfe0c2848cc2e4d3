"""Walks over whole tracks: several steps, stitching, fields by weather, and the walk of a study."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailweave.functions.kernels import KernelParams, kernels_of
from trailweave.operators.bridge import Field, biased_field, bridge, brownian_field, check_arguments, terrain_field
from trailweave.operators.track import dimensions, segments, to_cells, to_degrees

#: Rows of weather that may be broadcast to a time walk.
WEATHER_ROWS = 2_000_000


def segments_of(steps: DataFrame, T: int, width: int, height: int) -> DataFrame:
    """Segments between consecutive steps ``animal_id, seq, x, y`` with ``T`` points each; needs two steps a track."""
    check_arguments(width, height, T)
    bad = steps.where(~(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))).first()
    if bad:
        raise ValueError(f"step ({bad['x']}, {bad['y']}) is outside the grid")
    short = steps.groupBy("animal_id").count().where("count < 2").first()
    if short:
        raise ValueError(f"{short['animal_id']} has fewer than two steps")
    w = Window.partitionBy("animal_id").orderBy("seq")
    rows = steps.select(
        "animal_id", (F.row_number().over(w) - 1).cast("int").alias("seg"), F.col("x").cast("int").alias("x0"), F.col("y").cast("int").alias("y0"),
        F.lead("x").over(w).cast("int").alias("x1"), F.lead("y").over(w).cast("int").alias("y1"), F.lit(T).alias("T"),
    )
    return rows.where("x1 is not null")


def points(spark: SparkSession, steps: list[tuple[int, int]], animal_id: str = "walk") -> DataFrame:
    return spark.createDataFrame([(animal_id, k, int(x), int(y)) for k, (x, y) in enumerate(steps)], "animal_id string, seq int, x int, y int")


def stitch(walk: DataFrame, drop_last: bool = True, append_final: bool = False) -> DataFrame:
    """Segments in one line: each without its last point, the track's last point appended if wanted.

    A segment of one point keeps it.
    """
    ends = walk.groupBy("animal_id", "seg").agg(F.max("t").alias("__t"))
    finals = ends.groupBy("animal_id").agg(F.max("seg").alias("__seg"))
    rows = walk.join(ends, ["animal_id", "seg"]).join(finals, "animal_id")
    keep = F.lit(True) if not drop_last else (F.col("t") < F.col("__t")) | (F.col("__t") == 0)
    if append_final:
        keep = keep | (F.col("seg") == F.col("__seg"))
    return rows.where(keep & F.col("t").isNotNull()).drop("__t", "__seg")


class ByGrid:
    """A field for each size of grid, made once in a worker; it is the same at all points."""

    #: Segments of one start share their layers; which starts are neighbours doesn't matter.
    order, scattered = ("x0", "y0"), True

    def __init__(self, make: Callable[[int, int], Field]):
        self.make, self.fields = make, {}

    def __call__(self, row: dict) -> Field:
        size = int(row["width"]), int(row["height"])
        if size not in self.fields:
            self.fields[size] = self.make(*size)
        return self.fields[size]

    def field(self, size: tuple[int, int], first: int, label: int) -> Field:
        return self({"width": size[0], "height": size[1]})

    def directions(self, size: tuple[int, int], first: int) -> int:
        return self.field(size, first, first).D

    def labels(self, batch: pa.RecordBatch) -> None:
        return None

    def __getstate__(self) -> dict:
        return {"make": self.make, "fields": {}}


class ByHour:
    """``weather_field`` of each segment's own hours; the moves of an hour are the same for all segments of a size of grid."""

    #: Segments of one time meet the same hours, and those near in time some of them.
    order, scattered = ("ts0", "ts1"), False

    def __init__(self, terrain_of: Callable[[int, int], np.ndarray], mapping: dict[int, KernelParams], weather: dict[tuple[int, int, int], tuple]):
        self.terrain_of, self.mapping, self.weather, self.known = terrain_of, mapping, weather, {}

    def _field(self, size: tuple[int, int], hours: list[int]) -> Field:
        return weather_field(self.terrain_of(*size), self.mapping, self.weather, hours)

    def __call__(self, row: dict) -> Field:
        return self._field((int(row["width"]), int(row["height"])), hours_of(row))

    def field(self, size: tuple[int, int], first: int, label: int) -> Field:
        """The field of two points: the state has the directions of the ``first`` hour, as a walk's has, and moves in the second."""
        return self._field(size, [first, label])

    def directions(self, size: tuple[int, int], first: int) -> int:
        if (size, first) not in self.known:
            self.known[size, first] = self._field(size, [first]).D
        return self.known[size, first]

    def labels(self, batch: pa.RecordBatch) -> np.ndarray:
        """``hours_of`` of all rows, ``[segment, t]``; those beyond a segment's points mean nothing."""
        a, b = (batch.column(c).to_numpy(zero_copy_only=False).astype("datetime64[us]").astype(np.int64) / 1e6 for c in ("ts0", "ts1"))
        T = batch.column("T").to_numpy(zero_copy_only=False)
        t = np.arange(max(1, int(T.max())))
        return ((a[:, None] + (b - a)[:, None] * t / np.maximum(T - 1, 1)[:, None]) // 3600).astype(int)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}


def multistep_biased(steps: DataFrame, biases: list[list], width: int, height: int, S: int = 7, kernel: np.ndarray | None = None, append_final: bool = True, seed: int = 0) -> DataFrame:
    """A walk through all steps, each segment with a bias series of its own; a segment has as many points as its series."""
    longest = max(map(len, biases), default=1)
    parts = segments_of(steps, longest, width, height)
    sizes = F.array(*(F.lit(len(b)) for b in biases))
    parts = parts.withColumn("T", F.get(sizes, F.col("seg")))
    if parts.where("T is null").first():
        raise ValueError("there are more segments than bias series")
    walk = bridge(parts, lambda row: biased_field(width, height, biases[int(row["seg"])], S, kernel), seed)
    return stitch(walk, True, append_final)


def multistep(steps: DataFrame, T: int, field: Field, keep_both: bool = True, append_final: bool = False, seed: int = 0) -> DataFrame:
    """A walk through all steps: ``(n - 1) * T`` points if both ends of a segment stay, else ``(n - 1) * (T - 1)``, and one with the final."""
    return stitch(bridge(segments_of(steps, T, field.width, field.height), lambda row: field, seed), not keep_both, append_final)


def weather_field(
    terrain: np.ndarray, mapping: dict[int, KernelParams], weather: dict[tuple[int, int, int], tuple], hours: list[int], grid: int = 5,
    resolver: Callable[[KernelParams, tuple], KernelParams] | None = None, full_influence: bool = True,
) -> Field:
    """Kernels by landcover class and by the weather of each point's hour.

    ``weather[hour, gy, gx]`` holds wind speed, wind direction, clouds and
    rain; ``hours[t]`` is the hour of point ``t``.  Without ``full_influence``
    the first hour holds throughout.
    """
    resolver = resolver or by_weather
    base = terrain_field(terrain, mapping)
    order, (h, w) = sorted(mapping), terrain.shape
    gx = np.minimum(grid - 1, np.arange(w) * grid // w)
    gy = grid - 1 - np.minimum(grid - 1, np.arange(h) * grid // h)
    cell = gy[:, None] * grid + gx[None, :]
    index = base.classes(0) * grid * grid + cell
    used, local = np.unique(index, return_inverse=True)
    local = local.reshape(index.shape)
    made: dict[int, tuple[list[np.ndarray], np.ndarray]] = {}

    def of(t: int) -> tuple[list[np.ndarray], np.ndarray]:
        """The different kernels of an hour, and which of them each cell has."""
        hour = hours[t] if full_influence else hours[0]
        if hour not in made:
            now = [(order[k // (grid * grid)], weather.get((hour, k % (grid * grid) // grid, k % grid))) for k in used.tolist()]
            params = [replace(resolver(mapping[c], v) if v else mapping[c], forbidden=False) for c, v in now]
            kinds = {p: i for i, p in enumerate(dict.fromkeys(params))}
            if len(made) > 4:
                made.clear()
            made[hour] = [kernels_of(p) for p in kinds], np.array([kinds[p] for p in params])[local]
        return made[hour]

    return Field(w, h, of(0)[0], lambda t: of(t)[1], base.open, still=not full_influence, at=lambda t: of(t)[0])


def by_weather(params: KernelParams, weather: tuple) -> KernelParams:
    """The worked rule on a class's parameters: step from wind, directions from its sector, spread from clouds, bias from rain."""
    wind, direction, clouds, rain = weather
    S = int(max(1, round(wind / 2)))
    return KernelParams(True, S, max(1, int(direction // 45)), max(0.2, clouds / 100.0), int(rain > 0.1), 0, params.forbidden)


def weather_table(weather: DataFrame) -> dict[tuple[int, int, int], tuple]:
    """Weather as a lookup by hour since the epoch and grid point; its size is checked first."""
    if weather.count() > WEATHER_ROWS:
        raise ValueError("the weather is too large to broadcast; cut it by animal and dates")
    rows = weather.selectExpr("cast(unix_timestamp(cast(ts as timestamp)) / 3600 as int) as hour", "gy", "gx", "wind_speed", "wind_direction", "cloud_cover", "precipitation")
    columns = [c.to_pylist() for c in rows.toArrow().columns]
    return {(hour, gy, gx): tuple(values) for hour, gy, gx, *values in zip(*columns, strict=True)}


def hours_of(row: dict) -> list[int]:
    """The hour of each point of a segment, from its two times in equal steps."""
    a, b, T = row["ts0"].timestamp(), row["ts1"].timestamp(), int(row["T"])
    return [int((a + (b - a) * t / max(T - 1, 1)) // 3600) for t in range(T)]


def track_walks(
    fixes: DataFrame, resolution: int, field_of: Callable[[dict], Field] | None = None, S: int = 3, padding: float = 0.2, seed: int = 0,
    fallback: bool = False,
) -> DataFrame:
    """The bridges of every track: ``animal_id, seg, t, x, y, status, lon, lat``, the final point of each track too."""
    dims = dimensions(fixes, resolution, padding)
    cells = to_cells(fixes, dims)
    parts = segments(cells).join(dims.select("animal_id", "width", "height"), "animal_id")
    walk = bridge(parts, field_of or ByGrid(lambda width, height: brownian_field(width, height, S)), seed, fallback)
    return to_degrees(stitch(walk, append_final=True), dims)
