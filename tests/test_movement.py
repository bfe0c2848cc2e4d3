"""Known places, rasters, kernels, bridges of directions, biases and terrains, layers."""

import math
from collections import Counter

import numpy as np
import pytest

from trailweave.functions import geo
from trailweave.functions import kernels as K
from trailweave.operators import bridge as B
from trailweave.operators import landscape, walks
from trailweave.sinks import writers
from trailweave.sources import fixtures as fx
from trailweave.sources import readers


def test_known_utm_places(spark):
    """Published or symmetric places: the central meridian at the equator, and the meridian arc to 45 degrees north."""
    rows = [(3.0, 0.0, 32631, 500000.0, 0.0), (9.0, 45.0, 32632, 500000.0, 4982950.400), (-75.0, 0.0, 32718, 500000.0, 10000000.0)]
    frame = spark.createDataFrame(rows, "lon double, lat double, epsg int, east double, north double")
    east, north = geo.to_utm("lon", "lat", "epsg")
    for r in frame.selectExpr("east", "north", f"{east} as e", f"{north} as n").collect():
        assert abs(r.e - r.east) < 0.01 and abs(r.n - r.north) < 0.01
    lon, lat = geo.from_utm("east", "north", "epsg")
    for r in frame.selectExpr("lon", "lat", f"{lon} as x", f"{lat} as y").collect():
        assert abs(r.x - r.lon) < 1e-7 and abs(r.y - r.lat) < 1e-7


def test_raster_window():
    place, size = (0.0, 10.0, 1.0, 1.0), (20, 10)
    assert landscape.raster_window((2.5, 3.5, 6.5, 8.5), place, size) == (1, 6, 2, 6)
    assert landscape.raster_window((6.5, 8.5, 2.5, 3.5), place, size) == (1, 6, 2, 6)
    assert landscape.raster_window((-5, -5, 50, 50), place, size) == (0, 9, 0, 19)
    with pytest.raises(ValueError):
        landscape.raster_window((100, 100, 120, 120), place, size)


def test_rasters(spark, tmp_path):
    (tmp_path / "r.txt").write_text("1 2\n3 4")
    got = {(r.x, r.y): (r.cls, r.lon, r.lat) for r in readers.raster_text(spark, str(tmp_path / "r.txt"), (10.0, 50.0, 0.5, 0.25)).collect()}
    assert got[1, 0] == (2, 10.75, 49.875) and got[0, 1] == (3, 10.25, 49.625)
    spark.createDataFrame([(0, 1, 30)], "col int, row int, band_1 int").write.parquet(str(tmp_path / "p"))
    assert tuple(readers.raster_parquet(spark, str(tmp_path / "p")).first()) == (0, 1, 30)


def test_matrices(spark, tmp_path):
    a, b = np.arange(9.0).reshape(3, 3) + 1, np.full((3, 3), 2.0)
    assert np.allclose(K.scaled(a, 2), a / 2)
    K.combine_into(a, b)
    assert a[0, 0] == 2 and a[2, 2] == 18 and K.combine(b, b)[0, 0] == 4
    assert np.allclose(K.rotate_about(a, 90, 1, 1), np.rot90(a, -1)) and np.allclose(K.rotate_about(a, 0, 0, 0), a)
    assert np.allclose(K.upsample(np.array([[0.0, 2.0], [2.0, 4.0]]), 3, 3), [[0, 1, 2], [1, 2, 3], [2, 3, 4]])
    t = K.with_matrix(K.tensor(2, 3, 3, 1.0), 1, a)
    assert K.in_bounds(t, 1, 2, 2) and not K.in_bounds(t, 2, 0, 0) and not K.in_bounds(t, 0, 0) and t[1, 2, 2] == 18 and t[0].sum() == 9
    with pytest.raises(ValueError):
        K.with_matrix(t, 2, a)
    frame = spark.createDataFrame([(y, x, float(a[y, x])) for y in range(3) for x in range(3)], "y int, x int, v double")
    writers.matrix(frame, str(tmp_path / "m"))
    assert writers.matrix_text(readers.matrix(spark, str(tmp_path / "m")).collect(), 0).splitlines()[0] == "2 4 6"


def occupancy(field, start, end, T, at):
    """Share of each cell at point ``at`` over all walks, by multiplying out every move of the state (direction, cell)."""
    D, h, w = field.D, field.height, field.width
    free = np.ones((h, w), bool) if field.open is None else field.open
    first = np.zeros((D, h, w))
    first[:, start[1], start[0]] = 1 / D

    def moves(t):
        grid = field.classes(t)
        bx, by = field.shift(t)
        out = {}
        for y in range(h):
            for x in range(w):
                kernels = field.kernels_at(t)[0 if grid is None else grid[y, x]]
                S = kernels.shape[1] // 2
                masks = K.sector_masks(D, S)
                for d in range(D):
                    kernel = kernels[round(d * len(kernels) / D) % len(kernels)]
                    reach = {}
                    for dy in range(-S, S + 1):
                        for dx in range(-S, S + 1):
                            ty, tx = y + dy + by, x + dx + bx
                            if 0 <= ty < h and 0 <= tx < w and free[ty, tx] and kernel[dy + S, dx + S] > 0:
                                reach[dy, dx, ty, tx] = kernel[dy + S, dx + S]
                    total = sum(reach.values())
                    out[d, y, x] = [(e, ty, tx, v / total * masks[e, dy + S, dx + S]) for (dy, dx, ty, tx), v in reach.items() for e in range(D) if masks[e, dy + S, dx + S] > 0]
        return out

    steps = [moves(t) for t in range(1, T)]
    ahead = [first]
    for m in steps:
        now = np.zeros_like(first)
        for (d, y, x), to in m.items():
            if ahead[-1][d, y, x]:
                for e, ty, tx, v in to:
                    now[e, ty, tx] += ahead[-1][d, y, x] * v
        ahead.append(now)
    back = np.zeros_like(first)
    back[:, end[1], end[0]] = 1
    for t in range(T - 1, at, -1):
        before = np.zeros_like(first)
        for (d, y, x), to in steps[t - 1].items():
            before[d, y, x] = sum(v * back[e, ty, tx] for e, ty, tx, v in to)
        back = before
    both = (ahead[at] * back).sum(0)
    return both / both.sum()


def _terrain():
    rng = np.random.default_rng(3)
    grid = rng.choice([10, 30, 80], size=(6, 7), p=[0.45, 0.4, 0.15])
    grid[1, 1] = grid[4, 5] = 30
    return B.terrain_field(grid, {10: K.KernelParams(S=1), 30: K.KernelParams(False, 2, 4), 80: K.KernelParams(S=1, forbidden=True)})


@pytest.mark.parametrize("field", [
    B.correlated_field(7, 6, 4, 1), B.biased_field(7, 6, [(t % 2, 0) for t in range(6)], 1), _terrain(),
    B.terrain_field(np.full((6, 7), 10), {10: K.KernelParams(S=1)}, biases=[(0, t % 2) for t in range(6)]),
    B.terrain_field(np.full((6, 7), 10), {10: K.KernelParams(S=2)}, kernels={10: np.ones((1, 3, 3)) / 9}),
])
def test_walks_have_the_distribution_of_all_paths(field):
    start, end, T, at, n = (1, 1), (5, 4), 6, 3, 2500
    want = occupancy(field, start, end, T, at)
    got = Counter(B.walk(field, start, end, T, (k,))[at] for k in range(n))
    share = np.array([[got[x, y] / n for x in range(7)] for y in range(6)])
    assert np.abs(share - want).max() < 0.045 and not share[want == 0].any()


def test_layers(spark, tmp_path):
    field = B.brownian_field(9, 8, 1)
    rows = list(B.layers(field, (4, 4), 4))
    assert all(math.isclose(sum(p for t, *_, p in rows if t == k), 1) for k in range(4))
    starts = spark.createDataFrame([("a", 0, 4, 4, 4), ("a", 1, 0, 0, 3)], "animal_id string, seg int, x0 int, y0 int, T int")
    writers.layers(B.layer_tables(starts, lambda row: field), str(tmp_path / "dp"))
    back = readers.layers(spark, str(tmp_path / "dp"), 3).where("seg = 0")
    assert {(r.d, r.x, r.y): round(r.p, 12) for r in back.collect()} == {(d, x, y): round(p, 12) for t, d, x, y, p in rows if t == 3}


def test_terrain_in_tiles(spark):
    """Each segment meets the cells it can reach; a walk through them is one through the whole terrain."""
    rng = np.random.default_rng(5)
    grid = rng.choice([10, 30, 80], size=(90, 140), p=[0.5, 0.45, 0.05])
    ends = [(20, 20, 26, 24), (60, 62, 66, 66), (120, 80, 131, 85), (5, 5, 5, 5), (100, 10, 104, 70)]
    for x0, y0, x1, y1 in ends:
        grid[y0, x0] = grid[y1, x1] = 10
    grid[15, 40] = 80
    mapping = {10: K.KernelParams(S=2), 30: K.KernelParams(False, 1, 4), 80: K.KernelParams(S=1, forbidden=True)}
    terrain = spark.createDataFrame([(x, y, int(grid[y, x])) for y in range(90) for x in range(140)], "x int, y int, cls int")
    rows = [("a", k, *e, 1 if e[:2] == e[2:] else 20) for k, e in enumerate(ends)] + [("b", 0, 38, 15, 40, 15, 9)]
    segments = spark.createDataFrame(rows, "animal_id string, seg int, x0 int, y0 int, x1 int, y1 int, T int")
    got = B.terrain_bridge(segments, terrain, mapping).toPandas()
    status = {(r.animal_id, r.seg): r.status for r in got.itertuples()}
    assert [status["a", k] for k in range(5)] == ["OK", "OK", "OK", "OK", "UNREACHABLE"] and status["b", 0] == "UNREACHABLE"
    for k, (x0, y0, x1, y1) in enumerate(ends[:4]):
        path = got[(got.animal_id == "a") & (got.seg == k)].sort_values("t")
        cells = list(zip(path.x.astype(int), path.y.astype(int), strict=True))
        assert cells[0] == (x0, y0) and cells[-1] == (x1, y1) and len(cells) == rows[k][-1]
        assert all(grid[y, x] != 80 for x, y in cells)


def test_biased_multistep(spark):
    steps = walks.points(spark, [(10, 10), (22, 12), (15, 25)])
    got = walks.multistep_biased(steps, [[(1, 0)] * 12, [(0, 1)] * 15], 40, 40, 3).orderBy("seg", "t").collect()
    assert len(got) == 11 + 14 + 1 and (got[0].x, got[0].y, got[11].x, got[11].y, got[-1].x, got[-1].y) == (10, 10, 22, 12, 15, 25)
    with pytest.raises(ValueError):
        walks.multistep_biased(steps, [[(1, 0)] * 12], 40, 40, 3).count()


@pytest.mark.parametrize("field", [B.correlated_field(30, 30, 6, 3), B.terrain_field(np.full((30, 30), 30), K.default_mapping("mixed", "MEDIUM", 3))])
def test_multistep_of_fields(spark, field):
    steps = walks.points(spark, [(10, 10), (20, 20), (5, 25)])
    got = walks.multistep(steps, 20, field, keep_both=False).orderBy("seg", "t").collect()
    assert len(got) == 2 * 19 and (got[0].x, got[0].y, got[19].x, got[19].y) == (10, 10, 20, 20)


def test_weather_rule_has_no_cut():
    p = walks.by_weather(K.KernelParams(), (40.0, 200.0, 50.0, 0.0))
    assert (p.S, p.D, p.diffusity) == (20, 4, 0.5)


def test_plot_and_weather_files(spark, tmp_path):
    walk = spark.range(250_000).selectExpr("cast(id % 3 as string) as animal_id", "0 as seg", "cast(id as int) as t", "1 as x", "1 as y")
    assert writers.plot_frame(walk).count() == 250_000
    fixes = fx.fixes(spark, "/root/testdata/sf0.001").where("lon is not null").selectExpr("*", "1.5 as temperature")
    writers.weather_track_csv(fixes, str(tmp_path / "w"))
    back = spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "w"))
    assert back.count() == fixes.count() and back.where("index = 0").count() == fixes.select("animal_id").distinct().count()
    daily = readers.covariate_csv(spark, str(tmp_path / "w"), "lat", "lon", "ts")
    assert {"lat", "lon", "ts", "temperature"} <= set(daily.columns)
    with pytest.raises(ValueError):
        readers.covariate_csv(spark, str(tmp_path / "w"), "no", "lon", "ts")
    writers.kernel_data(spark.createDataFrame([("a", 0, 1.5)], "animal_id string, t int, S double"), str(tmp_path / "k"))
    assert spark.read.option("header", True).csv(str(tmp_path / "k")).first().animal_id == "a"
