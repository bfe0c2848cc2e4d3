"""Walks drawn many at a time are those drawn one by one."""

import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trailweave.functions.kernels import gaussian
from trailweave.operators import bridge as B
from trailweave.operators import walks
from trailweave.plans import queries as plans
from trailweave.sources import fixtures as fx


def terrain(width, height):
    y, x = np.mgrid[:height, :width]
    return np.array([10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 100])[(x * 31 + y * 17 + (x * y) % 7) % 11]


def segments(n, width, height, open_, seed=3):
    rng = np.random.default_rng(seed)
    free = np.flatnonzero(open_.ravel())
    start, end = rng.choice(free[:12], n), rng.choice(free, n)
    far = abs(start % width - end % width) + abs(start // width - end // width)
    return start, end, np.maximum(5, far)


def drawn(field, start, end, T):
    heads = [repr((0, "a", i))[:-1].encode() for i in range(len(T))]
    size = field.width, field.height
    cells, reached = B.walk_many(B._Tables(walks.ByGrid(lambda width, height: field)), size, field.D, 0, start, end, T, None, heads)
    return [[(int(c) % size[0], int(c) // size[0]) for c in row[:t]] if ok else None for row, t, ok in zip(cells, T, reached, strict=True)]


def one_by_one(field, start, end, T):
    w = field.width
    return [B.walk(field, (int(s) % w, int(s) // w), (int(e) % w, int(e) // w), int(t), (0, "a", i)) for i, (s, e, t) in enumerate(zip(start, end, T, strict=True))]


FIELDS = {
    "brownian": lambda: B.brownian_field(15, 24, 3),
    "correlated": lambda: B.correlated_field(15, 24, 4, 3),
    "mixed": lambda: B.terrain_field(terrain(15, 24), fx.mapping()),
    "wide": lambda: B.brownian_field(30, 28, 3),
}


@pytest.mark.parametrize("name", FIELDS)
def test_same_walks(name):
    field = FIELDS[name]()
    some = segments(40, field.width, field.height, np.ones((field.height, field.width), bool) if field.open is None else field.open)
    assert drawn(field, *some) == one_by_one(field, *some)


@pytest.mark.parametrize("name", ["correlated", "mixed"])
def test_many_cost_less(name):
    """Segments of a start share their layers: a walk more costs little."""
    field = FIELDS[name]()
    some = segments(20, 15, 24, np.ones((24, 15), bool) if field.open is None else field.open)
    began = time.process_time()
    one_by_one(field, *some)
    alone = (time.process_time() - began) / 20
    many = segments(1000, 15, 24, np.ones((24, 15), bool) if field.open is None else field.open)
    began = time.process_time()
    drawn(field, *many)
    assert (time.process_time() - began) / 1000 < alone / 5


def test_closed_ends_and_large_grids(spark, monkeypatch):
    """Closed ends and what is out of reach say so; a grid too large for a table is walked segment by segment."""
    closed = terrain(15, 24)
    y, x = np.argwhere(closed == 80)[0].tolist()
    field = walks.ByGrid(lambda width, height: B.terrain_field(closed, fx.mapping()) if width == 15 else B.brownian_field(width, height, 1))
    rows = [("a", 0, x, y, 0, 0, 9, 15, 24), ("a", 1, 0, 0, 60, 60, 5, 80, 70), ("a", 2, 1, 1, 9, 9, 20, 80, 70), ("b", 0, 2, 2, 2, 2, 1, 15, 24)]
    frame = spark.createDataFrame(rows, "animal_id string, seg int, x0 int, y0 int, x1 int, y1 int, T int, width int, height int")
    got = B.bridge(frame, field).orderBy("animal_id", "seg", "t").collect()
    assert [(r.seg, r.t, r.status) for r in got if r.animal_id == "a" and r.seg < 2] == [(0, None, "UNREACHABLE"), (1, None, "UNREACHABLE")]
    assert [(r.x, r.y) for r in got if r.seg == 2] == B.walk(B.brownian_field(80, 70, 1), (1, 1), (9, 9), 20, (0, "a", 2))
    assert [(r.t, r.x, r.y, r.status) for r in got if r.animal_id == "b"] == [(0, 2, 2, "OK")]
    ends = B.bridge(frame, field, fallback=True).where("status = 'FALLBACK'").orderBy("seg", "t").collect()
    assert [(r.x, r.y) for r in ends] == [(x, y), (0, 0), (0, 0), (60, 60)]
    bad = spark.createDataFrame([("a", 0, 0, 0, 15, 3, 9, 15, 24)], frame.schema)
    with pytest.raises(Exception, match="outside the grid"):
        B.bridge(bad, field).collect()


def test_hours(spark):
    """Time walks drawn together are those of each segment's own field, whatever hours they share."""
    mapping, hour = fx.mapping(), 473352
    weather = {
        (hour + h, gy, gx): (((h * 7 + gy * 5) % 200) / 10, (h * 29 + gx * 17) % 360, (h * 19 + gx + gy) % 101, 0.5 if (h + gx * gy) % 6 == 0 else 0.0)
        for h in range(40) for gy in range(5) for gx in range(5)
    }
    land = terrain(15, 24)
    field = walks.ByHour(lambda width, height: land[:height, :width], mapping, weather)
    start, end, T = segments(24, 15, 24, land != 80)
    rng = np.random.default_rng(5)
    first = rng.integers(0, 20 * 3600, 24)
    rows = [
        {"animal_id": "a", "seg": i, "x0": int(s % 15), "y0": int(s // 15), "x1": int(e % 15), "y1": int(e // 15), "T": int(t), "width": 15, "height": 24,
         "ts0": pd.Timestamp((hour * 3600 + int(f)) * 10**9), "ts1": pd.Timestamp((hour * 3600 + int(f) + int(g)) * 10**9)}
        for i, (s, e, t, f, g) in enumerate(zip(start, end, T, first, rng.integers(60, 15 * 3600, 24), strict=True))
    ]
    labels = field.labels(pa.RecordBatch.from_pandas(pd.DataFrame(rows)))
    assert all(labels[r["seg"], : r["T"]].tolist() == walks.hours_of(r) for r in rows)
    want = {r["seg"]: B.walk(field(r), (r["x0"], r["y0"]), (r["x1"], r["y1"]), r["T"], (0, "a", r["seg"])) for r in rows}
    frame = spark.createDataFrame(pd.DataFrame(rows)).withColumns({c: F.col(c).cast("int") for c in ("seg", "x0", "y0", "x1", "y1", "T", "width", "height")})
    got = B.bridge(frame, field).toPandas().sort_values(["seg", "t"])
    for seg, part in got.groupby("seg"):
        path = list(zip(part["x"], part["y"], strict=True)) if (part["status"] == "OK").all() else None
        assert path == want[seg]
    assert set(got["seg"]) == set(want) and sum(p is not None for p in want.values()) > 12


def test_narrow_kernels():
    """A move of small weight is possible still: under clear sky and little wind a step has a deviation of a tenth of a cell."""
    for end in ((6, 8), (2, 8), (8, 8), (2, 16), (1, 9)):
        for bias in (0, 1):
            assert B.walk(B.brownian_field(14, 24, 1, gaussian(1, 0.1, bias)), (2, 11), end, 7) is not None
    (down, across), *more = B._profiles(gaussian(3, 0.3, 1).tobytes(), 7)
    assert not more and np.allclose(np.outer(down, across), gaussian(3, 0.3, 1), rtol=1e-12, atol=0)


def test_time_query_shares_moves():
    """``bridge_time`` is drawn by tables of an hour, not by a field a segment."""
    made = {}
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(plans, "bridge", lambda segments, field_of: made.setdefault("field", field_of))
        patch.setattr(plans, "_gridded", lambda *_: None)
        patch.setattr(plans, "terrain_array", lambda _: terrain(64, 48))
        patch.setattr(plans.fx, "terrain", lambda _: None)
        patch.setattr(plans.fx, "weather", lambda _: None)
        patch.setattr(walks, "weather_table", lambda _: {})
        plans.bridge_time(None, "")
    assert isinstance(made["field"], walks.ByHour)
