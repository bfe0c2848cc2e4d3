"""Drawing walks of shared tables costs little beside them, and gives what one by one gives."""

import time

import numpy as np
import pyarrow as pa

from trailweave.operators import bridge as B
from trailweave.operators import track, walks
from trailweave.plans import queries as plans

SCHEMA = "animal_id string, seg int, x0 int, y0 int, x1 int, y1 int, T int, width int, height int"


def test_uniforms_of_many_keys():
    """All at once as one at a time, whatever the animal is called; texts beyond a block too."""
    animals = ["7", "wolf 3", "it's", 'a"b', "b\\c", "Bär", "x" * 36, "y" * 41, "z" * 42, "w" * 43, "v" * 200, "", None, "line\n", "k" * 47]
    segs = [0, 12345, 2, 3, 4, 5, 6, 7, 8, 9, 10, 2**31 - 1, 1, 2, 123]
    for some in (animals, animals[:2], animals[6:12]):
        keys = B._Keys.of(5, pa.array(some, pa.string()), pa.array(segs[: len(some)], pa.int32()))
        rows = np.arange(len(some))
        last = (rows * 37 + 1) % 120
        assert keys.uniforms(rows, last).tolist() == [B.uniform(5, some[i], segs[i], int(last[i])) for i in rows]
        assert keys.uniforms(rows, 9).tolist() == [B.uniform(5, a, s, 9) for a, s in zip(some, segs, strict=False)]
        back = keys.take(rows[::-1])
        assert back.uniforms(rows, "d").tolist() == [B.uniform(5, some[i], segs[i], "d") for i in rows[::-1]]


def test_a_point_costs_less_than_its_number():
    """The drawing of all points takes less time than one MD5 a point in Python, when many walks leave one cell."""
    field, rng, n = B.correlated_field(15, 24, 4, 3), np.random.default_rng(1), 20_000
    start, end = np.full(n, 7 * 15 + 6), rng.integers(0, 15 * 24, n)
    T = np.maximum(5, abs(end % 15 - 6) + abs(end // 15 - 7))
    heads = [repr((0, "a", i))[:-1].encode() for i in range(n)]
    tables = B._Tables(walks.ByGrid(lambda width, height: field))
    tables((15, 24), 4, 0, 0)
    began = time.process_time()
    cells, reached = B.walk_many(tables, (15, 24), 4, 0, start, end, T, None, heads)
    took = time.process_time() - began
    began = time.process_time()
    for i in range(n // 10):
        for t in range(T[i]):
            B.uniform(0, "a", i, t)
    assert reached.all() and (cells[np.arange(n), T - 1] == end).all() and (cells[:, 0] == start).all()
    assert took < 10 * (time.process_time() - began)


def test_pieces_of_long_walks(spark, monkeypatch):
    """However few points are drawn at a time, the walks are the same."""
    rng = np.random.default_rng(2)
    rows = [(f"a{i % 5}", i, 3, 4, int(x), int(y), int(t), 15, 24) for i, (x, y, t) in enumerate(zip(rng.integers(0, 15, 60), rng.integers(0, 24, 60), rng.integers(1, 40, 60), strict=True))]
    rows = [r if r[6] > 1 else (*r[:4], 3, 4, *r[6:]) for r in rows]
    frame = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    field = B.correlated_field(15, 24, 4, 3)
    want = {(r[0], r[1]): [(3, 4)] if r[6] == 1 else B.walk(field, r[2:4], r[4:6], r[6], (0, r[0], r[1])) for r in rows}

    def got():
        found = {}
        for r in B.bridge(frame, walks.ByGrid(lambda width, height: B.correlated_field(width, height, 4, 3))).orderBy("animal_id", "seg", "t").collect():
            found.setdefault((r.animal_id, r.seg), []).append((r.x, r.y) if r.status == "OK" else None)
        return {k: None if v == [None] else v for k, v in found.items()}

    assert got() == want and any(v is None for v in want.values())
    monkeypatch.setattr(B, "POINTS", 50)
    monkeypatch.setattr(B, "TABLE_MEMORY", 1 << 20)
    assert got() == want


def test_segments_keep_their_grid(spark, sf_dir):
    """A segment has its animal's grid without a second join, and only what a walk needs is dealt."""
    cells, dims = plans._cells(spark, sf_dir), plans._dims(spark, sf_dir).select("animal_id", "width", "height")
    got, want = plans._gridded(spark, sf_dir), track.segments(cells).join(dims, "animal_id")
    assert got.count() == want.count() and not got.exceptAll(want.select(got.columns)).take(1)
    fixes = {r["animal_id"]: r["count"] for r in cells.groupBy("animal_id").count().collect()}
    least = max(fixes.values())
    assert track.segments(cells, least).count() == sum(n - 1 for n in fixes.values() if n >= least) < got.count()
    plan = plans.bridge_correlated(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("Relation [") == 2
    dealt = next(line for line in plan[plan.index("MapInArrow") :].splitlines() if "Project [" in line)
    assert "ts0" not in dealt and "ts1" not in dealt
