"""What the review of the first round found to be less than the whole job."""

import numpy as np
import pytest

from trailweave.plans import queries as plans


@pytest.mark.parametrize("name", ["bridge_correlated", "bridge_biased", "bridge_mixed", "bridge_time"])
def test_bridges_run_over_all_segments(spark, sf_dir, name):
    """Each segment of the tracks has its walk, with its number of points between its own fixes, or says that its end can't be reached."""
    want = {(r.animal_id, r.seg): r for r in plans._segments(spark, sf_dir).collect()}
    walk = plans.QUERIES[name](spark, sf_dir).toPandas()
    found = {k: g.sort_values("t") for k, g in walk.groupby(["animal_id", "seg"])}
    assert found.keys() == want.keys()
    for key, rows in found.items():
        s = want[key]
        if (rows["status"] == "UNREACHABLE").all():
            assert name != "bridge_correlated" and len(rows) == 1
            continue
        assert len(rows) == s.T
        x, y = rows["x"].tolist(), rows["y"].tolist()
        assert (x[0], y[0], x[-1], y[-1]) == (s.x0, s.y0, s.x1, s.y1)
    assert any((g["status"] == "OK").all() for g in found.values())


def test_terrain_under_a_grid():
    cut = plans._cut(np.arange(12).reshape(3, 4), 5, 2)
    assert cut.tolist() == [[0, 1, 2, 3, -1], [4, 5, 6, 7, -1]]
