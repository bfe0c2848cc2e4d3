"""Segments from a stream of fixes: the state is the last segment's end and the fixes that may still be preceded."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SEGMENTS = "animal_id string, seg int, ts0 timestamp, lon0 double, lat0 double, ts1 timestamp, lon1 double, lat1 double"
_STATE = "seg int, ts long, lon double, lat double, held_ts array<long>, held_id array<long>, held_lon array<double>, held_lat array<double>"
_COLUMNS = ["animal_id", "seg", "ts0", "lon0", "lat0", "ts1", "lon1", "lat1"]


def stream_segments(fixes: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each fix with the one before it in time, when the watermark has passed the fix.

    Fixes may come in any order within ``delay``: they are held until none
    can precede them, and go on by event time even if their animal sends
    nothing more.  Fixes later than ``delay`` are dropped by the watermark.
    Of fixes of one animal and time the first by ``event_id`` counts.  A
    key's state is its last fix and the fixes of the last ``delay``.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, held = None, []
        if state.exists:
            seg, ts, lon, lat, *lists = state.get
            last = None if seg is None or seg < 0 else (seg, ts, lon, lat)
            held = [tuple(x) for x in zip(*lists, strict=True)]
        if not state.hasTimedOut:
            for rows in batches:
                rows = rows.dropna(subset=["ts", "lon", "lat"])
                held += [(int(ts.value // 1000), int(i), float(lon), float(lat)) for ts, i, lon, lat in zip(rows["ts"], rows["event_id"], rows["lon"], rows["lat"], strict=True)]
        held.sort()
        passed = state.getCurrentWatermarkMs() * 1000
        out, left = [], []
        for ts, i, lon, lat in held:
            if ts > passed:
                left.append((ts, i, lon, lat))
            elif last is None or ts > last[1]:
                if last is not None:
                    out.append((key[0], last[0], pd.Timestamp(last[1], unit="us"), last[2], last[3], pd.Timestamp(ts, unit="us"), lon, lat))
                last = (0 if last is None else last[0] + 1, ts, lon, lat)
        lists = [list(c) for c in zip(*left, strict=True)] or [[], [], [], []]
        state.update((*(last or (-1, 0, 0.0, 0.0)), *lists))
        if left:
            state.setTimeoutTimestamp(max(left[0][0] // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=_COLUMNS).astype({"seg": "int32"})

    return fixes.withWatermark("ts", delay).groupBy("animal_id").applyInPandasWithState(step, SEGMENTS, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def daily_counts(fixes: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Fixes of each animal and day, when the watermark has passed the day."""
    from pyspark.sql import functions as F

    return fixes.withWatermark("ts", delay).groupBy("animal_id", F.window("ts", "1 day")).count()
