"""Readers, writers and the stream."""

import datetime
import json
import time

import pytest
from pyspark.sql import functions as F

from trailweave.operators import landscape, track
from trailweave.sinks import writers
from trailweave.sources import fixtures as fx
from trailweave.sources import readers
from trailweave.streaming.segments import stream_segments


def test_study(spark, tmp_path):
    head = "event-id,visible,timestamp,location-long,location-lat,sensor-type,individual-taxon-canonical-name,tag-local-identifier,individual-local-identifier,study-name"
    (tmp_path / "a.csv").write_text(head + '\n1,true,2024-01-01 10:00:00.000,9.5,48.1,gps,Felis,0042,tom,"One, two"\n2,true,2024-01-01 11:00:00.000,,48.1,gps,Felis,0042,tom,x\n')
    got = readers.study(spark, str(tmp_path))
    assert [r.animal_id for r in got.collect()] == ["0042", "0042"] and track.valid(got).count() == 1
    (tmp_path / "b.csv").write_text(head)
    with pytest.raises(FileNotFoundError):
        readers.study(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        readers.study(spark, str(tmp_path / "none"))


def test_terrain(spark, tmp_path):
    writers.terrain_text(fx.terrain(spark), str(tmp_path / "t"))
    back = readers.terrain_text(spark, str(tmp_path / "t"))
    assert sorted(back.collect()) == sorted(fx.terrain(spark).select("x", "y", "cls").collect())
    (tmp_path / "c.txt").write_text("1,2,3,\n4,5,6,")
    assert readers.terrain_text(spark, str(tmp_path / "c.txt"), ",").count() == 6
    (tmp_path / "d.txt").write_text("1 2\n3")
    with pytest.raises(ValueError):
        readers.terrain_text(spark, str(tmp_path / "d.txt"))
    assert readers.constant_terrain(spark, 30, 4, 3).count() == 12


def test_weather_files(spark, tmp_path):
    head = "latitude,longitude,timestamp,temperature_2m,relative_humidity_2m,precipitation,wind_speed_10m,wind_direction_10m,snowfall,weather_code,cloud_cover"
    (tmp_path / "weather_grid_y1_x2.csv").write_text(head + "\n1.0,2.0,2024-01-01T05:00,3.5,50,0.0,7.2,180,0.0,1,40\n")
    row = readers.weather_grid(spark, str(tmp_path)).first()
    assert (row.gy, row.gx, row.wind_speed_10m, row.timestamp.hour) == (1, 2, 7.2, 5)
    answer = spark.createDataFrame([(1, json.dumps({"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "temperature_2m": [1.0]}}))], "k int, body string")
    got = readers.series_json(answer, "body").orderBy("ts").collect()
    assert [r.temperature_2m for r in got] == [1.0, None]


def test_walk_json(spark, tmp_path):
    walk = spark.createDataFrame([("a", 0, 1, 2, 3), ("a", 0, 0, 1, 1)], "animal_id string, seg int, t int, x int, y int")
    steps = spark.createDataFrame([("a", 0, 1, 1)], "animal_id string, seq int, x int, y int")
    text = writers.walk_json(walk, ["animal_id"], steps, fx.terrain(spark)).first().json
    doc = json.loads(text)
    assert doc["Walk"] == [{"x": 1, "y": 1}, {"x": 2, "y": 3}] and doc["Steps"] == [{"x": 1, "y": 1}] and len(doc["Terrain"]) == 48
    (tmp_path / "w.json").write_text(text)
    assert [tuple(r) for r in readers.walk_json(spark, str(tmp_path / "w.json")).orderBy("t").collect()] == [(0, 1, 1), (1, 2, 3)]


def test_map():
    page = writers.map_html(['{"geometry":{"coordinates":[[1,2],[3,4]]}}'])
    assert page.count("<circle") == 2 and "polyline" in page
    with pytest.raises(ValueError):
        writers.map_html([])


def test_kernels_round_trip(spark, tmp_path):
    frame = spark.range(10).selectExpr("cast(id % 2 as int) as t", "cast(id as int) as x", "0 as y", "1.0 as w")
    writers.kernels(frame, str(tmp_path / "k"))
    assert readers.kernels(spark, str(tmp_path / "k"), t=1, x=3).count() == 1


def test_retry():
    calls, waits = [], []

    def fetch():
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError
        return {"ok": 1}

    assert readers.with_retry(fetch, wait=waits.append) == {"ok": 1} and waits == [1.0, 2.0]
    with pytest.raises(PermissionError):
        readers.remote_credentials("NO_SUCH_USER", "NO_SUCH_PASSWORD")


def test_resample_outside(spark):
    with pytest.raises(ValueError):
        landscape.resample(fx.terrain(spark), (100, 200, 0, 5), 3, 3)


def test_degenerate_box(spark):
    one = spark.createDataFrame([(1, "a", "2024-01-01 00:00:00", 9.0, 48.0)], "event_id long, animal_id string, ts string, lon double, lat double").withColumn("ts", __import__("pyspark").sql.functions.to_timestamp("ts"))
    dims = track.dimensions(one, 10, 0.0).first()
    assert 0 < dims.lon_max - dims.lon_min < 2e-6 and max(dims.width, dims.height) == 10
    cell = track.to_cells(one, track.dimensions(one, 10)).first()
    assert 0 <= cell.x < 10 and 0 <= cell.y < 10


def run_stream(spark, tmp_path, files, delay, name):
    """Segments of batches of fixes ``(event_id, animal_id, ts, lon, lat)`` that come file by file."""
    kind = "event_id long, animal_id string, ts timestamp, lon double, lat double"
    for k, rows in enumerate(files):
        part = spark.createDataFrame(rows, kind).coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken in order of their times
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = stream_segments(stream, delay).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    return spark.table(name)


def test_stream_in_one_batch(spark, tmp_path, sf_dir):
    """All fixes of which the last hour has passed, and no other, are in segments as the window function gives them."""
    fixes = track.valid(fx.fixes(spark, sf_dir)).withColumn("ts", F.col("ts").cast("timestamp"))
    rows = [tuple(r) for r in fixes.select("event_id", "animal_id", "ts", "lon", "lat").collect()]
    got = {(r.animal_id, r.ts0, r.ts1) for r in run_stream(spark, tmp_path, [rows], "1 hour", "one").collect()}
    # Spark's watermark is in milliseconds
    end = max(r[2] for r in rows) - datetime.timedelta(hours=1)
    want, last = set(), {}
    for _, a, ts, _, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        if ts <= end and last.get(a) != ts:
            if a in last:
                want.add((a, last[a], ts))
            last[a] = ts
    assert got == want and len(got) > 500


def test_stream_out_of_order(spark, tmp_path):
    """A fix that comes a batch late within the delay is in its place; one beyond the delay is dropped; a silent animal's fixes go on."""
    at = lambda m: datetime.datetime(2024, 1, 1, 12) + datetime.timedelta(minutes=m)
    fix = lambda i, a, m: (i, a, at(m), float(m), 1.0)
    files = [
        [fix(1, "a", 0), fix(2, "a", 30), fix(3, "b", 0), fix(4, "b", 10)],
        [fix(5, "a", 15), fix(6, "a", 40)],  # 15 comes after 30
        [fix(7, "a", 200)],
        [fix(9, "a", 210)],
        [fix(8, "a", 20), fix(10, "c", 1000)],  # 20 is beyond the delay by then
    ]
    got = sorted((r.animal_id, r.seg, r.lon0, r.lon1) for r in run_stream(spark, tmp_path, files, "60 minutes", "late").collect())
    assert got == [("a", 0, 0.0, 15.0), ("a", 1, 15.0, 30.0), ("a", 2, 30.0, 40.0), ("a", 3, 40.0, 200.0), ("a", 4, 200.0, 210.0), ("b", 0, 0.0, 10.0)]
