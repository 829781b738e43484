"""Streams against the batch operators: restarts, repeated batches, late rows; and the stored tables behind them."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from skysift.operators import incidents
from skysift.operators.tracking import track
from skysift.sources.versioned import VersionedTable
from skysift.streaming import incidents as stream_incidents
from skysift.streaming import tracker

DET = "mission_id long, frame_idx long, det_id long, class_name string, conf double, x1 long, y1 long, x2 long, y2 long, cx long, cy long, ts timestamp"
ROW = "mission_id long, incident_id string, type string, version long"
REPORT = "mission_id long, seq long, frame_idx long, type string, track_id long, confidence double, x double, y double, z double, reprojection_error_px double"


def detections(frames=40, missions=3, seed=1):
    rng = random.Random(seed)
    start, rows = datetime.datetime(2024, 1, 1), []
    for m in range(1, missions + 1):
        spots = [(rng.choice(["person", "vehicle"]), rng.randrange(1500), rng.randrange(800)) for _ in range(5)]
        for f in range(frames):
            for k, (c, x, y) in enumerate(spots):
                x, y = x + rng.randrange(-20, 30), y + rng.randrange(-20, 30)
                spots[k] = c, x, y
                if rng.random() < 0.7:
                    ts = start + datetime.timedelta(seconds=f + rng.random() / 2)
                    rows.append((m, f, len(rows), c, rng.randrange(100) / 100.0, x, y, x + 40, y + 60, x + 20, y + 30, ts))
    return rows


def run(spark, source, out, state):
    stream = spark.readStream.schema(DET).parquet(source)
    query = tracker.track_stream(stream, "0 seconds").writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
    query.outputMode("append").trigger(availableNow=True).start().awaitTermination()


def test_tracker_stream_survives_restarts(spark, tmp_path):
    """Three runs from one checkpoint give the ids of one batch walk."""
    rows = detections()
    det = spark.createDataFrame(rows, DET)
    want = {(r.mission_id, r.det_id, r.track_id, r.track_length) for r in track(det).collect()}
    source, out, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    for low, high in ((0, 11), (11, 12), (12, 40)):
        part = det.filter(F.col("frame_idx").between(low, high - 1))
        part.repartition(2).write.mode("append").parquet(source)
        run(spark, source, out, state)
    seen = spark.read.parquet(out).count()
    assert 0 < seen < len(rows)  # the watermark has not passed the last frames
    last = spark.createDataFrame([(m, 10**6, None, None, None, *[None] * 6, datetime.datetime(2030, 1, 1)) for m in (9,)], DET)
    last.write.mode("append").parquet(source)
    run(spark, source, out, state)
    got = [(r.mission_id, r.det_id, r.track_id, r.track_length) for r in spark.read.parquet(out).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_upsert_keeps_files_of_untouched_buckets(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path), ROW, buckets=8)
    assert table.read().collect() == [] and table.manifest()["version"] == 0
    table.upsert(spark.createDataFrame([(m, "INC-001", "old", 1) for m in range(40)], ROW))
    before = table.manifest()["files"]
    one = spark.createDataFrame([(3, "INC-001", "new", 2), (3, "INC-002", "added", 1)], ROW)
    table.upsert(one)
    after = table.manifest()["files"]
    (bucket,) = table.touched(one)
    assert len(before) > 4 and set(before) == set(after)
    for name, files in before.items():
        assert (files == after[name]) == (name != str(bucket))
    got = {(r.mission_id, r.incident_id): r.type for r in table.read().collect()}
    assert got == {(m, "INC-001"): "old" for m in range(40)} | {(3, "INC-001"): "new", (3, "INC-002"): "added"}
    assert table.read(version=1).count() == 40
    table.expire(keep=1)
    assert {(r.mission_id, r.incident_id): r.type for r in VersionedTable(spark, str(tmp_path), ROW).read().collect()} == got
    with pytest.raises(ValueError, match="version 1"):
        table.read(version=1)


def test_upsert_orders_ties_and_applies_a_tag_once(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path), ROW, buckets=2)
    table.upsert(spark.createDataFrame([(1, "a", "z", 5), (1, "b", "z", 7), (1, "c", None, None)], ROW), tag=0)
    batch = spark.createDataFrame([(1, "a", "x", 5), (1, "a", "y", 5), (1, "b", "y", 6), (1, "c", "y", 0)], ROW)
    for _ in range(2):
        table.upsert(batch.repartition(4), tag=1)
    assert {r.incident_id: (r.type, r.version) for r in table.read().collect()} == {"a": ("y", 5), "b": ("z", 7), "c": ("y", 0)}
    assert table.manifest()["version"] == 2
    table.upsert(spark.createDataFrame([], ROW), tag=2)
    assert table.read().count() == 3 and table.applied == 2


def test_appended_files_stay_few(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path), ROW, buckets=1)
    for i in range(6):
        table.append(spark.createDataFrame([(1, f"i{i}", "t", i)], ROW), tag=i, most=3)
        table.append(spark.createDataFrame([(1, f"i{i}", "t", i)], ROW), tag=i, most=3)  # repeated
    assert sorted(r.version for r in table.read().collect()) == list(range(6))
    assert len(table.manifest()["files"]["0"]) <= 4 and table.applied == 5


def reports(n, missions, seed):
    rng = random.Random(seed)
    for i in range(n):
        place = [None] * 3 if rng.random() < 0.2 else [rng.randrange(60) / 4.0, rng.randrange(40) / 4.0, rng.randrange(8) / 4.0]
        yield (rng.randrange(missions), i, i // 4, rng.choice("AB"), rng.choice([None, 1, 2, 3]), 0.5 + rng.randrange(40) / 100.0, *place, float(rng.randrange(40)))


def test_incident_stream_equals_batch_merge(spark, tmp_path):
    """In order, late, repeated after a failure between the two tables: always the batch merge of what came."""
    rows = list(reports(300, 4, 2))
    batches = [rows[:100], rows[100:180], rows[200:260], rows[180:200] + rows[260:]]  # the last has late ones
    folder, came = str(tmp_path), []
    for number, part in enumerate(batches):
        came += part
        batch = spark.createDataFrame(part, REPORT).repartition(3)
        if number == 2:  # the reports were stored, then the job died
            stream_incidents.tables(spark, folder, batch, 8)[0].append(batch, number)
        for _ in range(2):
            stream_incidents.apply_batch(batch, number, folder, 8)
        want = incidents.merge_incidents(spark.createDataFrame(came, REPORT))
        got = stream_incidents.read_incidents(spark, folder).select(*want.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_incident_stream_leaves_other_missions_alone(spark, tmp_path):
    folder = str(tmp_path)
    stream_incidents.apply_batch(spark.createDataFrame(list(reports(200, 40, 3)), REPORT), 0, folder, 16)
    _, state = stream_incidents.tables(spark, folder, spark.createDataFrame([], REPORT), 16)
    before = state.manifest()["files"]
    batch = spark.createDataFrame([(7, 900, 100, "A", 1, 0.9, 1.0, 1.0, 1.0, 1.0)], REPORT)
    stream_incidents.apply_batch(batch, 1, folder, 16)
    after = state.manifest()["files"]
    assert {b for b in after if before.get(b) != after[b]} == {str(b) for b in state.touched(batch)}


def test_tracker_wakes_once_for_frames_that_pass_together(spark, tmp_path, monkeypatch):
    """Frames over several blocks, in any order, some late: the ids of the batch walk, and one timer a mission and watermark."""
    calls = tmp_path / "calls"
    calls.mkdir()
    plain = tracker.Tracker.handleExpiredTimer

    class Counted(tracker.Tracker):
        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            with open(f"{calls}/{key[0]}", "a") as f:
                f.write("x")
            yield from plain(self, key, timerValues, expiredTimerInfo)

    monkeypatch.setattr(tracker, "Tracker", Counted)
    rows = detections(frames=150, missions=2, seed=3)
    det = spark.createDataFrame(rows, DET)
    want = {(r.mission_id, r.det_id, r.track_id, r.track_length) for r in track(det).collect()}
    source, out, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    last = spark.createDataFrame([(9, 10**6, None, None, None, *[None] * 6, datetime.datetime(2030, 1, 1))], DET)
    for part in (det.filter("frame_idx >= 90"), det.filter("frame_idx < 90 AND det_id % 2 = 0"), det.filter("frame_idx < 90 AND det_id % 2 = 1"), last):
        part.repartition(2).write.mode("append").parquet(source)
    run(spark, source, out, state)
    got = [(r.mission_id, r.det_id, r.track_id, r.track_length) for r in spark.read.parquet(out).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {p.name: len(p.read_text()) for p in calls.iterdir()} == {"1": 1, "2": 1}
