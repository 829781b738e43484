"""Trackers against a plain frame-by-frame loop, in one and in many blocks."""

from __future__ import annotations

import math
import random

import numpy as np

from skysift.operators.ordering import runs
from skysift.operators.tracking import NearestWalk, track, track_simple

DET = "mission_id long, frame_idx long, det_id long, class_name string, conf double, x1 long, y1 long, x2 long, y2 long, cx long, cy long"


def make(rows, spark):
    full = [(1, f, i, c, p, *b, (b[0] + b[2]) // 2, (b[1] + b[3]) // 2) for i, (f, c, p, b) in enumerate(rows)]
    return full, spark.createDataFrame(full, DET)


def walk(seed: int, frames: int = 40):
    rng = random.Random(seed)
    objects = [(rng.choice(["person", "vehicle", "boat"]), rng.randrange(1500), rng.randrange(800)) for _ in range(6)]
    rows = []
    for f in range(frames):
        for k, (c, x, y) in enumerate(objects):
            objects[k] = (c, x + rng.randrange(-40, 60), y + rng.randrange(-30, 40))
            if rng.random() < 0.7:
                cls = c if rng.random() < 0.9 else "vehicle"
                x, y = objects[k][1], objects[k][2]
                rows.append((f, cls, rng.randrange(100) / 100.0, (x, y, x + 40 + k, y + 60)))
    return rows


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    area = lambda q: (q[2] - q[0]) * (q[3] - q[1])
    return w * h / max(1.0, area(a) + area(b) - w * h)


def loop(full):
    live, ids, next_id = [], {}, 1
    for frame in sorted({r[1] for r in full}):
        dets = sorted((r for r in full if r[1] == frame), key=lambda r: (r[3] != "person", -r[4], -r[2]))
        pairs = []
        for ti, t in enumerate(live):
            missed = frame - t["last"]
            if missed > 5:
                continue
            for di, d in enumerate(dets):
                o, dist = iou(t["box"], d[5:9]), math.hypot(t["c"][0] - d[9], t["c"][1] - d[10])
                same = t["cls"] == d[3]
                if same and d[3] == "person":
                    reach = 250 + 30 * max(0, missed - 1)
                    if dist <= reach:
                        pairs.append((-(max(o, max(0.0, 1 - dist / reach)) + 0.25), ti, di))
                elif same or not (o < 0.2 and dist > 45):
                    score = max(o, 0.5 * max(0.0, 1 - dist / 200)) + (0.15 if same else 0)
                    if score > 0.15:
                        pairs.append((-score, ti, di))
        used_t, used_d = set(), set()
        for _, ti, di in sorted(pairs):
            if ti in used_t or di in used_d:
                continue
            used_t.add(ti), used_d.add(di)
            t, d = live[ti], dets[di]
            t.update(box=d[5:9], c=(d[9], d[10]), last=frame, n=t["n"] + 1)
            ids[d[2]] = (t["id"], t["n"])
        for di, d in enumerate(dets):
            if di not in used_d:
                live.append({"id": next_id, "box": d[5:9], "c": (d[9], d[10]), "cls": d[3], "last": frame, "n": 1})
                ids[d[2]] = (next_id, 1)
                next_id += 1
    return ids


def test_tracker_matches_loop(spark):
    for seed in (1, 2):
        full, det = make(walk(seed), spark)
        want = loop(full)
        for batch in (10_000, 7):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            got = {r.det_id: (r.track_id, r.track_length) for r in track(det.repartition(3)).collect()}
            assert got == want
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_tracker_cuts_at_pauses(spark):
    """Pauses of exactly the idle limit keep a track, longer ones end it; segments walk apart."""
    rows = [(f + shift, *rest) for shift in (0, 45, 96, 5000) for f, *rest in walk(5)]
    full, det = make(rows, spark)
    want = loop(full)
    got = {r.det_id: (r.track_id, r.track_length) for r in track(det).collect()}
    assert got == want
    segments = {(r.frame_idx, r.segment) for r in runs(det, ["mission_id"], "frame_idx", 5, "segment", size=16).collect()}
    begins, last = {}, None
    for f in sorted({r[1] for r in full}):
        begins[f] = f if last is None or f - last > 5 else begins[last]
        last = f
    assert segments == set(begins.items()) and len({s for _, s in segments}) >= 3


def test_track_survives_missed_frames(spark):
    _, det = make([(0, "person", 0.5, (100, 100, 120, 150)), (3, "person", 0.5, (108, 106, 128, 156))], spark)
    rows = {r.frame_idx: r for r in track(det).collect()}
    assert rows[0].track_id == rows[3].track_id and rows[3].track_length == 2


def test_track_follows_fast_person(spark):
    _, det = make([(0, "person", 0.5, (200, 200, 220, 250)), (1, "person", 0.5, (340, 250, 360, 300))], spark)
    rows = {r.frame_idx: r for r in track(det).collect()}
    assert rows[0].track_id == rows[1].track_id
    assert rows[1].tracking_conf > rows[0].tracking_conf == 0.55


def simple_loop(full, legacy):
    tracks, ids, made = [], {}, {}
    for _, frame, det, cls, _, x1, y1, x2, y2, cx, cy in sorted(full, key=lambda r: (r[1], r[2])):
        best, top = None, -1.0
        for t in tracks:
            if t["cls"] != cls:
                continue
            a1, b1, a2, b2, ax, ay = t["box"]
            w, h = max(0, min(x2, a2) - max(x1, a1) + 1), max(0, min(y2, b2) - max(y1, b1) + 1)
            areas = (x2 - x1 + 1) * (y2 - (x1 if legacy else y1) + 1) + (a2 - a1 + 1) * (b2 - (a1 if legacy else b1) + 1)
            o, dist = w * h / (areas - w * h + 1e-6), math.hypot(cx - ax, cy - ay)
            if (o > 0.2 or dist < 60) and o + 1 / (1 + dist) > top:
                best, top = t, o + 1 / (1 + dist)
        if best is None:
            made[cls] = made.get(cls, 0) + 1
            best = {"cls": cls, "id": f"{cls.upper()}_{made[cls]:03d}"}
            tracks.append(best)
        best["box"] = (x1, y1, x2, y2, cx, cy)
        ids[det] = best["id"]
    return ids


def test_simple_tracker_matches_loop(spark):
    full, det = make(walk(3, 60), spark)
    for legacy in (False, True):
        got = {r.det_id: r.object_id for r in track_simple(det.repartition(3), legacy_iou=legacy).collect()}
        assert got == simple_loop(full, legacy)


def test_simple_tracker_looks_at_near_tracks_only():
    """With many tracks far apart, a detection meets those of its own surroundings."""
    walker = NearestWalk((1, "boat"), False)
    box = lambda x: (float(x), 0.0, x + 20.0, 20.0, x + 10.0, 10.0)
    for k in range(2000):
        columns = dict(zip(("x1", "y1", "x2", "y2", "cx", "cy"), (np.array([v]) for v in box(k * 400))))
        walker.take(columns | {"det_id": np.array([k])})
    assert len(walker.tracks) == 2000
    assert len(set().union(*(walker.cells.get(c, ()) for c in walker._cells(*box(40_000)[:4], 60.0)))) <= 2
