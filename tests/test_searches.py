"""Searches around a place: nearest flag, clipped lookup, radii that differ, the origin, and bounded model calls."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from skysift.operators import detect, flood, localize, spatial


def test_nearest_flag_matches_all_pixels(spark):
    rng = random.Random(4)
    pixels, probes, want = [], [], {}
    for frame, share in enumerate((0.0, 0.004, 0.1, 0.9)):
        wet = [(r, c) for r in range(40) for c in range(60) if rng.random() < share]
        pixels += [(1, frame, r, c, (r, c) in set(wet)) for r in range(40) for c in range(60)]
        for k in range(25):
            r, c = rng.randrange(40), rng.randrange(60)
            probes.append((1, frame, 100 * frame + k, r, c))
            if wet:
                want[100 * frame + k] = min(((r - i) ** 2 + (c - j) ** 2) ** 0.5 for i, j in wet)
    image = spark.createDataFrame(pixels, "mission_id long, frame_idx long, r long, c long, is_water boolean").repartition(7)
    det = spark.createDataFrame(probes, "mission_id long, frame_idx long, det_id long, pr long, pc long")
    got = {r.det_id: r.flood_distance_px for r in flood.nearest_flag(det, image).collect()}
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k], rtol=0, atol=1e-12) for k in want)


def camera_row():
    return {"mission_id": 1, "frame_idx": 0, "r00": 1.0, "r01": 0.0, "r02": 0.0, "r10": 0.0, "r11": 1.0, "r12": 0.0, "r20": 0.0, "r21": 0.0, "r22": 1.0,
            "t0": 0.0, "t1": 0.0, "t2": 0.0, "fx": 100.0, "fy": 100.0, "cx": 20.0, "cy": 20.0, "img_w": 80, "img_h": 80, "model_w": 40, "model_h": 40}


def test_depth_is_read_inside_the_box_alone(spark):
    cameras = spark.createDataFrame(pd.DataFrame([camera_row()]))
    depth = spark.createDataFrame([(1, 0, 20, 18, 9.0), (1, 0, 20, 23, 5.0), (1, 0, 24, 20, 7.0)], "mission_id long, frame_idx long, r long, c long, depth double")
    none = spark.createDataFrame([], "mission_id long, frame_idx long, r long, c long, px double, py double, pz double")
    rows = [(1, 0, 1, 40.0, 40.0, 0, 0, 79, 79), (1, 0, 2, 40.0, 40.0, 40, 30, 60, 45), (1, 0, 3, 40.0, 40.0, 38, 46, 41, 60), (1, 0, 4, 40.0, 40.0, 0, 0, 4, 4), (1, 0, 5, 40.0, 40.0, None, None, None, None)]
    det = spark.createDataFrame(rows, "mission_id long, frame_idx long, det_id long, u double, v double, x1 long, y1 long, x2 long, y2 long")
    found = lambda box: {r.det_id: (r.sampled_depth_m, r.neighborhood_size) for r in localize.lookup(det, none, depth, cameras, box=box).collect()}
    assert set(found(None).values()) == {(9.0, 5)}
    assert found(("x1", "y1", "x2", "y2")) == {1: (9.0, 5), 2: (5.0, 9), 3: (7.0, 9), 4: (None, 0), 5: (9.0, 5)}


def test_points_win_over_depth_and_only_the_smallest_ring_counts(spark):
    cameras = spark.createDataFrame(pd.DataFrame([camera_row()]))
    depth = spark.createDataFrame([(1, 0, 20, 20, 3.0)], "mission_id long, frame_idx long, r long, c long, depth double")
    rows = [(1, 0, 20, 22, 1.0, 2.0, 3.0), (1, 0, 22, 20, 3.0, 4.0, 9.0), (1, 0, 20, 24, 50.0, 50.0, 50.0), (1, 0, 20, 20, 0.0, 0.0, 0.0)]
    points = spark.createDataFrame(rows, "mission_id long, frame_idx long, r long, c long, px double, py double, pz double")
    det = spark.createDataFrame([(1, 0, 1, 40.0, 40.0)], "mission_id long, frame_idx long, det_id long, u double, v double")
    (r,) = localize.lookup(det, points, depth, cameras).collect()
    assert (r.x_m, r.y_m, r.z_m, r.neighborhood_size, r.source) == (2.0, 3.0, 6.0, 5, "points")
    (r,) = localize.lookup(det, points.limit(0), depth, cameras).collect()
    assert (r.sampled_depth_m, r.status, r.source) == (3.0, "DIRECT_HIT", "depth")


def test_radii_that_differ_by_row_lose_no_pair(spark):
    rng = np.random.default_rng(3)
    xyz, radius = rng.random((150, 3)), rng.choice([0.05, 0.2, 0.4], 150)
    df = spark.createDataFrame([(1, i, *map(float, p), float(q)) for i, (p, q) in enumerate(zip(xyz, radius))], "scene_id long, point_id long, x double, y double, z double, q double")
    got = {(r.a, r.b) for r in spatial.radius_pairs(df, F.col("q")).collect()}
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(axis=2))
    assert got == {(i, j) for i in range(150) for j in range(150) if d[i, j] <= radius[i]}


def test_pairs_with_the_origin(spark):
    places = spark.createDataFrame([("T1", 3.0, 4.0, 0.0)], "id string, x double, y double, z double")
    cameras = spark.createDataFrame([("C1", 3.0, 4.0, 12.0)], "id string, x double, y double, z double")
    wanted = spark.createDataFrame([("ORIGIN", "T1"), ("C1", "ORIGIN"), ("T1", "C1"), ("ORIGIN", "ORIGIN"), ("T1", "nowhere")], "a string, b string")
    out = localize.measure_pairs(places, cameras, wanted)
    name = next(c for c in out.columns if "dist" in c)
    assert {(r.a, r.b): r[name] for r in out.collect()} == {("ORIGIN", "T1"): 5.0, ("C1", "ORIGIN"): 13.0, ("T1", "C1"): 12.0, ("ORIGIN", "ORIGIN"): 0.0}


def test_models_get_a_bounded_selection(spark):
    frames = spark.createDataFrame([(m, f) for m, n in ((1, 100), (2, 7)) for f in range(n)], "mission_id long, frame_idx long")
    sizes = lambda **how: {(r.mission_id, r.n) for r in detect.infer_mission_with(frames, lambda pdf: pd.DataFrame({"mission_id": pdf.mission_id[:1], "n": [len(pdf)]}), "mission_id long, n long", **how).collect()}
    assert sizes() == {(1, 24), (2, 7)} and sizes(most=5) == {(1, 5), (2, 5)}
    assert sizes(window=50) == {(1, 50), (2, 7)}
