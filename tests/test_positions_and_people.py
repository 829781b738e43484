"""Localisation, surroundings, fusion and risk on cases with known answers."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from skysift.functions.camera import grade_reprojection
from skysift.operators import cloud, depth, flood, localize, rescue

CAM = ("mission_id long, frame_idx long, r00 double, r01 double, r02 double, r10 double, r11 double, r12 double, r20 double, r21 double, "
       "r22 double, t0 double, t1 double, t2 double, fx double, fy double, cx double, cy double, img_w int, img_h int, model_w int, model_h int")


def camera(spark, f, c, img, model, shift=(0.0, 0.0, 0.0)):
    return spark.createDataFrame([(1, 1, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, *shift, f, f, c, c, *img, *model)], CAM)


def grade(spark, p, f=320.0, c=196.0):
    x, y, z = p
    safe = z if z > 0 else 1.0
    u, v = (f * x / safe + c) * 1920 / (2 * c), (f * y / safe + c) * 1080 / (2 * c)
    cam = camera(spark, f, c, (1920, 1080), (392, 392))
    return grade_reprojection(cam.withColumns({"x": F.lit(x), "y": F.lit(y), "z": F.lit(z), "u": F.lit(u), "v": F.lit(v)})).first()


def test_reprojection_of_known_points(spark):
    row = grade(spark, (2.5, 1.2, 8.0))
    assert row.reprojection_status == "HIGH_CONFIDENCE" and row.reprojection_error_px < 0.05 and row.camera_depth_m == 8.0
    assert grade(spark, (3.0, -1.5, 12.0), 300.0).reprojection_error_px < 0.01
    behind = grade(spark, (0.0, 0.0, -5.0))
    assert (behind.reprojection_status, behind.reprojection_error_px) == ("BEHIND_CAMERA", 999.0)


def localized(spark, value):
    det = spark.createDataFrame([(1, 1, 1, 0.8, 100, 100, 200, 300, 150.0, 200.0)],
                                "mission_id long, frame_idx long, det_id long, conf double, x1 long, y1 long, x2 long, y2 long, u double, v double")
    raster = spark.range(518 * 518).select(
        F.lit(1).cast("long").alias("mission_id"), F.lit(1).cast("long").alias("frame_idx"),
        F.floor(F.col("id") / 518).alias("r"), (F.col("id") % 518).alias("c"), F.lit(value).alias("depth"),
    )
    return localize.localize(det, raster, camera(spark, 500.0, 259.0, (518, 518), (518, 518))).first()


def test_localize_with_and_without_depth(spark):
    row = localized(spark, 5.0)
    assert row.location_status == "LOCALIZED_3D" and row.z_m == 5.0 and row.reprojection_error_px == 0.0
    lost = localized(spark, 0.0)
    assert lost.location_status == "UNLOCALIZED" and (lost.x_m, lost.y_m, lost.z_m) == (None, None, None)


def test_lookup_rings_and_failure(spark):
    det = spark.createDataFrame([(1, 1, 1, 10.0, 10.0)], "mission_id long, frame_idx long, det_id long, u double, v double")
    cam = camera(spark, 20.0, 10.0, (20, 20), (20, 20))
    none = spark.createDataFrame([], "mission_id long, frame_idx long, r long, c long, depth double")
    schema = "mission_id long, frame_idx long, r long, c long, px double, py double, pz double"

    def look(rows):
        return localize.lookup(det, spark.createDataFrame(rows, schema), none, cam).first()

    hit = look([(1, 1, 10, 10, 1.5, -0.5, 4.2)])
    assert (hit.status, hit.x_m, hit.y_m, hit.z_m) == ("DIRECT_HIT", 1.5, -0.5, 4.2)
    near = look([(1, 1, 12, 10, 2.0, -1.0, 5.0), (1, 1, 10, 12, 2.1, -0.9, 5.1), (1, 1, 15, 10, 9.0, 9.0, 9.0)])
    assert (near.status, near.x_m, near.y_m, near.z_m) == ("NEIGHBORHOOD_5x5", 2.05, -0.95, 5.05)
    lost = look([(1, 1, 10, 10, 0.0, 0.0, 0.0)])
    assert (lost.status, lost.x_m) == ("FAILED", None)


def test_position_consensus(spark):
    rows = [(1, 1, f, "LOCALIZED_3D", x, y, 3.0, 1.0, 0.5) for f, x, y in ((1, 1.0, 2.0), (2, 1.1, 2.1), (3, 0.9, 1.9))]
    rows += [(1, 1, 4, "LOCALIZED_3D", 40.0, 2.0, 3.0, 1.0, 0.5), (1, 2, 1, "UNLOCALIZED", None, None, None, None, 0.5)]
    obs = spark.createDataFrame(rows, "mission_id long, track_id long, frame_idx long, location_status string, x_m double, y_m double, z_m double, reprojection_error_px double, conf double")
    out = {r.track_id: r for r in localize.fuse_positions(obs).collect()}
    assert out[1].x_m == 1.0 and out[1].source_frames == [1, 2, 3, 4] and out[1].observation_count == 4
    assert out[2].location_status == "UNLOCALIZED" and out[2].x_m is None and out[2].confidence is None


def raster(spark, size, wet):
    return spark.range(size * size).select(
        F.lit(1).cast("long").alias("mission_id"), F.lit(1).cast("long").alias("frame_idx"),
        F.floor(F.col("id") / size).alias("r"), (F.col("id") % size).alias("c"), F.lit(10.0).alias("depth"),
    ).withColumn("is_water", wet)


def person(spark):
    return spark.createDataFrame([(1, 1, 1, 240, 240, 260, 260)], "mission_id long, frame_idx long, det_id long, rx1 long, ry1 long, rx2 long, ry2 long")


def test_person_on_island_and_on_dry_ground(spark):
    island = ~(F.col("r").between(230, 269) & F.col("c").between(230, 269))
    row = flood.person_context(person(spark), raster(spark, 500, island), (500, 500)).first()
    assert row.classification == "POTENTIAL_STRANDED_PERSON" and row.surrounding_flood_pct > 70
    assert row.flood_distance_px == 20.0
    dry = flood.person_context(person(spark), raster(spark, 500, F.lit(False)), (500, 500)).first()
    assert (dry.classification, dry.surrounding_flood_pct, dry.flood_distance_px) == ("NORMAL_PERSON", 0.0, 999.0)


def test_flood_state_of_half_flooded_frame(spark):
    boxes = spark.createDataFrame([], "mission_id long, frame_idx long, det_id long, class_name string, rx1 long, ry1 long, rx2 long, ry2 long")
    half = flood.flood_state(raster(spark, 100, F.col("r") >= 50), boxes).first()
    assert half.water_state == "VALIDATED_INUNDATION" and half.water_ratio == 0.5 and half.largest_component_ratio == 0.5
    strip = flood.flood_state(raster(spark, 100, F.col("r").between(40, 49)), boxes).first()
    assert strip.water_state == "WATER_BODY" and strip.incident_gate == "FAIL"
    assert flood.flood_state(raster(spark, 100, F.lit(False)), boxes).first().water_state == "NO_WATER"


PERSON = ("mission_id long, frame_idx long, det_id long, track_id long, conf double, x1 long, y1 long, x2 long, y2 long, u double, v double, x double, y double, z double, "
          "reprojection_error_px double, surrounding_flood_pct double, isolation_score double, elevation_context string, flood_proximity string")


def test_fusion_of_three_frames(spark):
    rows = [
        (1, f, f, 1, c, 0, 0, 10, 10, 5.0, 5.0, 1.0, 2.0, 3.0, e, w, s, "ELEVATED_STRUCTURE", "HIGH")
        for f, c, e, w, s in ((0, 0.90, 2.1, 75.0, 0.80), (1, 0.92, 1.9, 80.0, 0.82), (2, 0.91, 2.3, 78.0, 0.81))
    ]
    (t,) = rescue.fuse_tracks(spark.createDataFrame(rows, PERSON)).collect()
    assert (t.observation_count, t.rescue_priority, t.localization_status, t.person_confidence) == (3, "HIGH", "LOCALIZED_3D", 0.91)
    assert t.target_id == "PERSON #01" and t.best_reprojection_error_px == 1.9 and t.is_validated


def test_triage_order(spark):
    rows = [(1, 1, 2, 2, 0.80, None, None, "NORMAL_PERSON", 0.0, 0.0), (1, 1, 1, 1, 0.85, 1.0, 2.0, "POTENTIAL_STRANDED_PERSON", 90.0, 2.0)]
    df = spark.createDataFrame(rows, "mission_id long, frame_idx long, det_id long, track_id long, conf double, x double, reprojection_error_px double, isolation_type string, surrounding_flood_pct double, elevation_relative_m double")
    ranked = rescue.rank_priorities(df).orderBy("rank").collect()
    assert [(r.det_id, r.rescue_priority) for r in ranked] == [(1, "HIGH"), (2, "LOW")]


def test_scene_risk_without_people(spark):
    scene = spark.createDataFrame([(1, 0.30, True, 0, 0)], "mission_id long, flood_ratio double, is_active boolean, people long, high long")
    row = rescue.scene_risk_ratio(scene).first()
    assert row.risk_level in ("HIGH", "CRITICAL") and any("30.0%" in r for r in row.risk_reasons)


def test_depth_alignment_recovers_line(spark):
    rng = random.Random(7)
    rows = []
    for i in range(2500):
        mono = rng.uniform(0.5, 5.0)
        rows.append((1, 1, 3.5 * mono + 0.8 + (30.0 if i % 50 == 0 else 0.0), mono, 2.0))
    df = spark.createDataFrame(rows, "mission_id long, frame_idx long, depth double, mono_depth double, depth_conf double")
    line = depth.align_depth(df)
    row = line.first()
    assert abs(row.scale - 3.5) < 0.2 and abs(row.shift - 0.8) < 0.2
    stats = depth.consistency_stats(depth.consistency(depth.apply_alignment(df, line))).first()
    assert stats.high_consistency_pct > 80


def test_scene_quality_of_good_and_flat_cloud(spark):
    pts = spark.range(60000).select(
        F.lit(1).cast("long").alias("scene_id"), F.col("id").alias("point_id"),
        *[(F.rand(s) * 10 - 5).alias(c) for s, c in ((1, "x"), (2, "y"), (3, "z"))],
    )
    cams = None
    for i in range(4):
        one = camera(spark, 300.0, 196.0, (1920, 1080), (392, 392), (0.4 * i, 0.0, 0.0)).withColumn("frame_idx", F.lit(i).cast("long"))
        cams = one if cams is None else cams.unionByName(one)
    cams = cams.withColumnRenamed("mission_id", "scene_id")
    depths = spark.createDataFrame([(1, 1.0)], "scene_id long, valid_ratio double")
    good = cloud.scene_quality(pts, cams, depths).first()
    assert good.geometry_status in ("GOOD", "ACCEPTABLE") and good.geometry_quality_score > 60 and good.localization_allowed
    flat = cloud.scene_quality(pts.withColumn("z", F.lit(1.0)), cams, depths).first()
    assert flat.geometry_status == "INVALID" and not flat.localization_allowed


def test_quaternion_is_unit(spark):
    from skysift.functions.camera import to_quaternion

    turn = camera(spark, 1.0, 1.0, (1, 1), (1, 1)).withColumns(
        {"r00": F.lit(-1.0), "r11": F.lit(-1.0), "r22": F.lit(1.0)}
    )
    q = to_quaternion(turn).first()
    assert math.isclose(q.qw**2 + q.qx**2 + q.qy**2 + q.qz**2, 1.0) and math.isclose(abs(q.qz), 1.0)


def test_targets_of_equal_state_keep_the_order_of_their_numbers(spark):
    rows = [(1, f"PERSON #{i}", "PERSON LOCALIZED", "LOW", 0.5) for i in range(1, 131)]
    df = spark.createDataFrame(rows, "mission_id long, target_id string, detection_state string, rescue_priority string, isolation_score double")
    got = [r.target_id for r in rescue.order_targets(df).orderBy("target_rank").collect()]
    assert got == [r[1] for r in rows]


def test_small_scenes_pass_the_outlier_stages(spark):
    rows = [(1, i, float(i), 0.0, 0.0) for i in range(8)] + [(2, i, float(i), 0.0, 0.0) for i in range(30)]
    df = spark.createDataFrame(rows, "scene_id long, point_id long, x double, y double, z double")
    got = cloud._beyond(df, 10, lambda p: p.limit(0))
    assert {(r.scene_id, r.point_id) for r in got.collect()} == {(1, i) for i in range(8)}
