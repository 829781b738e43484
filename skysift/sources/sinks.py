"""Sinks: incident, priority and detection exports, poses, text reconstructions.

Every sink writes a folder of part files; nothing passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.functions.camera import camera_centre, to_quaternion
from skysift.functions.numeric import clip, fixed, half_even
from skysift.operators.cloud import cap_points
from skysift.operators.ordering import BLOCK, numbered
from skysift.sources.versioned import latest

MISSING = "N/A"


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(MISSING))


def incident_csv_rows(inc: DataFrame) -> DataFrame:
    """Eleven flat columns of an incident; a missing location reads ``N/A``."""
    plain = {"incident_type": "type", "severity": "severity", "confidence": "confidence", "source_frame_id": "source_frame_id"}
    return inc.select(
        "incident_id",
        *[F.col(source).cast("string").alias(name) for name, source in plain.items()],
        *[_text(F.col(c)).alias(f"world_{c}") for c in "xyz"],
        F.col("flood_context").alias("flood_status"),
        F.col("evidence").alias("summary"),
        F.col("timestamp").cast("string").alias("timestamp"),
    )


def priority_csv_rows(people: DataFrame) -> DataFrame:
    return people.select(
        *[F.col(c).cast("string").alias(c) for c in ("victim_id", "track_id", "frame_id", "rescue_priority", "priority_score")],
        _text(F.col("isolation_type")).alias("isolation_type"),
        F.coalesce("surrounding_flood_pct", F.lit(0.0)).cast("string").alias("surrounded_pct"),
        _text(F.col("nearest_water_distance_m")).alias("nearest_water_dist_m"),
        *[_text(half_even(F.col(c), 2)).alias(f"world_{c}") for c in "xyz"],
        F.col("recommended_action").alias("rationale"),
    )


def detection_csv_rows(det: DataFrame) -> DataFrame:
    return det.select(
        F.col("det_id").cast("string").alias("detection_id"), "class_name",
        half_even(F.col("conf"), 3).cast("string").alias("confidence"),
        F.col("frame_idx").cast("string").alias("frame_idx"),
        *[half_even(F.col(c).cast("double"), 1).cast("string").alias(f"bbox_{c}") for c in ("x1", "y1", "x2", "y2")],
        *[_text(half_even(F.col(c), 3)).alias(f"world_{c}") for c in "xyz"],
        (F.coalesce("tile_id", F.lit("full_frame")) != "full_frame").cast("string").alias("is_tiled"),
    )


def _write_csv(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(folder)


def write_incidents(inc: DataFrame, folder: str) -> None:
    inc.write.mode("overwrite").json(f"{folder}/incidents_json")
    _write_csv(incident_csv_rows(inc), f"{folder}/incidents_csv")


def write_priorities(people: DataFrame, folder: str) -> None:
    _write_csv(priority_csv_rows(people), f"{folder}/rescue_priorities")


def write_detections(det: DataFrame, folder: str) -> None:
    _write_csv(detection_csv_rows(det), f"{folder}/detected_objects")


def hard_case_records(cases: DataFrame) -> DataFrame:
    """Metadata record of each hard case; reads the crop of ``margin_box``."""
    return cases.select(
        F.format_string("frame_%04d.jpg", F.col("frame_idx")).alias("frame_id"), "frame_idx", "track_id",
        F.col("raw_class").alias("raw_yolo_class"), F.col("conf").alias("raw_yolo_confidence"),
        F.col("final_class").alias("validated_class"), F.col("validation_conf").alias("validation_confidence"),
        "validation_evidence", F.array("x1", "y1", "x2", "y2").alias("original_bbox"),
        F.array("crop_x1", "crop_y1", "crop_x2", "crop_y2").alias("cropped_bbox"), "image_width", "image_height", "category",
    )


def write_hard_cases(cases: DataFrame, folder: str) -> None:
    """One folder per category; the category also stays in every record."""
    rows = hard_case_records(cases).withColumn("_folder", F.col("category"))
    rows.write.mode("overwrite").partitionBy("_folder").json(folder)


def pose_records(cameras: DataFrame) -> DataFrame:
    centred = camera_centre(cameras)
    return centred.select(
        "mission_id", "frame_idx", F.array(*[half_even(F.col(c), 3) for c in ("px", "py", "pz")]).alias("position")
    )


def write_poses(cameras: DataFrame, folder: str) -> None:
    """Records with their mission in part files, one for each task; the number of files does not grow with the missions."""
    pose_records(cameras).write.mode("overwrite").json(folder)


def camera_lines(cameras: DataFrame) -> DataFrame:
    """``id PINHOLE w h fx fy cx cy`` per camera."""
    placed = numbered(cameras, ["mission_id"], F.floor(F.col("frame_idx") / BLOCK), [F.col("frame_idx")], "id")
    w, h = half_even(F.col("cx") * 2.0).cast("long"), half_even(F.col("cy") * 2.0).cast("long")
    usable = (w > 0) & (h > 0)
    size = lambda v: F.when(usable, v).otherwise(F.lit(518)).cast("string")
    line = F.concat_ws(" ", F.col("id").cast("string"), F.lit("PINHOLE"), size(w), size(h), *[F.col(c).cast("string") for c in ("fx", "fy", "cx", "cy")])
    return placed.select("mission_id", "id", line.alias("value"))


def image_lines(cameras: DataFrame) -> DataFrame:
    """``id qw qx qy qz tx ty tz camera name`` per image, then an empty line."""
    placed = numbered(to_quaternion(cameras), ["mission_id"], F.floor(F.col("frame_idx") / BLOCK), [F.col("frame_idx")], "id")
    numbers = [F.col(c).cast("string") for c in ("qw", "qx", "qy", "qz", "t0", "t1", "t2")]
    name = F.format_string("frame_%05d.jpg", F.col("frame_idx"))
    line = F.concat_ws(" ", F.col("id").cast("string"), *numbers, F.col("id").cast("string"), name)
    return placed.select("mission_id", "id", F.concat(line, F.lit("\n")).alias("value"))


def point_lines(points: DataFrame, cap: int | None = None, blocks: int = 1024) -> DataFrame:
    """``id x y z r g b 0.5`` per point; with ``cap`` a sample of at most so many of each scene."""
    kept = points if cap is None else cap_points(points, cap)
    span = kept.groupBy("scene_id").agg(F.min("point_id").alias("_lo"), F.max("point_id").alias("_hi"))
    ranged = kept.join(span, "scene_id")
    block = F.floor((F.col("point_id") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1) * blocks)
    placed = numbered(ranged, ["scene_id"], block, [F.col("point_id")], "id")
    shade = lambda c: F.floor(clip(F.col(c) * 255.0, 0.0, 255.0)).cast("string")
    line = F.concat_ws(" ", F.col("id").cast("string"), *[fixed(F.col(c), 6) for c in "xyz"], shade("red"), shade("grn"), shade("blu"), F.lit("0.5"))
    return placed.select("scene_id", "id", line.alias("value"))


def _write_lines(lines: DataFrame, key: str, folder: str) -> None:
    ordered = lines.repartitionByRange(key, "id").sortWithinPartitions(key, "id")
    ordered.select(key, "value").write.mode("overwrite").partitionBy(key).text(folder)


def write_colmap_text(points: DataFrame, cameras: DataFrame, folder: str, cap: int | None = None) -> None:
    """Text reconstruction: cameras, images and points, one folder per scene."""
    _write_lines(camera_lines(cameras), "mission_id", f"{folder}/cameras")
    _write_lines(image_lines(cameras), "mission_id", f"{folder}/images")
    _write_lines(point_lines(points, cap), "scene_id", f"{folder}/points3D")


def upsert_table(batch: DataFrame, current: str | None, target: str, key: str = "incident_id") -> None:
    """Write the latest row per key of table ``current`` and the batch to ``target``.

    The new version goes to its own folder, so a failed job leaves the old one whole.  For a table that grows,
    ``VersionedTable`` rewrites touched buckets only.
    """
    spark = batch.sparkSession
    old = spark.read.parquet(current) if current else batch.limit(0)
    latest(old, batch, key).write.mode("overwrite").partitionBy("mission_id").parquet(target)
