"""Row schemas of the tables the library reads and writes, as DDL text."""

from __future__ import annotations

FRAMES = (
    "mission string, path string, kind string, size_bytes long, frame_idx long, name string"
)

DETECTION = (
    "mission_id long, frame_idx long, frame_id string, det_id long, track_id long, raw_class string, class_name string, "
    "conf double, x1 long, y1 long, x2 long, y2 long, image_width int, image_height int, tile_id string"
)

HARD_CASE = (
    "frame_id string, frame_idx long, track_id long, raw_yolo_class string, raw_yolo_confidence double, "
    "validated_class string, validation_confidence double, validation_evidence string, original_bbox array<long>, "
    "cropped_bbox array<long>, image_width int, image_height int, category string"
)

INCIDENT_REPORT = (
    "mission_id long, seq long, frame_idx long, type string, track_id long, object_id string, confidence double, "
    "x double, y double, z double, reprojection_error_px double, rescue_priority string, ts timestamp"
)
