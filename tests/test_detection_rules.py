"""Rule regressions on single detections, and the invariants around them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skysift.functions.boxes import confidence_gate
from skysift.operators.detect import actionable, hard_case_counts, temporal_metrics, validate
from skysift.operators.incidents import vehicle_incidents

DET = "mission_id long, frame_idx long, det_id long, track_id long, raw_class string, conf double, x1 long, y1 long, x2 long, y2 long, water_overlap double"


def run(spark, cls, conf, box, overlap=None, history=()):
    track = 1 if history else None
    det = spark.createDataFrame([(1, 50, 1, track, cls, conf, *box, overlap)], DET)
    seen = spark.createDataFrame([(1, i, 100 + i, 1, c, p, 0, 0, 9, 9, None) for i, (c, p) in enumerate(history)], DET)
    return validate(det, temporal_metrics(seen)).first()


CASES = [
    ("truck", 0.22, (100, 100, 240, 200), None, "BUILDING", "building-like"),
    ("car", 0.35, (500, 400, 560, 420), None, "VEHICLE", "vehicle geometry"),
    ("boat", 0.40, (200, 300, 290, 320), 1.0, "BOAT", "water context"),
    ("car", 0.18, (700, 600, 750, 630), 1.0, "UNCERTAIN_OBJECT", "water reflection"),
    ("person", 0.14, (100, 200, 300, 215), None, "UNCERTAIN_OBJECT", "extreme aspect ratio"),
    ("building", 0.65, (300, 300, 420, 400), 0.40, "BUILDING", "persistent structural footprint"),
    ("person", 0.10, (10, 10, 25, 40), None, "PERSON", "valid aerial person"),
    ("car", 0.10, (10, 10, 70, 40), None, "UNCERTAIN_OBJECT", "below class threshold"),
]


@pytest.mark.parametrize("cls,conf,box,overlap,final,words", CASES)
def test_ladder(spark, cls, conf, box, overlap, final, words):
    row = run(spark, cls, conf, box, overlap)
    assert row.final_class == final
    assert words in row.validation_evidence.lower()
    assert (row.raw_class, row.conf) == (cls, conf)


HISTORY = [("car", 0.21), ("car", 0.32), ("building", 0.18), ("truck", 0.27), ("car", 0.30)]


def test_history(spark):
    seen = spark.createDataFrame([(1, i, i, 1, c, p, 0, 0, 9, 9, None) for i, (c, p) in enumerate(HISTORY)], DET)
    row = temporal_metrics(seen).first()
    assert (row.dominant_class, row.vote_ratio, row.switch_count) == ("vehicle", 0.8, 2)
    assert row.class_distribution == {"vehicle": 4, "building": 1}


def test_history_overrides(spark):
    row = run(spark, "building", 0.18, (14, 10, 66, 60), None, HISTORY)
    assert row.final_class == "VEHICLE" and row.is_changed


def test_unsteady_track_is_uncertain(spark):
    row = run(spark, "car", 0.5, (0, 0, 40, 20), None, [("car", 0.5), ("boat", 0.5), ("building", 0.5), ("person", 0.5)])
    assert row.final_class == "UNCERTAIN_OBJECT" and "oscillations" in row.validation_evidence


def test_first_seen_class_wins_ties(spark):
    seen = spark.createDataFrame([(1, i, i, 1, c, 0.5, 0, 0, 9, 9, None) for i, c in enumerate(["boat", "person", "person", "boat"])], DET)
    assert temporal_metrics(seen).first().dominant_class == "boat"


def test_confidence_gate(spark):
    det = spark.createDataFrame([("person", 0.12), ("car", 0.12)], "raw_class string, conf double")
    assert [r.raw_class for r in confidence_gate(det, 0.15, 0.08).collect()] == ["person"]


def test_uncertain_vehicle_makes_no_incident(spark):
    rows = [(1, 1, 1, 1, "UNCERTAIN_OBJECT", 0.4, 1.0, 1.0, 1.0, "NO_WATER"), (1, 1, 2, 1, "VEHICLE", 0.4, 1.0, 1.0, 1.0, "POTENTIAL_INUNDATION")]
    df = spark.createDataFrame(rows, "mission_id long, frame_idx long, det_id long, track_id long, final_class string, validation_conf double, x double, y double, z double, water_state string")
    assert [r.type for r in vehicle_incidents(df).collect()] == ["VEHICLE_IN_FLOOD"]
    assert actionable(df).count() == 1


def test_hard_case_counts_hold_zeros(spark):
    cases = spark.createDataFrame([("correct_boat",)], "category string")
    counts = {r.category: r.n for r in hard_case_counts(cases).collect()}
    assert len(counts) == 8 and counts["correct_boat"] == 1 and counts["false_boat"] == 0


def test_filter_after_validation_compiles(spark):
    """A filter on the final class must not pull the whole ladder into one method."""
    det = spark.createDataFrame([(1, 50, 1, None, "car", 0.5, 0, 0, 40, 20, 0.0)], DET)
    kept = validate(det, temporal_metrics(det)).filter(F.col("final_class") == "VEHICLE")
    assert kept.count() == 1
