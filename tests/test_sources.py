"""Sources and sinks over files."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysift.sources import readers, sinks


def test_frame_manifest(spark, tmp_path):
    for mission, names in (("flight_a", ("b.jpg", "a.PNG", "notes.txt")), ("flight_b", ("z.mp4", "y.jpeg"))):
        (tmp_path / mission).mkdir()
        for name in names:
            (tmp_path / mission / name).write_bytes(b"x" * 10)
    rows = readers.read_frames(spark, str(tmp_path)).orderBy("mission", "frame_idx").collect()
    assert [(r.mission, r.path.rsplit("/", 1)[1], r.frame_idx) for r in rows] == [
        ("flight_a", "a.PNG", 0), ("flight_a", "b.jpg", 1), ("flight_b", "y.jpeg", 0), ("flight_b", "z.mp4", 1),
    ]
    assert rows[3].kind == "clip" and rows[0].size_bytes == 10 and rows[1].name == "frame_00001.jpg"


def test_hard_case_documents(spark, tmp_path):
    (tmp_path / "correct_boat").mkdir()
    (tmp_path / "correct_boat" / "one.json").write_text(
        '{\n "frame_id": "f.jpg", "frame_idx": 3, "track_id": 1, "raw_yolo_class": "boat",\n "original_bbox": [1, 2, 3, 4], "category": "correct_boat"\n}'
    )
    row = readers.read_hard_cases(spark, str(tmp_path)).first()
    assert (row.frame_idx, row.original_bbox, row.category) == (3, [1, 2, 3, 4], "correct_boat")


def test_upsert_keeps_latest(spark, tmp_path):
    schema = "mission_id long, incident_id string, type string, version long"
    first = spark.createDataFrame([(1, "INC-001", "A", 1), (1, "INC-002", "B", 2)], schema)
    second = spark.createDataFrame([(1, "INC-002", "C", 3), (2, "INC-001", "D", 4)], schema)
    one, two = str(tmp_path / "v1"), str(tmp_path / "v2")
    sinks.upsert_table(first, None, one)
    sinks.upsert_table(second, one, two)
    got = {(r.mission_id, r.incident_id): r.type for r in spark.read.parquet(two).collect()}
    assert got == {(1, "INC-001"): "A", (1, "INC-002"): "C", (2, "INC-001"): "D"}


def test_empty_incident_export_has_a_header_row(spark, tmp_path):
    empty = spark.createDataFrame([], "incident_id string, type string, severity string, confidence double, source_frame_id string, x double, y double, z double, flood_context string, evidence string, timestamp string")
    sinks.write_incidents(empty, str(tmp_path))
    texts = [p.read_text() for p in (tmp_path / "incidents_csv").glob("*.csv")]
    assert any(t.startswith("incident_id,incident_type,severity") for t in texts)


def test_missing_location_reads_na(spark):
    df = spark.range(1).select(
        F.lit("INC-001").alias("incident_id"), F.lit("A").alias("type"), F.lit("LOW").alias("severity"), F.lit(0.5).alias("confidence"),
        F.lit("f").alias("source_frame_id"), *[F.lit(None).cast("double").alias(c) for c in "xyz"], F.lit("NONE").alias("flood_context"),
        F.lit("e").alias("evidence"), F.lit(None).cast("string").alias("timestamp"),
    )
    row = sinks.incident_csv_rows(df).first()
    assert (row.world_x, row.world_y, row.world_z) == ("N/A", "N/A", "N/A")
