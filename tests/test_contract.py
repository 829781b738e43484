"""The driver contract, and a sample of queries against their SQL twins."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as contract
from compare import plain

SAMPLE = (
    "b04_clip_box", "k01_nms", "e01_temporal_metrics", "f09_check_25", "g02_laplacian", "k02_dedup_frames", "c03_box_fraction",
    "c11_nearest_flag", "k04_voxel_downsample", "e27_trajectory", "e33_track_audit", "m01_merge_incidents", "a07_write_detections",
)


def test_every_twin_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    rows = contract.entry(spark)
    assert "mission_id" in rows.columns and rows.count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_sample_matches_sql(spark, folder, name):
    db = duckdb.connect()
    for table in ("events", "lineitem", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    df = contract.queries()[name](spark, folder)
    columns = sorted(df.columns)
    ours = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = db.execute(contract.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    theirs = Counter(tuple(plain(row[names.index(c)]) for c in columns) for row in cursor.fetchall())
    assert sorted(names) == columns and ours == theirs


def test_stream_tracker_matches_batch(spark, folder):
    queries = contract.queries()
    batch = {(r.det_id, r.track_id, r.track_length) for r in queries["d01_track"](spark, folder).collect()}
    stream = {(r.det_id, r.track_id, r.track_length) for r in queries["d03_track_stream"](spark, folder).collect()}
    assert stream == batch
