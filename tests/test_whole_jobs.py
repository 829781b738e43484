"""Queries on tables whose sums, copies or groups outgrow the plain way."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd

import __spark_entry__ as contract
from skysift.operators import incidents, neighbours, spatial, suppression
from skysift.operators.suppression import nms
from skysift.plans import registry, views
from skysift.sources import readers, sinks
from tests.test_scale_paths import BOXES, crowd, greedy

LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double"


def test_copies_of_a_position_are_not_paired(spark):
    copies = spark.range(200_000).selectExpr("1L AS scene_id", "id AS point_id", "IF(id % 2 = 0, 0.0D, 0.012D) AS x", "IF(id % 2 = 0, -0.0D, 0.016D) AS y", "IF(id % 4 = 0, -0.0D, 0.0D) AS z")
    far = spark.range(200_000, 200_003).selectExpr("1L", "id", "5.0D", "5.0D", "CASE id WHEN 200000 THEN 5.0D WHEN 200001 THEN 5.015D END")
    got = spatial.radius_totals(copies.union(far), 0.021).collect()
    assert sorted(r.a for r in got) == list(range(200_002))  # a point without a place has no neighbours, not even itself
    for r in got:
        assert r.neighbours == (200_000 if r.a < 200_000 else 2)
        assert math.isclose(r.total, 100_000 * math.hypot(0.012, 0.016) if r.a < 200_000 else 0.015, rel_tol=1e-9)


def test_totals_over_block_edges(spark):
    rng = np.random.default_rng(3)
    xyz = np.round(rng.random((1500, 3)) * [1.8, 2.2, 0.5] - 0.6, 2)
    xyz[:40] = xyz[40:80]
    rows = [(i % 2, i, *map(float, p)) for i, p in enumerate(xyz)] + [(0, 9001, None, 0.0, 0.0), (0, 9002, math.nan, 0.0, 0.0), (1, 9003, math.inf, 0.0, 0.0)]
    points = spark.createDataFrame(rows, "scene_id long, point_id long, x double, y double, z double")
    got = {r.a: (r.neighbours, r.total) for r in spatial.radius_totals(points, 0.1).collect()}
    cell, (x, y, z) = np.floor(xyz / 0.1), xyz.T
    d = np.sqrt((x[:, None] - x) ** 2 + (y[:, None] - y) ** 2 + (z[:, None] - z) ** 2)
    met = (d <= 0.1) & (np.abs(cell[:, None] - cell[None]).max(axis=2) <= 1) & (np.arange(1500)[:, None] % 2 == np.arange(1500) % 2)
    assert sorted(got) == list(range(1500)) and met.sum() > 3000
    assert all(got[i][0] == met[i].sum() and math.isclose(got[i][1], d[i][met[i]].sum(), abs_tol=1e-9) for i in range(1500))


def test_positions_are_repeated_on_the_rim_only(spark, monkeypatch):
    """One row a position moves, and one more for each block that it touches the rim of; not one for each cell around it."""
    points = spark.range(20_000).selectExpr("1L AS scene_id", "id AS point_id", "pmod(id * 7919, 997) / 500D AS x", "pmod(id * 104729, 983) / 500D AS y", "0.5D AS z")
    moved, whole = [], spatial.fan_out
    monkeypatch.setattr(spatial, "fan_out", lambda df, *keys: moved.append(df.count()) or whole(df, *keys))
    spatial.radius_totals(points, 0.02).count()
    assert sum(moved) < 3 * 20_000


def test_id_sums_beyond_long(spark, tmp_path):
    query = contract.queries()["k05_confidence_gate"]
    for shift in (0, 500_000_000_000):
        rows = [(shift + i, 1, 8, 1, 1.0, 1000.0, 0.0, 0.06) for i in range(3)]
        spark.createDataFrame(rows, LINES).write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
        (r,) = query(spark, str(tmp_path)).collect()
        assert (r.points, r.id_sum) == (3, sum((o * 8 + 1) * 1048576 + 1017 for o, *_ in rows))
        assert isinstance(r.id_sum, int) == (shift == 0)


def test_model_sees_every_frame(spark, folder):
    name = "u03_infer_mission_with"
    assert "position" not in contract.oracle_sql()[name]
    frames = contract.queries()[name](spark, folder)
    events = spark.read.parquet(f"{folder}/events.parquet")
    wanted = events.selectExpr("floor(event_id / 500) AS m", "floor(event_id % 500 / 10) AS f").distinct()
    assert {(r.mission_id, r.frame_idx) for r in frames.collect()} == {(r.m, r.f) for r in wanted.collect()}


def test_crowds_are_walked_without_rounds(spark, monkeypatch):
    rows = crowd(60, copies=2, seed=4)
    det = spark.createDataFrame(rows, BOXES)
    ids = lambda **how: {r.det_id for r in nms(det, **how).collect()}
    assert ids(limit=10, walk=10) == greedy(rows)  # rounds
    monkeypatch.setattr(suppression, "_rounds", lambda *_: 1 / 0)
    rows = crowd(400, copies=3, seed=5)
    det = spark.createDataFrame(rows, BOXES)
    assert ids(limit=10) == greedy(rows)
    assert nms(det, limit=10).columns == det.columns


def test_walk_goes_over_batches_and_blocks(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        rows = crowd(700, copies=2, seed=5)
        pooled = spark.createDataFrame(rows, BOXES).selectExpr("*", "raw_class = 'person' AS _person")
        assert {r.det_id for r in suppression._walk(pooled, 0.45, 0.40, piece=7, block=16).collect()} == greedy(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_poses_of_many_missions_need_few_files(spark, tmp_path):
    cameras = spark.range(300).selectExpr(
        "id AS mission_id", "0L AS frame_idx", *[f"{float(i == j)}D AS r{i}{j}" for i in range(3) for j in range(3)], "id * 1.0D AS t0", "0.0D AS t1", "0.0D AS t2"
    )
    sinks.write_poses(cameras.repartition(3), str(tmp_path / "poses"))
    assert len(list((tmp_path / "poses").rglob("part-*.json"))) <= 3
    read = spark.read.schema("mission_id long, frame_idx long, position array<double>").json(str(tmp_path / "poses"))
    assert {r.mission_id: r.position[0] for r in read.collect()} == {m: (-float(m) if m else 0.0) for m in range(300)}


def test_files_are_listed_by_tasks(spark, tmp_path):
    for name in ("a/b/c/1.jpg", "a/2.jpg", "3 x%20.jpg", "_hidden/4.jpg", "a/.5.jpg"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * len(name))
    (tmp_path / "empty").mkdir()
    for path in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}"):
        got = {(r.path.removeprefix("file:").replace("//", "/"), r.length) for r in readers.list_files(spark, path).collect()}
        assert got == {(f"{tmp_path}/{n}", len(n)) for n in ("a/b/c/1.jpg", "a/2.jpg", "3 x%20.jpg")}
    assert "binaryFile" not in readers.read_frames(spark, str(tmp_path))._jdf.queryExecution().toString()


def test_near_incidents_once(spark):
    rng = np.random.default_rng(11)
    xyz = np.round(rng.random((200, 3)) * [12, 9, 5] - 6, 1)
    rows = [(i % 2, 1000 - i, "T", *map(float, p)) for i, p in enumerate(xyz)] + [(0, 5000, "T", None, None, None)]
    got = incidents.near_incidents(spark.createDataFrame(rows, "mission_id long, seq long, type string, x double, y double, z double"))
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(axis=2))
    want = sorted((1000 - j, 1000 - i) for i in range(200) for j in range(i + 1, 200) if i % 2 == j % 2 and d[i, j] < 2)
    assert sorted((r.a, r.b) for r in got.collect()) == want


def test_cells_repeated_for_a_join_are_not_broadcast(spark):
    points = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0), (1, 2, 0.5, 0.0, 0.0)], "scene_id long, point_id long, x double, y double, z double")
    for pairs in (spatial.radius_pairs_once(points, 1.0, "scene_id"), spatial.radius_pairs(points, 1.0)):
        assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_mask_points_samples_frames_with_water_only(spark, folder, monkeypatch, tmp_path):
    """Samples of a frame without a mask fail here, so none may be made."""
    contract.queries()  # loads the plans
    spark.read.parquet(f"{folder}/embeddings.parquet").filter("vec_id % 3 = 0").write.parquet(f"{tmp_path}/embeddings.parquet")
    (tmp_path / "events.parquet").symlink_to(f"{folder}/events.parquet")
    rows = lambda: sorted(registry.QUERIES["c09_mask_points"](views.Views(spark, str(tmp_path))).collect())
    want = rows()
    checked = "y1 + CASE WHEN (mission_id * 50 + frame_idx) % 3 > 0 THEN CAST(raise_error('made') AS BIGINT) ELSE 0 END + CAST("
    monkeypatch.setitem(views.VIEWS, "samp", views.VIEWS["samp"].replace("y1 + CAST(", checked, 1))
    assert want and rows() == want


def test_keys_that_boxes_settle_open_no_positions(spark):
    row = "scene_id long, id long, x double, y double, z double, w long, size double, reach double"
    left = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0, 1, 1.0, 1.7)], row)
    near = [(1, 2, 1.1 + i / 1e5, 0.1, 0.1, 1, 1.0, 1.7) for i in range(600)]
    partly = [(1, 2, 1.51 + i / 1200, 0.6, 0.1, 1, 1.0, 1.7) for i in range(580)]
    right = spark.createDataFrame(near + partly, row)
    weights = lambda enough: [r.w for r in spatial.near_weights(left, right, ["scene_id", "a", "b"], enough).collect()]
    within = sum(math.sqrt(r[2] ** 2 + r[3] ** 2 + r[4] ** 2) <= 1.7 for r in partly)
    assert 0 < within < 580 and weights(1) == [600]  # the half inside the reach; the cut one is not opened
    assert weights(1000) == [600 + within]


def test_points_of_crowded_cells_share_their_neighbours(spark, monkeypatch):
    """Rows that meet a group, for each of its points: few, as a group holds many points where cells are crowded."""
    rng = np.random.default_rng(4)
    xyz = rng.random((8_000, 3))
    places = spark.createDataFrame(pd.DataFrame({"scene_id": 1, "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2], "w": 1, "size": 0.5}))
    got = {(r.x, r.y, r.z): r.mean_distance for r in neighbours.nearest_means(places, 20).collect()}
    assert len(got) == len(xyz)
    for p in xyz[:200]:
        assert math.isclose(got[tuple(p)], np.sort(np.sqrt(((xyz - p) ** 2).sum(axis=1)))[:20].mean(), rel_tol=1e-9)

    def met(k):
        def run(key, own, near):
            return own[["x", "y", "z"]].assign(scene_id=key[0], mean_distance=len(near) / len(own))

        return run

    monkeypatch.setattr(neighbours, "_means", met)
    share = sum(r.mean_distance for r in neighbours.nearest_means(places, 20).collect()) / len(xyz)
    assert share < 100, share
