"""The paths for hot keys must give what the paths for small keys give."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from skysift.operators import cloud, frames, incidents, merging, neighbours, raster, spatial, successors
from skysift.operators.ordering import digits, numbered, previous, quantiles, top_rows
from skysift.operators.suppression import nms

BOXES = "mission_id long, frame_idx long, det_id long, raw_class string, conf double, x1 long, y1 long, x2 long, y2 long"


def crowd(n: int, copies: int = 5, seed: int = 3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y, w, h = rng.randrange(300), rng.randrange(200), rng.randrange(5, 90), rng.randrange(5, 90)
        for _ in range(copies if i % 10 == 0 else 1):
            rows.append((1, i % 2, len(rows), rng.choice(["person", "car"]), rng.randrange(100) / 100.0, x, y, x + w, y + h))
    return rows


def greedy(rows):
    kept = set()
    for frame in {r[1] for r in rows}:
        for person, bar in ((True, 0.40), (False, 0.45)):
            pool = sorted((r for r in rows if r[1] == frame and (r[3] == "person") == person), key=lambda r: (-r[4], -r[2]))
            chosen = []
            for r in pool:
                def iou(a, b):
                    w, h = min(a[7], b[7]) - max(a[5], b[5]) + 1, min(a[8], b[8]) - max(a[6], b[6]) + 1
                    inter = max(0, w) * max(0, h)
                    area = lambda q: (q[7] - q[5] + 1) * (q[8] - q[6] + 1)
                    return inter / (area(a) + area(b) - inter + 1e-6)

                if all(iou(k, r) <= bar for k in chosen):
                    chosen.append(r)
            kept |= {r[2] for r in chosen}
    return kept


def test_suppression_fold_and_rounds_match_greedy(spark):
    rows = crowd(250)
    det = spark.createDataFrame(rows, BOXES)
    want = greedy(rows)
    assert {r.det_id for r in nms(det).collect()} == want
    assert {r.det_id for r in nms(det, limit=10).collect()} == want


def test_suppression_with_ids_that_repeat_between_missions(spark):
    rows = [(m, f, i, *rest) for m in (1, 2) for f in (0, 1) for (_, _, i, *rest) in crowd(20, copies=2, seed=10 * m + f)]
    det = spark.createDataFrame(rows, BOXES)
    keys = lambda df: {(r.mission_id, r.frame_idx, r.det_id) for r in df.collect()}
    whole = keys(nms(det))
    assert keys(nms(det, limit=2)) == whole
    assert {(m, f) for m, f, _ in whole} == {(1, 0), (1, 1), (2, 0), (2, 1)}


def test_suppression_of_known_pairs(spark):
    rows = [
        (1, 0, 1, "car", 0.85, 100, 100, 300, 300), (1, 0, 2, "person", 0.28, 120, 120, 140, 160),
        (2, 0, 3, "person", 0.38, 450, 450, 470, 500), (2, 0, 4, "person", 0.59, 452, 451, 471, 501),
    ]
    assert {r.det_id for r in nms(spark.createDataFrame(rows, BOXES)).collect()} == {1, 2, 4}


def reports(n: int, seed: int = 5):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        place = [None] * 3 if rng.random() < 0.2 else [rng.randrange(120) / 4.0, rng.randrange(60) / 4.0, rng.randrange(8) / 4.0]
        out.append((1, i, i // 4, rng.choice(["A", "B"]), rng.choice([None, 1, 2, 3, 4, 5]), rng.choice(["N/A", "o1", "o2"]),
                    0.5 + rng.randrange(40) / 100.0, *place, float(rng.randrange(40)), "LOW"))
    return out


REPORT = ("mission_id long, seq long, frame_idx long, type string, track_id long, object_id string, confidence double, "
          "x double, y double, z double, reprojection_error_px double, rescue_priority string")


def test_incident_merge_in_batches_and_parts(spark):
    inc = spark.createDataFrame(reports(240), REPORT)
    for merge in (incidents.merge_incidents, incidents.merge_incidents_boost):
        whole = sorted(map(str, merge(inc).collect()))
        assert sorted(map(str, merge(inc, limit=10).collect())) == whole
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
        assert sorted(map(str, merge(inc).collect())) == whole
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def plain_merge(rows, boost):
    """The rules, one report at a time against a list of all incidents."""
    made, radius = {}, 3.0 if boost else 2.0
    for _, seq, frame, kind, track, obj, conf, x, y, z, err, _ in sorted(rows, key=lambda r: (r[2], r[1])):
        link = (None if obj == "N/A" else obj) if boost else track
        have = made.setdefault(kind, [])
        by_link = next((i for i, e in enumerate(have) if link is not None and e["link"] == link), None)
        near = lambda e: x is not None and e["at"] is not None and sum((a - b) ** 2 for a, b in zip(e["at"], (x, y, z))) ** 0.5 < radius
        by_place = next((i for i, e in enumerate(have) if near(e)), None)
        hits = [i for i in (by_link, by_place) if i is not None]
        spot = None if not hits else min(hits) if boost else hits[0]
        if spot is None:
            have.append({"seq": seq, "frames": {frame}, "conf": round(conf, 3 if boost else 2), "at": None if x is None else (x, y, z), "link": link, "n": 1})
            continue
        e = have[spot]
        e["frames"].add(frame)
        e["n"] += 1
        if boost:
            e["conf"] = round(min(0.98, max(e["conf"], conf) + 0.04), 3)
            if x is not None and (e["at"] is None or conf > e["conf"] - 0.05):
                e["at"] = (x, y, z)
        elif spot == by_link:
            e["conf"] = max(e["conf"], conf)
            if e["at"] is None and x is not None:
                e["at"] = (x, y, z)
    return sorted((kind, e["seq"], sorted(e["frames"]), e["n"], e["conf"], e["at"]) for kind, have in made.items() for e in have)


def test_incident_merge_matches_the_rules(spark):
    rows = reports(400, seed=8)
    inc = spark.createDataFrame(rows, REPORT).repartition(4)
    for boost, merge in ((False, incidents.merge_incidents), (True, incidents.merge_incidents_boost)):
        got = sorted((r.type, r.first_seq, r.frame_ids, r.observation_count, r.confidence, None if r.x is None else (r.x, r.y, r.z)) for r in merge(inc).collect())
        assert got == plain_merge(rows, boost)


def test_cost_of_a_report_does_not_grow_with_the_incidents():
    """Cells opened and incidents compared for each report stay level while the incidents grow."""
    rng = random.Random(1)
    compared = []
    for n in (2000, 8000):
        side = n ** (1 / 3) * 4
        walk = merging.ByTrack((1, "A"), 2.0)
        rows = {c: np.array([f(i) for i in range(n)], dtype=object) for c, f in {
            "known": lambda i: 0, "seq": lambda i: i, "frame_idx": lambda i: i, "confidence": lambda i: 0.5,
            "x": lambda i: rng.random() * side, "y": lambda i: rng.random() * side, "z": lambda i: rng.random() * side,
            "reprojection_error_px": lambda i: None, "_link": lambda i: None}.items()}
        walk.take(rows)
        compared.append(sum(len(walk.cells.get((i, j, k), ())) for i in range(5, 8) for j in range(5, 8) for k in range(5, 8)))
        assert len(walk.rows) > n / 2
    assert compared[1] < 2 * compared[0] + 10


def test_canonical_record_has_twenty_fields(spark):
    rows = [(1, 1, 4, "A", 7, "o", 0.556, None, None, None, None, "HIGH", "burning", 0.456, "s.jpg"), (1, 2, 9, "A", 7, "o", 0.7, 1.0, 2.0, 3.0, 5.0, "LOW", None, None, None)]
    inc = spark.createDataFrame(rows, REPORT + ", summary string, isolation_score double, source_frame_id string")
    (r,) = incidents.canonical_records(incidents.merge_incidents(inc), inc).collect()
    assert len(r) == 21 and (r.id, r.severity, r.evidence, r.summary) == ("INC-001", "MEDIUM", "burning", "burning")
    assert (r.frame_ids, r.confidence, r.isolation_score, r.source_frame_id, r.bbox_2d) == ([4, 9], 0.7, 0.46, "s.jpg", [0, 0, 0, 0])
    assert tuple(r.location_3d) == (1.0, 2.0, 3.0, "LOCALIZED_3D") and r.location_status == "UNLOCALIZED" and r.rescue_priority == "HIGH"
    bare = spark.createDataFrame([row[:12] for row in rows[1:]], REPORT)
    (r,) = incidents.canonical_records(incidents.merge_incidents(bare), bare).collect()
    assert (r.evidence, r.flood_status, r.source_frame_id, r.location_status) == ("No evidence summary provided.", "NONE", "frame_0009.jpg", "LOCALIZED")


def test_incident_merge_of_two_reports(spark):
    rows = [(1, 1, 1, "FLOOD_ZONE", None, "HAZARD_001", 0.70, 12.5, 5.0, 2.0, None, "LOW"), (1, 2, 2, "FLOOD_ZONE", None, "HAZARD_001", 0.75, 12.6, 5.1, 2.1, None, "LOW")]
    (row,) = incidents.merge_incidents_boost(spark.createDataFrame(rows, REPORT)).collect()
    assert (row.observation_count, row.frame_ids, row.confidence) == (2, [1, 2], 0.79)


def test_dedup_in_blocks(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(6, 8))
    rows = []
    for i in range(120):
        v = base[i // 20] + rng.normal(size=8) * 0.2
        rows.append((1, i, [float(x) for x in v / np.linalg.norm(v)], float(rng.integers(1, 10))))
    df = spark.createDataFrame(rows, "mission_id long, frame_idx long, fingerprint array<double>, sharpness double")
    kept, gone, last = [], {}, None
    for _, i, v, s in rows:
        sim = None if last is None else float(np.dot(last[1], v))
        if last is None or not sim > 0.9:
            last = (i, v, s)
        elif s > last[2] * 1.25:
            gone[last[0]] = "replaced"
            last = (i, v, s)
        else:
            gone[i] = "duplicate"
    want = {i: gone.get(i, "kept") for i in range(120)}
    for block in (1000, 7):
        got = {r.frame_idx: r.outcome for r in frames.dedup_frames(df, 0.9, block=block).collect()}
        assert got == want


def plain_dedup(rows, threshold):
    """Outcome of every frame by the plain walk over (frame, fingerprint, sharpness)."""
    outcome, last = {}, None
    for i, v, s in rows:
        if last is None or not float((v * last[1]).sum()) > threshold:
            outcome[i], last = "kept", (i, v, s)
        elif s > last[2] * 1.25:
            outcome[last[0]], outcome[i], last = "replaced", "kept", (i, v, s)
        else:
            outcome[i] = "duplicate"
    return outcome


def scenes(n, seed, still=0.5):
    """Long still scenes, drifts and cuts of unit vectors."""
    rng = np.random.default_rng(seed)
    out, v, left, moving = [], None, 0, False
    for i in range(n):
        if left == 0:
            v, left, moving = rng.normal(size=8), int(rng.integers(1, 4000 if rng.random() < still else 40)), rng.random() < 0.4
        left -= 1
        v = v + rng.normal(size=8) * (0.02 if moving else 0.0005)
        sharp = 5.0 * (1.3 if rng.random() < 0.0005 else 1.0) * (1 + i / n)
        out.append((i, v / np.linalg.norm(v), sharp))
    return out


def test_dedup_of_a_hundred_thousand_frames(spark):
    rows = scenes(100_000, 4)
    want = plain_dedup(rows, 0.97)
    df = spark.createDataFrame([(1, i, v.tolist(), s) for i, v, s in rows], "mission_id long, frame_idx long, fingerprint array<double>, sharpness double").repartition(8)
    got = {r.frame_idx: r.outcome for r in frames.dedup_frames(df, 0.97).collect()}
    assert got == want and sum(v == "kept" for v in want.values()) > 100


def test_dedup_rounds_grow_with_the_logarithm_of_blocks(spark, monkeypatch):
    """A scene that never changes passes all blocks; the tree is climbed, not walked."""
    rounds = []
    plain = successors.is_empty
    monkeypatch.setattr(successors, "is_empty", lambda df: (rounds.append(1), plain(df))[1])
    counts = []
    for n in (64, 512):
        v = [1.0] + [0.0] * 7
        df = spark.createDataFrame([(1, i, v if i < n - 1 else v[::-1], 1.0) for i in range(n)], "mission_id long, frame_idx long, fingerprint array<double>, sharpness double")
        rounds.clear()
        got = {r.frame_idx: r.outcome for r in frames.dedup_frames(df, 0.9, block=4).collect()}
        assert sorted(i for i, o in got.items() if o == "kept") == [0, n - 1]
        counts.append(len(rounds))
    # Eight times the blocks are three more levels, each with one round to build, at most three to climb and one to double.
    assert counts[1] <= counts[0] + 15


def test_dedup_without_fingerprints_or_sharpness(spark):
    rows = [(1, 0, [1.0, 0.0], 1.0), (1, 1, None, 1.0), (1, 2, [1.0, 0.0], None), (1, 3, [1.0, 0.0], 9.0), (2, 7, None, None)]
    df = spark.createDataFrame(rows, "mission_id long, frame_idx long, fingerprint array<double>, sharpness double")
    for block in (256, 1):
        got = {(r.mission_id, r.frame_idx): r.outcome for r in frames.dedup_frames(df, 0.9, block=block).collect()}
        assert got == {(1, 0): "kept", (1, 1): "kept", (1, 2): "kept", (1, 3): "duplicate", (2, 7): "kept"}
    assert frames.dedup_frames(df.limit(0), 0.9).count() == 0


def test_components_groups_and_rounds(spark):
    rng = random.Random(1)
    edges = [(g, rng.randrange(200), rng.randrange(200)) for g in (1, 2) for _ in range(120)] + [(3, i, i + 1) for i in range(300)]
    e = spark.createDataFrame(edges, "g long, a long, b long")
    v = spark.createDataFrame([(g, i) for g in (1, 2, 3) for i in range(301)], "g long, v long")
    small = {(r.g, r.v): r.label for r in spatial.components(v, e, ["g"]).collect()}
    large = {(r.g, r.v): r.label for r in spatial.components(v, e, ["g"], limit=0).collect()}
    assert small == large and small[(3, 300)] == 0


def test_quantiles(spark):
    rng = np.random.default_rng(0)
    data = {1: rng.normal(size=999), 2: np.round(rng.normal(size=500), 1), 3: np.array([4.0]), 4: np.full(50, 2.5)}
    df = spark.createDataFrame([(k, float(x)) for k, xs in data.items() for x in xs], "k long, v double")
    for row in quantiles(df, ["k"], "v", {"a": 0.02, "m": 0.5, "z": 0.98}).collect():
        assert np.allclose([row.a, row.m, row.z], np.percentile(data[row.k], [2, 50, 98]))


def test_quantiles_of_extreme_values(spark):
    """Far outliers, one value in many shapes, both signs, the smallest and the largest doubles."""
    rng = np.random.default_rng(5)
    data = {
        1: np.concatenate([rng.normal(size=500), [1e300, -1e300]]), 2: 1e6 + rng.random(700) * 1e-6, 3: np.concatenate([np.zeros(40), -np.zeros(3), [5e-324, -5e-324, 2.0**-1022]]),
        4: np.array([1.0, 2.0, 4.0, np.nextafter(2.0, 0), np.nextafter(4.0, 9)] * 7), 5: -np.exp(rng.normal(size=300) * 50), 6: np.array([7.0, np.inf, 8.0]),
    }
    df = spark.createDataFrame([(k, float(x)) for k, xs in data.items() for x in xs] + [(1, None), (9, None), (2, float("nan"))], "k long, v double")
    got = {r.k: (r.a, r.m, r.z) for r in quantiles(df, ["k"], "v", {"a": 0.02, "m": 0.5, "z": 0.9}).collect()}
    assert set(got) == set(data)
    for k in (1, 2, 3, 4, 5):
        assert np.allclose(got[k], np.percentile(data[k], [2, 50, 90]), rtol=1e-12, atol=0), k
    assert got[6][1] == 8.0


def test_digits_never_fall(spark):
    rng = np.random.default_rng(6)
    values = np.concatenate([np.exp(rng.normal(size=2000) * 300), -np.exp(rng.normal(size=2000) * 300), [0.0, 5e-324, -5e-324, np.inf, -np.inf, 1.7e308], 2.0 ** np.arange(-1074, 1024), np.nextafter(2.0 ** np.arange(-1000, 1000), 0)])
    df = spark.createDataFrame([(float(v),) for v in np.unique(values)], "v double")
    for bits in (4, 32):
        got = [r.d for r in df.select("v", digits(F.col("v"), bits).alias("d")).orderBy("v").collect()]
        assert all(a <= b for a, b in zip(got, got[1:])) and got.count(0) == 1


def test_one_outlier_does_not_fill_a_bin(spark):
    """A hundred thousand values and one far away: the bins that are looked into hold a small part."""
    df = spark.createDataFrame([(float(x),) for x in [*np.random.default_rng(7).random(20_000), 1e200]], "v double")
    sizes = [r["count"] for r in df.groupBy(digits(F.col("v"), 8)).count().collect()]
    assert max(sizes) < 200


def plain_neighbours(image, r, c):
    """Above, below, left, right; mirrored where there is none."""
    at = lambda i, j: image.get((i, j))
    up, down, left, right = at(r - 1, c), at(r + 1, c), at(r, c - 1), at(r, c + 1)
    own = image[r, c]
    pick = lambda *xs: next((x for x in xs if x is not None), own)
    return pick(up, down), pick(down, up), pick(left, right), pick(right, left)


def test_stencils_of_odd_shapes(spark):
    """Frames of one row, one column, rows of different extent; every value against the plain rule."""
    rng = random.Random(2)
    shapes = {0: [(r, c) for r in range(5) for c in range(7)], 1: [(0, c) for c in range(4)], 2: [(r, 3) for r in range(4)], 3: [(r, c) for r in range(4) for c in range(r, 6 + r % 2)], 4: [(0, 0)]}
    images = {f: {p: rng.randrange(256) for p in ps} for f, ps in shapes.items()}
    images[5] = {(r, c): rng.randrange(256) for r in range(4) for c in range(6) if (r, c) != (1, 2)}  # a hole
    rows = [(1, f, r, c, v, v % 3 == 0) for f, image in images.items() for (r, c), v in image.items()]
    pixels = spark.createDataFrame(rows, "mission_id long, frame_idx long, r long, c long, gray long, is_edge boolean").repartition(5)
    got = {(r.frame_idx, r.r, r.c): r for r in raster.laplacian(pixels).collect()}
    assert len(got) == len(rows) and set(raster.laplacian(pixels).columns) == {*pixels.columns, "laplacian"}
    for f, image in images.items():
        for (r, c), v in image.items():
            up, down, left, right = plain_neighbours(image, r, c)
            assert got[f, r, c].laplacian == up + down + left + right - 4 * v, (f, r, c)
    full = {(r.r, r.c): r.gradient for r in raster.gradient(pixels.filter("frame_idx = 0")).collect()}
    image = images[0]
    mirror = lambda i, n: 1 if i < 0 else n - 2 if i >= n else i
    for (r, c), size in full.items():
        g = lambda i, j: image[mirror(r + i, 5), mirror(c + j, 7)]
        gx = sum(w * (g(i, 1) - g(i, -1)) for i, w in ((-1, 1), (0, 2), (1, 1)))
        gy = sum(w * (g(1, j) - g(-1, j)) for j, w in ((-1, 1), (0, 2), (1, 1)))
        assert np.isclose(size, np.hypot(gx, gy))
    dense = {(r.frame_idx, r.r, r.c): r.edge_density for r in raster.edge_density(pixels, 2).collect()}
    for f, image in images.items():
        if f in (2, 5):
            for r, c in image:
                around = [v % 3 == 0 for (i, j), v in image.items() if abs(i - r) <= 2 and abs(j - c) <= 2]
                assert np.isclose(dense[f, r, c], np.mean(around))


def test_stencils_shuffle_rows_not_pixels(spark):
    """Above the scan, exchanges carry packed image rows."""
    rows = [(1, 0, r, c, (r * c) % 251) for r in range(30) for c in range(200)]
    pixels = spark.createDataFrame(rows, "mission_id long, frame_idx long, r long, c long, gray long").coalesce(2)
    plan = raster.laplacian(pixels)._jdf.queryExecution().executedPlan().toString()
    assert "partial_collect_list" in plan and plan.count("Exchange hashpartitioning") == 2


def test_numbered_previous_and_top(spark):
    df = spark.createDataFrame([(k, i, i * i) for k in (1, 2) for i in range(0, 50, 3)], "k long, i long, v long")
    block = F.floor(F.col("i") / 10)
    got = numbered(df, ["k"], block, [F.col("i")], "n").filter("k = 1").orderBy("i").collect()
    assert [r.n for r in got] == list(range(1, 18))
    before = previous(df, ["k"], ["i"], {"v": "pv"}, block).filter("k = 2").orderBy("i").collect()
    assert [r.pv for r in before] == [None] + [i * i for i in range(0, 48, 3)]
    assert [r.i for r in top_rows(df, ["k"], [F.col("v").desc()], 2).filter("k = 1").orderBy("rank").collect()] == [48, 45]


def points(spark, xyz):
    rows = [(1, i, *map(float, p)) for i, p in enumerate(xyz)]
    return spark.createDataFrame(rows, "scene_id long, point_id long, x double, y double, z double")


def blobs(seed=0):
    rng = np.random.default_rng(seed)
    dense = [c + rng.normal(size=(120, 3)) * 0.05 for c in ([0, 0, 0], [1, 1, 0], [0, 1, 1])]
    return np.vstack([*dense, rng.uniform(-2, 3, size=(40, 3)), np.zeros((30, 3))])


def test_neighbour_search_matches_brute_force(spark):
    xyz = blobs()
    d = np.linalg.norm(xyz[:, None] - xyz[None], axis=2)
    want = np.sort(d, axis=1)[:, :20].mean(axis=1)
    got = {r.point_id: r.mean_distance for r in cloud.knn_distance(points(spark, xyz), 20, 0.1).collect()}
    assert len(got) == len(xyz)
    assert np.allclose([got[i] for i in range(len(xyz))], want)


def test_neighbours_of_uneven_clouds(spark):
    """A crowded cell, an isolated point, copies, a line, and scenes with fewer points than asked for."""
    rng = np.random.default_rng(11)
    crowd = np.concatenate([rng.random((3000, 3)) * 0.08, rng.random((200, 3)) * 2 - 1, [[9.0, 9.0, 9.0], [-7.5, 0.3, 2.0]], np.repeat([[0.5, 0.5, 0.5]], 30, axis=0), np.linspace(0, 3, 50)[:, None] * [1, 1, 0]])
    few = rng.random((5, 3))
    rows = [(1, i, *map(float, p)) for i, p in enumerate(crowd)] + [(2, i, *map(float, p)) for i, p in enumerate(few)] + [(3, 0, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "scene_id long, point_id long, x double, y double, z double").repartition(6)
    got = {(r.scene_id, r.point_id): r.mean_distance for r in cloud.knn_distance(df, 20, 0.1).collect()}
    assert len(got) == len(rows)
    for scene, xyz in ((1, crowd), (2, few), (3, np.array([[1.0, 2.0, 3.0]]))):
        d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(axis=2))
        want = np.sort(d, axis=1)[:, :20].mean(axis=1)
        assert np.allclose([got[scene, i] for i in range(len(xyz))], want)
    assert cloud.knn_distance(df.limit(0), 20, 0.1).count() == 0


def test_an_isolated_point_opens_a_part_of_a_crowd(spark, monkeypatch):
    rng = np.random.default_rng(12)
    xyz = np.concatenate([rng.random((20_000, 3)), [[4.0, 0.5, 0.5]]])
    met = []
    monkeypatch.setattr(neighbours, "cut", lambda df: (out := spatial.cut(df), met.append((df.columns, out)))[0])
    got = {r.point_id: r.mean_distance for r in cloud.knn_distance(points(spark, xyz), 20, 0.1).collect()}
    assert np.isclose(got[20_000], np.sort(np.linalg.norm(xyz - xyz[-1], axis=1))[:20].mean())
    last = [df for columns, df in met if "_lo_x" in columns]
    far = [df.filter("_lo_x = 4").agg(F.sum("n")).first()[0] for df in last]
    assert far[-1] is None or min(f for f in far if f) < 8000


def test_radius_outliers_match_brute_force(spark):
    xyz = blobs(1)
    d = np.linalg.norm(xyz[:, None] - xyz[None], axis=2)
    sizes = spark.createDataFrame([(1, 0.12)], "scene_id long, radius double")
    kept = {r.point_id for r in cloud.radius_outliers(points(spark, xyz), sizes, 10).collect()}
    assert kept == set(np.nonzero((d <= 0.12).sum(axis=1) > 10)[0])


def test_clusters_match_brute_force(spark):
    xyz = blobs(2)
    near = np.linalg.norm(xyz[:, None] - xyz[None], axis=2) <= 0.1
    core = near.sum(axis=1) >= 10
    label = np.full(len(xyz), -1)
    for i in np.nonzero(core)[0]:
        if label[i] < 0:
            todo = [i]
            while todo:
                j = todo.pop()
                if label[j] < 0 and core[j]:
                    label[j] = i
                    todo.extend(np.nonzero(near[j] & core)[0])
    for i in np.nonzero(~core)[0]:
        touching = label[near[i] & core]
        label[i] = touching.min() if len(touching) else -1
    got = {r.point_id: r.cluster for r in cloud.dbscan(points(spark, xyz), F.lit(0.1), 10).collect()}
    assert {i: (None if c < 0 else c) for i, c in enumerate(label)} == got


def test_dense_cells_cost_no_pairs(spark, monkeypatch):
    """Sixty thousand positions in two neighbouring cells and a few beside them: boxes decide, few rows are opened."""
    rng = np.random.default_rng(9)
    xyz = np.concatenate([rng.random((30_000, 3)) * 0.05, rng.random((30_000, 3)) * 0.05 + [0.13, 0, 0], [[0.3, 0, 0], [0.37, 0.02, 0.01], [0.9, 0.9, 0.9]]])
    met = []
    plain = spatial.cut
    monkeypatch.setattr(spatial, "cut", lambda df: (out := plain(df), met.append(out.count()))[0])
    got = {r.point_id: r.cluster for r in cloud.dbscan(points(spark, xyz), F.lit(0.1), 10).collect()}
    assert max(met) < 70_000
    d = lambda i: np.linalg.norm(xyz - xyz[i], axis=1)
    assert got[0] == 0 and got[59_999] == 0 and {got[i] for i in range(60_000)} == {0}
    assert got[60_002] is None
    for i in (60_000, 60_001):
        assert (got[i] == 0) == bool(((d(i) <= 0.1) & (np.arange(len(xyz)) < 60_000)).any())


def test_counts_are_exact_below_the_limit(spark):
    rng = np.random.default_rng(10)
    xyz = np.concatenate([rng.random((400, 3)) * 0.5, np.repeat(rng.random((5, 3)), 4, axis=0), rng.integers(0, 4, (200, 3)) * 0.1])
    got = cloud.neighbour_counts(points(spark, xyz), F.lit(0.1), 7).collect()
    assert len(got) == len(np.unique(xyz, axis=0))
    for r in got:
        want = int((np.sqrt(((xyz - [r.x, r.y, r.z]) ** 2).sum(axis=1)) <= 0.1).sum())
        assert r.neighbours == want or (r.neighbours >= 7 and want >= 7)


def test_cap_is_exact_and_repeatable(spark):
    cloud_df = points(spark, np.random.default_rng(4).normal(size=(500, 3)))
    first = {r.point_id for r in cloud.cap_points(cloud_df, 77).collect()}
    assert len(first) == 77
    assert first == {r.point_id for r in cloud.cap_points(cloud_df.repartition(7), 77).collect()}


def test_cloud_filter_drops_noise(spark):
    rng = np.random.default_rng(3)
    xyz = np.vstack([rng.normal(size=(1000, 3)) * 0.5, rng.uniform(50, 100, size=(50, 3))])
    df = points(spark, xyz).withColumns({"conf": F.lit(1.0), "red": F.lit(0.5), "grn": F.lit(0.5), "blu": F.lit(0.5)})
    sor = cloud.statistical_outliers(df, 20, 2.0, 0.3)
    assert sor.count() < 1050 and sor.filter("x > 20").count() == 0
