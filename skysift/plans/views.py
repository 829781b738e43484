"""Survey tables derived from the given tables.

Every view is one SQL text that both engines read; only the table references and
the unnesting of the embedding array are spelled per engine.  All arithmetic uses
integers and doubles, so both give the same rows.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession

TABLES = ("events", "lineitem", "embeddings", "orders", "customer", "supplier", "part", "nation", "region")

VIEWS: dict[str, str] = {}

# Twenty missions of fifty frames per ten thousand events, ten boxes per frame.
VIEWS["det"] = """
SELECT mission_id, frame_idx, det_id, slot, raw_class, conf, x1, y1, x1 + w AS x2, y1 + h AS y2,
       1920 AS image_width, 1080 AS image_height
FROM (
  SELECT CAST(FLOOR(event_id / 500) AS BIGINT) AS mission_id,
         CAST(FLOOR((event_id % 500) / 10) AS BIGINT) AS frame_idx,
         event_id AS det_id, CAST(event_id % 10 AS BIGINT) AS slot,
         CASE event_type WHEN 'view' THEN 'person' WHEN 'click' THEN 'car' WHEN 'error' THEN 'truck'
              WHEN 'purchase' THEN 'boat' ELSE 'building' END AS raw_class,
         CAST((event_id * 7919) % 1000 AS DOUBLE) / 1000e0 AS conf,
         CAST(CAST(FLOOR((event_id % 10) / 2) AS BIGINT) * 180 + CAST(FLOOR((event_id % 500) / 10) AS BIGINT) * 7
              + user_id % 5 AS BIGINT) % 1800 AS x1,
         CAST(CAST(FLOOR((event_id % 10) / 2) AS BIGINT) * 90 + (event_id * 31) % 12 AS BIGINT) AS y1,
         CAST(8 + (CAST(FLOOR(event_id / 2) AS BIGINT) * 37) % 112 + event_id % 2 AS BIGINT) AS w,
         CAST(12 + (CAST(FLOOR(event_id / 2) AS BIGINT) * 53) % 108 AS BIGINT) AS h
  FROM {events}
) raw
"""

# The same boxes on tracks: one track per slot, some of them steady in class.
VIEWS["trk"] = """
SELECT mission_id, frame_idx, det_id, slot, slot AS track_id,
       CASE WHEN slot = 1 AND (det_id * 7) % 10 < 8 THEN 'car'
            WHEN slot = 2 AND (det_id * 3) % 10 < 7 THEN 'building'
            WHEN slot IN (4, 5) THEN 'person' ELSE raw_class END AS raw_class,
       conf, x1, y1, x2, y2, image_width, image_height,
       CAST((det_id * 41) % 101 AS DOUBLE) / 100e0 AS water_overlap
FROM det
"""

VIEWS["pix0"] = """
SELECT CAST(FLOOR(vec_id / 50) AS BIGINT) AS mission_id, CAST(vec_id % 50 AS BIGINT) AS frame_idx, vec_id,
       CAST(pos AS BIGINT) AS pos, CAST(FLOOR(pos / 8) AS BIGINT) AS r, CAST(pos % 8 AS BIGINT) AS c,
       CAST(GREATEST(0e0, LEAST(255e0, FLOOR(128e0 + 400e0 * e + 0.5e0))) AS BIGINT) AS gray
FROM {pixel_source}
"""

# An 8x8 raster per vector: blue, muddy or green frames, a mask, an edge flag and depth.
VIEWS["pix"] = """
SELECT mission_id, frame_idx, r, c, gray,
       CASE WHEN vec_id % 3 = 2 THEN CAST(FLOOR(gray / 2) AS BIGINT) ELSE gray END AS b,
       CASE vec_id % 3 WHEN 0 THEN CAST(FLOOR(gray * 4 / 5) AS BIGINT)
            WHEN 1 THEN LEAST(255, CAST(FLOOR(gray * 5 / 4) AS BIGINT)) ELSE gray END AS g,
       CASE vec_id % 3 WHEN 0 THEN CAST(FLOOR(gray * 2 / 5) AS BIGINT)
            WHEN 1 THEN LEAST(255, CAST(FLOOR(gray * 3 / 2) AS BIGINT)) ELSE CAST(FLOOR(gray / 2) AS BIGINT) END AS rd,
       gray + 16 * (vec_id % 7) > 180 AS is_water,
       (vec_id * 5 + pos * 3) % 7 < 2 AS is_edge,
       CASE WHEN (vec_id + pos) % 29 = 0 THEN NULL WHEN (vec_id + pos) % 23 = 0 THEN 0e0
            ELSE 2e0 + CAST((vec_id * 13 + pos * 17) % 100 AS DOUBLE) / 10e0 END AS depth,
       (1.2e0 + CAST((vec_id * 13 + pos * 17) % 100 AS DOUBLE) / 10e0) / 3.5e0
         + CAST((vec_id * 7 + pos * 3) % 5 AS DOUBLE) / 50e0 AS mono_depth,
       1e0 + CAST((vec_id + pos * 5) % 9 AS DOUBLE) / 2e0 AS depth_conf
FROM pix0
"""

# Boxes of the raster frames, in raster pixels (half-open).
VIEWS["rbox"] = """
SELECT mission_id, frame_idx, det_id, raw_class,
       CASE raw_class WHEN 'car' THEN 'vehicle' WHEN 'truck' THEN 'vehicle' ELSE raw_class END AS class_name, conf,
       rx1, ry1, LEAST(8, rx1 + 1 + CAST(FLOOR((x2 - x1) / 32) AS BIGINT)) AS rx2,
       LEAST(8, ry1 + 1 + CAST(FLOOR((y2 - y1) / 32) AS BIGINT)) AS ry2
FROM (SELECT det.*, CAST(FLOOR(x1 / 225) AS BIGINT) AS rx1, CAST(FLOOR(y1 / 60) AS BIGINT) AS ry1 FROM det) b
"""

VIEWS["cam"] = """
SELECT mission_id, frame_idx,
       CASE WHEN frame_idx % 2 = 1 THEN 0.6e0 ELSE 1e0 END AS r00,
       CASE WHEN frame_idx % 2 = 1 THEN -0.8e0 ELSE 0e0 END AS r01, 0e0 AS r02,
       CASE WHEN frame_idx % 2 = 1 THEN 0.8e0 ELSE 0e0 END AS r10,
       CASE WHEN frame_idx % 2 = 1 THEN 0.6e0 ELSE 1e0 END AS r11, 0e0 AS r12,
       0e0 AS r20, 0e0 AS r21, 1e0 AS r22,
       CAST(frame_idx AS DOUBLE) / 16e0 AS t0, CAST(frame_idx AS DOUBLE) / 32e0 AS t1,
       CAST(mission_id % 4 AS DOUBLE) / 8e0 AS t2,
       300e0 AS fx, 300e0 AS fy, 196e0 AS cx, 196e0 AS cy,
       1920 AS img_w, 1080 AS img_h, 392 AS model_w, 392 AS model_h
FROM (SELECT DISTINCT mission_id, frame_idx FROM det) f
"""

# Detections with a world point near the ray of their centre (null for some).
VIEWS["obs"] = """
SELECT mission_id, frame_idx, det_id, slot, track_id, raw_class, conf, x1, y1, x2, y2, u, v, zz,
       CASE WHEN det_id % 9 = 0 THEN NULL ELSE r00 * (xx - t0) + r10 * (yy - t1) + r20 * (zz - t2) END AS x,
       CASE WHEN det_id % 9 = 0 THEN NULL ELSE r01 * (xx - t0) + r11 * (yy - t1) + r21 * (zz - t2) END AS y,
       CASE WHEN det_id % 9 = 0 THEN NULL ELSE r02 * (xx - t0) + r12 * (yy - t1) + r22 * (zz - t2) END AS z
FROM (
  SELECT p.*, cam.r00, cam.r01, cam.r02, cam.r10, cam.r11, cam.r12, cam.r20, cam.r21, cam.r22, cam.t0, cam.t1, cam.t2,
         (u * 392e0 / 1920e0 + CAST(det_id % 11 - 5 AS DOUBLE) - cam.cx) * zz / cam.fx AS xx,
         (v * 392e0 / 1080e0 + CAST(det_id % 5 - 2 AS DOUBLE) - cam.cy) * zz / cam.fy AS yy
  FROM (SELECT trk.*, CAST(x1 + x2 AS DOUBLE) / 2e0 AS u, CAST(y1 + y2 AS DOUBLE) / 2e0 AS v,
               CAST(det_id % 50 - 1 AS DOUBLE) / 4e0 AS zz FROM trk) p
  JOIN cam ON p.mission_id = cam.mission_id AND p.frame_idx = cam.frame_idx
) q
"""

# Depth and point samples on a 3x3 grid in every box, one value per pixel.
VIEWS["samp"] = """
SELECT mission_id, frame_idx, r, c, MIN(depth) AS depth, MIN(px) AS px, MIN(py) AS py, MIN(pz) AS pz
FROM (
  SELECT mission_id, frame_idx,
         y1 + CAST(FLOOR((2 * CAST(FLOOR(k / 3) AS BIGINT) + 1) * (y2 - y1) / 6) AS BIGINT) AS r,
         x1 + CAST(FLOOR((2 * (k % 3) + 1) * (x2 - x1) / 6) AS BIGINT) AS c,
         CASE WHEN (det_id + k) % 29 = 0 THEN NULL WHEN (det_id * 3 + k) % 23 < 2 THEN 0e0
              ELSE 2e0 + CAST((det_id * 13 + k * 17) % 100 AS DOUBLE) / 10e0 END AS depth,
         CASE WHEN (det_id + k) % 3 > 0 THEN CAST(det_id % 40 AS DOUBLE) / 4e0 END AS px,
         CASE WHEN (det_id + k) % 3 > 0 THEN CAST((det_id * 7 + k) % 30 AS DOUBLE) / 8e0 END AS py,
         CASE WHEN (det_id + k) % 3 > 0 THEN 1e0 + CAST((det_id + k * 5) % 20 AS DOUBLE) / 4e0 END AS pz
  FROM det, (SELECT CAST(0 AS BIGINT) AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4
             UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7 UNION ALL SELECT 8) ks
) s
GROUP BY mission_id, frame_idx, r, c
"""

# One cloud per supplier residue.
VIEWS["pts"] = """
SELECT CAST(l_suppkey % 8 AS BIGINT) AS scene_id, (l_orderkey * 8 + l_linenumber) * 1048576 + (l_partkey * 1009 + l_suppkey) % 1048576 AS point_id,
       l_quantity / 50e0 AS x, l_extendedprice / 105000e0 AS y, l_discount * 10e0 AS z,
       1e0 + l_tax * 5e0 AS conf, CAST(l_linenumber % 5 AS DOUBLE) / 4e0 AS red,
       CAST(l_linenumber % 3 AS DOUBLE) / 2e0 AS grn, l_discount * 5e0 AS blu,
       CASE WHEN l_linenumber % 2 = 0 THEN 'refined' ELSE 'baseline' END AS variant,
       l_orderkey, l_linenumber
FROM {lineitem}
"""

# Observations of persons with their surroundings.
VIEWS["person"] = """
SELECT mission_id, frame_idx, det_id, track_id, conf, x1, y1, x2, y2, u, v, x, y, z,
       CASE WHEN det_id % 13 = 0 THEN NULL ELSE CAST((det_id * 29) % 400 AS DOUBLE) / 10e0 END AS reprojection_error_px,
       CAST((det_id * 37) % 1000 AS DOUBLE) / 10e0 * CAST(mission_id % 3 AS DOUBLE) / 2e0 AS surrounding_flood_pct,
       CAST((det_id * 53) % 1000 AS DOUBLE) / 1000e0 * CAST(mission_id % 3 AS DOUBLE) / 2e0 AS isolation_score,
       CASE WHEN det_id % 3 = 0 THEN 'ELEVATED_STRUCTURE' ELSE 'GROUND_LEVEL' END AS elevation_context,
       CASE det_id % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MODERATE' ELSE 'HIGH (INUNDATED SURROUNDINGS)' END AS flood_proximity
FROM obs WHERE raw_class = 'person'
"""

# Incident reports in arrival order, spread over a small site.
VIEWS["inc"] = """
SELECT mission_id, det_id AS seq, frame_idx,
       CASE slot % 3 WHEN 0 THEN 'STRANDED_PERSON' WHEN 1 THEN 'VEHICLE_IN_FLOOD' ELSE 'FLOOD_ZONE' END AS type,
       CASE WHEN det_id % 7 = 0 THEN NULL ELSE (det_id * 5) % 23 END AS track_id,
       CASE WHEN det_id % 4 = 0 THEN 'N/A' ELSE CONCAT('OBJ_', CAST((det_id * 11) % 19 AS VARCHAR(9))) END AS object_id,
       0.5e0 + CAST((det_id * 7919) % 400 AS DOUBLE) / 1000e0 AS confidence,
       CASE WHEN det_id % 5 = 0 THEN NULL ELSE CAST((det_id * 17) % 160 AS DOUBLE) / 4e0 END AS x,
       CASE WHEN det_id % 5 = 0 THEN NULL ELSE CAST((det_id * 31) % 120 AS DOUBLE) / 4e0 END AS y,
       CASE WHEN det_id % 5 = 0 THEN NULL ELSE CAST((det_id * 7) % 16 AS DOUBLE) / 4e0 END AS z,
       CAST((det_id * 29) % 400 AS DOUBLE) / 10e0 AS reprojection_error_px,
       CASE det_id % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS rescue_priority
FROM det
"""

# A small cloud of six blobs per scene, one point per customer; some points lie apart.
VIEWS["site"] = """
SELECT CAST(c_nationkey % 4 AS BIGINT) AS scene_id, c_custkey AS point_id,
       CAST((c_custkey * 37) % 6 AS DOUBLE) / 4e0 + CAST((c_custkey * 7919) % 97 AS DOUBLE) / 970e0 AS x,
       CAST((c_custkey * 31337) % 101 AS DOUBLE) / 1010e0 + CASE WHEN c_custkey % 41 = 0 THEN 0.3e0 ELSE 0e0 END AS y,
       CAST((c_custkey * 104729) % 89 AS DOUBLE) / 890e0 AS z
FROM {customer}
"""

DEPENDS = {
    "trk": ["det"],
    "pix": ["pix0"],
    "rbox": ["det"],
    "cam": ["det"],
    "obs": ["det", "trk", "cam"],
    "samp": ["det"],
    "person": ["det", "trk", "cam", "obs"],
    "inc": ["det"],
}

SPARK_PIXELS = (
    "(SELECT vec_id, CAST(pos AS BIGINT) AS pos, CAST(e AS DOUBLE) AS e "
    "FROM {embeddings} LATERAL VIEW POSEXPLODE(embedding) x AS pos, e) p"
)
DUCK_PIXELS = (
    "(SELECT vec_id, i AS pos, CAST(embedding[i + 1] AS DOUBLE) AS e "
    "FROM embeddings, range(64) t(i)) p"
)


def closure(names: list[str]) -> list[str]:
    """Views and the views they read, in the order they must be defined."""
    out: list[str] = []
    for name in names:
        for item in [*closure(DEPENDS.get(name, [])), name]:
            if item not in out:
                out.append(item)
    return out


def duck_with(names: list[str]) -> str:
    sources = {t: t for t in TABLES} | {"pixel_source": DUCK_PIXELS}
    return ", ".join(f"{n} AS ({VIEWS[n].format(**sources)})" for n in closure(names))


class Views:
    """DataFrames of the survey tables over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _view(self, name: str) -> DataFrame:
        refs = {t: f"parquet.`{self.folder}/{t}.parquet`" for t in TABLES}
        refs["pixel_source"] = SPARK_PIXELS.format(**refs)
        chain = ", ".join(f"{n} AS ({VIEWS[n].format(**refs)})" for n in closure([name]))
        return self.spark.sql(f"WITH {chain} SELECT * FROM {name}")

    def over(self, name: str, base: str, rows: DataFrame) -> DataFrame:
        """A view with ``rows`` in place of the view ``base``, so that nothing is derived from rows that are not wanted."""
        kept = closure([base])
        chain = ", ".join(f"{n} AS ({VIEWS[n]})" for n in closure([name]) if n not in kept)
        return self.spark.sql(f"WITH {base} AS (SELECT * FROM {{rows}}), {chain} SELECT * FROM {name}", rows=rows)

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self._view(name)
        raise AttributeError(name)
