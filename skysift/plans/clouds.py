"""Queries over depth maps, point clouds and camera paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysift.functions.numeric import half_even
from skysift.lineage import cut, is_empty
from skysift.operators import cloud, depth, spatial
from skysift.plans.localization import CENTRE
from skysift.plans.registry import R, RS, query

FR = "mission_id, frame_idx"


def settle(c, places):
    return half_even(half_even(F.col(c), 9), places)


# ------------------------------------------------------------------ depth

DSTAT = """ds AS (SELECT mission_id, frame_idx, count(*) FILTER (okd) / count(*) AS vr, min(depth) FILTER (okd) AS mn, max(depth) FILTER (okd) AS mx, stddev_pop(depth) FILTER (okd) AS sd
  FROM (SELECT *, depth IS NOT NULL AND depth > 0.05e0 AND depth < 200 AS okd FROM pix) s GROUP BY 1, 2)"""


@query(
    "e10_depth_stats", "pix",
    f"""{DSTAT} SELECT {FR}, {R('vr', 6)} AS valid_ratio, CASE WHEN vr >= 0.05e0 THEN mn END AS min_depth, CASE WHEN vr >= 0.05e0 THEN mx END AS max_depth,
    CASE WHEN vr >= 0.05e0 THEN {RS('sd', 5)} END AS std_depth, coalesce(vr >= 0.05e0 AND sd >= 1e-4, false) AS is_valid FROM ds""",
)
def _(v):
    return depth.depth_stats(v.pix).withColumns({"valid_ratio": half_even(F.col("valid_ratio"), 6), "std_depth": settle("std_depth", 5)})


def _solve_sql(rows: str, w: str, out: str) -> str:
    return f"""{out}s AS (SELECT mission_id, frame_idx, sum({w}) AS w, sum({w} * x) AS sx, sum({w} * x * x) AS sxx, sum({w} * y) AS sy, sum({w} * x * y) AS sxy FROM {rows} GROUP BY 1, 2),
  {out} AS (SELECT mission_id, frame_idx, sc, (sy - sc * sx) / w AS sh FROM (SELECT *, (w * sxy - sx * sy) / (w * sxx - sx * sx) AS sc FROM {out}s) q)"""


def _round_sql(i: int) -> str:
    return f"""r{i} AS (SELECT u.*, abs(x * sc + sh - y) AS res FROM u JOIN l{i - 1} USING (mission_id, frame_idx)),
  m{i} AS (SELECT mission_id, frame_idx, median(res) AS med FROM r{i} GROUP BY 1, 2),
  w{i} AS (SELECT r{i}.*, pow(1e0 / greatest(1e0, res / (1.345e0 * (med + 1e-6))), 2) AS wt FROM r{i} JOIN m{i} USING (mission_id, frame_idx)),
  {_solve_sql(f'w{i}', 'wt', f'l{i}')}"""


# Every tenth frame keeps too few pixels and stays at identity.
USABLE = "depth IS NOT NULL AND depth > 0.1e0 AND depth < 100 AND mono_depth > 1e-4 AND depth_conf >= CASE WHEN frame_idx % 10 = 0 THEN 4.5e0 ELSE 1e0 END"
ALIGN = f"""g AS (SELECT pix.*, depth AS y, mono_depth AS x FROM pix WHERE {USABLE}),
  n AS (SELECT mission_id, frame_idx FROM g GROUP BY 1, 2 HAVING count(*) >= 30), u AS (SELECT g.* FROM g JOIN n USING (mission_id, frame_idx)),
  {_solve_sql('u', '1e0', 'l0')}, {_round_sql(1)}, {_round_sql(2)}, {_round_sql(3)},
  line AS (SELECT f.mission_id, f.frame_idx, CASE WHEN sc IS NULL THEN 1e0 ELSE greatest(1e-4, sc) END AS scale, coalesce(sh, 0e0) AS shift, sc IS NOT NULL AS is_aligned
    FROM (SELECT DISTINCT mission_id, frame_idx FROM pix) f LEFT JOIN l3 USING (mission_id, frame_idx))"""


def _confident(v):
    """Weak confidence on every tenth frame, so that some frames stay unaligned."""
    weak = (F.col("frame_idx") % 10 == 0) & (F.col("depth_conf") < 4.5)
    return v.pix.withColumn("depth_conf", F.when(weak, 0.9).otherwise(F.col("depth_conf")))


def _line(v):
    return depth.align_depth(_confident(v), min_valid=30)


@query("e13_align_depth", "pix", f"{ALIGN} SELECT {FR}, {RS('scale', 5)} AS scale, {RS('shift', 5)} AS shift, is_aligned FROM line")
def _(v):
    return _line(v).withColumns({"scale": settle("scale", 5), "shift": settle("shift", 5)})


@query(
    "e13_align_median_ratio", "pix",
    f"""g AS (SELECT pix.*, depth / (mono_depth + 1e-8) AS ra FROM pix WHERE {USABLE}),
    m AS (SELECT mission_id, frame_idx, median(ra) AS scale FROM g GROUP BY 1, 2 HAVING count(*) >= 30)
    SELECT f.mission_id, f.frame_idx, {R('coalesce(scale, 1e0)', 6)} AS scale, 0e0 AS shift, scale IS NOT NULL AS is_aligned
    FROM (SELECT DISTINCT mission_id, frame_idx FROM pix) f LEFT JOIN m USING (mission_id, frame_idx)""",
)
def _(v):
    line = depth.align_depth(_confident(v), "median_ratio", min_valid=30)
    return line.withColumn("scale", half_even(F.col("scale"), 6))


APPLIED = f"""{ALIGN}, ap AS (SELECT pix.* REPLACE (CASE WHEN frame_idx % 10 = 0 AND depth_conf < 4.5e0 THEN 0.9e0 ELSE depth_conf END AS depth_conf),
  CASE WHEN is_aligned THEN least(100e0, greatest(0.1e0, scale * mono_depth + shift)) ELSE mono_depth END AS al, is_aligned
  FROM pix JOIN line USING (mission_id, frame_idx)),
  sc AS (SELECT *, coalesce(abs(depth - al), 5e0) AS diff, exp(-coalesce(abs(depth - al), 5e0) / (0.5e0 + 1e-6)) AS agree FROM ap)"""


@query(
    "e14_align_residual", "pix",
    f"""{APPLIED} SELECT {FR}, CASE WHEN any_value(is_aligned) THEN {RS(f'sqrt(avg((al - depth) * (al - depth)) FILTER ({USABLE}))', 5)} ELSE 0e0 END AS residual_rmse,
    {RS(f'count(*) FILTER ({USABLE}) / count(*)', 6)} AS valid_pixel_ratio FROM ap GROUP BY 1, 2""",
)
def _(v):
    return depth.align_residual(_confident(v), _line(v))


def _scored(v):
    return depth.consistency(depth.apply_alignment(_confident(v), _line(v)))


@query(
    "e15_consistency", "pix",
    f"""{APPLIED}, ok AS (SELECT * FROM sc WHERE depth > 0.1e0 AND al > 0.1e0 AND depth_conf > 0.5e0),
    st AS (SELECT mission_id, frame_idx, avg(diff) AS a, median(diff) AS m, count(*) FILTER (agree > 0.6e0) / count(*) * 100e0 AS h FROM ok GROUP BY 1, 2)
    SELECT {FR}, {RS('a', 5)} AS mean_difference, {RS('m', 5)} AS median_difference, {RS('h', 4)} AS high_consistency_pct FROM st""",
)
def _(v):
    return depth.consistency_stats(_scored(v))


@query(
    "e16_fuse_confidence", "pix",
    f"""{APPLIED}, mm AS (SELECT mission_id, frame_idx, min(depth_conf) AS lo, max(depth_conf) AS hi FROM sc GROUP BY 1, 2)
    SELECT sc.mission_id, sc.frame_idx, r, c, {RS('0.6e0 * CASE WHEN hi > lo THEN (depth_conf - lo) / (hi - lo) ELSE 1e0 END + 0.4e0 * agree', 5)} AS fused_conf
    FROM sc JOIN mm ON sc.mission_id = mm.mission_id AND sc.frame_idx = mm.frame_idx""",
)
def _(v):
    fused = depth.fuse_confidence(_scored(v)).withColumn("fused_conf", settle("fused_conf", 5))
    return fused.select("mission_id", "frame_idx", "r", "c", "fused_conf")


# ------------------------------------------------------------------ clouds


def long_sums(sums, name):
    """Exact sums as BIGINT, as in SQL; where one is too large for it (SQL stops there), as whole decimals."""
    sums = cut(sums)
    large = sums.filter(F.abs(F.col(name)) > F.lit(2**63 - 1).cast("decimal(38,0)"))
    return sums.withColumn(name, F.col(name).cast("long" if is_empty(large) else "decimal(38,0)"))


@query(
    "b18_valid_points", "pts",
    "SELECT scene_id, point_id FROM pts WHERE conf >= 1.1e0 AND sqrt(x * x + y * y + z * z) > 1e-4 AND sqrt(x * x + y * y + z * z) < 500",
)
def _(v):
    return cloud.valid_points(v.pts, 1.1).select("scene_id", "point_id")


@query(
    "k05_confidence_gate", "pts",
    """k AS (SELECT scene_id, count(*) FILTER (conf >= 1.25e0) AS n FROM pts GROUP BY 1)
    SELECT pts.scene_id, count(*) AS points, CAST(sum(point_id) AS BIGINT) AS id_sum FROM pts JOIN k USING (scene_id) WHERE conf >= 1.25e0 OR n <= 100 GROUP BY 1""",
)
def _(v):
    kept = cloud.confidence_gate_points(v.pts, 1.25)
    return long_sums(kept.groupBy("scene_id").agg(F.count(F.lit(1)).alias("points"), F.sum(F.col("point_id").cast("decimal(20,0)")).alias("id_sum")), "id_sum")


SIZES = """bb AS (SELECT scene_id, min(x) AS x0, min(y) AS y0, min(z) AS z0, least(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS ext FROM pts GROUP BY 1),
  sz AS (SELECT *, CASE WHEN ext < 1.5e0 THEN least(0.02e0, greatest(0.0035e0, ext / 80e0)) ELSE 0.02e0 END AS vx FROM bb),
  sr AS (SELECT *, CASE WHEN ext >= 1.5e0 THEN 0.08e0 ELSE least(0.08e0, greatest(0.02e0, vx * 5e0)) END AS rad FROM sz)"""
VOXEL = f"""{SIZES}, vox AS (SELECT scene_id, min(point_id) AS point_id, avg(x) AS x, avg(y) AS y, avg(z) AS z, avg(red) AS red FROM (
    SELECT pts.*, floor((x - (x0 - vx / 2e0)) / vx) AS ix, floor((y - (y0 - vx / 2e0)) / vx) AS iy, floor((z - (z0 - vx / 2e0)) / vx) AS iz FROM pts JOIN sz USING (scene_id)) q
    GROUP BY scene_id, ix, iy, iz)"""


@query("k04_voxel_downsample", "pts", f"{VOXEL} SELECT scene_id, point_id, {RS('x', 6)} AS x, {RS('y', 6)} AS y, {RS('z', 6)} AS z, {RS('red', 6)} AS red FROM vox")
def _(v):
    thin = cloud.voxel_downsample(v.pts)
    return thin.select("scene_id", "point_id", *[settle(c, 6).alias(c) for c in ("x", "y", "z", "red")])


def rounded_voxels(v):
    """Voxel means rounded, so that both engines compare equal distances."""
    sizes = cloud.effective_sizes(v.pts)
    thin = cloud.voxel_downsample(v.pts, sizes)
    return thin.select("scene_id", "point_id", *[settle(c, 6).alias(c) for c in "xyz"]), sizes


CELLS = "floor(x / {s}) AS gx, floor(y / {s}) AS gy, floor(z / {s}) AS gz"


@query(
    "c06_radius_pairs", "pts",
    f"""p AS (SELECT scene_id, point_id, x, y, z, {CELLS.format(s='0.02e0')} FROM pts),
    q AS (SELECT p.* REPLACE (gx + dx AS gx, gy + dy AS gy, gz + dz AS gz) FROM p, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy), (VALUES (-1), (0), (1)) c(dz))
    SELECT q.scene_id, q.point_id AS a, count(*) AS neighbours, {RS('sum(sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) + (q.z - p.z) * (q.z - p.z)))', 6)} AS total
    FROM q JOIN p ON q.scene_id = p.scene_id AND q.gx = p.gx AND q.gy = p.gy AND q.gz = p.gz
    WHERE sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) + (q.z - p.z) * (q.z - p.z)) <= 0.02e0 GROUP BY 1, 2""",
)
def _(v):
    return spatial.radius_totals(v.pts, 0.02).withColumn("total", settle("total", 6))


@query(
    "k07_radius_outliers", "pts",
    f"""{VOXEL}, rv AS (SELECT scene_id, point_id, {RS('x', 6)} AS x, {RS('y', 6)} AS y, {RS('z', 6)} AS z FROM vox),
    p AS (SELECT rv.*, rad, floor(x / rad) AS gx, floor(y / rad) AS gy, floor(z / rad) AS gz FROM rv JOIN sr USING (scene_id)),
    q AS (SELECT p.* REPLACE (gx + dx AS gx, gy + dy AS gy, gz + dz AS gz) FROM p, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy), (VALUES (-1), (0), (1)) c(dz))
    SELECT q.scene_id, q.point_id FROM q JOIN p ON q.scene_id = p.scene_id AND q.gx = p.gx AND q.gy = p.gy AND q.gz = p.gz
    WHERE sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) + (q.z - p.z) * (q.z - p.z)) <= q.rad GROUP BY 1, 2 HAVING count(*) > 10""",
)
def _(v):
    thin, sizes = rounded_voxels(v)
    return cloud.radius_outliers(thin, sizes, 10).select("scene_id", "point_id")


# The neighbour search and the clusters are too slow in SQL on whole tables; the
# tests check them against brute force on small clouds.
@query("k06_statistical_outliers")
def _(v):
    thin, sizes = rounded_voxels(v)
    sized = thin.join(sizes.select("scene_id", "voxel"), "scene_id")
    return cloud.statistical_outliers(sized, 20, 2.0, F.col("voxel") * 5.0).select("scene_id", "point_id")


@query("k08_dbscan")
def _(v):
    thin, sizes = rounded_voxels(v)
    sized = thin.join(sizes.select("scene_id", "voxel"), "scene_id")
    found = cloud.dbscan(sized, F.col("voxel") * 5.0, 10)
    return found.groupBy("scene_id", "cluster").agg(F.count(F.lit(1)).alias("points"))


# The same two on one point per customer, few enough for SQL to compare all pairs of a scene.
APART = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"


@query(
    "k06_statistical_outliers_sites", "site",
    f"""d AS (SELECT a.scene_id, a.point_id, {APART} AS d FROM site a JOIN site b ON a.scene_id = b.scene_id),
    k AS (SELECT scene_id, point_id, avg(d) AS m FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, point_id ORDER BY d) AS r FROM d) q WHERE r <= 20 GROUP BY 1, 2),
    lim AS (SELECT scene_id, avg(m) FILTER (m > 0) AS mean, stddev_samp(m) FILTER (m > 0) AS sd FROM k GROUP BY 1)
    SELECT k.scene_id, point_id FROM k JOIN lim ON k.scene_id = lim.scene_id WHERE m > 0 AND m < mean + 2 * coalesce(sd, 0)""",
)
def _(v):
    return cloud.statistical_outliers(v.site, 20, 2.0, 0.05).select("scene_id", "point_id")


@query(
    "k08_dbscan_sites", "site",
    f"""RECURSIVE n AS (SELECT a.scene_id, a.point_id AS p, b.point_id AS q FROM site a JOIN site b ON a.scene_id = b.scene_id WHERE {APART} <= 0.03e0),
    core AS (SELECT scene_id, p FROM n GROUP BY 1, 2 HAVING count(*) >= 6),
    e AS (SELECT n.* FROM n SEMI JOIN core a ON n.scene_id = a.scene_id AND n.p = a.p SEMI JOIN core b ON n.scene_id = b.scene_id AND n.q = b.p),
    reach AS (SELECT scene_id, p, p AS label FROM core UNION SELECT e.scene_id, e.q, r.label FROM reach r JOIN e ON r.scene_id = e.scene_id AND r.p = e.p),
    lab AS (SELECT scene_id, p, min(label) AS cluster FROM reach GROUP BY 1, 2),
    edge AS (SELECT n.scene_id, n.p, min(cluster) AS cluster FROM n JOIN lab ON n.scene_id = lab.scene_id AND n.q = lab.p ANTI JOIN core c ON n.scene_id = c.scene_id AND n.p = c.p GROUP BY 1, 2)
    SELECT s.scene_id, s.point_id, coalesce(lab.cluster, edge.cluster) AS cluster FROM site s
    LEFT JOIN lab ON s.scene_id = lab.scene_id AND s.point_id = lab.p LEFT JOIN edge ON s.scene_id = edge.scene_id AND s.point_id = edge.p""",
)
def _(v):
    return cloud.dbscan(v.site, F.lit(0.03), 6).select("scene_id", "point_id", "cluster")


@query(
    "c10_keep_clusters", "pts",
    """c AS (SELECT *, CAST(floor(y * 20) AS BIGINT) AS cluster FROM pts), v AS (SELECT scene_id, cluster FROM c GROUP BY 1, 2 HAVING count(*) % 3 <> 0)
    SELECT c.scene_id, c.point_id, c.cluster FROM c SEMI JOIN v ON c.scene_id = v.scene_id AND c.cluster = v.cluster""",
)
def _(v):
    grouped = v.pts.withColumn("cluster", F.floor(F.col("y") * 20))
    valid = grouped.groupBy("scene_id", "cluster").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") % 3 != 0)
    return cloud.keep_clusters(grouped, valid).select("scene_id", "point_id", "cluster")


@query(
    "e38_stage_counts", "pts",
    VOXEL.replace("pts", "gated").replace("bb AS", "k AS (SELECT scene_id, count(*) FILTER (conf >= 1.25e0) AS n FROM pts GROUP BY 1), gated AS (SELECT pts.* FROM pts JOIN k USING (scene_id) WHERE conf >= 1.25e0 OR n <= 100), bb AS", 1)
    + f""", a AS (SELECT scene_id, count(*) AS raw FROM pts GROUP BY 1), b AS (SELECT scene_id, count(*) AS after_confidence FROM gated GROUP BY 1), c AS (SELECT scene_id, count(*) AS after_voxel FROM vox GROUP BY 1)
    SELECT scene_id, raw, after_confidence, after_voxel, raw - after_voxel AS removed_points, {R('(raw - after_voxel) / raw * 100e0', 2)} AS reduction_pct FROM a JOIN b USING (scene_id) JOIN c USING (scene_id)""",
)
def _(v):
    gated = cloud.confidence_gate_points(v.pts, 1.25)
    return cloud.stage_counts({"raw": v.pts, "after_confidence": gated, "after_voxel": cloud.voxel_downsample(gated)})


@query("e38_full_filter_counts")
def _(v):
    return cloud.stage_counts(cloud.filter_cloud(v.pts))


@query(
    "h02_cap_points", "pts",
    """rk AS (SELECT scene_id, point_id, row_number() OVER (PARTITION BY scene_id ORDER BY md5(scene_id || ':' || point_id || ':7'), point_id) AS rank FROM pts)
    SELECT scene_id, point_id FROM rk WHERE rank <= 300""",
)
def _(v):
    return cloud.cap_points(v.pts, 300).select("scene_id", "point_id")


CSTAT = """cs AS (SELECT scene_id, count(*) AS point_count, var_pop(x) AS vx, var_pop(y) AS vy, var_pop(z) AS vz, max(x) - min(x) AS ex, max(y) - min(y) AS ey, max(z) - min(z) AS ez FROM pts GROUP BY 1),
  cv AS (SELECT *, CASE WHEN point_count < 50 THEN 'INSUFFICIENT' WHEN least(vx, vy, vz) < 1e-5 THEN 'DEGENERATE' WHEN ex < 0.05e0 AND ey < 0.05e0 THEN 'TOO_SMALL' END AS issue FROM cs)"""


@query(
    "e11_cloud_stats", "pts",
    f"""{CSTAT} SELECT scene_id, point_count, {RS('vx', 6)} AS var_x, {RS('vy', 6)} AS var_y, {RS('vz', 6)} AS var_z, {R('ex', 6)} AS extent_x, {R('ey', 6)} AS extent_y, {R('ez', 6)} AS extent_z,
    issue, issue IS NULL AS is_valid FROM cv""",
)
def _(v):
    out = cloud.cloud_stats(v.pts)
    return out.withColumns({c: settle(c, 6) for c in out.columns if c.startswith(("var_", "extent_"))})


METRIC = f"""mt AS (SELECT scene_id, variant, count(*) AS n, max(x) - min(x) AS ex, max(y) - min(y) AS ey, max(z) - min(z) AS ez, avg(conf) AS a, median(conf) AS m, stddev_pop(conf) AS s FROM pts GROUP BY 1, 2),
  mv AS (SELECT *, greatest(ex, 1e-3) * greatest(ey, 1e-3) * greatest(ez, 1e-3) AS vol FROM mt),
  me AS (SELECT scene_id, variant, n AS point_count, {R('ex', 3)} AS extent_x, {R('ey', 3)} AS extent_y, {R('ez', 3)} AS extent_z, {R('vol', 3)} AS volume, {R('n / vol', 2)} AS density,
    {RS('a', 4)} AS mean_confidence, {RS('m', 4)} AS median_confidence, {RS('s', 4)} AS std_confidence FROM mv)"""


@query("e12_cloud_metrics", "pts", f"{METRIC} SELECT * FROM me")
def _(v):
    return cloud.cloud_metrics(v.pts, ["scene_id", "variant"])


@query(
    "e28_compare", "pts",
    f"""{METRIC} SELECT b.scene_id, b.point_count AS baseline_point_count, b.mean_confidence AS baseline_mean_confidence, b.density AS baseline_density,
    r.point_count AS refined_point_count, r.mean_confidence AS refined_mean_confidence, r.density AS refined_density,
    r.point_count - b.point_count AS point_count_diff, {R('r.mean_confidence - b.mean_confidence', 4)} AS confidence_gain
    FROM me b JOIN me r ON b.scene_id = r.scene_id AND b.variant = 'baseline' AND r.variant = 'refined'""",
)
def _(v):
    return cloud.compare(v.pts)


SAMPLE = f"""rk AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY point_id) - 1 AS p, count(*) OVER (PARTITION BY scene_id) AS n FROM pts),
  sm AS (SELECT * FROM rk WHERE p % CASE WHEN n > 500 THEN greatest(1, CAST(floor(n / 500) AS BIGINT)) ELSE 1 END = 0),
  ct AS (SELECT scene_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM sm GROUP BY 1),
  r95 AS (SELECT scene_id, quantile_cont(sqrt((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz)), 0.95) AS r95 FROM sm JOIN ct USING (scene_id) GROUP BY 1),
  {CSTAT}, ch AS (SELECT scene_id, r95, least(1e0, greatest(0.1e0, 1e0 - r95 / greatest(1e0, ex + ey + ez))) AS coherence FROM r95 JOIN cs USING (scene_id))"""


@query("e26_coherence", "pts", f"{SAMPLE} SELECT scene_id, {RS('r95', 5)} AS r95, {RS('coherence', 5)} AS coherence FROM ch")
def _(v):
    return cloud.coherence(v.pts).withColumns({"r95": settle("r95", 5), "coherence": settle("coherence", 5)})


# ---------------------------------------------------------------- trajectory

PATH = f"""cc AS (SELECT mission_id, frame_idx, {CENTRE[0]} AS px, {CENTRE[1]} AS py, {CENTRE[2]} AS pz FROM cam),
  v1 AS (SELECT *, px - lag(px) OVER w AS vx, py - lag(py) OVER w AS vy, pz - lag(pz) OVER w AS vz FROM cc WINDOW w AS (PARTITION BY mission_id ORDER BY frame_idx)),
  v2 AS (SELECT *, sqrt(vx * vx + vy * vy + vz * vz) AS speed, sqrt(pow(vx - lag(vx) OVER w, 2) + pow(vy - lag(vy) OVER w, 2) + pow(vz - lag(vz) OVER w, 2)) AS acc FROM v1
    WINDOW w AS (PARTITION BY mission_id ORDER BY frame_idx))"""


@query("g03_motion", "cam", f"{PATH} SELECT mission_id, frame_idx, {R('speed', 6)} AS speed, {R('acc', 6)} AS acceleration FROM v2")
def _(v):
    out = cloud.motion(v.cam)
    return out.select("mission_id", "frame_idx", half_even(F.col("speed"), 6).alias("speed"), half_even(F.col("acceleration"), 6).alias("acceleration"))


@query(
    "e27_trajectory", "cam",
    f"""{PATH} SELECT mission_id, count(*) AS cameras, CASE WHEN count(*) >= 3 THEN {RS('avg(speed)', 4)} ELSE 0e0 END AS mean_velocity,
    CASE WHEN count(*) >= 3 THEN {RS('avg(acc)', 4)} ELSE 0e0 END AS mean_acceleration, CASE WHEN count(*) >= 3 THEN {RS('sum(speed)', 4)} END AS path_length FROM v2 GROUP BY 1""",
)
def _(v):
    return cloud.trajectory(v.cam)


@query(
    "g10_baseline", "cam",
    f"""{PATH} SELECT mission_id, count(*) AS cameras, {RS('sqrt(pow(max(px) - min(px), 2) + pow(max(py) - min(py), 2) + pow(max(pz) - min(pz), 2))', 5)} AS camera_baseline,
    {RS('avg(speed)', 5)} AS mean_step, sqrt(pow(max(px) - min(px), 2) + pow(max(py) - min(py), 2) + pow(max(pz) - min(pz), 2)) >= 0.01e0 AND avg(speed) > 1e-4 AS trajectory_valid FROM v2 GROUP BY 1""",
)
def _(v):
    return cloud.baseline(v.cam).withColumns({"camera_baseline": settle("camera_baseline", 5), "mean_step": settle("mean_step", 5)})


@query(
    "g09_interpolate_path", "cam",
    f"""{PATH}, pr AS (SELECT *, lag(frame_idx) OVER w AS from_frame, lag(px) OVER w AS ax, lag(py) OVER w AS ay, lag(pz) OVER w AS az FROM cc WINDOW w AS (PARTITION BY mission_id ORDER BY frame_idx))
    SELECT mission_id, from_frame, CAST(i AS INT) AS step, {R('(1e0 - i / 40e0) * ax + i / 40e0 * px', 6)} AS x, {R('(1e0 - i / 40e0) * ay + i / 40e0 * py', 6)} AS y, {R('(1e0 - i / 40e0) * az + i / 40e0 * pz', 6)} AS z
    FROM pr, range(40) t(i) WHERE from_frame IS NOT NULL""",
)
def _(v):
    out = cloud.interpolate_path(v.cam)
    return out.withColumns({c: half_even(F.col(c), 6) for c in "xyz"})


# --------------------------------------------------------------- scene scores


def scene_cameras(v):
    """Cameras of all missions, laid on the eight scenes."""
    return v.cam.withColumns(
        {"frame_idx": F.col("mission_id") * 50 + F.col("frame_idx"), "scene_id": F.col("mission_id") % 8}
    ).drop("mission_id")


def scene_depth(v):
    return depth.depth_stats(v.pix).select((F.col("mission_id") % 8).alias("scene_id"), "valid_ratio")


SCENE = f"""scam AS (SELECT cam.* EXCLUDE (mission_id) REPLACE (mission_id * 50 + frame_idx AS frame_idx), mission_id % 8 AS scene_id FROM cam),
  {DSTAT}, dv AS (SELECT mission_id % 8 AS scene_id, avg(vr) AS v FROM ds GROUP BY 1)"""


@query(
    "e24_geometry_score", "pts cam pix",
    f"""{SCENE}, {CSTAT}, mb AS (SELECT scene_id, sqrt(pow(max(t0) - min(t0), 2) + pow(max(t1) - min(t1), 2) + pow(max(t2) - min(t2), 2)) AS b FROM scam GROUP BY 1),
    j AS (SELECT cv.*, b, coalesce(v, 0e0) AS v FROM cv JOIN mb USING (scene_id) LEFT JOIN dv USING (scene_id)),
    s AS (SELECT *, {RS('least(30e0, b / 0.5e0 * 30e0) + least(30e0, point_count / 10000e0 * 30e0) + least(20e0, v / 0.8e0 * 20e0) + least(20e0, sqrt(ex * ex + ey * ey + ez * ez) / 5e0 * 20e0)', 1)} AS score FROM j),
    g AS (SELECT *, CASE WHEN issue IS NOT NULL THEN 'INVALID' WHEN score >= 70 AND b >= 0.1e0 THEN 'GOOD' WHEN score >= 40 AND b >= 0.02e0 THEN 'ACCEPTABLE' WHEN score >= 20 THEN 'POOR' ELSE 'INVALID' END AS geometry_status FROM s)
    SELECT scene_id, geometry_status, point_count, CASE WHEN issue IS NULL THEN score ELSE 0e0 END AS geometry_quality_score, {R('b', 3)} AS camera_baseline_m, {RS('v', 3)} AS mean_depth_valid_ratio,
    geometry_status IN ('GOOD', 'ACCEPTABLE') AS localization_allowed FROM g""",
)
def _(v):
    return cloud.geometry_score(v.pts, scene_cameras(v), scene_depth(v))


EIGEN = """cvx AS (SELECT scene_id, covar_samp(x, x) AS a, covar_samp(y, y) AS b, covar_samp(z, z) AS c, covar_samp(x, y) AS d, covar_samp(x, z) AS e, covar_samp(y, z) AS f FROM sm GROUP BY 1),
  eg0 AS (SELECT *, (a + b + c) / 3 AS q FROM cvx),
  eg1 AS (SELECT *, sqrt((pow(a - q, 2) + pow(b - q, 2) + pow(c - q, 2) + 2 * (d * d + e * e + f * f)) / 6) AS p FROM eg0),
  eg2 AS (SELECT *, acos(greatest(-1e0, least(1e0, ((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)) / (2 * pow(p, 3))))) / 3 AS ph FROM eg1),
  sp AS (SELECT scene_id, greatest(1e-6, q + 2 * p * cos(ph + 2 * pi() / 3)) / greatest(1e-6, q + 2 * p * cos(ph)) AS spread FROM eg2)"""


@query(
    "e25_scene_quality", "pts cam pix",
    f"""{SCENE}, {SAMPLE}, {EIGEN}, {PATH.replace('FROM cam)', 'FROM (SELECT scene_id AS mission_id, scam.* EXCLUDE (scene_id) FROM scam))')},
    bl AS (SELECT mission_id AS scene_id, sqrt(pow(max(px) - min(px), 2) + pow(max(py) - min(py), 2) + pow(max(pz) - min(pz), 2)) AS b, avg(speed) AS st FROM v2 GROUP BY 1),
    j AS (SELECT cv.*, b, b >= 0.01e0 AND st > 1e-4 AS tv, coalesce(v, 0.8e0) AS v, coherence, spread, list_sort([ex, ey, ez]) AS es
      FROM cv JOIN bl USING (scene_id) LEFT JOIN dv USING (scene_id) LEFT JOIN ch USING (scene_id) LEFT JOIN sp USING (scene_id)),
    k AS (SELECT *, es[3] < 0.05e0 OR (es[2] < 0.005e0 AND es[3] > 1) OR spread < 1e-5 AS bad FROM j),
    s AS (SELECT *, {RS('''CASE WHEN point_count >= 50000 THEN 25e0 WHEN point_count >= 10000 THEN 15e0 + (point_count - 10000) / 40000e0 * 10e0 WHEN point_count >= 4000 THEN 8e0 + (point_count - 4000) / 6000e0 * 7e0 ELSE point_count / 4000e0 * 8e0 END
      + CASE WHEN b >= 0.3e0 THEN 25e0 WHEN b >= 0.1e0 THEN 18e0 + (b - 0.1e0) / 0.2e0 * 7e0 WHEN b >= 0.02e0 THEN 8e0 + (b - 0.02e0) / 0.08e0 * 10e0 ELSE b / 0.02e0 * 6e0 END
      + CASE WHEN v >= 0.8e0 THEN 20e0 WHEN v >= 0.6e0 THEN 10e0 + (v - 0.6e0) / 0.2e0 * 10e0 ELSE v / 0.6e0 * 10e0 END
      + CASE WHEN bad THEN 0e0 ELSE least(5e0, spread * 50e0) + least(10e0, es[3] / 5e0 * 10e0) END + 15e0''', 1)} AS score FROM k),
    g AS (SELECT *, CASE WHEN issue IS NOT NULL OR bad OR point_count < 800 THEN 1 WHEN point_count < 5000 OR b < 0.02e0 OR v < 0.5e0 OR score < 40 THEN 2 WHEN score >= 70 AND b >= 0.08e0 THEN 4 ELSE 3 END AS code FROM s)
    SELECT scene_id, point_count, ['RECONSTRUCTION_FAILED', 'RECONSTRUCTION_WEAK', 'RECONSTRUCTION_VALID', 'RECONSTRUCTION_GOOD'][code] AS reconstruction_status,
    ['INVALID', 'POOR', 'ACCEPTABLE', 'GOOD'][code] AS geometry_status, CASE WHEN issue IS NULL THEN score ELSE 0e0 END AS geometry_quality_score, code >= 3 AS localization_allowed,
    {RS('b', 3)} AS camera_baseline_m, tv AS trajectory_valid, {RS('v', 3)} AS valid_depth_ratio, {RS('coherence', 3)} AS coherence, {RS('spread', 4)} AS geometric_spread FROM g""",
)
def _(v):
    return cloud.scene_quality(v.pts, scene_cameras(v), scene_depth(v))


@query(
    "e29_diagnostic_score", "pts cam person",
    f"""scam AS (SELECT mission_id % 8 AS scene_id, mission_id * 50 + frame_idx AS k, {CENTRE[0]} AS px, {CENTRE[1]} AS py, {CENTRE[2]} AS pz FROM cam),
    en AS (SELECT scene_id, sqrt(pow(arg_min(px, k) - arg_max(px, k), 2) + pow(arg_min(py, k) - arg_max(py, k), 2) + pow(arg_min(pz, k) - arg_max(pz, k), 2)) AS span FROM scam GROUP BY 1),
    ps AS (SELECT scene_id, count(*) AS n, var_pop(z) AS vz FROM pts GROUP BY 1), er AS (SELECT mission_id % 8 AS scene_id, avg(reprojection_error_px) AS err FROM person GROUP BY 1),
    s AS (SELECT ps.scene_id, {RS('least(100e0, span / 2e0 * 50e0 + least(50e0, n / 500e0))', 4)} AS geometric_score,
      {RS('least(100e0, greatest(0e0, 100e0 - coalesce(err, 0e0) * 2e0) * 0.6e0 + least(40e0, vz * 500e0))', 4)} AS visual_score FROM ps JOIN en USING (scene_id) LEFT JOIN er USING (scene_id))
    SELECT *, CASE WHEN geometric_score > 70 AND visual_score > 60 THEN 'GOOD' WHEN geometric_score > 40 THEN 'POOR' ELSE 'INVALID' END AS status FROM s""",
)
def _(v):
    errors = v.person.select((F.col("mission_id") % 8).alias("scene_id"), "reprojection_error_px")
    return cloud.diagnostic_score(v.pts, scene_cameras(v), errors)
