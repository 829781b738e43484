"""Queries over cameras and positions: projection, localisation, tracking."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysift.functions import boxes, camera
from skysift.functions.numeric import half_even
from skysift.operators import localize, tracking
from skysift.plans.registry import R, RS, query

J = "ON o.mission_id = cam.mission_id AND o.frame_idx = cam.frame_idx"


def obs_cam(v):
    return v.obs.join(v.cam, ["mission_id", "frame_idx"])


OC = f"oc AS (SELECT o.*, cam.* EXCLUDE (mission_id, frame_idx) FROM obs o JOIN cam {J})"


def world_sql(p: tuple[str, str, str]) -> tuple[str, str, str]:
    return tuple(f"(r0{j} * ({p[0]} - t0) + r1{j} * ({p[1]} - t1) + r2{j} * ({p[2]} - t2))" for j in range(3))


def camera_sql(p: tuple[str, str, str]) -> tuple[str, str, str]:
    return tuple(f"(r{i}0 * {p[0]} + r{i}1 * {p[1]} + r{i}2 * {p[2]} + t{i})" for i in range(3))


@query(
    "f01_rescale", "det",
    f"SELECT det_id, {R('x1 * (392e0 / 1920e0)', 6)} AS um, {R('y1 * (392e0 / 1080e0)', 6)} AS vm FROM det",
)
def _(v):
    um, vm = camera.rescale(F.col("x1"), F.col("y1"), F.lit(1920.0), F.lit(1080.0), F.lit(392.0), F.lit(392.0))
    return v.det.select("det_id", half_even(um, 6).alias("um"), half_even(vm, 6).alias("vm"))


@query(
    "f02_scale_intrinsics", "cam",
    f"""SELECT mission_id, frame_idx, {R('fx * (img_w / model_w)', 6)} AS fx_img, {R('fy * (img_h / model_h)', 6)} AS fy_img,
        {R('cx * (img_w / model_w)', 6)} AS cx_img, {R('cy * (img_h / model_h)', 6)} AS cy_img FROM cam""",
)
def _(v):
    names = ("fx_img", "fy_img", "cx_img", "cy_img")
    return camera.scale_intrinsics(v.cam).select(
        "mission_id", "frame_idx", *[half_even(F.col(c), 6).alias(c) for c in names]
    )


UNPROJECTED = ("((u * 392e0 / 1920e0 - cx) * zz / fx)", "((v * 392e0 / 1080e0 - cy) * zz / fy)", "zz")


@query(
    "f03_unproject", "obs cam",
    f"{OC} SELECT det_id, {R(UNPROJECTED[0], 6)} AS xc, {R(UNPROJECTED[1], 6)} AS yc, zz AS zc FROM oc",
)
def _(v):
    p = camera.unproject(F.col("u") * 392.0 / 1920.0, F.col("v") * 392.0 / 1080.0, F.col("zz"))
    return obs_cam(v).select("det_id", half_even(p[0], 6).alias("xc"), half_even(p[1], 6).alias("yc"), p[2].alias("zc"))


@query(
    "f04_to_world", "obs cam",
    f"{OC} SELECT det_id, " + ", ".join(f"{R(e, 6)} AS w{a}" for a, e in zip("xyz", world_sql(UNPROJECTED))) + " FROM oc",
)
def _(v):
    p = camera.unproject(F.col("u") * 392.0 / 1920.0, F.col("v") * 392.0 / 1080.0, F.col("zz"))
    return obs_cam(v).select("det_id", *[half_even(c, 6).alias(f"w{a}") for a, c in zip("xyz", camera.to_world(p))])


PC = camera_sql(("x", "y", "z"))
PROJ = f"""pc AS (SELECT *, {PC[0]} AS xc, {PC[1]} AS yc, {PC[2]} AS zc FROM oc),
  px AS (SELECT *, CASE WHEN zc <= 0.001e0 THEN -1e0 ELSE fx * xc / zc + cx END AS pu,
         CASE WHEN zc <= 0.001e0 THEN -1e0 ELSE fy * yc / zc + cy END AS pv FROM pc)"""


@query("f05_to_pixel", "obs cam", f"{OC}, {PROJ} SELECT det_id, {R('pu', 6)} AS pu, {R('pv', 6)} AS pv, {R('zc', 6)} AS zc FROM px WHERE x IS NOT NULL")
def _(v):
    p = camera.to_pixel([F.col("x"), F.col("y"), F.col("z")])
    return obs_cam(v).filter(F.col("x").isNotNull()).select(
        "det_id", *[half_even(c, 6).alias(n) for n, c in zip(("pu", "pv", "zc"), p)]
    )


@query(
    "f08_check_30", "obs cam",
    f"""{OC}, {PROJ}, e AS (SELECT *, pu * (img_w / model_w) AS iu, pv * (img_h / model_h) AS iv,
      zc <= 0.001e0 OR pu < 0 OR pv < 0 AS outside FROM px), q AS (SELECT *, sqrt((iu - u) * (iu - u) + (iv - v) * (iv - v)) AS err FROM e)
    SELECT det_id, CASE WHEN x IS NULL THEN 'UNAVAILABLE' WHEN outside THEN 'REJECTED' WHEN err <= 30 THEN 'VALID' ELSE 'REJECTED' END AS reprojection_status,
      CASE WHEN x IS NULL THEN NULL WHEN outside THEN 999e0 ELSE {R('err', 2)} END AS reprojection_error_px,
      CASE WHEN x IS NOT NULL AND NOT outside THEN {R('iu', 1)} END AS projected_u,
      CASE WHEN x IS NOT NULL AND NOT outside THEN {R('iv', 1)} END AS projected_v,
      CASE WHEN x IS NOT NULL AND NOT outside THEN {R('zc', 2)} END AS camera_depth_m FROM q""",
)
def _(v):
    return camera.check_reprojection(obs_cam(v)).select(
        "det_id", "reprojection_status", "reprojection_error_px", "projected_u", "projected_v", "camera_depth_m"
    )


@query(
    "f09_check_25", "obs cam",
    f"""{OC}, {PROJ}, g AS (SELECT *, CASE WHEN cx > 0 AND cx < img_w * 0.35e0 THEN round_even(cx * 2e0, 0) ELSE img_w END AS gw,
      CASE WHEN cx > 0 AND cx < img_w * 0.35e0 THEN round_even(cy * 2e0, 0) ELSE img_h END AS gh FROM px),
    e AS (SELECT *, pu * (img_w / gw) AS iu, pv * (img_h / gh) AS iv FROM g),
    q AS (SELECT *, sqrt((iu - u) * (iu - u) + (iv - v) * (iv - v)) AS err FROM e)
    SELECT det_id, CASE WHEN x IS NULL THEN 'UNAVAILABLE' WHEN zc <= 0.001e0 THEN 'BEHIND_CAMERA' WHEN err < 5 THEN 'HIGH_CONFIDENCE'
      WHEN err < 25 THEN 'VALID' ELSE 'REJECTED' END AS reprojection_status,
      CASE WHEN x IS NULL OR zc <= 0.001e0 THEN 999e0 ELSE {R('err', 2)} END AS reprojection_error_px,
      coalesce(x IS NOT NULL AND zc > 0.001e0, false) AS is_in_front,
      CASE WHEN zc > 0.001e0 THEN {R('zc', 3)} END AS camera_depth_m FROM q""",
)
def _(v):
    return camera.grade_reprojection(obs_cam(v)).select(
        "det_id", "reprojection_status", "reprojection_error_px", "is_in_front", "camera_depth_m"
    )


@query(
    "f10_to_gps", "obs",
    f"""SELECT det_id, {R('12.5e0 + y / 111139e0', 6)} AS latitude, {R('77.25e0 + x / (111139e0 * cos(radians(12.5e0)))', 6)} AS longitude,
      {R('900e0 + z', 2)} AS altitude_m, CASE WHEN x IS NOT NULL THEN 'LOCALIZED_GPS' ELSE 'UNLOCALIZED' END AS location_status FROM obs""",
)
def _(v):
    return camera.to_gps(v.obs, 12.5, 77.25, 900.0).select("det_id", "latitude", "longitude", "altitude_m", "location_status")


CENTRE = world_sql(("0e0", "0e0", "0e0"))


@query(
    "f11_camera_centre", "cam",
    "SELECT mission_id, frame_idx, " + ", ".join(f"{R(e, 6)} AS p{a}" for a, e in zip("xyz", CENTRE)) + ", r20 AS look_x, r21 AS look_y, r22 AS look_z FROM cam",
)
def _(v):
    return camera.camera_centre(v.cam).select(
        "mission_id", "frame_idx", *[half_even(F.col(c), 6).alias(c) for c in ("px", "py", "pz")], "look_x", "look_y", "look_z"
    )


def _odd_cameras(v):
    return v.cam.withColumns(
        {
            "fx": F.when(F.col("frame_idx") % 7 == 0, F.lit(0.0)).otherwise(F.col("fx")),
            "cx": F.when(F.col("frame_idx") % 5 == 0, F.lit(700.0)).otherwise(F.col("cx")),
            "r00": F.when(F.col("frame_idx") % 6 == 0, F.lit(1.2)).otherwise(F.col("r00")),
            "t1": F.when(F.col("frame_idx") % 8 == 0, F.lit(2000.0)).otherwise(F.col("t1")),
        }
    )


ODD = """odd AS (SELECT cam.* REPLACE (CASE WHEN frame_idx % 7 = 0 THEN 0e0 ELSE fx END AS fx, CASE WHEN frame_idx % 5 = 0 THEN 700e0 ELSE cx END AS cx,
  CASE WHEN frame_idx % 6 = 0 THEN 1.2e0 ELSE r00 END AS r00, CASE WHEN frame_idx % 8 = 0 THEN 2000e0 ELSE t1 END AS t1) FROM cam)"""


@query(
    "f12_valid_intrinsics", "cam",
    f"{ODD} SELECT mission_id, frame_idx, fx > 0 AND fy > 0 AND cx BETWEEN -model_w * 0.5 AND model_w * 1.5 AND cy BETWEEN -model_h * 0.5 AND model_h * 1.5 AS ok FROM odd",
)
def _(v):
    return _odd_cameras(v).select("mission_id", "frame_idx", camera.valid_intrinsics().alias("ok"))


ORTHO = "greatest(" + ", ".join(
    f"abs(r0{i} * r0{j} + r1{i} * r1{j} + r2{i} * r2{j} - {1 if i == j else 0})" for i in range(3) for j in range(i, 3)
) + ")"
DET = "(r00 * (r11 * r22 - r12 * r21) - r01 * (r10 * r22 - r12 * r20) + r02 * (r10 * r21 - r11 * r20))"


@query(
    "f13_valid_extrinsics", "cam",
    f"{ODD} SELECT mission_id, frame_idx, {ORTHO} <= 0.1e0 AND abs({DET} - 1e0) <= 0.1e0 AND greatest(abs(t0), abs(t1), abs(t2)) <= 1000 AS ok FROM odd",
)
def _(v):
    return _odd_cameras(v).select("mission_id", "frame_idx", camera.valid_extrinsics().alias("ok"))


@query(
    "f14_to_quaternion", "cam",
    f"""w AS (SELECT *, sqrt(1e0 + r00 + r11 + r22) / 2e0 AS w FROM cam)
    SELECT mission_id, frame_idx, {R('w', 6)} AS qw, {R('(r21 - r12) / (4 * w)', 6)} AS qx, {R('(r02 - r20) / (4 * w)', 6)} AS qy, {R('(r10 - r01) / (4 * w)', 6)} AS qz FROM w""",
)
def _(v):
    return camera.to_quaternion(v.cam).select(
        "mission_id", "frame_idx", *[half_even(F.col(c), 6).alias(c) for c in ("qw", "qx", "qy", "qz")]
    )


MEASURED = f"""{R('sqrt(dx * dx + dy * dy + dz * dz)', 4)} AS distance_m, {R('sqrt(dx * dx + dz * dz)', 4)} AS ground_range_m,
  CASE WHEN dy < -0.05e0 THEN 'CLIMB' WHEN dy > 0.05e0 THEN 'DESCENT' ELSE 'LEVEL' END AS climb,
  {R("CASE WHEN sqrt(dx * dx + dz * dz) > 1e-6 THEN degrees(atan2(-dy, sqrt(dx * dx + dz * dz))) WHEN dy < 0 THEN 90e0 WHEN dy > 0 THEN -90e0 ELSE 0e0 END", 4)} AS pitch_deg,
  {R('sqrt(dx * dx + dy * dy + dz * dz) / 5e0', 4)} AS transit_s,
  CASE WHEN sqrt(dx * dx + dy * dy + dz * dz) < 1 THEN 'DIRECT CONTACT' WHEN sqrt(dx * dx + dy * dy + dz * dz) < 5 THEN 'CLOSE HOVER'
       WHEN sqrt(dx * dx + dy * dy + dz * dz) < 25 THEN 'LOCAL SECTOR' ELSE 'EXTENDED TRANSIT' END AS band"""


@query(
    "f15_measure", "obs cam",
    f"{OC}, m AS (SELECT det_id, x - {CENTRE[0]} AS dx, y - {CENTRE[1]} AS dy, z - {CENTRE[2]} AS dz FROM oc WHERE x IS NOT NULL) SELECT det_id, {MEASURED} FROM m",
)
def _(v):
    seen = camera.camera_centre(obs_cam(v)).filter(F.col("x").isNotNull())
    a, b = [F.col("px"), F.col("py"), F.col("pz")], [F.col("x"), F.col("y"), F.col("z")]
    return seen.select("det_id", *[c.alias(n) for n, c in camera.measure(a, b).items()])


@query(
    "c01_frame_context", "det cam pix",
    """fl AS (SELECT mission_id, frame_idx, count(*) FILTER (is_water) AS water FROM pix GROUP BY ALL)
    SELECT det.det_id, cam.t0, fl.water FROM det JOIN cam ON det.mission_id = cam.mission_id AND det.frame_idx = cam.frame_idx
    JOIN fl ON det.mission_id = fl.mission_id AND det.frame_idx = fl.frame_idx""",
)
def _(v):
    flood = v.pix.groupBy("mission_id", "frame_idx").agg(F.count_if(F.col("is_water")).alias("water"))
    return localize.with_frame_context(v.det, v.cam, flood).select("det_id", "t0", "water")


def model_samples(v):
    """Samples on the model grid, one per pixel."""
    r, c = F.floor(F.col("r") * 392 / 1080), F.floor(F.col("c") * 392 / 1920)
    return v.samp.withColumns({"r": r, "c": c}).groupBy("mission_id", "frame_idx", "r", "c").agg(
        F.min("depth").alias("depth"), F.min("px").alias("px"), F.min("py").alias("py"), F.min("pz").alias("pz")
    )


MS = """ms AS (SELECT mission_id, frame_idx, CAST(floor(r * 392 / 1080) AS BIGINT) AS r, CAST(floor(c * 392 / 1920) AS BIGINT) AS c,
  min(depth) AS depth, min(px) AS px, min(py) AS py, min(pz) AS pz FROM samp GROUP BY 1, 2, 3, 4)"""
UV = "uv AS (SELECT *, CAST(round_even(u * (392 / 1920), 0) AS BIGINT) AS ui, CAST(round_even(v * (392 / 1080), 0) AS BIGINT) AS vi FROM obs)"


@query(
    "c04_near_pixels", "obs cam samp",
    f"""{MS}, {UV}, n AS (SELECT uv.det_id, greatest(abs(r - vi), abs(c - ui)) AS far FROM uv JOIN ms ON uv.mission_id = ms.mission_id
      AND uv.frame_idx = ms.frame_idx WHERE abs(r - vi) <= 7 AND abs(c - ui) <= 7)
    SELECT det_id, CAST(CASE WHEN far <= 2 THEN far WHEN far <= 4 THEN 4 ELSE 7 END AS BIGINT) AS ring, count(*) AS n FROM n GROUP BY ALL""",
)
def _(v):
    u, w = F.rint(F.col("u") * (392.0 / 1920.0)).cast("long"), F.rint(F.col("v") * (392.0 / 1080.0)).cast("long")
    det = v.obs.select("mission_id", "frame_idx", "det_id", u.alias("ui"), w.alias("vi"))
    near = localize.near_pixels(det, model_samples(v).select("mission_id", "frame_idx", "r", "c"))
    return near.groupBy("det_id", "ring").agg(F.count(F.lit(1)).alias("n"))


LOCALIZED = f"""{MS}, {OC}, s AS (SELECT *, model_w / img_w AS sx, model_h / img_h AS sy FROM oc),
  b AS (SELECT *, greatest(0, trunc(x1 * sx)) AS bx1, greatest(0, trunc(y1 * sy)) AS by1, least(model_w, trunc(x2 * sx)) AS bx2, least(model_h, trunc(y2 * sy)) AS by2 FROM s),
  m AS (SELECT *, trunc(bx1 + (bx2 - bx1) * 0.3e0) AS mx1, trunc(by1 + (by2 - by1) * 0.3e0) AS my1,
     greatest(trunc(bx1 + (bx2 - bx1) * 0.3e0) + 1, trunc(bx1 + (bx2 - bx1) * 0.7e0)) AS mx2,
     greatest(trunc(by1 + (by2 - by1) * 0.3e0) + 1, trunc(by1 + (by2 - by1) * 0.7e0)) AS my2 FROM b),
  d AS (SELECT m.det_id, median(CASE WHEN r >= my1 AND r < my2 AND c >= mx1 AND c < mx2 THEN depth END) AS mid,
     median(CASE WHEN r >= by1 AND r < by2 AND c >= bx1 AND c < bx2 THEN depth END) AS whole
     FROM m JOIN (SELECT * FROM ms WHERE depth > 0.1 AND depth < 150) q ON m.mission_id = q.mission_id AND m.frame_idx = q.frame_idx GROUP BY 1),
  p AS (SELECT m.*, coalesce(d.mid, d.whole) AS dd FROM m LEFT JOIN d ON m.det_id = d.det_id),
  c AS (SELECT *, (u * sx - cx) * dd / fx AS ux, (v * sy - cy) * dd / fy AS uy FROM p),
  w AS (SELECT *, {world_sql(('ux', 'uy', 'dd'))[0]} AS wx, {world_sql(('ux', 'uy', 'dd'))[1]} AS wy, {world_sql(('ux', 'uy', 'dd'))[2]} AS wz FROM c),
  k AS (SELECT *, {camera_sql(('wx', 'wy', 'wz'))[0]} AS kx, {camera_sql(('wx', 'wy', 'wz'))[1]} AS ky, {camera_sql(('wx', 'wy', 'wz'))[2]} AS kz FROM w),
  e AS (SELECT *, fx * kx / kz + cx AS ru, fy * ky / kz + cy AS rv FROM k),
  f AS (SELECT *, CASE WHEN dd IS NULL THEN NULL WHEN kz <= 0.001e0 OR ru < 0 OR rv < 0 THEN 999e0
     ELSE sqrt((ru / sx - u) * (ru / sx - u) + (rv / sy - v) * (rv / sy - v)) END AS err FROM e),
  loc AS (SELECT mission_id, frame_idx, det_id, track_id, raw_class, conf, coalesce(err <= 30, false) AS good,
     CASE WHEN coalesce(err <= 30, false) THEN 'LOCALIZED_3D' ELSE 'UNLOCALIZED' END AS location_status,
     CASE WHEN err <= 30 THEN {R('wx', 2)} END AS x_m, CASE WHEN err <= 30 THEN {R('wy', 2)} END AS y_m, CASE WHEN err <= 30 THEN {R('wz', 2)} END AS z_m,
     CASE WHEN err <= 30 THEN {R('dd', 2)} END AS depth_m, {R('err', 2)} AS reprojection_error_px,
     CASE WHEN err <= 30 THEN {R('0.4e0 * conf + 0.3e0 * greatest(0e0, 1e0 - err / 30e0) + 0.3e0 * CASE WHEN dd > 0.5e0 THEN 0.9e0 ELSE 0.6e0 END', 3)} END AS object_conf
     FROM f)"""


def localized(v):
    return localize.localize(v.obs.drop("x", "y", "z"), model_samples(v), v.cam)


@query(
    "f06_localize", "obs cam samp",
    LOCALIZED + " SELECT det_id, location_status, x_m, y_m, z_m, depth_m, reprojection_error_px, object_conf FROM loc",
)
def _(v):
    return localized(v).select(
        "det_id", "location_status", "x_m", "y_m", "z_m", "depth_m", "reprojection_error_px", "object_conf"
    )


LOOKED = f"""{MS}, {UV}, n AS (SELECT uv.det_id, r, c, depth, px, py, pz, greatest(abs(r - vi), abs(c - ui)) AS far FROM uv JOIN ms ON uv.mission_id = ms.mission_id
      AND uv.frame_idx = ms.frame_idx WHERE abs(r - vi) <= 7 AND abs(c - ui) <= 7 AND ui BETWEEN 0 AND 391 AND vi BETWEEN 0 AND 391),
  g AS (SELECT *, CASE WHEN far <= 2 THEN far WHEN far <= 4 THEN 4 ELSE 7 END AS ring FROM n),
  gp AS (SELECT det_id, ring, median(px) AS px, median(py) AS py, median(pz) AS pz FROM g WHERE px IS NOT NULL AND py IS NOT NULL AND pz IS NOT NULL
     AND sqrt(px * px + py * py + pz * pz) > 1e-3 AND sqrt(px * px + py * py + pz * pz) < 500 GROUP BY 1, 2),
  gd AS (SELECT det_id, ring, median(depth) AS depth FROM g WHERE depth >= 0.2e0 AND depth <= 250 GROUP BY 1, 2),
  bp AS (SELECT det_id, min(ring) AS pring, arg_min(px, ring) AS px, arg_min(py, ring) AS py, arg_min(pz, ring) AS pz FROM gp GROUP BY 1),
  bd AS (SELECT det_id, min(ring) AS dring, arg_min(depth, ring) AS dd FROM gd GROUP BY 1),
  {OC}, a AS (SELECT oc.*, bp.pring, bp.px AS ppx, bp.py AS ppy, bp.pz AS ppz, bd.dring, bd.dd,
     (u * (model_w / img_w) - cx) * bd.dd / fx AS ux, (v * (model_h / img_h) - cy) * bd.dd / fy AS uy
     FROM oc LEFT JOIN bp ON oc.det_id = bp.det_id LEFT JOIN bd ON oc.det_id = bd.det_id),
  looked AS (SELECT det_id, mission_id, frame_idx, track_id, coalesce(pring, dring) AS ring,
     CASE WHEN coalesce(pring, dring) IS NULL THEN 'UNAVAILABLE' ELSE 'LOCALIZED_3D' END AS location_status,
     CASE WHEN pring IS NOT NULL THEN {R('ppx', 3)} ELSE {R(world_sql(('ux', 'uy', 'dd'))[0], 3)} END AS x_m,
     CASE WHEN pring IS NOT NULL THEN {R('ppy', 3)} ELSE {R(world_sql(('ux', 'uy', 'dd'))[1], 3)} END AS y_m,
     CASE WHEN pring IS NOT NULL THEN {R('ppz', 3)} ELSE {R(world_sql(('ux', 'uy', 'dd'))[2], 3)} END AS z_m FROM a)"""


@query(
    "f07_lookup", "obs cam samp",
    LOOKED + """ SELECT det_id, location_status, x_m, y_m, z_m, CAST(coalesce(ring * 2 + 1, 0) AS BIGINT) AS neighborhood_size,
      CASE WHEN ring IS NULL THEN 'FAILED' WHEN ring = 0 THEN 'DIRECT_HIT' ELSE 'NEIGHBORHOOD_' || (ring * 2 + 1) || 'x' || (ring * 2 + 1) END AS status FROM looked""",
)
def _(v):
    samples = model_samples(v)
    found = localize.lookup(v.obs.drop("x", "y", "z"), samples, samples, v.cam)
    return found.select("det_id", "location_status", "x_m", "y_m", "z_m", "neighborhood_size", "status")


BOXED_LOOK = LOOKED.replace(
    "FROM g WHERE depth >= 0.2e0 AND depth <= 250 GROUP BY 1, 2",
    """FROM g JOIN uvb USING (det_id) WHERE depth >= 0.2e0 AND depth <= 250 AND c BETWEEN bx1 AND bx2 AND r BETWEEN by1 AND by2 GROUP BY 1, 2""",
).replace(
    ", n AS (SELECT uv.det_id",
    """, uvb AS (SELECT det_id, CAST(trunc(x1 * (392e0 / 1920e0)) AS BIGINT) AS bx1, CAST(trunc(y1 * (392e0 / 1080e0)) AS BIGINT) AS by1,
      CAST(trunc(x2 * (392e0 / 1920e0)) AS BIGINT) AS bx2, CAST(trunc(y2 * (392e0 / 1080e0)) AS BIGINT) AS by2 FROM obs), n AS (SELECT uv.det_id""", 1,
)


@query(
    "f07_lookup_in_box", "obs cam samp",
    BOXED_LOOK + """ SELECT det_id, location_status, x_m, y_m, z_m, CAST(coalesce(ring * 2 + 1, 0) AS BIGINT) AS neighborhood_size,
      CASE WHEN ring IS NULL THEN 'FAILED' WHEN ring = 0 THEN 'DIRECT_HIT' ELSE 'NEIGHBORHOOD_' || (ring * 2 + 1) || 'x' || (ring * 2 + 1) END AS status FROM looked""",
)
def _(v):
    samples = model_samples(v)
    found = localize.lookup(v.obs.drop("x", "y", "z"), samples, samples, v.cam, box=("x1", "y1", "x2", "y2"))
    return found.select("det_id", "location_status", "x_m", "y_m", "z_m", "neighborhood_size", "status")


@query(
    "e03_fuse_positions", "obs cam samp",
    LOCALIZED + f""", tr AS (SELECT * FROM loc WHERE track_id IS NOT NULL), pl AS (SELECT * FROM tr WHERE good),
    md AS (SELECT mission_id, track_id, median(x_m) AS mx, median(y_m) AS my, median(z_m) AS mz, count(*) AS n FROM pl GROUP BY ALL),
    jd AS (SELECT pl.*, n < 3 OR sqrt((x_m - mx) * (x_m - mx) + (y_m - my) * (y_m - my) + (z_m - mz) * (z_m - mz)) <= 2.5e0 AS inl
      FROM pl JOIN md ON pl.mission_id = md.mission_id AND pl.track_id = md.track_id),
    kept AS (SELECT mission_id, track_id, bool_or(inl) AS any_in FROM jd GROUP BY ALL),
    us AS (SELECT jd.* FROM jd JOIN kept ON jd.mission_id = kept.mission_id AND jd.track_id = kept.track_id WHERE inl OR NOT any_in),
    fu AS (SELECT mission_id, track_id, avg(x_m) AS ax, avg(y_m) AS ay, avg(z_m) AS az, avg(reprojection_error_px) AS ae, avg(conf) AS ac, count(*) AS n FROM us GROUP BY ALL),
    al AS (SELECT mission_id, track_id, list_sort(list_distinct(list(frame_idx))) AS source_frames, count(*) AS observation_count FROM tr GROUP BY ALL)
    SELECT al.mission_id, al.track_id, CASE WHEN n IS NULL THEN 'UNLOCALIZED' ELSE 'LOCALIZED_3D' END AS location_status,
      {RS('ax', 2)} AS x_m, {RS('ay', 2)} AS y_m, {RS('az', 2)} AS z_m, {RS('ae', 2)} AS reprojection_error_px,
      CASE WHEN n IS NOT NULL THEN {RS('least(0.98e0, ac + least(0.15e0, n * 0.03e0))', 3)} END AS confidence, source_frames, observation_count
    FROM al LEFT JOIN fu ON al.mission_id = fu.mission_id AND al.track_id = fu.track_id""",
)
def _(v):
    return localize.fuse_positions(localized(v))


@query(
    "e31_reprojection_stats", "person",
    f"""SELECT mission_id, count(*) AS evaluated, count(*) FILTER (e <= 25) AS valid, count(*) FILTER (e > 25) AS rejected,
      {RS('coalesce(avg(e) FILTER (e <= 25), 0e0)', 4)} AS valid_mean, {R('coalesce(median(e) FILTER (e <= 25), 0e0)', 4)} AS valid_median,
      {R('coalesce(max(e) FILTER (e <= 25), 0e0)', 4)} AS valid_max, {RS('avg(e)', 4)} AS all_mean
    FROM (SELECT mission_id, reprojection_error_px AS e FROM person WHERE reprojection_error_px IS NOT NULL) s GROUP BY 1""",
)
def _(v):
    return localize.reprojection_stats(v.person)


@query(
    "l05_localization_gate", "obs cam samp",
    LOCALIZED + """, q AS (SELECT mission_id, count(*) FILTER (good) * 2 > count(*) AND mission_id % 2 = 0 AS ok FROM loc GROUP BY 1)
    SELECT det_id, CASE WHEN ok THEN location_status ELSE 'UNLOCALIZED' END AS location_status, CASE WHEN ok THEN x_m END AS x_m,
      CASE WHEN ok THEN y_m END AS y_m, CASE WHEN ok THEN z_m END AS z_m, CASE WHEN ok THEN reprojection_error_px END AS reprojection_error_px
    FROM loc JOIN q ON loc.mission_id = q.mission_id""",
)
def _(v):
    placed = localized(v)
    quality = placed.groupBy("mission_id").agg(
        (
            (F.count_if(F.col("location_status") == "LOCALIZED_3D") * 2 > F.count(F.lit(1)))
            & (F.col("mission_id") % 2 == 0)
        ).alias("localization_allowed")
    )
    return localize.localization_gate(placed, quality).select(
        "det_id", "location_status", "x_m", "y_m", "z_m", "reprojection_error_px"
    )


# ---------------------------------------------------------------- tracking


def trackable(v):
    return boxes.clip_box(boxes.normalize_class(v.det))


BOXED = """bx AS (SELECT det_id, mission_id, frame_idx, CASE WHEN raw_class IN ('car','truck') THEN 'vehicle' ELSE raw_class END AS cls,
  x1, y1, x2, y2, CAST(floor((x1 + x2) / 2) AS BIGINT) AS cx, CAST(floor((y1 + y2) / 2) AS BIGINT) AS cy FROM det)"""


@query(
    "c05_score_pairs", "det",
    f"""{BOXED}, p AS (SELECT d.mission_id, d.frame_idx, t.det_id AS track_key, d.det_id, t.cls AS tc, d.cls AS dc,
       least(t.x2, d.x2) - greatest(t.x1, d.x1) AS iw, least(t.y2, d.y2) - greatest(t.y1, d.y1) AS ih,
       (t.x2 - t.x1) * (t.y2 - t.y1) + (d.x2 - d.x1) * (d.y2 - d.y1) AS areas,
       sqrt(CAST((t.cx - d.cx) * (t.cx - d.cx) + (t.cy - d.cy) * (t.cy - d.cy) AS DOUBLE)) AS dist
       FROM bx t JOIN bx d ON t.mission_id = d.mission_id AND d.frame_idx = t.frame_idx + 2),
    i AS (SELECT *, CASE WHEN iw > 0 AND ih > 0 THEN iw * ih / greatest(1e0, areas - iw * ih) ELSE 0e0 END AS iou FROM p),
    s AS (SELECT *, CASE WHEN tc = 'person' AND dc = 'person' THEN greatest(iou, 1e0 - dist / 280e0) + 0.25e0
       ELSE greatest(iou, 0.5e0 * greatest(0e0, 1e0 - dist / 200e0)) + CASE WHEN tc = dc THEN 0.15e0 ELSE 0e0 END END AS score FROM i)
    SELECT mission_id, frame_idx, track_key, det_id, {R('score', 6)} AS score FROM s
    WHERE CASE WHEN tc = 'person' AND dc = 'person' THEN dist <= 280 ELSE NOT (tc <> dc AND iou < 0.2e0 AND dist > 45) AND score > 0.15e0 END""",
)
def _(v):
    rows = trackable(v)
    tracks = rows.withColumns(
        {"frame_idx": F.col("frame_idx") + 2, "frames_missed": F.lit(2), "track_key": F.col("det_id")}
    )
    return tracking.score_pairs(tracks, rows)


# One step of the recursion is one frame: score all pairs, take the best ones first, let the rest found tracks.
PAIR_IOU = """(CASE WHEN least(e.x2, d.x2) > greatest(e.x1, d.x1) AND least(e.y2, d.y2) > greatest(e.y1, d.y1)
  THEN (least(e.x2, d.x2) - greatest(e.x1, d.x1)) * (least(e.y2, d.y2) - greatest(e.y1, d.y1))
    / greatest(1e0, CAST((e.x2 - e.x1) * (e.y2 - e.y1) + (d.x2 - d.x1) * (d.y2 - d.y1) - (least(e.x2, d.x2) - greatest(e.x1, d.x1)) * (least(e.y2, d.y2) - greatest(e.y1, d.y1)) AS DOUBLE)) ELSE 0e0 END)"""
PAIR_GAP = "sqrt(CAST((e.cx - d.cx) * (e.cx - d.cx) + (e.cy - d.cy) * (e.cy - d.cy) AS DOUBLE))"
REACH = "(250e0 + 30e0 * greatest(0, frame_idx - e.last - 1))"
PAIR_SCORE = f"""CASE WHEN e.cls = 'person' AND d.cls = 'person' THEN CASE WHEN {PAIR_GAP} <= {REACH} THEN greatest({PAIR_IOU}, greatest(0e0, 1e0 - {PAIR_GAP} / {REACH})) + 0.25e0 END
  WHEN e.cls <> d.cls AND {PAIR_IOU} < 0.2e0 AND {PAIR_GAP} > 45 THEN NULL
  WHEN greatest({PAIR_IOU}, 0.5e0 * greatest(0e0, 1e0 - {PAIR_GAP} / 200e0)) + CASE WHEN e.cls = d.cls THEN 0.15e0 ELSE 0e0 END > 0.15e0
  THEN greatest({PAIR_IOU}, 0.5e0 * greatest(0e0, 1e0 - {PAIR_GAP} / 200e0)) + CASE WHEN e.cls = d.cls THEN 0.15e0 ELSE 0e0 END END"""
TRACK = "STRUCT(x1 BIGINT, y1 BIGINT, x2 BIGINT, y2 BIGINT, cx BIGINT, cy BIGINT, cls VARCHAR, last BIGINT, len BIGINT, id BIGINT)"
SEEN_AS = "{'x1': d.x1, 'y1': d.y1, 'x2': d.x2, 'y2': d.y2, 'cx': d.cx, 'cy': d.cy, 'cls': %s, 'last': frame_idx, 'len': %s, 'id': %s}"
TRACKED = f"""RECURSIVE {BOXED}, fr AS (SELECT mission_id, frame_idx, row_number() OVER (PARTITION BY mission_id ORDER BY frame_idx) AS rn,
      list({{'det': det_id, 'cls': cls, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'cx': cx, 'cy': cy}} ORDER BY CASE cls WHEN 'person' THEN 0 ELSE 1 END, conf DESC, det_id DESC) AS ds
      FROM (SELECT bx.*, det.conf FROM bx JOIN det USING (det_id)) b GROUP BY 1, 2),
  walk AS (SELECT mission_id, CAST(-1 AS BIGINT) AS frame_idx, 0 AS rn, CAST([] AS {TRACK}[]) AS st, CAST(0 AS BIGINT) AS made, CAST([] AS STRUCT(det BIGINT, id BIGINT, len BIGINT)[]) AS found FROM (SELECT DISTINCT mission_id FROM fr) g
    UNION ALL
    SELECT mission_id, frame_idx, rn, list_concat(kept, fresh), made + len(fresh),
      list_transform(ds, lambda d, i: CASE WHEN len(list_filter(took, lambda x: x.d = i)) > 0
        THEN {{'det': d.det, 'id': kept[list_filter(took, lambda x: x.d = i)[1].t].id, 'len': kept[list_filter(took, lambda x: x.d = i)[1].t].len}}
        ELSE {{'det': d.det, 'id': made + list_position(alone, i), 'len': CAST(1 AS BIGINT)}} END)
    FROM (SELECT *, list_transform(live, lambda e, t: CASE WHEN len(list_filter(took, lambda x: x.t = t)) > 0
              THEN list_transform([ds[list_filter(took, lambda x: x.t = t)[1].d]], lambda d: {SEEN_AS % ('e.cls', 'e.len + 1', 'e.id')})[1] ELSE e END) AS kept,
            list_transform(alone, lambda i, j: list_transform([ds[i]], lambda d: {SEEN_AS % ('d.cls', 'CAST(1 AS BIGINT)', 'made + j')})[1]) AS fresh
      FROM (SELECT *, list_filter(range(1, len(ds) + 1), lambda i: len(list_filter(took, lambda x: x.d = i)) = 0) AS alone
        FROM (SELECT *, coalesce(list_reduce(pairs, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.t = x[1].t OR y.d = x[1].d)) > 0 THEN acc ELSE list_concat(acc, x) END), CAST([] AS STRUCT(s DOUBLE, t BIGINT, d BIGINT)[])) AS took
          FROM (SELECT *, CASE WHEN len(scored) > 0 THEN list_transform(list_sort(scored), lambda x: [x]) END AS pairs
            FROM (SELECT *, list_filter(flatten(list_transform(live, lambda e, t: list_transform(ds, lambda d, i: {{'s': -({PAIR_SCORE}), 't': t, 'd': i}}))), lambda x: x.s IS NOT NULL) AS scored
              FROM (SELECT f.mission_id, f.frame_idx, f.rn, f.ds, w.made, list_filter(w.st, lambda e: f.frame_idx - e.last <= 5) AS live
                FROM walk w JOIN fr f ON f.mission_id = w.mission_id AND f.rn = w.rn + 1) a) b) c) d) e) f),
  trk1 AS (SELECT mission_id, frame_idx, unnest(found, recursive := false) AS m FROM walk WHERE rn > 0)"""


@query("d01_track", "det", f"{TRACKED} SELECT mission_id, frame_idx, m.det AS det_id, m.id AS track_id, m.len AS track_length, CASE WHEN m.len <= 1 THEN 0.55e0 ELSE least(1e0, {R('0.4e0 + 0.15e0 * least(m.len, 4)', 3)}) END AS tracking_conf FROM trk1")
def _(v):
    return tracking.track(trackable(v)).select("mission_id", "frame_idx", "det_id", "track_id", "track_length", "tracking_conf")


SHARED = "greatest(0, least(o.x2, e.x2) - greatest(o.x1, e.x1) + 1) * greatest(0, least(o.y2, e.y2) - greatest(o.y1, e.y1) + 1)"
SIMPLE_IOU = f"""({SHARED} / (CAST((o.x2 - o.x1 + 1) * (o.y2 - o.y1 + 1) + (e.x2 - e.x1 + 1) * (e.y2 - e.y1 + 1) - {SHARED} AS DOUBLE) + 1e-6))"""
SIMPLE_GAP = "sqrt(CAST((o.cx - e.cx) * (o.cx - e.cx) + (o.cy - e.cy) * (o.cy - e.cy) AS DOUBLE))"
ONE_BOX = "{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'cx': cx, 'cy': cy}"


@query(
    "d02_track_simple", "det",
    f"""RECURSIVE {BOXED}, o AS (SELECT *, row_number() OVER (PARTITION BY mission_id, cls ORDER BY frame_idx, det_id) AS rn FROM bx),
    walk AS (SELECT mission_id, cls, 0 AS rn, CAST([] AS STRUCT(x1 BIGINT, y1 BIGINT, x2 BIGINT, y2 BIGINT, cx BIGINT, cy BIGINT)[]) AS st, CAST(NULL AS BIGINT) AS det_id, CAST(NULL AS BIGINT) AS frame_idx, 0 AS k FROM (SELECT DISTINCT mission_id, cls FROM o) g
      UNION ALL
      SELECT mission_id, cls, rn, CASE WHEN spot > 0 THEN list_transform(st, lambda e, i: CASE WHEN i = spot THEN {ONE_BOX} ELSE e END) ELSE list_append(st, {ONE_BOX}) END,
        det_id, frame_idx, CASE WHEN spot > 0 THEN spot ELSE len(st) + 1 END FROM (
          SELECT *, CASE WHEN coalesce(list_max(sc), -1) > 0 THEN list_position(sc, list_max(sc)) ELSE 0 END AS spot FROM (
            SELECT w.st, o.*, list_transform(w.st, lambda e: CASE WHEN {SIMPLE_IOU} > 0.2e0 OR {SIMPLE_GAP} < 60 THEN {SIMPLE_IOU} + 1e0 / (1e0 + {SIMPLE_GAP}) ELSE -1e0 END) AS sc
            FROM walk w JOIN o ON o.mission_id = w.mission_id AND o.cls = w.cls AND o.rn = w.rn + 1) a) b)
    SELECT mission_id, frame_idx, det_id, printf('%s_%03d', upper(cls), k) AS object_id FROM walk WHERE rn > 0""",
)
def _(v):
    return tracking.track_simple(trackable(v)).select("mission_id", "frame_idx", "det_id", "object_id")


@query(
    "f19_tracking_confidence", "trk",
    f"""n AS (SELECT det_id, row_number() OVER (PARTITION BY mission_id, track_id ORDER BY frame_idx, det_id) AS track_length FROM trk)
    SELECT det_id, CASE WHEN track_length <= 1 THEN 0.55e0 ELSE least(1e0, {R('0.4e0 + 0.15e0 * least(track_length, 4)', 3)}) END AS tracking_conf FROM n""",
)
def _(v):
    from skysift.operators.ordering import BLOCK, numbered

    block = F.floor(F.col("frame_idx") / BLOCK)
    order = [F.col("frame_idx"), F.col("det_id")]
    counted = numbered(v.trk, ["mission_id", "track_id"], block, order, "track_length")
    return counted.select("det_id", tracking.tracking_confidence(F.col("track_length")).alias("tracking_conf"))
