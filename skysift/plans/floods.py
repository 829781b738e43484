"""Queries over water masks, hazards, damage and surroundings."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysift.functions.numeric import half_even
from skysift.operators import flood, raster, spatial
from skysift.plans.rasters import HSV
from skysift.plans.registry import FX, R, RS, query

FR = "mission_id, frame_idx"
ON = "a.mission_id = b.mission_id AND a.frame_idx = b.frame_idx"

PARTS = """wet AS (SELECT mission_id, frame_idx, r, c FROM pix WHERE is_water),
  reach AS (SELECT mission_id, frame_idx, r * 100 + c AS src, r, c FROM wet
    UNION SELECT a.mission_id, a.frame_idx, src, b.r, b.c FROM reach a JOIN wet b ON a.mission_id = b.mission_id AND a.frame_idx = b.frame_idx
      AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1),
  lab AS (SELECT mission_id, frame_idx, r, c, min(src) AS label FROM reach GROUP BY 1, 2, 3, 4),
  tot AS (SELECT mission_id, frame_idx, count(*) AS total, count(*) FILTER (is_water) AS wn FROM pix GROUP BY 1, 2),
  part AS (SELECT mission_id, frame_idx, label, count(*) AS area, min(c) AS min_c, max(c) AS max_c, min(r) AS min_r, max(r) AS max_r FROM lab GROUP BY 1, 2, 3)"""


@query("k09_mask_components", "pix", f"RECURSIVE {PARTS} SELECT {FR}, CAST(floor(label / 100) AS BIGINT) AS top_r, label % 100 AS top_c, area, min_c, max_c, min_r, max_r FROM part")
def _(v):
    out = spatial.mask_components(v.pix.filter("is_water"), ["mission_id", "frame_idx"], 4)
    return out.select("mission_id", "frame_idx", F.floor(F.col("label") / spatial.RUN_UNIT).alias("top_r"), (F.col("label") % spatial.RUN_UNIT).alias("top_c"), "area", "min_c", "max_c", "min_r", "max_r")


OVER = """ov AS (SELECT a.mission_id, a.frame_idx, a.det_id, any_value(a.class_name) AS class_name, avg(CAST(b.{flag} AS INT)) AS share FROM rbox a JOIN {mask} b
  ON a.mission_id = b.mission_id AND a.frame_idx = b.frame_idx AND b.r >= a.ry1 AND b.r < a.ry2 AND b.c >= a.rx1 AND b.c < a.rx2 GROUP BY 1, 2, 3)"""


@query(
    "c03_box_fraction", "rbox pix",
    OVER.format(flag="is_water", mask="pix") + f" SELECT a.det_id, {R('coalesce(share, 0e0)', 6)} AS water_overlap FROM rbox a LEFT JOIN ov ON a.det_id = ov.det_id",
)
def _(v):
    out = flood.water_overlap(v.rbox, v.pix, tile=4)
    return out.select("det_id", half_even(F.col("water_overlap"), 6).alias("water_overlap"))


@query(
    "j08_water_overlap", "rbox pix",
    OVER.format(flag="is_water", mask="pix") + f""" SELECT a.mission_id, a.class_name, count(*) AS boxes, {RS('avg(coalesce(share, 0e0))', 6)} AS mean_overlap,
    count(*) FILTER (share > 0.15e0) AS wet_boxes FROM rbox a LEFT JOIN ov ON a.det_id = ov.det_id GROUP BY 1, 2""",
)
def _(v):
    share = F.col("water_overlap")
    return flood.water_overlap(v.rbox, v.pix, tile=4).groupBy("mission_id", "class_name").agg(
        F.count(F.lit(1)).alias("boxes"),
        half_even(half_even(F.avg(share), 9), 6).alias("mean_overlap"),
        F.count_if(share > 0.15).alias("wet_boxes"),
    )


VALID = f"""{PARTS}, big AS (SELECT part.*, area >= floor(total * 0.05e0) AS ok FROM part JOIN tot USING (mission_id, frame_idx)),
  vm AS (SELECT pix.*, coalesce(ok, false) AS is_valid FROM pix LEFT JOIN lab USING (mission_id, frame_idx, r, c) LEFT JOIN big USING (mission_id, frame_idx, label)),
  top AS (SELECT mission_id, frame_idx, arg_max(area, area * 10000 - label) AS largest,
    arg_max(greatest(max_c - min_c + 1, max_r - min_r + 1) / greatest(1, least(max_c - min_c + 1, max_r - min_r + 1)), area * 10000 - label) AS aspect FROM big GROUP BY 1, 2),
  flat AS (SELECT mission_id, frame_idx, CASE WHEN count(*) FILTER (is_valid) > 10 AND count(*) FILTER (is_valid AND depth > 0.1) > 5
    THEN least(1e0, greatest(0e0, 1e0 - stddev_pop(depth) FILTER (is_valid AND depth > 0.1) / (avg(depth) FILTER (is_valid AND depth > 0.1) + 1e-4))) ELSE 0.5e0 END AS flat,
    avg(CAST(is_valid AS INT)) AS ratio FROM vm GROUP BY 1, 2), {OVER.format(flag='is_valid', mask='vm')},
  ctx AS (SELECT mission_id, frame_idx, coalesce(max(share) FILTER (class_name = 'building'), 0e0) AS bldg, coalesce(max(share) FILTER (class_name = 'vehicle'), 0e0) AS road,
    bool_or(class_name IN ('vehicle', 'person', 'boat') AND share > 0.05e0) AS contact FROM ov GROUP BY 1, 2)"""


def _mask(v):
    runs, parts = flood.mask_parts(v.pix, 0.05, 4)
    return flood.valid_mask(v.pix, runs, parts)


@query("e18_depth_flatness", "rbox pix", f"RECURSIVE {VALID} SELECT {FR}, {RS('flat', 4)} AS depth_flatness FROM flat")
def _(v):
    out = flood.depth_flatness(_mask(v), "is_valid", 10, 5)
    return out.withColumn("depth_flatness", half_even(half_even(F.col("depth_flatness"), 9), 4))


@query("e19_overlap_context", "rbox pix", f"RECURSIVE {VALID} SELECT {FR}, {R('bldg', 6)} AS building_overlap, {R('road', 6)} AS road_overlap, contact FROM ctx")
def _(v):
    frames = v.pix.select("mission_id", "frame_idx").distinct()
    boxes = v.rbox.join(frames, ["mission_id", "frame_idx"], "left_semi")
    out = flood.overlap_context(boxes, _mask(v), "is_valid", 4)
    return out.withColumns({c: half_even(F.col(c), 6) for c in ("building_overlap", "road_overlap")})


STATE = f"""{VALID}, fl AS (SELECT tot.mission_id, tot.frame_idx, ratio, wn / total AS cand, coalesce(largest, 0) / total AS largest, coalesce(aspect, 1e0) AS aspect, flat,
    coalesce(bldg, 0e0) AS bldg, coalesce(road, 0e0) AS road, coalesce(contact, false) AS contact
    FROM tot JOIN flat USING (mission_id, frame_idx) LEFT JOIN top USING (mission_id, frame_idx) LEFT JOIN ctx USING (mission_id, frame_idx)),
  cd AS (SELECT *, CASE WHEN ratio < 0.02e0 AND cand < 0.03e0 THEN 0 WHEN aspect >= 3.5e0 AND bldg < 0.02e0 AND road < 0.02e0 AND NOT contact AND ratio <= 0.2e0 THEN 1
    WHEN ratio >= 0.2e0 OR (ratio >= 0.06e0 AND (bldg > 0.02e0 OR road > 0.03e0 OR contact)) THEN 2 WHEN ratio >= 0.04e0 OR cand >= 0.06e0 THEN 3 ELSE 4 END AS code FROM fl),
  state AS (SELECT mission_id, frame_idx, CASE code WHEN 0 THEN 'NO_WATER' WHEN 2 THEN 'VALIDATED_INUNDATION' WHEN 3 THEN 'POTENTIAL_INUNDATION' ELSE 'WATER_BODY' END AS water_state,
    {R('ratio', 4)} AS water_ratio, {R('cand', 4)} AS candidate_ratio,
    {R('CASE code WHEN 0 THEN 0e0 WHEN 1 THEN 0.15e0 WHEN 2 THEN least(1e0, 0.4e0 + ratio * 1.5e0 + bldg * 0.3e0 + flat * 0.2e0) WHEN 3 THEN least(0.75e0, greatest(0.3e0, 0.35e0 + ratio)) ELSE 0.1e0 END', 3)} AS flood_confidence,
    {RS('flat', 3)} AS depth_flatness, {R('bldg', 3)} AS building_overlap, {R('road', 3)} AS road_overlap, {R('largest', 4)} AS largest_component_ratio,
    CASE WHEN code IN (2, 3) THEN 'PASS' ELSE 'FAIL' END AS incident_gate,
    CASE code WHEN 0 THEN 'Water candidate coverage is negligible (<2% of image area).'
      WHEN 1 THEN 'Water detected but confined in natural channel/canal (aspect ratio ' || {FX('aspect', 1)} || ':1, no infrastructure inundation).'
      WHEN 2 THEN 'Confirmed inundation across ' || {FX('ratio * 100e0', 1)} || '% of scene contacting built infrastructure/terrain.'
      WHEN 3 THEN 'Potential flood inundation detected (' || {FX('ratio * 100e0', 1)} || '% surface coverage).'
      ELSE 'Minor water body candidate detected without signs of hazardous flooding.' END AS summary_evidence FROM cd)"""


def flood_states(v):
    return flood.flood_state(v.pix, v.rbox, 0.05, 10, 5, 4)


@query("j02_flood_state", "rbox pix", f"RECURSIVE {STATE} SELECT * FROM state")
def _(v):
    return flood_states(v)


ROLL = """roll AS (SELECT mission_id, max(water_ratio) AS max_ratio, count(*) FILTER (water_state = 'VALIDATED_INUNDATION') AS validated_frames,
  count(*) FILTER (water_state = 'POTENTIAL_INUNDATION') AS potential_frames, count(*) AS frames FROM state GROUP BY 1)"""


@query(
    "e20_flood_rollup", "rbox pix",
    f"""RECURSIVE {STATE}, {ROLL} SELECT *, validated_frames > 0 OR max_ratio >= 0.05e0 AS is_flooded, CASE WHEN validated_frames > 0 THEN 'VALIDATED_INUNDATION'
    WHEN potential_frames > 0 THEN 'POTENTIAL_INUNDATION' WHEN max_ratio > 0.01e0 THEN 'WATER_BODY' ELSE 'NO_WATER' END AS dominant_state FROM roll""",
)
def _(v):
    return flood.flood_rollup(flood_states(v))


EVID = f"""{PARTS}, tp AS (SELECT mission_id, frame_idx, max(area) AS top FROM part GROUP BY 1, 2),
  cov AS (SELECT b.mission_id, b.frame_idx, b.r, b.c, b.is_water FROM rbox a JOIN pix b ON {ON} AND b.r >= a.ry1 AND b.r < a.ry2 AND b.c >= a.rx1 AND b.c < a.rx2
    WHERE a.class_name = 'building' GROUP BY ALL),
  bl AS (SELECT mission_id, frame_idx, count(*) FILTER (is_water) / (count(*) + 1e-6) AS bldg FROM cov GROUP BY 1, 2),
  bu AS (SELECT DISTINCT mission_id, frame_idx FROM rbox WHERE class_name = 'building'),
  e0 AS (SELECT tot.mission_id, tot.frame_idx, wn / total AS ratio, coalesce(top / (wn + 1e-6), 0e0) AS coh, coalesce(bldg, 0e0) AS bldg, bu.mission_id IS NOT NULL AS built
    FROM tot LEFT JOIN tp USING (mission_id, frame_idx) LEFT JOIN bl USING (mission_id, frame_idx) LEFT JOIN bu ON tot.mission_id = bu.mission_id AND tot.frame_idx = bu.frame_idx),
  e1 AS (SELECT *, CASE WHEN ratio > 0.02e0 THEN least(1e0, ratio * 3e0) ELSE 0e0 END AS sem,
    CASE WHEN built THEN least(1e0, 0.3e0 + bldg * 1.5e0) ELSE least(0.3e0, ratio * 0.8e0) END AS inun FROM e0),
  e2 AS (SELECT *, 0.4e0 * (sem * coh) + 0.5e0 * inun + 0.1e0 * least(1e0, ratio * 4e0) AS score FROM e1),
  ev AS (SELECT mission_id, frame_idx, {R('ratio', 4)} AS water_ratio, {R('sem', 4)} AS semantic_confidence, {R('inun', 4)} AS inundation_confidence, {R('coh', 4)} AS spatial_coherence,
    {R('bldg', 4)} AS building_overlap_ratio, 0e0 AS road_overlap_ratio, {R('score', 4)} AS flood_score,
    CASE WHEN ratio < 0.03e0 THEN 'NO_WATER' WHEN score >= 0.45e0 THEN 'FLOOD_ZONE' WHEN score >= 0.35e0 THEN 'POTENTIAL_INUNDATION' ELSE 'WATER_BODY' END AS water_state,
    CASE WHEN ratio >= 0.03e0 AND score >= 0.35e0 THEN 'PASS' ELSE 'FAIL' END AS incident_gate FROM e2)"""


@query("j03_flood_evidence", "rbox pix", f"RECURSIVE {EVID} SELECT * FROM ev")
def _(v):
    return flood.flood_evidence(v.pix, v.rbox, 4)


def ratio_frames(v):
    """Fire and debris ratios next to the flood evidence of each frame."""
    fire = raster.fire_ratio(v.pix)
    debris = v.pix.groupBy("mission_id", "frame_idx").agg(half_even(F.avg(F.col("is_edge").cast("int")) * 1.3, 6).alias("debris_ratio"))
    road = v.rbox.filter("class_name = 'vehicle'").select("mission_id", "frame_idx").distinct().withColumn("has_road", F.lit(True))
    return (
        flood.flood_evidence(v.pix, v.rbox, 4)
        .join(fire, ["mission_id", "frame_idx"]).join(debris, ["mission_id", "frame_idx"])
        .join(road, ["mission_id", "frame_idx"], "left").withColumn("has_road", F.coalesce("has_road", F.lit(False)))
    )


RATIOS = f"""{EVID}, {HSV}, fi AS (SELECT mission_id, frame_idx, {R('avg(CAST(h <= 25 AND s >= 120 AND v >= 200 AS INT))', 6)} AS fire_ratio,
    {R('avg(CAST(is_edge AS INT)) * 1.3e0', 6)} AS debris_ratio FROM hv GROUP BY 1, 2),
  ro AS (SELECT DISTINCT mission_id, frame_idx FROM rbox WHERE class_name = 'vehicle'),
  rt AS (SELECT ev.*, fire_ratio, debris_ratio, ro.mission_id IS NOT NULL AS has_road FROM ev JOIN fi USING (mission_id, frame_idx)
    LEFT JOIN ro ON ev.mission_id = ro.mission_id AND ev.frame_idx = ro.frame_idx)"""


@query(
    "j05_scene_class", "rbox pix",
    f"""RECURSIVE {RATIOS} SELECT mission_id, frame_idx, CASE WHEN fire_ratio > 0.02e0 THEN 'FIRE' WHEN water_ratio > 0.28e0 THEN 'FLOOD' WHEN debris_ratio > 0.35e0 THEN 'EARTHQUAKE_DAMAGE' ELSE 'NORMAL' END AS scene_class,
    {R('CASE WHEN fire_ratio > 0.02e0 THEN 0.9e0 WHEN water_ratio > 0.28e0 THEN least(0.95e0, 0.5e0 + water_ratio * 1.5e0) WHEN debris_ratio > 0.35e0 THEN least(0.9e0, 0.4e0 + debris_ratio * 1.2e0) ELSE 0.95e0 END', 6)} AS scene_confidence,
    fire_ratio > 0.02e0 OR water_ratio > 0.28e0 OR debris_ratio > 0.35e0 AS is_disaster FROM rt""",
)
def _(v):
    return flood.scene_class(ratio_frames(v)).select("mission_id", "frame_idx", "scene_class", "scene_confidence", "is_disaster")


HAZ = f"""{RATIOS}, hz AS (
  SELECT mission_id, frame_idx, 'FLOOD_ZONE' AS incident_type, 'flood' AS hazard_class, {R('flood_score', 3)} AS confidence, CASE WHEN water_ratio > 0.35e0 THEN 'CRITICAL' ELSE 'HIGH' END AS severity,
    {R('water_ratio * 100e0', 1)} AS coverage_pct, 'Flooded water inundation detected (' || {FX('water_ratio * 100e0', 1)} || '% area, Score: ' || {FX('flood_score', 2)} || '). State: ' || water_state || '.' AS evidence FROM rt WHERE incident_gate = 'PASS'
  UNION ALL SELECT mission_id, frame_idx, CASE WHEN has_road THEN 'BLOCKED_ROAD_DEBRIS' ELSE 'POTENTIAL_GROUND_OBSTRUCTION' END, 'debris', least(0.9e0, {R('0.4e0 + debris_ratio * 1.1e0', 3)}),
    CASE WHEN debris_ratio > 0.45e0 THEN 'HIGH' ELSE 'MEDIUM' END, {R('debris_ratio * 100e0', 1)}, 'Severe rubble concentration (' || {FX('debris_ratio * 100e0', 1)} || '% area) ' || CASE WHEN has_road THEN 'obstructing road' ELSE 'on ground region' END || '.' FROM rt WHERE debris_ratio > 0.35e0
  UNION ALL SELECT mission_id, frame_idx, 'FIRE_SMOKE_HAZARD', 'fire', least(0.95e0, {R('0.6e0 + fire_ratio * 10e0', 3)}), 'CRITICAL', {R('fire_ratio * 100e0', 1)},
    'Visible high-temperature flame / active fire hue detected over ' || {FX('fire_ratio * 100e0', 2)} || '% frame area.' FROM rt WHERE fire_ratio > 0.015e0)"""


@query("j06_hazards", "rbox pix", f"RECURSIVE {HAZ} SELECT * FROM hz")
def _(v):
    return flood.hazards(ratio_frames(v))


def _buildings(v):
    named = F.when(F.col("det_id") % 3 == 0, F.concat(F.lit("STRUCTURE_"), F.col("det_id").cast("string"))).otherwise(F.lit("OBJ"))
    return v.rbox.withColumn("object_id", named)


BLD = """bd AS (SELECT * FROM (SELECT rbox.*, CASE WHEN det_id % 3 = 0 THEN 'STRUCTURE_' || det_id ELSE 'OBJ' END AS object_id FROM rbox) s
  WHERE (class_name IN ('building', 'structure') OR object_id LIKE '%STRUCTURE%') AND rx2 - rx1 >= 2 AND ry2 - ry1 >= 2)"""


@query("b17_damage_candidates", "rbox", f"{BLD} SELECT det_id, object_id, class_name FROM bd")
def _(v):
    return flood.damage_candidates(_buildings(v), 2).select("det_id", "object_id", "class_name")


def _nb(axis: str, other: str) -> str:
    w = f"OVER (PARTITION BY mission_id, frame_idx, det_id, {other} ORDER BY {axis})"
    return (f"CASE WHEN lag({axis}) {w} IS NOT NULL AND lead({axis}) {w} IS NOT NULL THEN (lead(depth) {w} - lag(depth) {w}) / 2e0 "
            f"WHEN lead({axis}) {w} IS NOT NULL THEN lead(depth) {w} - depth WHEN lag({axis}) {w} IS NOT NULL THEN depth - lag(depth) {w} END")


CROP = f"""{HSV}, lap AS (SELECT *, coalesce(lag(gray) OVER a, lead(gray) OVER a, gray) + coalesce(lead(gray) OVER a, lag(gray) OVER a, gray) + coalesce(lag(gray) OVER b, lead(gray) OVER b, gray)
    + coalesce(lead(gray) OVER b, lag(gray) OVER b, gray) - 4 * gray AS lp FROM hv WINDOW a AS (PARTITION BY mission_id, frame_idx, r ORDER BY c), b AS (PARTITION BY mission_id, frame_idx, c ORDER BY r)),
  {BLD}, cr AS (SELECT bd.mission_id, bd.frame_idx, bd.det_id, lap.r, lap.c, lap.depth, lap.lp FROM bd JOIN lap ON bd.mission_id = lap.mission_id AND bd.frame_idx = lap.frame_idx
    AND lap.r >= ry1 AND lap.r < ry2 AND lap.c >= rx1 AND lap.c < rx2),
  gr AS (SELECT *, sqrt(gx * gx + gy * gy) AS g FROM (SELECT *, {_nb('c', 'r')} AS gx, {_nb('r', 'c')} AS gy FROM cr) s)"""


@query("g05_depth_gradient", "rbox pix", f"{CROP} SELECT det_id, r, c, {R('g', 6)} AS depth_gradient FROM gr")
def _(v):
    crops = spatial.box_pixels(
        flood.damage_candidates(_buildings(v), 2).select("mission_id", "frame_idx", "det_id", *flood.BOX),
        v.pix.select("mission_id", "frame_idx", "r", "c", "depth"), raster.FRAME, flood.BOX, 4,
    )
    return flood.depth_gradient(crops).select("det_id", "r", "c", half_even(F.col("depth_gradient"), 6).alias("depth_gradient"))


@query(
    "j07_damage", "rbox pix",
    f"""{CROP}, st AS (SELECT mission_id, frame_idx, det_id, var_pop(lp) AS lv, coalesce(count(*) FILTER (g IS NOT NULL AND depth > 0.1 AND g > 0.2) / nullif(count(*) FILTER (g IS NOT NULL AND depth > 0.1), 0), 0e0) AS ra FROM gr GROUP BY 1, 2, 3)
    SELECT mission_id, frame_idx, det_id, CASE WHEN ra > 0.22e0 AND lv > 1400 THEN 'potential_major_damage' ELSE 'minor_damage' END AS damage_level,
    CASE WHEN ra > 0.22e0 AND lv > 1400 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
    least(0.92e0, greatest(0.4e0, {RS('least(0.5e0, lv / 2500e0 * 0.5e0) + least(0.5e0, ra / 0.4e0 * 0.5e0)', 3)})) AS confidence, {RS('lv', 2)} AS laplacian_variance, {R('ra', 4)} AS gradient_ratio
    FROM st WHERE ra > 0.15e0 AND lv > 900""",
)
def _(v):
    return flood.damage(v.pix, _buildings(v), 2, 4)


PERS = "ps AS (SELECT * FROM rbox WHERE raw_class = 'person')"
NEAR = """nr AS (SELECT a.det_id, sqrt(CAST(min((b.r - a.pr) * (b.r - a.pr) + (b.c - a.pc) * (b.c - a.pc)) AS DOUBLE)) AS d FROM pp a JOIN pix b
  ON a.mission_id = b.mission_id AND a.frame_idx = b.frame_idx WHERE b.is_water GROUP BY 1)"""
PP = f"""{PERS}, pp AS (SELECT *, least(7, CAST(floor((rx1 + rx2) / 2) AS BIGINT)) AS pc, least(7, CAST(floor((ry1 + ry2) / 2) AS BIGINT)) AS pr,
  greatest(0, rx1 - floor((rx2 - rx1) * 1.5e0)) AS ox1, greatest(0, ry1 - floor((ry2 - ry1) * 1.5e0)) AS oy1,
  least(8, rx2 + floor((rx2 - rx1) * 1.5e0)) AS ox2, least(8, ry2 + floor((ry2 - ry1) * 1.5e0)) AS oy2 FROM ps)"""


@query("c11_nearest_flag", "rbox pix", f"{PP}, {NEAR} SELECT det_id, {R('d', 6)} AS flood_distance_px FROM nr")
def _(v):
    half = lambda a, b: F.least(F.lit(7), F.floor((F.col(a) + F.col(b)) / 2))
    probes = v.rbox.filter("raw_class = 'person'").withColumns({"pc": half("rx1", "rx2"), "pr": half("ry1", "ry2")})
    out = flood.nearest_flag(probes, v.pix)
    return out.select("det_id", half_even(F.col("flood_distance_px"), 6).alias("flood_distance_px"))


CTX = f"""{PP}, {NEAR}, rg AS (SELECT a.det_id, avg(CAST(b.is_water AS INT)) AS ratio,
    count(*) FILTER (depth > 0.1 AND r >= ry1 AND r < ry2 AND c >= rx1 AND c < rx2) AS np, count(*) FILTER (depth > 0.1) AS ns,
    median(depth) FILTER (depth > 0.1 AND r >= ry1 AND r < ry2 AND c >= rx1 AND c < rx2) AS dp, median(depth) FILTER (depth > 0.1) AS ds
    FROM pp a JOIN pix b ON {ON} AND b.r >= a.oy1 AND b.r < a.oy2 AND b.c >= a.ox1 AND b.c < a.ox2 GROUP BY 1),
  wf AS (SELECT mission_id, frame_idx, count(*) FILTER (is_water) > 0.01e0 * count(*) AS wet FROM pix GROUP BY 1, 2),
  jx AS (SELECT pp.mission_id, pp.frame_idx, pp.det_id, coalesce(wet, false) AS wet, d, coalesce(ratio, 0e0) AS ratio, coalesce(np > 5 AND ns > 20 AND ds - dp > 0.8e0, false) AS up
    FROM pp LEFT JOIN nr USING (det_id) LEFT JOIN rg USING (det_id) LEFT JOIN wf ON pp.mission_id = wf.mission_id AND pp.frame_idx = wf.frame_idx),
  kx AS (SELECT *, CASE WHEN NOT wet THEN 'dry' WHEN d = 0 OR ratio > 0.55e0 OR (up AND ratio > 0.35e0) THEN 'a' WHEN d < 150 OR ratio > 0.2e0 THEN 'b' ELSE 'c' END AS k FROM jx),
  ctx AS (SELECT mission_id, frame_idx, det_id, CASE k WHEN 'a' THEN 'POTENTIAL_STRANDED_PERSON' WHEN 'b' THEN 'POTENTIAL_ISOLATED_PERSON' ELSE 'NORMAL_PERSON' END AS classification,
    CASE k WHEN 'dry' THEN 'NONE' WHEN 'a' THEN 'HIGH (INUNDATED SURROUNDINGS)' WHEN 'b' THEN 'MODERATE' ELSE 'LOW' END AS flood_proximity,
    CASE k WHEN 'a' THEN 'LOW / SEVERELY RESTRICTED' WHEN 'b' THEN 'PARTIALLY ACCESSIBLE' ELSE 'HIGH' END AS accessible_dry_area,
    CASE WHEN wet THEN {R('d', 1)} ELSE 999e0 END AS flood_distance_px, CASE WHEN wet THEN {R('ratio * 100e0', 1)} ELSE 0e0 END AS surrounding_flood_pct,
    CASE WHEN wet THEN {R('d * 0.05e0', 2)} ELSE 99e0 END AS nearest_water_distance_m, CASE WHEN wet AND up THEN 'ELEVATED_STRUCTURE' ELSE 'GROUND_LEVEL' END AS elevation_context,
    CASE WHEN wet AND up THEN 2e0 ELSE 0e0 END AS elevation_relative_m,
    CASE WHEN wet THEN {R('0.45e0 * least(1e0, greatest(0e0, 1e0 - d / 120e0)) + 0.35e0 * least(1e0, greatest(0e0, ratio * 1.5e0)) + 0.2e0 * CASE WHEN up THEN 0.85e0 ELSE 0.3e0 END', 3)} ELSE 0e0 END AS isolation_score,
    CASE k WHEN 'dry' THEN 'Person observed in dry environment with no significant floodwater detected.'
      WHEN 'a' THEN CASE WHEN up THEN 'Person is isolated on an elevated structure surrounded by floodwater (' || {FX('ratio * 100e0', 0)} || '% water perimeter coverage; distance to water: ' || {FX('d', 0)} || 'px).'
        ELSE 'Person is located in/adjacent to floodwater (' || {FX('ratio * 100e0', 0)} || '% water contact) with restricted dry ground access.' END
      WHEN 'b' THEN 'Person detected within ' || {FX('d', 0)} || 'px of floodwater with potential access route.'
      ELSE 'Person observed on accessible dry ground (' || {FX('d', 0)} || 'px from floodwater).' END AS evidence FROM kx)"""


@query("j09_person_context", "rbox pix", f"{CTX} SELECT * EXCLUDE (mission_id, frame_idx) FROM ctx")
def _(v):
    out = flood.person_context(v.rbox.filter("raw_class = 'person'"), v.pix, (8, 8), 4)
    return out.select(
        "det_id", "classification", "flood_proximity", "accessible_dry_area", "flood_distance_px", "surrounding_flood_pct",
        "nearest_water_distance_m", "elevation_context", "elevation_relative_m", "isolation_score", "evidence",
    )


@query(
    "j10_vehicle_context", "rbox pix",
    OVER.format(flag="is_water", mask="pix") + f""", sh AS (SELECT a.det_id, coalesce(share, 0e0) AS s FROM rbox a LEFT JOIN ov ON a.det_id = ov.det_id WHERE a.class_name = 'vehicle')
    SELECT det_id, CASE WHEN s > 0.35e0 THEN 'FLOODED_VEHICLE' WHEN s > 0.05e0 THEN 'VEHICLE_NEAR_FLOOD' ELSE 'NORMAL_VEHICLE' END AS classification,
    CASE WHEN s > 0.35e0 THEN 'HIGH' WHEN s > 0.05e0 THEN 'MEDIUM' ELSE 'LOW' END AS severity, {R('s * 100e0', 1)} AS water_contact_pct FROM sh""",
)
def _(v):
    out = flood.vehicle_context(v.rbox.filter("class_name = 'vehicle'"), v.pix, 4)
    return out.select("det_id", "classification", "severity", "water_contact_pct")
