"""Queries over persons, rescue targets, scene risk and incidents."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysift.functions import boxes, camera
from skysift.functions.numeric import half_even
from skysift.lineage import cut, shared_folder
from skysift.operators import cloud, detect, incidents, localize, reports, rescue
from skysift.operators.suppression import nms
from skysift.plans.clouds import PATH
from skysift.plans.detection import VALIDATED, nms_sql, validated
from skysift.plans.localization import CENTRE, LOCALIZED, MEASURED, localized
from skysift.plans.registry import FX, R, RS, query
from skysift.sources.versioned import VersionedTable

OK = "(x IS NOT NULL)"


def priority_sql(cls: str, iso: str, fl: str, up: str, conf: str, local: str, err: str, n: str) -> tuple[str, str]:
    quality = f"CASE WHEN {local} AND {err} IS NOT NULL THEN greatest(0.2e0, 1e0 - {err} / 40e0) WHEN {local} THEN 0.85e0 ELSE 0.3e0 END"
    score = RS(f"0.35e0 * {iso} + 0.25e0 * ({fl} / 100e0) + 0.15e0 * {conf} + 0.15e0 * {quality} + 0.1e0 * least(1e0, 0.6e0 + {n} * 0.1e0)", 3)
    rule = (f"CASE WHEN {cls} = 'POTENTIAL_STRANDED_PERSON' OR (score >= 0.55e0 AND {fl} > 20) OR ({fl} > 40 AND {up}) THEN 'HIGH' "
            f"WHEN {cls} = 'POTENTIAL_ISOLATED_PERSON' OR (score >= 0.4e0 AND {fl} > 10) OR {fl} > 15 THEN 'MEDIUM' ELSE 'LOW' END")
    return score, rule


SCORE, RULE = priority_sql("cls", "iso", "fl", "up", "mc", "local", "err", "n")


def fused_sql(source: str) -> str:
    good = "x IS NOT NULL AND reprojection_error_px <= 25"
    key = "CASE WHEN {c} THEN lpad(CAST(CAST({e} * 1000 AS BIGINT) AS VARCHAR), 12, '0') || lpad(CAST(frame_idx AS VARCHAR), 10, '0') || lpad(CAST(det_id AS VARCHAR), 18, '0') END"
    k1, k2 = key.format(c=good, e="reprojection_error_px"), key.format(c=OK, e="0")
    return f"""fa AS (SELECT mission_id, CAST(track_id AS VARCHAR) AS track_key, count(*) AS n, {R('avg(conf)', 9)} AS mc, max(conf) AS xc, list_sort(list_distinct(list(frame_idx))) AS source_frames,
      min(frame_idx) AS f1, max(frame_idx) AS f2, min(frame_idx * 1000000000 + det_id) AS first, count(*) FILTER {OK.replace('(', '(WHERE ', 1)} AS cand, count(*) FILTER (WHERE {good}) AS good,
      {R(f'min(reprojection_error_px) FILTER (WHERE x IS NOT NULL)', 2)} AS best, {RS('avg(reprojection_error_px) FILTER (WHERE x IS NOT NULL)', 2)} AS av, {RS(f'avg(reprojection_error_px) FILTER (WHERE {good})', 2)} AS avg_good,
      arg_min(x, {k1}) AS gx, arg_min(y, {k1}) AS gy, arg_min(z, {k1}) AS gz, arg_min(x, {k2}) AS ax, arg_min(y, {k2}) AS ay, arg_min(z, {k2}) AS az,
      sqrt(pow(stddev_pop(x), 2) + pow(stddev_pop(y), 2) + pow(stddev_pop(z), 2)) AS sd, {R('avg(surrounding_flood_pct)', 9)} AS fl, stddev_pop(surrounding_flood_pct) AS flsd, {R('avg(isolation_score)', 9)} AS iso,
      arg_max({{'a': x1, 'b': y1, 'c': x2, 'd': y2, 'e': u, 'f': v}}, conf * 1e6 - det_id * 1e-6) AS bx
      FROM {source} GROUP BY 1, 2),
    mo AS (SELECT mission_id, CAST(track_id AS VARCHAR) AS track_key, elevation_context AS e, count(*) AS c FROM {source} GROUP BY ALL),
    me2 AS (SELECT mission_id, track_key, arg_min(e, (-c, e)) AS elev FROM mo GROUP BY 1, 2),
    mp AS (SELECT mission_id, CAST(track_id AS VARCHAR) AS track_key, flood_proximity AS e, count(*) AS c FROM {source} GROUP BY ALL),
    mq AS (SELECT mission_id, track_key, arg_min(e, (-c, e)) AS prox FROM mp GROUP BY 1, 2),
    fb AS (SELECT fa.*, elev, prox, elev = 'ELEVATED_STRUCTURE' AS up, good > 0 AS local, CASE WHEN good > 0 THEN best ELSE av END AS err,
      CASE WHEN fl > 25 OR iso > 0.5e0 THEN 'POTENTIAL_STRANDED_PERSON' ELSE 'NORMAL_PERSON' END AS cls FROM fa JOIN me2 USING (mission_id, track_key) JOIN mq USING (mission_id, track_key)),
    fc AS (SELECT *, {SCORE} AS score FROM fb), fd AS (SELECT *, {RULE} AS prio, {RS('least(1e0, greatest(0e0, 1e0 - iso))', 3)} AS ground FROM fc),
    fe AS (SELECT *, prio IN ('HIGH', 'MEDIUM') OR iso > 0.35e0 OR fl > 15 AS dis, row_number() OVER (PARTITION BY mission_id ORDER BY first) AS idx FROM fd),
    fused AS (SELECT mission_id, track_key, printf('PERSON #%02d', idx) AS target_id, {R('mc', 3)} AS person_confidence, {R('xc', 3)} AS max_confidence, n AS observation_count, source_frames,
      {R('n / greatest(1, f2 - f1 + 1)', 3)} AS persistence, cand AS num_3d_candidates, good AS num_valid_reprojections, best AS best_reprojection_error_px, av AS mean_reprojection_error_px,
      avg_good AS mean_valid_reprojection_error_px, CASE WHEN good > 0 THEN 'LOCALIZED_3D' WHEN cand > 0 THEN 'REPROJECT_REJECTED' ELSE 'UNLOCALIZED' END AS localization_status, err AS reprojection_error_px,
      {R('CASE WHEN good > 0 THEN gx WHEN cand > 0 THEN ax ELSE 0e0 END', 6)} AS x, {R('CASE WHEN good > 0 THEN gy WHEN cand > 0 THEN ay ELSE 0e0 END', 6)} AS y, {R('CASE WHEN good > 0 THEN gz WHEN cand > 0 THEN az ELSE 0e0 END', 6)} AS z,
      CASE WHEN cand > 0 AND CASE WHEN cand > 1 THEN sd ELSE 0e0 END < 100 THEN {RS('CASE WHEN cand > 1 THEN sd ELSE 0e0 END', 3)} END AS dispersion_3d_m,
      CASE WHEN cand > 0 THEN {RS('least(1e0, greatest(0.1e0, 1e0 - CASE WHEN cand > 1 THEN sd ELSE 0e0 END / 3e0))', 3)} ELSE 0e0 END AS consistency_3d_score,
      {RS('least(1e0, greatest(0.2e0, 1e0 - CASE WHEN n > 1 THEN flsd ELSE 0e0 END / 50e0))', 3)} AS flood_context_consistency, prox AS flood_proximity, elev AS elevation_context,
      {R('fl / 100e0', 3)} AS surrounding_flood_ratio, {R('iso', 3)} AS isolation_score, ground AS accessible_ground_score,
      bx.a AS x1, bx.b AS y1, bx.c AS x2, bx.d AS y2, bx.e AS u, bx.f AS v, prio AS rescue_priority, score AS rescue_score,
      CASE WHEN local AND dis THEN 'VALIDATED RESCUE TARGET' WHEN dis THEN 'POTENTIAL STRANDED PERSON' WHEN local THEN 'PERSON REPROJECTION VALID' WHEN cand > 0 THEN 'PERSON 3D LOCALIZED' ELSE 'PERSON CONTEXTUALIZED' END AS detection_state,
      local AND dis AS is_validated,
      CASE prio WHEN 'HIGH' THEN 'Person observed across ' || n || ' frame(s) on ' || CASE WHEN elev LIKE '%ELEVATED%' THEN 'elevated structure' ELSE 'isolated high ground' END || ' surrounded by ' || {FX('fl', 0)} || '% floodwater with limited apparent egress.'
        WHEN 'MEDIUM' THEN 'Person detected in proximity to active flood boundary (' || {FX('fl', 0)} || '% surrounding water, isolation ' || {FX('iso', 2)} || '). Evacuation monitoring recommended.'
        ELSE 'Person located on accessible terrain (' || {FX('ground * 100e0', 0)} || '% dry ground egress) with minimal flood hazard.' END AS reason FROM fe)"""


FUSED = fused_sql("person")


def targets(v):
    return rescue.fuse_tracks(v.person)


@query("e02_fuse_tracks", "person", f"{FUSED} SELECT * FROM fused")
def _(v):
    out = targets(v)
    return out.withColumns({c: half_even(F.col(c), 6) for c in "xyz"})


@query(
    "h03_order_targets", "person",
    f"""{FUSED}, o AS (SELECT *, list_position(['VALIDATED RESCUE TARGET', 'POTENTIAL STRANDED PERSON', 'PERSON REPROJECTION VALID', 'PERSON 3D LOCALIZED', 'PERSON 3D CANDIDATE', 'PERSON CONTEXTUALIZED'], detection_state) AS a,
      list_position(['HIGH', 'MEDIUM', 'LOW'], rescue_priority) AS b FROM fused)
    SELECT mission_id, target_id, detection_state, rescue_priority, row_number() OVER (PARTITION BY mission_id ORDER BY a, b, isolation_score DESC, CAST(nullif(regexp_extract(target_id, '(\\d+)\\D*$', 1), '') AS BIGINT), target_id) AS target_rank FROM o""",
)
def _(v):
    return rescue.order_targets(targets(v)).select("mission_id", "target_id", "detection_state", "rescue_priority", "target_rank")


GATE = """(is_validated OR coalesce(reprojection_error_px <= 25 AND localization_status = 'LOCALIZED_3D'
  AND (rescue_priority IN ('HIGH', 'MEDIUM') OR isolation_score > 0.35e0 OR surrounding_flood_ratio > 0.15e0), false))"""


@query("b12_rescue_gate", "person", f"{FUSED} SELECT mission_id, target_id, rescue_priority FROM fused WHERE {GATE}")
def _(v):
    return rescue.rescue_targets(targets(v)).select("mission_id", "target_id", "rescue_priority")


@query(
    "b13_sanitize_target", "obs",
    """SELECT det_id, CASE WHEN det_id % 4 = 0 THEN 'HIGH' WHEN det_id % 4 = 1 THEN 'MEDIUM' ELSE 'LOW' END AS rescue_priority FROM obs WHERE det_id % 5 <> 0""",
)
def _(v):
    rough = v.obs.select(
        "det_id",
        F.element_at(F.array(F.lit("HIGH"), F.lit("medium"), F.lit("URGENT"), F.lit("low")), (F.col("det_id") % 4 + 1).cast("int")).alias("rescue_priority"),
        F.when(F.col("det_id") % 5 == 0, F.array("x", "y")).otherwise(F.array("x", "y", "z")).alias("location_3d"),
    )
    return rescue.sanitize_target(rough).select("det_id", "rescue_priority")


@query(
    "c08_unfused_persons", "person",
    f"""{FUSED}, miss AS (SELECT p.* FROM person p ANTI JOIN (SELECT * FROM fused WHERE {GATE}) t ON p.mission_id = t.mission_id AND CAST(p.track_id AS VARCHAR) = t.track_key)
    SELECT mission_id, CAST(track_id AS VARCHAR) AS track_key, arg_min(det_id, det_id) AS det_id, arg_min(conf, det_id) AS conf FROM miss GROUP BY 1, 2""",
)
def _(v):
    gated = rescue.rescue_targets(targets(v))
    return rescue.unfused_persons(v.person, gated).select("mission_id", "track_key", "det_id", "conf")


def people(v):
    kinds = F.array(*[F.lit(k) for k in ("POTENTIAL_STRANDED_PERSON", "POTENTIAL_ISOLATED_PERSON", "NORMAL_PERSON", "NORMAL_PERSON", "NORMAL_PERSON")])
    return v.person.withColumns(
        {"isolation_type": F.element_at(kinds, (F.col("det_id") % 5 + 1).cast("int")), "elevation_relative_m": (F.col("det_id") % 3).cast("double")}
    )


L_SCORE, L_RULE = priority_sql("isolation_type", "(fl / 100e0)", "fl", "up", "conf", OK, "reprojection_error_px", "1")
PEOPLE = f"""pe0 AS (SELECT person.*, surrounding_flood_pct AS fl, det_id % 3 > 1.5e0 AS up, CAST(det_id % 3 AS DOUBLE) AS elevation_relative_m,
    CASE det_id % 5 WHEN 0 THEN 'POTENTIAL_STRANDED_PERSON' WHEN 1 THEN 'POTENTIAL_ISOLATED_PERSON' ELSE 'NORMAL_PERSON' END AS isolation_type FROM person),
  pe1 AS (SELECT *, {L_SCORE} AS score FROM pe0), pe2 AS (SELECT *, {L_RULE} AS rescue_priority, {R('score * 100e0', 1)} AS priority_score FROM pe1),
  pe AS (SELECT *, CASE rescue_priority WHEN 'HIGH' THEN 'Urgent aerial/boat rescue required. Target is stranded/isolated by floodwater.'
    WHEN 'MEDIUM' THEN 'Prioritize monitoring and prepare evacuation route. Person in proximity to advancing water.' ELSE 'Routine monitoring. Person is located on accessible dry ground.' END AS recommended_action,
    row_number() OVER (PARTITION BY mission_id ORDER BY priority_score DESC, frame_idx, det_id) AS rank FROM pe2)"""


@query(
    "l01_rescue_priority", "person",
    f"""{PEOPLE} SELECT det_id, rescue_priority, score AS rescue_score, recommended_action, 'Priority ' || rescue_priority || ' (Score: ' || {FX('score', 2)} || ') | Detection Conf: ' || {FX(R('conf', 9), 2)}
    || ' | Isolation: ' || {FX(R('fl / 100e0', 9), 2)} || ' | Surrounding Flood: ' || {FX(R('fl', 9), 0)} || '% | 3D Status: ' || CASE WHEN {OK} THEN 'LOCALIZED_3D' ELSE 'UNLOCALIZED' END AS priority_explanation FROM pe""",
)
def _(v):
    return rescue.score_people(people(v)).select("det_id", "rescue_priority", "rescue_score", "recommended_action", "priority_explanation")


@query("l02_rank_priorities", "person", f"{PEOPLE} SELECT mission_id, det_id, rescue_priority, priority_score, rank FROM pe")
def _(v):
    return rescue.rank_priorities(people(v)).select("mission_id", "det_id", "rescue_priority", "priority_score", "rank")


@query("h04_rank_by_score", "person", f"{PEOPLE} SELECT mission_id, det_id, rank FROM pe WHERE rescue_priority = 'HIGH' OR rank > 0")
def _(v):
    return rescue.rank_by_score(rescue.score_people(people(v))).select("mission_id", "det_id", "rank")


@query("h05_top_k", "person", f"{PEOPLE} SELECT mission_id, det_id, priority_score, CAST(rank AS INT) AS rank FROM pe WHERE rank <= 5")
def _(v):
    return rescue.top_k(rescue.score_people(people(v)), 5).select("mission_id", "det_id", "priority_score", "rank")


@query(
    "h06_representative", "trk",
    "SELECT mission_id, track_id, arg_max(det_id, conf * 1e9 - det_id) AS best_det, arg_min(det_id, conf * 1e9 + det_id) AS worst_det FROM trk GROUP BY 1, 2",
)
def _(v):
    return rescue.representative(v.trk, ["mission_id", "track_id"]).select("mission_id", "track_id", "best_det", "worst_det")


# --------------------------------------------------------------- scene risk


def mission_floods(v):
    """A flood state per frame, drawn from the events of the frame."""
    ratio = (F.col("frame_idx") * 7 + F.col("mission_id") * 13) % 45
    return v.cam.select(
        "mission_id", "frame_idx",
        (F.when(F.col("mission_id") % 4 == 0, 0.0).otherwise(ratio / 100.0) / (F.col("mission_id") % 4 + 1)).alias("water_ratio"),
    ).withColumn(
        "water_state",
        F.when(F.col("water_ratio") > 0.20, F.lit("VALIDATED_INUNDATION")).when(F.col("water_ratio") > 0.08, F.lit("POTENTIAL_INUNDATION")).otherwise(F.lit("NO_WATER")),
    )


FLOODS = """mf0 AS (SELECT mission_id, frame_idx, CASE WHEN mission_id % 4 = 0 THEN 0e0 ELSE ((frame_idx * 7 + mission_id * 13) % 45) / 100e0 END / (mission_id % 4 + 1) AS water_ratio FROM cam),
  mf AS (SELECT *, CASE WHEN water_ratio > 0.2e0 THEN 'VALIDATED_INUNDATION' WHEN water_ratio > 0.08e0 THEN 'POTENTIAL_INUNDATION' ELSE 'NO_WATER' END AS water_state FROM mf0)"""
LISTED = "list_filter([{}], lambda x: x IS NOT NULL)"

RISK_A = f"""{FUSED}, {FLOODS}, tg AS (SELECT mission_id, count(*) AS people, count(*) FILTER (rescue_priority = 'HIGH') AS hi, count(*) FILTER (rescue_priority = 'MEDIUM') AS md FROM fused GROUP BY 1),
  wa AS (SELECT mission_id, bool_or(water_state = 'VALIDATED_INUNDATION') AS sure, bool_or(water_state = 'POTENTIAL_INUNDATION') AS maybe, max(water_ratio) AS ratio FROM mf GROUP BY 1),
  ri AS (SELECT wa.*, coalesce(people, 0) AS people, coalesce(hi, 0) AS hi, coalesce(md, 0) AS md FROM wa LEFT JOIN tg USING (mission_id)),
  rl AS (SELECT *, CASE WHEN hi > 0 AND sure THEN 'CRITICAL' WHEN sure OR hi > 0 THEN 'HIGH' WHEN maybe OR md > 0 THEN 'MEDIUM' ELSE 'LOW / NO DISASTER EVIDENCE' END AS risk_level FROM ri),
  risk AS (SELECT mission_id, risk_level, CASE WHEN risk_level LIKE 'LOW%' THEN 0e0 ELSE {R('least(100e0, greatest(0e0, CASE WHEN sure THEN 45e0 + least(30e0, ratio * 100e0) WHEN maybe THEN 25e0 + least(15e0, ratio * 100e0) ELSE 0e0 END + CASE WHEN hi > 0 THEN 25e0 + least(15e0, hi * 5e0) ELSE 0e0 END + CASE WHEN md > 0 THEN 10e0 + least(10e0, md * 3e0) ELSE 0e0 END))', 1)} END AS risk_score,
    {LISTED.format(f"CASE WHEN sure THEN 'Validated flood inundation confirmed covering ' || {FX('ratio * 100e0', 1)} || '% of aerial scene.' WHEN maybe THEN 'Potential flood inundation detected covering ' || {FX('ratio * 100e0', 1)} || '% of scene.' ELSE 'No active flood inundation evidence detected across analyzed frames.' END, CASE WHEN hi > 0 THEN 'CRITICAL SAR: ' || hi || ' potentially stranded person(s) isolated by floodwater.' END, CASE WHEN md > 0 THEN 'Monitoring: ' || md || ' person(s) in proximity to active flood boundary.' END, CASE WHEN people = 0 THEN 'Zero persons detected in available aerial frames (continuous optical search active).' END")} AS risk_reasons,
    {LISTED.format("CASE WHEN hi > 0 THEN 'Dispatch rescue team to ' || hi || ' high-priority stranded victim location(s).' END, CASE WHEN md > 0 THEN 'Establish evacuation route for ' || md || ' person(s) near flood perimeter.' END, CASE WHEN people = 0 AND sure THEN 'Area inundation response active; continue aerial search for potential submerged victims.' WHEN people = 0 THEN 'Routine aerial patrol. No emergency rescue operations required.' END")} AS rescue_priorities FROM rl)"""


def risk_a(v):
    return rescue.scene_risk(mission_floods(v), targets(v))


@query("e21_scene_risk", "person cam", f"{RISK_A} SELECT * FROM risk")
def _(v):
    return risk_a(v)


@query(
    "e22_scene_risk_ratio", "person cam",
    f"""{PEOPLE}, {FLOODS}, tg AS (SELECT mission_id, count(*) AS people, count(*) FILTER (rescue_priority = 'HIGH') AS hi FROM pe GROUP BY 1),
    wa AS (SELECT mission_id, avg(water_ratio) AS ratio FROM mf GROUP BY 1), j AS (SELECT mission_id, {R('ratio', 6)} AS ratio, mission_id % 7 = 2 AS act, coalesce(people, 0) AS people, coalesce(hi, 0) AS hi FROM wa LEFT JOIN tg USING (mission_id)),
    k AS (SELECT *, act OR ratio >= 0.15e0 AS fl, 50e0 + least(40e0, ratio * 100e0) AS base FROM j)
    SELECT mission_id, CASE WHEN fl AND hi > 0 THEN 'CRITICAL' WHEN fl THEN 'HIGH' WHEN ratio >= 0.04e0 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
    {R('CASE WHEN fl AND hi > 0 THEN least(100e0, base + 20e0) WHEN fl THEN base WHEN ratio >= 0.04e0 THEN 35e0 ELSE 10e0 END', 1)} AS risk_score,
    {LISTED.format(f"CASE WHEN fl THEN 'Validated flood inundation confirmed covering ' || {FX('ratio * 100e0', 1)} || '% of aerial scene.' WHEN ratio >= 0.04e0 THEN 'Potential flood inundation detected covering ' || {FX('ratio * 100e0', 1)} || '% of scene.' ELSE 'Routine aerial monitoring. No active flood inundation evidence detected.' END, CASE WHEN fl AND hi > 0 THEN 'CRITICAL SAR: ' || hi || ' stranded victim(s) isolated by floodwaters.' WHEN fl AND people = 0 THEN 'Zero persons detected in available aerial frames (continuous optical search active).' END")} AS risk_reasons FROM k""",
)
def _(v):
    counts = rescue.score_people(people(v)).groupBy("mission_id").agg(
        F.count(F.lit(1)).alias("people"), F.count_if(F.col("rescue_priority") == "HIGH").alias("high")
    )
    water = mission_floods(v).groupBy("mission_id").agg(half_even(F.avg("water_ratio"), 6).alias("flood_ratio"))
    scenes = water.join(counts, "mission_id", "left").na.fill(0, ["people", "high"]).withColumn("is_active", F.col("mission_id") % 7 == 2)
    return rescue.scene_risk_ratio(scenes)


def frame_hazards(v):
    return mission_floods(v).filter(F.col("water_ratio") > 0.05).select(
        "mission_id", "frame_idx", F.when(F.col("frame_idx") % 6 == 0, F.lit("BLOCKED_ROAD_DEBRIS")).otherwise(F.lit("FLOOD_ZONE")).alias("incident_type"),
        half_even(F.col("water_ratio") * 100.0, 1).alias("coverage_pct"),
    )


def frame_damage(v):
    return v.det.filter("raw_class = 'boat' AND conf > 0.9D").select(
        "mission_id", "frame_idx", F.when(F.col("conf") > 0.95, F.lit("HIGH")).otherwise(F.lit("MEDIUM")).alias("severity")
    )


HAZDMG = f"""{FLOODS}, hz AS (SELECT mission_id, frame_idx, CASE WHEN frame_idx % 6 = 0 THEN 'BLOCKED_ROAD_DEBRIS' ELSE 'FLOOD_ZONE' END AS incident_type, {R('water_ratio * 100e0', 1)} AS coverage_pct FROM mf WHERE water_ratio > 0.05e0),
  dm AS (SELECT mission_id, frame_idx, CASE WHEN conf > 0.95e0 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM det WHERE raw_class = 'boat' AND conf > 0.9e0)"""


@query(
    "e23_hazard_risk", "det cam",
    f"""{HAZDMG}, p AS (SELECT mission_id, count(*) FILTER (raw_class = 'person' AND conf > 0.97e0) AS n FROM det GROUP BY 1), h AS (SELECT mission_id, count(*) AS hz, max(coverage_pct) FILTER (incident_type = 'FLOOD_ZONE') AS cover, count(*) FILTER (incident_type = 'BLOCKED_ROAD_DEBRIS') AS debris FROM hz GROUP BY 1),
    d AS (SELECT mission_id, count(*) AS dmg, count(*) FILTER (severity = 'HIGH') AS severe FROM dm GROUP BY 1),
    j AS (SELECT p.*, coalesce(hz, 0) + coalesce(dmg, 0) > 0 AS act, cover, coalesce(debris, 0) AS debris, coalesce(severe, 0) AS severe FROM p LEFT JOIN h USING (mission_id) LEFT JOIN d USING (mission_id)),
    k AS (SELECT *, CASE WHEN act THEN CASE WHEN n > 0 THEN least(40e0, n * 20e0) ELSE 0e0 END + CASE WHEN cover IS NULL THEN 0e0 ELSE least(50e0, 25e0 + cover * 0.6e0) END + CASE WHEN severe > 0 THEN 25e0 ELSE 0e0 END + CASE WHEN debris > 0 THEN 15e0 ELSE 0e0 END ELSE 0e0 END AS s FROM j)
    SELECT mission_id, CASE WHEN NOT act THEN 'LOW / NO DISASTER EVIDENCE' WHEN s >= 75 THEN 'CRITICAL' WHEN s >= 45 THEN 'HIGH' WHEN s >= 20 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, least(100e0, {R('s', 1)}) AS risk_score,
    {LISTED.format(f"CASE WHEN n > 0 AND act THEN '+ ' || n || ' Person(s) detected in active disaster zone (+' || {FX('least(40e0, n * 20e0)', 0)} || ' pts)' WHEN n > 0 THEN 'Information: ' || n || ' Person(s) detected in normal environment (No emergency exposure).' ELSE 'No person detected in analyzed drone imagery.' END, CASE WHEN cover IS NOT NULL THEN '+ Active flood water coverage detected (' || {FX('cover', 1)} || '% area) (+' || {FX('least(50e0, 25e0 + cover * 0.6e0)', 0)} || ' pts)' END, CASE WHEN severe > 0 THEN '+ Visual structural damage / roof disruption detected on ' || severe || ' building(s) (+25 pts)' END, CASE WHEN debris > 0 THEN '+ Ground route obstruction / debris blockage detected (+15 pts)' END")} AS risk_reasons FROM k""",
)
def _(v):
    seen = v.det.select("mission_id", F.when(F.col("conf") > 0.97, F.col("raw_class")).alias("class_name"))
    return rescue.hazard_risk(seen, frame_hazards(v), frame_damage(v))


# ---------------------------------------------------------------- incidents


@query(
    "c07_near_incidents", "inc",
    f"""d AS (SELECT a.mission_id, a.type, a.seq AS a, b.seq AS b, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS dist FROM inc a JOIN inc b ON a.mission_id = b.mission_id AND a.type = b.type AND a.seq < b.seq WHERE a.x IS NOT NULL AND b.x IS NOT NULL)
    SELECT a, b, {R('dist', 6)} AS dist FROM d WHERE dist < 2""",
)
def _(v):
    return incidents.near_incidents(v.inc).select("a", "b", half_even(F.col("dist"), 6).alias("dist"))


@query("s02_merge_frames", "inc", "SELECT seq, list_sort(list_distinct([frame_idx, seq % 7, 3, frame_idx, 11])) AS frames FROM inc")
def _(v):
    a, b = F.array("frame_idx", F.col("seq") % 7, F.lit(3).cast("long")), F.array(F.col("frame_idx"), F.lit(11).cast("long"))
    return v.inc.select("seq", incidents.merge_frames(a, b).alias("frames"))


def _merge_sql(link: str, radius: str, first: str, pick: str, change: str) -> str:
    return f"""ord AS (SELECT inc.*, {link} AS link, row_number() OVER (PARTITION BY mission_id, type ORDER BY frame_idx, seq) AS rn FROM inc),
  walk AS (SELECT mission_id, type, 0 AS rn, CAST([] AS STRUCT(seq BIGINT, frame BIGINT, frames BIGINT[], conf DOUBLE, x DOUBLE, y DOUBLE, z DOUBLE, err DOUBLE, link VARCHAR, n BIGINT)[]) AS st FROM (SELECT DISTINCT mission_id, type FROM inc) g
    UNION ALL
    SELECT mission_id, type, rn, CASE WHEN spot > 0 THEN list_transform(st, lambda e, i: CASE WHEN i = spot THEN {change} ELSE e END)
      ELSE list_append(st, {{'seq': seq, 'frame': frame_idx, 'frames': [frame_idx], 'conf': {first}, 'x': rx, 'y': ry, 'z': rz, 'err': rerr, 'link': rlink, 'n': 1}}) END FROM (
        SELECT *, {pick} AS spot FROM (
          SELECT w.st, o.mission_id, o.type, o.rn, o.seq, o.frame_idx, o.confidence AS rc, o.x AS rx, o.y AS ry, o.z AS rz, o.reprojection_error_px AS rerr, o.link AS rlink,
            coalesce(list_position(list_transform(w.st, lambda e: coalesce(e.link = o.link, false)), true), 0) AS lk,
            coalesce(list_position(list_transform(w.st, lambda e: coalesce(sqrt(pow(e.x - o.x, 2) + pow(e.y - o.y, 2) + pow(e.z - o.z, 2)) < {radius}, false)), true), 0) AS pl
          FROM walk w JOIN ord o ON o.mission_id = w.mission_id AND o.type = w.type AND o.rn = w.rn + 1) a) b),
  fin AS (SELECT mission_id, type, unnest(st, recursive := false) AS m FROM walk w WHERE rn = (SELECT max(rn) FROM ord o WHERE o.mission_id = w.mission_id AND o.type = w.type))"""


FINISH = """, res AS (SELECT mission_id, type, m.seq AS first_seq, m.link AS linked_to, m.frames AS frame_ids, m.n AS observation_count, m.conf AS confidence, m.x AS x, m.y AS y, m.z AS z,
    CASE WHEN m.x IS NOT NULL THEN 'LOCALIZED_3D' ELSE 'UNAVAILABLE' END AS location_status, m.err AS reprojection_error_px,
    row_number() OVER (PARTITION BY mission_id ORDER BY m.frame, m.seq) AS k FROM fin)"""
FILL = "lk > 0 AND e.x IS NULL AND rx IS NOT NULL"
MERGE_A = _merge_sql(
    "CAST(track_id AS VARCHAR)", "2", R("rc", 2), "CASE WHEN lk > 0 THEN lk ELSE pl END",
    f"""{{'seq': e.seq, 'frame': e.frame, 'frames': list_sort(list_distinct(list_append(e.frames, frame_idx))), 'conf': CASE WHEN lk > 0 AND rc > e.conf THEN rc ELSE e.conf END,
      'x': CASE WHEN {FILL} THEN rx ELSE e.x END, 'y': CASE WHEN {FILL} THEN ry ELSE e.y END, 'z': CASE WHEN {FILL} THEN rz ELSE e.z END, 'err': CASE WHEN {FILL} THEN rerr ELSE e.err END, 'link': e.link, 'n': e.n + 1}}""",
) + FINISH
RAISED = R("least(0.98e0, greatest(e.conf, rc) + 0.04e0)", 3)
MOVE = f"rx IS NOT NULL AND (e.x IS NULL OR rc > {RAISED} - 0.05e0)"
MERGE_B = _merge_sql(
    "CASE WHEN object_id <> 'N/A' THEN object_id END", "3", R("rc", 3), "CASE WHEN lk > 0 AND pl > 0 THEN least(lk, pl) ELSE greatest(lk, pl) END",
    f"""{{'seq': e.seq, 'frame': e.frame, 'frames': list_sort(list_distinct(list_append(e.frames, frame_idx))), 'conf': {RAISED},
      'x': CASE WHEN {MOVE} THEN rx ELSE e.x END, 'y': CASE WHEN {MOVE} THEN ry ELSE e.y END, 'z': CASE WHEN {MOVE} THEN rz ELSE e.z END, 'err': CASE WHEN {MOVE} THEN rerr ELSE e.err END, 'link': e.link, 'n': e.n + 1}}""",
) + FINISH


@query("m01_merge_incidents", "inc", f"RECURSIVE {MERGE_A} SELECT * EXCLUDE (k), printf('INC-%03d', k) AS incident_id FROM res")
def _(v):
    return incidents.merge_incidents(v.inc)


@query("m02_merge_incidents_boost", "inc", f"RECURSIVE {MERGE_B} SELECT * EXCLUDE (k), printf('INCIDENT_%03d', k) AS incident_id FROM res")
def _(v):
    return incidents.merge_incidents_boost(v.inc)


@query(
    "m01_canonical_records", "inc",
    f"""RECURSIVE {MERGE_A} SELECT res.mission_id, printf('INC-%03d', k) AS id, printf('INC-%03d', k) AS incident_id, res.type, res.type AS incident_type, 'MEDIUM' AS severity, res.confidence,
    'No evidence summary provided.' AS evidence, 'No evidence summary provided.' AS summary, inc.track_id, frame_ids, printf('frame_%04d.jpg', inc.frame_idx) AS source_frame_id,
    [0, 0, 0, 0] AS bbox_2d, res.x AS location_x, res.y AS location_y, res.z AS location_z, CASE WHEN res.x IS NOT NULL THEN 'LOCALIZED_3D' ELSE 'UNAVAILABLE' END AS location_3d_status,
    CASE WHEN inc.x IS NOT NULL THEN 'LOCALIZED' ELSE 'UNLOCALIZED' END AS location_status, res.reprojection_error_px, 'NONE' AS flood_context, 'NONE' AS flood_status,
    {R("CAST(inc.seq % 1000 AS DOUBLE) / 999e0", 2)} AS isolation_score, inc.rescue_priority, 'VALIDATED' AS validation_status
    FROM res JOIN inc ON res.mission_id = inc.mission_id AND res.first_seq = inc.seq""",
)
def _(v):
    reports = v.inc.withColumn("isolation_score", (F.col("seq") % 1000).cast("double") / 999.0)
    out = incidents.canonical_records(incidents.merge_incidents(v.inc), reports)
    flat = [F.col("location_3d")[c].alias(f"location_{c}") for c in "xyz"]
    return out.select("*", *flat, F.col("location_3d.status").alias("location_3d_status")).drop("location_3d")


@query(
    "b10_incident_rows", "inc",
    f"""RECURSIVE {MERGE_A} SELECT res.mission_id, printf('INC-%03d', k) AS incident_id, res.type, 'MEDIUM' AS severity, {FX('res.confidence', 2)} AS confidence, coalesce('TRK-' || linked_to, 'N/A') AS track,
    CASE WHEN res.x IS NOT NULL THEN 'X:' || {FX('res.x', 2)} || ', Y:' || {FX('res.y', 2)} || ', Z:' || {FX('res.z', 2)} || coalesce(' (' || CAST(res.reprojection_error_px AS VARCHAR) || 'px)', '') ELSE 'UNAVAILABLE' END AS location,
    'NONE' AS flood_context, rescue_priority, 'VALIDATED' AS validation_status, 'Frames [' || array_to_string(frame_ids, ', ') || ']' AS frames FROM res JOIN inc ON res.mission_id = inc.mission_id AND res.first_seq = inc.seq""",
)
def _(v):
    return incidents.incident_rows(incidents.normalize_incidents(incidents.merge_incidents(v.inc), v.inc))


@query(
    "a08_upsert_incidents", "inc",
    """old AS (SELECT mission_id, 'INC-' || (seq % 97) AS incident_id, arg_max(type, seq) AS type, max(seq) AS version FROM inc WHERE seq % 2 = 0 GROUP BY 1, 2),
    new AS (SELECT mission_id, 'INC-' || (seq % 89) AS incident_id, type, seq AS version FROM inc WHERE seq % 2 = 1),
    a AS (SELECT * FROM old UNION ALL SELECT * FROM new) SELECT mission_id, incident_id, arg_max(type, version) AS type, max(version) AS version FROM a GROUP BY 1, 2""",
)
def _(v):
    name = lambda n: F.concat(F.lit("INC-"), (F.col("seq") % n).cast("string")).alias("incident_id")
    columns = ["mission_id", "type", F.col("seq").alias("version")]
    old = v.inc.filter("seq % 2 = 0").select(name(97), *columns)
    table = VersionedTable(v.spark, shared_folder(v.spark, "upsert"), old.schema, buckets=16)
    table.upsert(old)
    table.upsert(v.inc.filter("seq % 2 = 1").select(name(89), *columns))
    return table.read()


@query(
    "l03_flood_incidents", "pix cam",
    f"""{FLOODS}, ce AS (SELECT mission_id, frame_idx, floor(avg(r)) AS my, floor(avg(c)) AS mx FROM pix WHERE is_water GROUP BY 1, 2),
    cp AS (SELECT ce.mission_id, ce.frame_idx, p.mono_depth AS px, CAST(p.gray AS DOUBLE) / 8e0 AS py, p.depth AS pz FROM ce JOIN pix p ON ce.mission_id = p.mission_id AND ce.frame_idx = p.frame_idx AND p.r = my AND p.c = mx),
    j AS (SELECT mf.*, px, py, pz, px IS NOT NULL AND pz IS NOT NULL AS placed FROM mf LEFT JOIN cp USING (mission_id, frame_idx) WHERE water_state <> 'NO_WATER')
    SELECT mission_id, frame_idx, 'FLOOD_ZONE' AS type, CASE WHEN water_ratio > 0.3e0 THEN 'CRITICAL' ELSE 'HIGH' END AS severity, 0.9e0 AS confidence, CASE WHEN placed THEN {R('px', 2)} END AS x, CASE WHEN placed THEN {R('py', 2)} END AS y,
    CASE WHEN placed THEN {R('pz', 2)} END AS z, CASE WHEN placed THEN 'LOCALIZED_3D' ELSE 'UNAVAILABLE' END AS location_status, water_state AS flood_context,
    'Inundation confirmed with ' || {FX('water_ratio * 100e0', 1)} || '% water surface coverage.' AS evidence FROM j""",
)
def _(v):
    points = v.pix.filter(F.col("depth").isNotNull()).select(
        "mission_id", "frame_idx", "r", "c", F.col("mono_depth").alias("px"), (F.col("gray") / 8.0).alias("py"), F.col("depth").alias("pz")
    )
    centre = incidents.centroid_points(v.pix, points, (8, 8), (8, 8))
    return incidents.flood_incidents(mission_floods(v).filter("water_state <> 'NO_WATER'"), centre)


VICTIM = f"""vi AS (SELECT mission_id, frame_idx, det_id, track_id, CASE WHEN isolation_type LIKE '%STRANDED%' THEN 'STRANDED_PERSON' WHEN isolation_type LIKE '%ISOLATED%' THEN 'ISOLATED_PERSON' ELSE 'PERSON_IN_DISTRESS' END AS type,
  CASE rescue_priority WHEN 'HIGH' THEN 'CRITICAL' WHEN 'MEDIUM' THEN 'HIGH' ELSE 'LOW' END AS severity, 0.88e0 AS confidence, {R('x', 2)} AS x, {R('y', 2)} AS y, {R('z', 2)} AS z,
  CASE WHEN {OK} THEN 'LOCALIZED_3D' ELSE 'UNAVAILABLE' END AS location_status, isolation_type AS flood_context, recommended_action AS evidence FROM pe)"""


@query("l03_victim_incidents", "person", f"{PEOPLE}, {VICTIM} SELECT * FROM vi")
def _(v):
    return incidents.victim_incidents(rescue.score_people(people(v)))


VEHICLE = f"""ve AS (SELECT val.mission_id, val.frame_idx, val.det_id, val.track_id, CASE WHEN water_state LIKE '%INUNDATION%' THEN 'VEHICLE_IN_FLOOD' ELSE 'VEHICLE_DETECTED' END AS type, CASE WHEN water_state LIKE '%INUNDATION%' THEN 'HIGH' ELSE 'LOW' END AS severity,
  {R('validation_conf', 2)} AS confidence, {R('obs.x', 2)} AS x, {R('obs.y', 2)} AS y, {R('obs.z', 2)} AS z, CASE WHEN obs.x IS NOT NULL THEN 'LOCALIZED_3D' ELSE 'UNAVAILABLE' END AS location_status, water_state AS flood_context,
  'Vehicle located in aerial frame (' || water_state || ').' AS evidence FROM val JOIN obs ON val.det_id = obs.det_id JOIN mf ON val.mission_id = mf.mission_id AND val.frame_idx = mf.frame_idx
  WHERE val.raw_class IN ('car', 'truck', 'boat') AND final_class NOT LIKE '%UNCERTAIN%')"""


def vehicle_rows(v):
    cars = validated(v).filter(F.col("raw_class").isin("car", "truck", "boat"))
    return cars.join(v.obs.select("det_id", "x", "y", "z"), "det_id").join(mission_floods(v), ["mission_id", "frame_idx"])


@query("l03_vehicle_incidents", "obs cam", f"{VALIDATED}, {FLOODS}, {VEHICLE} SELECT * FROM ve")
def _(v):
    return incidents.vehicle_incidents(vehicle_rows(v))


@query(
    "s04_union_incidents", "person obs cam",
    f"""{PEOPLE}, {VICTIM}, {VALIDATED}, {FLOODS}, {VEHICLE} SELECT mission_id, type, severity, count(*) AS n, count(track_id) AS tracked, {RS('avg(confidence)', 4)} AS confidence FROM (
    SELECT mission_id, type, severity, confidence, track_id FROM vi UNION ALL SELECT mission_id, type, severity, confidence, track_id FROM ve
    UNION ALL SELECT mission_id, 'FLOOD_ZONE', 'HIGH', water_ratio, NULL FROM mf WHERE water_state = 'VALIDATED_INUNDATION') s GROUP BY 1, 2, 3""",
)
def _(v):
    flooded = mission_floods(v).filter("water_state = 'VALIDATED_INUNDATION'").select(
        "mission_id", "frame_idx", F.lit("FLOOD_ZONE").alias("type"), F.lit("HIGH").alias("severity"), F.col("water_ratio").alias("confidence")
    )
    every = incidents.union_incidents(
        incidents.victim_incidents(rescue.score_people(people(v))), incidents.vehicle_incidents(vehicle_rows(v)), flooded
    )
    return every.groupBy("mission_id", "type", "severity").agg(
        F.count(F.lit(1)).alias("n"), F.count("track_id").alias("tracked"),
        half_even(half_even(F.avg("confidence"), 9), 4).alias("confidence"),
    )


@query(
    "l04_object_incidents", "trk cam",
    f"""{HAZDMG}, dg AS (SELECT mission_id, frame_idx, bool_or(wet) AS fl FROM (SELECT mission_id, frame_idx, incident_type = 'FLOOD_ZONE' AS wet FROM hz UNION ALL SELECT mission_id, frame_idx, false FROM dm) s GROUP BY 1, 2),
    j AS (SELECT trk.*, coalesce(fl, false) AS fl, dg.mission_id IS NOT NULL AS act, raw_class = 'person' AS per FROM trk LEFT JOIN dg ON trk.mission_id = dg.mission_id AND trk.frame_idx = dg.frame_idx)
    SELECT mission_id, frame_idx, det_id, CASE WHEN per AND act THEN 'VICTIM_PERSON_DETECTED' WHEN per THEN 'PERSON_DETECTED' ELSE 'FLOODED_STRUCTURE' END AS type, CASE WHEN per AND act THEN 'CRITICAL' WHEN per THEN 'LOW' ELSE 'HIGH' END AS severity, conf AS confidence,
    CASE WHEN per AND act THEN 'Person / potential victim located in active disaster zone (frame ' || frame_idx || ').' WHEN per THEN 'Civilian person observed during aerial monitoring (frame ' || frame_idx || ').'
      ELSE 'Flooded structure inundated by water (' || {FX('water_overlap * 100e0', 1)} || '% water contact) in aerial frame ' || frame_idx || '.' END AS evidence
    FROM j WHERE per OR (raw_class = 'building' AND fl AND water_overlap > 0.02e0)""",
)
def _(v):
    seen = boxes.normalize_class(v.trk)
    return incidents.object_incidents(seen, frame_hazards(v), frame_damage(v))


# ------------------------------------------------------------------ reports


KEPT = "RECURSIVE rawp AS (SELECT * FROM trk WHERE raw_class = 'person'), gated AS (SELECT * FROM rawp WHERE conf >= 0.3e0), " + nms_sql("gated") + \
    ", keptp AS (SELECT gated.* FROM gated SEMI JOIN kept ON gated.det_id = kept.det_id)"
VALKEPT = VALIDATED.replace("FROM trk", "FROM keptp").replace("trk.", "keptp.")
STAGES = f"""{KEPT}, {VALKEPT}, certain AS (SELECT person.* FROM person SEMI JOIN (SELECT det_id FROM val WHERE final_class = 'PERSON') c ON person.det_id = c.det_id), {fused_sql('certain')}"""


def person_stages(v):
    raw = v.trk.filter("raw_class = 'person'")
    gated = boxes.confidence_gate(raw, 0.3, 0.3)
    kept = cut(nms(gated))
    sure = cut(detect.validate(kept, detect.temporal_metrics(kept)))
    certain = v.person.join(sure.filter("final_class = 'PERSON'").select("det_id"), "det_id", "left_semi")
    return raw, gated, kept, sure, rescue.fuse_tracks(certain)


@query(
    "e30_funnel", "person trk cam",
    f"""{STAGES} SELECT mission_id, CAST(1 AS INT) AS stage_no, 'raw' AS stage, count(*) AS n FROM rawp GROUP BY 1 UNION ALL SELECT mission_id, 2, 'confidence', count(*) FROM gated GROUP BY 1
    UNION ALL SELECT mission_id, 3, 'suppression', count(*) FROM keptp GROUP BY 1 UNION ALL SELECT mission_id, 4, 'tracks', count(DISTINCT track_id) FROM keptp GROUP BY 1
    UNION ALL SELECT mission_id, 5, 'validated', count(*) FROM val WHERE final_class = 'PERSON' GROUP BY 1 UNION ALL SELECT mission_id, 6, 'uncertain', count(*) FROM val WHERE final_class <> 'PERSON' GROUP BY 1
    UNION ALL SELECT mission_id, 7, 'fused', count(*) FROM fused GROUP BY 1 UNION ALL SELECT mission_id, 8, 'localized', count(*) FROM fused WHERE localization_status = 'LOCALIZED_3D' GROUP BY 1
    UNION ALL SELECT mission_id, 9, 'reprojection_valid', count(*) FROM fused WHERE reprojection_error_px <= 25 GROUP BY 1
    UNION ALL SELECT mission_id, 10, 'stranded', count(*) FROM fused WHERE detection_state = 'POTENTIAL STRANDED PERSON' GROUP BY 1
    UNION ALL SELECT mission_id, 11, 'rescue', count(*) FROM fused WHERE detection_state = 'VALIDATED RESCUE TARGET' GROUP BY 1""",
)
def _(v):
    return reports.person_funnel(*person_stages(v))


@query(
    "e33_track_audit", "person",
    f"""SELECT mission_id, track_id, count(*) AS observations, list_sort(list_distinct(list(frame_idx))) AS frames, count(x) AS candidates, count(*) FILTER (reprojection_error_px <= 25) AS valid, count(reprojection_error_px) AS reprojections,
    {R('min(reprojection_error_px)', 4)} AS best_error, {RS('avg(reprojection_error_px)', 4)} AS mean_error FROM person GROUP BY 1, 2""",
)
def _(v):
    return reports.track_audit(v.person)


@query(
    "e34_frame_audit", "trk",
    f"""{KEPT}, {VALKEPT}, a AS (SELECT mission_id, frame_idx, count(*) AS raw_person FROM rawp GROUP BY 1, 2), b AS (SELECT mission_id, frame_idx, count(*) AS after_nms, list_sort(list_distinct(list(track_id))) AS tracks FROM keptp GROUP BY 1, 2),
    c AS (SELECT mission_id, frame_idx, count(*) FILTER (final_class = 'PERSON') AS validated_person FROM val GROUP BY 1, 2),
    j AS (SELECT a.*, coalesce(after_nms, 0) AS after_nms, tracks, coalesce(validated_person, 0) AS validated_person FROM a LEFT JOIN b USING (mission_id, frame_idx) LEFT JOIN c USING (mission_id, frame_idx))
    SELECT *, row_number() OVER (PARTITION BY mission_id ORDER BY after_nms DESC, frame_idx) = 1 AS is_densest FROM j""",
)
def _(v):
    raw, _, kept, sure, _ = person_stages(v)
    return reports.frame_audit(raw, kept, sure)


@query(
    "e35_pipeline_status", "person cam",
    f"""{FUSED}, {FLOODS}, c AS (SELECT cam.mission_id, count(*) AS frames, any_value(flood_frames) AS ff, any_value(loc) AS loc, any_value(vr) AS vr, any_value(tg) AS tg FROM cam
      LEFT JOIN (SELECT mission_id, count(*) FILTER (water_ratio > 0.1e0) AS flood_frames FROM mf GROUP BY 1) f ON cam.mission_id = f.mission_id
      LEFT JOIN (SELECT mission_id, count(x) AS loc, count(*) FILTER (reprojection_error_px <= 5) AS vr FROM person GROUP BY 1) p ON cam.mission_id = p.mission_id
      LEFT JOIN (SELECT mission_id, count(*) AS tg FROM fused WHERE rescue_priority = 'HIGH' GROUP BY 1) t ON cam.mission_id = t.mission_id GROUP BY 1)
    SELECT mission_id, 'FRAMES' AS stage, CASE WHEN frames > 0 THEN 'SUCCESS' ELSE 'FAILED' END AS status FROM c
    UNION ALL SELECT mission_id, '2D-3D', CASE WHEN loc > 0 THEN 'SUCCESS' WHEN frames > 0 THEN 'PARTIAL' ELSE 'FAILED' END FROM c
    UNION ALL SELECT mission_id, 'REPROJECTION', CASE WHEN vr > 0 THEN 'SUCCESS' WHEN loc > 0 THEN 'PARTIAL' ELSE 'FAILED' END FROM c
    UNION ALL SELECT mission_id, 'TRACKING', CASE WHEN tg > 0 THEN 'SUCCESS' WHEN frames > 0 THEN 'PARTIAL' ELSE 'FAILED' END FROM c
    UNION ALL SELECT mission_id, 'FLOOD', CASE WHEN ff > 0 THEN 'SUCCESS' ELSE 'FAILED' END FROM c""",
)
def _(v):
    frames = v.cam.groupBy("mission_id").agg(F.count(F.lit(1)).alias("frames"))
    floods = mission_floods(v).groupBy("mission_id").agg(F.count_if(F.col("water_ratio") > 0.1).alias("flood_frames"))
    placed = v.person.groupBy("mission_id").agg(
        F.count("x").alias("localized"), F.count_if(F.col("reprojection_error_px") <= 5).alias("valid_reprojections")
    )
    high = targets(v).filter("rescue_priority = 'HIGH'").groupBy("mission_id").agg(F.count(F.lit(1)).alias("targets"))
    counts = frames.join(floods, "mission_id", "left").join(placed, "mission_id", "left").join(high, "mission_id", "left")
    return reports.pipeline_status(counts.na.fill(0))


@query(
    "e37_report_summary", "person trk cam",
    f"""{RISK_A}, {VALIDATED} SELECT c.mission_id, frames, selected_frames, coalesce(people, 0) AS people, coalesce(vehicles, 0) AS vehicles, risk_level, risk_score
    FROM (SELECT mission_id, count(*) AS frames, any_value(sf) AS selected_frames FROM cam JOIN (SELECT mission_id AS m, count(DISTINCT frame_idx) AS sf FROM det WHERE conf > 0.9e0 GROUP BY 1) s ON s.m = cam.mission_id GROUP BY 1) c
    LEFT JOIN (SELECT mission_id, count(*) FILTER (final_class = 'PERSON') AS people, count(*) FILTER (final_class IN ('VEHICLE', 'BOAT')) AS vehicles FROM val GROUP BY 1) d ON c.mission_id = d.mission_id
    LEFT JOIN risk ON c.mission_id = risk.mission_id""",
)
def _(v):
    return reports.report_summary(v.cam, v.det.filter("conf > 0.9D").select("mission_id", "frame_idx").distinct(), validated(v), risk_a(v))


@query(
    "c12_measure_pairs", "obs cam",
    f"""oc AS (SELECT o.det_id, o.x, o.y, o.z, cam.* FROM obs o JOIN cam ON o.mission_id = cam.mission_id AND o.frame_idx = cam.frame_idx WHERE o.x IS NOT NULL),
    pr AS (SELECT 'T' || det_id AS a, 'C' || mission_id || '_' || frame_idx AS b, {CENTRE[0]} - x AS dx, {CENTRE[1]} - y AS dy, {CENTRE[2]} - z AS dz FROM oc UNION ALL SELECT 'ORIGIN', 'T' || det_id, x, y, z FROM oc)
    SELECT a, b, {MEASURED} FROM pr""",
)
def _(v):
    placed = v.obs.filter(F.col("x").isNotNull())
    target = F.concat(F.lit("T"), F.col("det_id").cast("string"))
    camera_id = F.concat(F.lit("C"), F.col("mission_id").cast("string"), F.lit("_"), F.col("frame_idx").cast("string"))
    cameras = camera.camera_centre(v.cam).select(camera_id.alias("id"), F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z"))
    wanted = placed.select(target.alias("a"), camera_id.alias("b")).unionByName(
        placed.select(F.lit("ORIGIN").alias("a"), target.alias("b"))
    )
    return localize.measure_pairs(placed.select(target.alias("id"), "x", "y", "z"), cameras, wanted)


@query(
    "s03_compose_scene", "pts cam obs person",
    f"""{FUSED}, {PATH}, base AS (SELECT scene_id, 'environment' AS layer, x, red, grn FROM pts), fl AS (SELECT scene_id, 'flood' AS layer, x, 0.05e0 AS red, 0.65e0 AS grn FROM pts WHERE z < 0.3e0),
    tg AS (SELECT mission_id % 8 AS scene_id, 'target' AS layer, x, CASE rescue_priority WHEN 'LOW' THEN 0.1e0 ELSE 1e0 END AS red, CASE rescue_priority WHEN 'HIGH' THEN 0.1e0 WHEN 'MEDIUM' THEN 0.65e0 ELSE 0.95e0 END AS grn FROM fused WHERE {GATE}),
    pa AS (SELECT mission_id % 8 AS scene_id, 'path' AS layer, (1e0 - i / 40e0) * ax + i / 40e0 * px AS x, 0e0 AS red, 0.9e0 AS grn FROM (SELECT *, lag(px) OVER (PARTITION BY mission_id ORDER BY frame_idx) AS ax FROM cc) q, range(40) t(i) WHERE ax IS NOT NULL)
    SELECT scene_id, layer, count(*) AS n, {RS('avg(x)', 5)} AS mean_x, {RS('avg(red)', 5)} AS mean_red, {RS('avg(grn)', 5)} AS mean_grn FROM (SELECT * FROM base UNION ALL SELECT * FROM fl UNION ALL SELECT * FROM tg UNION ALL SELECT * FROM pa) s GROUP BY 1, 2""",
)
def _(v):
    scene = (F.col("mission_id") % 8).alias("scene_id")
    marks = rescue.rescue_targets(targets(v)).select(scene, "x", "y", "z", "rescue_priority", F.lit("person").alias("class_name"))
    path = cloud.interpolate_path(v.cam).select(scene, "x", "y", "z")
    whole = cloud.compose_scene(v.pts, v.pts.filter("z < 0.3D"), marks, path)
    return whole.groupBy("scene_id", "layer").agg(
        F.count(F.lit(1)).alias("n"), *[half_even(half_even(F.avg(c), 9), 5).alias(n) for c, n in (("x", "mean_x"), ("red", "mean_red"), ("grn", "mean_grn"))]
    )
