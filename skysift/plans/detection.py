"""Queries over detections: boxes, suppression, history, validation, hard cases."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from skysift.functions import boxes
from skysift.functions.numeric import half_even
from skysift.lineage import cut
from skysift.operators import detect, reports
from skysift.operators.suppression import nms
from skysift.plans.registry import FX, R, RS, query

W, H = "greatest(1, x2 - x1)", "greatest(1, y2 - y1)"


@query(
    "b01_normalize_class",
    "det",
    """SELECT det_id, raw_class,
       CASE WHEN raw_class IN ('car','truck','bus','motorcycle','bicycle') THEN 'vehicle' ELSE raw_class END AS class_name,
       CASE WHEN raw_class = 'person' THEN 'PERSON_DETECTED'
            WHEN raw_class IN ('car','truck','bus','motorcycle','bicycle') THEN 'VEHICLE_' || upper(raw_class)
            ELSE upper(raw_class) END AS detection_label FROM det""",
)
def _(v):
    return boxes.normalize_class(v.det).select("det_id", "raw_class", "class_name", "detection_label")


@query(
    "b02_confidence_gate",
    "det",
    "SELECT det_id, raw_class, conf FROM det WHERE conf >= CASE WHEN raw_class = 'person' THEN 0.08 ELSE 0.35 END",
)
def _(v):
    return boxes.confidence_gate(v.det, 0.35, 0.08).select("det_id", "raw_class", "conf")


@query(
    "b03_bbox_to_frame",
    "det",
    f"""m AS (SELECT det_id, least(1920e0, greatest(0e0, x1 * 1.5e0 + slot * 64)) AS a,
         least(1080e0, greatest(0e0, y1 * 1.25e0 + slot * 32)) AS b,
         least(1920e0, x2 * 1.5e0 + slot * 64) AS c, least(1080e0, y2 * 1.25e0 + slot * 32) AS d FROM det)
    SELECT det_id, {R('a', 2)} AS fx1, {R('b', 2)} AS fy1, {R('greatest(a, c)', 2)} AS fx2,
           {R('greatest(b, d)', 2)} AS fy2 FROM m""",
)
def _(v):
    out = boxes.bbox_to_frame(v.det, F.lit(1.5), F.lit(1.25), F.col("slot") * 64, F.col("slot") * 32)
    return out.select("det_id", "fx1", "fy1", "fx2", "fy2")


CLIPPED = f"""clipped AS (SELECT *, {W} AS bw, {H} AS bh FROM (
  SELECT det_id, mission_id, frame_idx, slot, raw_class, conf, image_width, image_height,
         CAST(trunc(least(greatest(x1, 0), 1919)) AS BIGINT) AS x1, CAST(trunc(least(greatest(y1, 0), 1079)) AS BIGINT) AS y1,
         CAST(trunc(least(greatest(x2, 0), 1919)) AS BIGINT) AS x2, CAST(trunc(least(greatest(y2, 0), 1079)) AS BIGINT) AS y2
  FROM det))"""


@query(
    "b04_clip_box",
    "det",
    f"""{CLIPPED}
    SELECT det_id, x1, y1, x2, y2, bw, bh, CAST(floor(x1 + bw / 2e0) AS BIGINT) AS cx,
           CAST(floor(y1 + bh / 2e0) AS BIGINT) AS cy, bw * bh AS area FROM clipped""",
)
def _(v):
    return boxes.clip_box(v.det).select("det_id", "x1", "y1", "x2", "y2", "bw", "bh", "cx", "cy", "area")


@query(
    "b05_bbox_metrics",
    "det",
    f"""SELECT det_id, {W} AS bw, {H} AS bh, {W} * {H} AS area,
        {R(f'greatest({W} / {H}, {H} / {W})', 6)} AS aspect FROM det""",
)
def _(v):
    return boxes.bbox_metrics(v.det).select("det_id", "bw", "bh", "area", half_even(F.col("aspect"), 6).alias("aspect"))


def _neighbours(v):
    a = v.det.select("mission_id", "frame_idx", "det_id", "x1", "y1", "x2", "y2")
    b = a.select("mission_id", "frame_idx", (F.col("det_id") - 1).alias("det_id"), *[F.col(c).alias("b" + c) for c in ("x1", "y1", "x2", "y2")])
    return a.join(b, ["mission_id", "frame_idx", "det_id"])


PAIR = """pair AS (SELECT a.det_id, a.x1, a.y1, a.x2, a.y2, b.x1 AS u1, b.y1 AS v1, b.x2 AS u2, b.y2 AS v2
  FROM det a JOIN det b ON a.mission_id = b.mission_id AND a.frame_idx = b.frame_idx AND b.det_id = a.det_id + 1)"""


@query(
    "b06_iou_plus_one",
    "det",
    f"""{PAIR}, i AS (SELECT *, greatest(0, least(x2, u2) - greatest(x1, u1) + 1) * greatest(0, least(y2, v2) - greatest(y1, v1) + 1) AS n FROM pair)
    SELECT det_id, {R('n / ((x2 - x1 + 1) * (y2 - y1 + 1) + (u2 - u1 + 1) * (v2 - v1 + 1) - n + 1e-6)', 6)} AS iou FROM i""",
)
def _(v):
    iou = boxes.overlap_plus_one(boxes.box_columns(), boxes.box_columns("b"))
    return _neighbours(v).select("det_id", half_even(iou, 6).alias("iou"))


@query(
    "b07_iou",
    "det",
    f"""{PAIR}, i AS (SELECT *, least(x2, u2) - greatest(x1, u1) AS iw, least(y2, v2) - greatest(y1, v1) AS ih FROM pair)
    SELECT det_id, CASE WHEN iw > 0 AND ih > 0 THEN
      {R('iw * ih / greatest(1e0, (x2 - x1) * (y2 - y1) + (u2 - u1) * (v2 - v1) - iw * ih)', 6)} ELSE 0e0 END AS iou FROM i""",
)
def _(v):
    iou = boxes.overlap(boxes.box_columns(), boxes.box_columns("b"))
    return _neighbours(v).select("det_id", half_even(iou, 6).alias("iou"))


@query(
    "b08_anti_boat",
    "det",
    f"""{CLIPPED}, roof AS (SELECT *, raw_class = 'boat' AND (bw * bh > 2000 OR
        (bw / (bh + 1e-6) BETWEEN 0.5e0 AND 2e0 AND bw * bh > 800)) AS is_roof,
        CASE WHEN raw_class IN ('car','truck') THEN 'vehicle' ELSE raw_class END AS cls FROM clipped)
    SELECT det_id, raw_class, conf, CASE WHEN is_roof THEN 'building' ELSE cls END AS class_name,
           CASE WHEN is_roof THEN 0e0 ELSE conf END AS validated_conf,
           CASE WHEN is_roof THEN 'COCO boat misclassification remapped to flooded structure roof.' END AS note FROM roof""",
)
def _(v):
    out = boxes.anti_boat(boxes.clip_box(boxes.normalize_class(v.det)))
    return out.select("det_id", "raw_class", "conf", "class_name", "validated_conf", "note")


@query(
    "b19_tiles",
    "det",
    """f AS (SELECT DISTINCT mission_id, frame_idx, image_width AS w, image_height AS h FROM det),
    xs AS (SELECT f.*, unnest(list_distinct(list_append(range(0, w - 640 + 1, 512), w - 640))) AS tile_x FROM f),
    ys AS (SELECT xs.*, unnest(list_distinct(list_append(range(0, h - 640 + 1, 512), h - 640))) AS tile_y FROM xs)
    SELECT mission_id, frame_idx, CAST(tile_x AS BIGINT) AS tile_x, CAST(tile_y AS BIGINT) AS tile_y,
           CAST(least(w, tile_x + 640) AS BIGINT) AS tile_x2, CAST(least(h, tile_y + 640) AS BIGINT) AS tile_y2 FROM ys""",
)
def _(v):
    frames = v.det.select("mission_id", "frame_idx", "image_width", "image_height").distinct()
    return boxes.tiles(frames).drop("image_width", "image_height")


def nms_sql(source: str) -> str:
    n = "(greatest(0, least(k.x2, j.x2) - greatest(k.x1, j.x1) + 1) * greatest(0, least(k.y2, j.y2) - greatest(k.y1, j.y1) + 1))"
    area = lambda q: f"(({q}.x2 - {q}.x1 + 1) * ({q}.y2 - {q}.y1 + 1))"
    iou = f"{n} / ({area('k')} + {area('j')} - {n} + 1e-6)".replace("j.", "items[i + 1].")
    return f"""grouped AS (SELECT mission_id, frame_idx, raw_class = 'person' AS p,
      list({{'det_id': det_id, 'conf': conf, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY conf DESC, det_id DESC) AS items
      FROM {source} GROUP BY ALL),
    walk AS (SELECT mission_id, frame_idx, p, items, 1 AS i, [items[1]] AS kept FROM grouped
      UNION ALL
      SELECT mission_id, frame_idx, p, items, i + 1,
        CASE WHEN len(list_filter(kept, lambda k: {iou} > CASE WHEN p THEN 0.40e0 ELSE 0.45e0 END)) = 0
             THEN list_append(kept, items[i + 1]) ELSE kept END
      FROM walk WHERE i < len(items)),
    kept AS (SELECT mission_id, frame_idx, unnest(kept).det_id AS det_id FROM walk WHERE i = len(items))"""


@query("k01_nms", "det", f"RECURSIVE {nms_sql('det')} SELECT mission_id, frame_idx, det_id FROM kept")
def _(v):
    return nms(v.det).select("mission_id", "frame_idx", "det_id")


@query(
    "k01_nms_dense", "det",
    f"""RECURSIVE dense AS (SELECT mission_id, frame_idx // 5 AS frame_idx, row_number() OVER (PARTITION BY mission_id, frame_idx // 5 ORDER BY det_id) AS det_id, conf, raw_class, x1, y1, x2, y2 FROM det),
    {nms_sql('dense')} SELECT mission_id, frame_idx, det_id FROM kept""",
)
def _(v):
    """Crowded frames, most settled in rounds; ids repeat from frame to frame and from mission to mission."""
    own = Window.partitionBy("mission_id", F.floor(F.col("frame_idx") / 5)).orderBy("det_id")
    dense = v.det.select(
        "mission_id", F.floor(F.col("frame_idx") / 5).alias("frame_idx"), F.row_number().over(own).cast("long").alias("det_id"),
        "conf", "raw_class", "x1", "y1", "x2", "y2",
    )
    return nms(dense, limit=30).select("mission_id", "frame_idx", "det_id")


@query(
    "s01_union_detections",
    "det",
    """SELECT mission_id, frame_idx, det_id, conf, 'full_frame' AS tile_id FROM det
    UNION ALL SELECT mission_id, frame_idx, det_id + 1000000000, conf,
    'tile_' || CAST(slot * 512 AS VARCHAR) || '_' || CAST((slot % 2) * 440 AS VARCHAR) FROM det""",
)
def _(v):
    full = v.det.select("mission_id", "frame_idx", "det_id", "conf")
    tiled = v.det.select(
        "mission_id", "frame_idx", (F.col("det_id") + 1000000000).alias("det_id"), "conf",
        (F.col("slot") * 512).alias("tile_x"), ((F.col("slot") % 2) * 440).alias("tile_y"),
    )
    return detect.union_detections(full, tiled)


HIST = """seen AS (SELECT mission_id, track_id, frame_idx, det_id, conf,
    CASE WHEN raw_class IN ('car','truck','bus','motorcycle','bicycle','vehicle') THEN 'vehicle' ELSE raw_class END AS cls FROM trk),
  switches AS (SELECT mission_id, track_id, CAST(sum(CASE WHEN prev IS NOT NULL AND prev <> cls THEN 1 ELSE 0 END) AS BIGINT) AS switch_count
    FROM (SELECT *, lag(cls) OVER (PARTITION BY mission_id, track_id ORDER BY frame_idx, det_id) AS prev FROM seen) GROUP BY ALL),
  per_class AS (SELECT mission_id, track_id, cls, count(*) AS n, avg(conf) AS mean, min(det_id) AS first FROM seen GROUP BY ALL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY mission_id, track_id ORDER BY n DESC, mean DESC, first) AS k,
    sum(n) OVER (PARTITION BY mission_id, track_id) AS total FROM per_class),
  hist AS (SELECT ranked.mission_id, ranked.track_id, cls AS dominant_class, """ + R("n / total", 3) + """ AS vote_ratio,
    """ + RS("mean", 3) + """ AS mean_class_conf, switch_count, CAST(total AS BIGINT) AS observations
    FROM ranked JOIN switches ON ranked.mission_id = switches.mission_id AND ranked.track_id = switches.track_id WHERE k = 1),
  dist AS (SELECT mission_id, track_id, string_agg(cls || ':' || n, ',' ORDER BY cls) AS distribution FROM per_class GROUP BY ALL)"""


@query("g01_class_switches", "trk", HIST + " SELECT * FROM switches")
def _(v):
    return detect.class_switches(v.trk)


@query(
    "e01_temporal_metrics",
    "trk",
    HIST + " SELECT hist.*, distribution FROM hist JOIN dist ON hist.mission_id = dist.mission_id AND hist.track_id = dist.track_id",
)
def _(v):
    listed = F.transform(F.map_entries("class_distribution"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    return detect.temporal_metrics(v.trk).withColumn("distribution", F.array_join(listed, ",")).drop("class_distribution")


@query(
    "c02_with_history",
    "trk",
    HIST + """, gap AS (SELECT trk.*, CASE WHEN det_id % 11 = 0 THEN NULL ELSE track_id END AS tid FROM trk)
    SELECT gap.det_id, tid AS track_id, dominant_class, vote_ratio, switch_count
    FROM gap LEFT JOIN hist ON gap.mission_id = hist.mission_id AND gap.tid = hist.track_id""",
)
def _(v):
    history = detect.temporal_metrics(v.trk)
    loose = v.trk.withColumn("track_id", F.when(F.col("det_id") % 11 != 0, F.col("track_id")))
    return detect.with_history(loose, history).select("det_id", "track_id", "dominant_class", "vote_ratio", "switch_count")


def _case(*branches: str) -> str:
    return "CASE " + " ".join(branches) + " END"


def validated_sql() -> str:
    """The rule ladder of detections as SQL: step code first, then its outputs."""
    a, asp = "CAST(area AS VARCHAR)", FX("aspect", 2)
    w0, w1 = FX("water * 100e0", 0), FX("water * 100e0", 1)
    step = _case(
        "WHEN conf < bar THEN 'weak'",
        "WHEN cls = 'person' THEN CASE WHEN area > 3500 THEN 'p_big' WHEN area < 10 THEN 'p_tiny' WHEN aspect > 8 THEN 'p_thin' ELSE 'p_ok' END",
        "WHEN cls = 'vehicle' THEN CASE WHEN area > 12000 THEN CASE WHEN bw / bh BETWEEN 0.35e0 AND 3e0 THEN 'v_roof' ELSE 'v_big' END"
        " WHEN area < 250 THEN 'v_small' WHEN water > 0.85e0 AND conf < 0.25e0 THEN 'v_mirror' ELSE 'v_ok' END",
        "WHEN cls = 'building' THEN CASE WHEN area < 1200 AND aspect BETWEEN 1.05e0 AND 4.5e0 THEN 'b_car' WHEN area >= 2500 THEN 'b_foot' ELSE 'b_ok' END",
        "WHEN cls = 'boat' THEN CASE WHEN water >= 0.15e0 THEN 'o_ok' WHEN area >= 2500 THEN 'o_roof'"
        " WHEN area <= 12000 AND aspect BETWEEN 1.1e0 AND 3.5e0 THEN 'o_car' ELSE 'o_dry' END",
        "ELSE 'other'",
    )
    final = _case(
        "WHEN step IN ('weak','p_big','p_tiny','p_thin','v_big','v_small','v_mirror','o_dry') THEN 'UNCERTAIN_OBJECT'",
        "WHEN step = 'p_ok' THEN 'PERSON' WHEN step IN ('v_ok','b_car','o_car') THEN 'VEHICLE'",
        "WHEN step IN ('v_roof','b_foot','b_ok','o_roof') THEN 'BUILDING' WHEN step = 'o_ok' THEN 'BOAT' ELSE upper(cls)",
    )
    value = _case(
        "WHEN step = 'weak' THEN conf * 0.5e0 WHEN step IN ('p_big','p_tiny','p_thin','v_big','v_small','v_mirror','o_dry') THEN 0e0",
        "WHEN step = 'v_roof' THEN least(0.85e0, conf + 0.15e0) WHEN step = 'b_foot' THEN greatest(conf, 0.70e0)",
        "WHEN step = 'o_roof' THEN least(0.80e0, conf + 0.10e0) ELSE conf",
    )
    note = _case(
        f"WHEN step = 'weak' THEN 'Confidence ' || {FX('conf', 2)} || ' below class threshold ' || {FX('bar', 2)} || ' for ' || cls || '.'",
        f"WHEN step = 'p_big' THEN 'Person bbox area ' || {a} || 'px exceeds plausible human bounds (max 3500px).'",
        f"WHEN step = 'p_tiny' THEN 'Sub-pixel noise (area ' || {a} || 'px < 10px).'",
        f"WHEN step = 'p_thin' THEN 'Extreme aspect ratio ' || {asp} || ' exceeds max 8.0.'",
        f"WHEN step = 'p_ok' THEN 'Valid aerial person geometry (area=' || {a} || 'px, aspect=' || {asp} || ').'",
        f"WHEN step = 'v_roof' THEN 'Building-like geometry (area=' || {a} || 'px > 12000px, aspect=' || {asp} || '); remapped from oversized vehicle.'",
        f"WHEN step = 'v_big' THEN 'Oversized vehicle detection (area=' || {a} || 'px) with conflicting shape; flagged uncertain.'",
        f"WHEN step = 'v_small' THEN 'Undersized vehicle candidate (area=' || {a} || 'px < 250px); noise suppression.'",
        f"WHEN step = 'v_mirror' THEN 'Deep water overlap (' || {w0} || '%) with low confidence (' || {FX('conf', 2)} || '); likely water reflection artifact.'",
        f"WHEN step = 'v_ok' THEN 'Vehicle geometry confirmed (area=' || {a} || 'px, aspect=' || {asp} || ', water overlap=' || {w0} || '%).'",
        f"WHEN step = 'b_car' THEN 'Compact object (area=' || {a} || 'px, aspect=' || {asp} || ') matches ground vehicle bounds; remapped from building.'",
        f"WHEN step = 'b_foot' THEN 'Persistent structural footprint (area=' || {a} || 'px, aspect=' || {asp} || ', water overlap=' || {w0} || '%).'",
        f"WHEN step = 'b_ok' THEN 'Structure geometry (area=' || {a} || 'px).'",
        f"WHEN step = 'o_roof' THEN 'Boat predicted on dry structure (area=' || {a} || 'px, water overlap=' || {w1} || '%); remapped to BUILDING.'",
        f"WHEN step = 'o_car' THEN 'Boat detected on dry ground with vehicle dimensions (area=' || {a} || 'px, aspect=' || {asp} || '); remapped to VEHICLE.'",
        f"WHEN step = 'o_dry' THEN 'Boat detected on dry terrain without water proximity (overlap=' || {w1} || '%); unsupported.'",
        f"WHEN step = 'o_ok' THEN 'Vessel confirmed in water context (overlap=' || {w1} || '%, aspect=' || {asp} || ').'",
    )
    moved = "step IN ('weak','p_big','p_tiny','p_thin','v_roof','v_big','v_small','v_mirror','b_car','o_roof','o_car','o_dry')"
    over = ("step <> 'weak' AND vote_ratio >= 0.65e0 AND upper(dominant_class) IN ('PERSON','VEHICLE','BUILDING','BOAT','UNCERTAIN_OBJECT')"
            " AND upper(dominant_class) <> fc AND fc <> 'PERSON'")
    return f"""sized AS (SELECT trk.*, dominant_class, vote_ratio, switch_count, {W} AS bw, {H} AS bh, {W} * {H} AS area,
        greatest({W} / {H}, {H} / {W}) AS aspect, water_overlap AS water,
        CASE WHEN raw_class IN ('car','truck','bus','motorcycle','vehicle') THEN 'vehicle' ELSE raw_class END AS cls
        FROM trk LEFT JOIN hist ON trk.mission_id = hist.mission_id AND trk.track_id = hist.track_id),
      barred AS (SELECT *, CASE WHEN cls = 'person' THEN 0.08e0 ELSE 0.15e0 END AS bar FROM sized),
      stepped AS (SELECT *, {step} AS step FROM barred),
      staged AS (SELECT *, {final} AS fc, {value} AS val, {note} AS note, {moved} AS moved FROM stepped),
      voted AS (SELECT *, coalesce({over}, false) AS over FROM staged),
      after AS (SELECT *, CASE WHEN over THEN upper(dominant_class) ELSE fc END AS fc2 FROM voted),
      shaky AS (SELECT *, coalesce(step <> 'weak' AND switch_count >= 3 AND vote_ratio < 0.5e0 AND fc2 <> 'PERSON', false) AS shaky FROM after),
      val AS (SELECT mission_id, frame_idx, det_id, track_id, raw_class, conf, x1, y1, x2, y2, image_width, image_height, water_overlap, switch_count,
        CASE WHEN shaky THEN 'UNCERTAIN_OBJECT' ELSE fc2 END AS final_class,
        {R('CASE WHEN shaky THEN 0e0 ELSE val END', 4)} AS validation_conf, moved OR over OR shaky AS is_changed,
        CASE WHEN note IS NULL AND NOT over AND NOT shaky THEN 'Validated by physical context.' ELSE concat_ws(' | ', note,
          CASE WHEN over THEN 'Temporal track consistency overrode transient ' || fc || ' -> ' || upper(dominant_class) || ' (vote ratio: '
            || {FX('vote_ratio', 2)} || ', ' || switch_count || ' switches).' END,
          CASE WHEN shaky THEN 'Excessive class oscillations (' || switch_count || ' switches across track); flagged UNCERTAIN_OBJECT.' END) END AS validation_evidence
        FROM shaky)"""


VALIDATED = HIST + ", " + validated_sql()


def validated(v):
    return detect.validate(v.trk, detect.temporal_metrics(v.trk))


@query(
    "b09_validate", "trk",
    VALIDATED + " SELECT det_id, raw_class, conf, final_class, validation_conf, is_changed, validation_evidence FROM val",
)
def _(v):
    return validated(v).select(
        "det_id", "raw_class", "conf", "final_class", "validation_conf", "is_changed", "validation_evidence"
    )


@query(
    "b11_actionable", "trk",
    VALIDATED + " SELECT det_id, final_class FROM val WHERE final_class NOT IN ('UNCERTAIN_OBJECT','UNKNOWN','NONE')",
)
def _(v):
    return detect.actionable(validated(v)).select("det_id", "final_class")


CATEGORY = """, cased AS (SELECT *, CASE
    WHEN raw_class IN ('vehicle','car','truck','bus') AND final_class = 'BUILDING' THEN 'building_as_vehicle'
    WHEN raw_class = 'building' AND final_class = 'VEHICLE' THEN 'vehicle_as_building'
    WHEN raw_class = 'person' AND final_class IN ('UNCERTAIN_OBJECT','BUILDING','VEHICLE') THEN 'false_person'
    WHEN raw_class = 'boat' AND final_class IN ('UNCERTAIN_OBJECT','BUILDING','VEHICLE') THEN 'false_boat'
    WHEN raw_class IN ('vehicle','car','truck','bus') AND final_class = 'VEHICLE' AND validation_conf >= 0.15e0 THEN 'correct_vehicle'
    WHEN final_class = 'BUILDING' AND validation_conf >= 0.2e0 THEN 'correct_building'
    WHEN raw_class = 'person' AND final_class = 'PERSON' AND validation_conf >= 0.08e0 THEN 'correct_person'
    WHEN raw_class = 'boat' AND final_class = 'BOAT' AND validation_conf >= 0.15e0 THEN 'correct_boat' END AS category FROM val)"""


@query("b14_hard_case_category", "trk", VALIDATED + CATEGORY + " SELECT det_id, category FROM cased WHERE category IS NOT NULL")
def _(v):
    return detect.hard_case_category(validated(v)).select("det_id", "category")


@query(
    "b15_margin_box", "det",
    f"""SELECT det_id, CAST(greatest(0, x1 - trunc({W} * 0.15e0)) AS BIGINT) AS crop_x1, CAST(greatest(0, y1 - trunc({H} * 0.15e0)) AS BIGINT) AS crop_y1,
    CAST(least(image_width, x2 + trunc({W} * 0.15e0)) AS BIGINT) AS crop_x2, CAST(least(image_height, y2 + trunc({H} * 0.15e0)) AS BIGINT) AS crop_y2 FROM det""",
)
def _(v):
    return boxes.margin_box(v.det).select("det_id", "crop_x1", "crop_y1", "crop_x2", "crop_y2")


@query(
    "b16_route", "trk",
    VALIDATED + """ SELECT det_id, 'person' AS stream FROM val WHERE final_class = 'PERSON'
    UNION ALL SELECT det_id, 'vehicle' FROM val WHERE final_class IN ('VEHICLE','BOAT')""",
)
def _(v):
    persons, vehicles = detect.route(validated(v))
    return persons.select("det_id", F.lit("person").alias("stream")).unionByName(
        vehicles.select("det_id", F.lit("vehicle").alias("stream"))
    )


@query(
    "e36_hard_case_counts", "trk",
    VALIDATED + CATEGORY + """, every AS (SELECT unnest(['building_as_vehicle','vehicle_as_building','false_person','false_boat',
    'correct_vehicle','correct_building','correct_person','correct_boat']) AS category)
    SELECT every.category, count(cased.det_id) AS n FROM every LEFT JOIN cased ON every.category = cased.category GROUP BY 1""",
)
def _(v):
    return detect.hard_case_counts(detect.hard_case_category(validated(v)))


COUNTS = """SELECT mission_id, count(*) FILTER (final_class = 'PERSON') AS people, count(*) FILTER (final_class = 'VEHICLE') AS vehicles,
    count(*) FILTER (final_class = 'BUILDING') AS buildings, count(*) FILTER (final_class = 'BOAT') AS boats,
    count(*) FILTER (final_class = 'UNCERTAIN_OBJECT') AS uncertain"""


@query(
    "e32_class_counts", "trk",
    VALIDATED + f""", c AS ({COUNTS} FROM val GROUP BY mission_id),
    s AS (SELECT mission_id, CAST(sum(switch_count) AS BIGINT) AS switches FROM switches GROUP BY mission_id)
    SELECT c.*, switches FROM c JOIN s ON c.mission_id = s.mission_id""",
)
def _(v):
    return reports.class_counts(validated(v), detect.temporal_metrics(v.trk))


@query(
    "class_counts_after_nms", "trk",
    "RECURSIVE gated AS (SELECT * FROM trk WHERE conf >= 0.08e0), " + nms_sql("gated") + ", kept_trk AS (SELECT trk.* FROM trk SEMI JOIN kept ON trk.det_id = kept.det_id), "
    + VALIDATED.replace("FROM trk", "FROM kept_trk").replace("trk.", "kept_trk.") + f", c AS ({COUNTS} FROM val GROUP BY mission_id), "
    "s AS (SELECT mission_id, CAST(sum(switch_count) AS BIGINT) AS switches FROM switches GROUP BY mission_id) "
    "SELECT c.*, switches FROM c JOIN s ON c.mission_id = s.mission_id",
)
def _(v):
    kept = cut(nms(boxes.confidence_gate(v.trk)))
    temporal = detect.temporal_metrics(kept)
    return reports.class_counts(detect.validate(kept, temporal), temporal)


@query(
    "u01_segment_with", "pix",
    """SELECT mission_id, frame_idx, count(*) AS pixels, count(*) FILTER (is_water) AS water FROM pix GROUP BY ALL""",
)
def _(v):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf.iloc[:1][["mission_id", "frame_idx"]].copy()
        return head.assign(pixels=len(pdf), water=int(pdf["is_water"].sum()))

    return detect.segment_with(
        v.pix.select("mission_id", "frame_idx", "is_water"), fn, "mission_id long, frame_idx long, pixels long, water long"
    )


@query(
    "u02_detect_with", "det",
    """f AS (SELECT DISTINCT mission_id, frame_idx, image_width AS w, image_height AS h FROM det),
    xs AS (SELECT f.*, unnest(list_distinct(list_append(range(0, w - 640 + 1, 512), w - 640))) AS tile_x FROM f),
    ys AS (SELECT xs.*, unnest(list_distinct(list_append(range(0, h - 640 + 1, 512), h - 640))) AS tile_y FROM xs)
    SELECT mission_id, frame_idx, CAST(tile_x + 10 AS BIGINT) AS x1, CAST(tile_y + 20 AS BIGINT) AS y1 FROM ys""",
)
def _(v):
    def fn(batches):
        for pdf in batches:
            yield pd.DataFrame(
                {"mission_id": pdf.mission_id, "frame_idx": pdf.frame_idx, "x1": pdf.tile_x + 10, "y1": pdf.tile_y + 20}
            )

    frames = v.det.select("mission_id", "frame_idx", "image_width", "image_height").distinct()
    return detect.detect_with(frames, fn, "mission_id long, frame_idx long, x1 long, y1 long")


@query(
    "u03_infer_mission_with", "cam",
    "SELECT mission_id, frame_idx, t0 * 2e0 AS depth_scale FROM cam",
)
def _(v):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"mission_id": pdf.mission_id, "frame_idx": pdf.frame_idx, "depth_scale": pdf.t0 * 2.0})

    return detect.infer_mission_with(
        v.cam.select("mission_id", "frame_idx", "t0"), fn, "mission_id long, frame_idx long, depth_scale double", window=24
    )
