"""Queries over sources, sinks and streams.

A sink query writes its export into the shared folder and reads it back, so what
is compared is what was written.
"""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysift.functions import boxes
from skysift.functions.numeric import half_even
from skysift.lineage import shared_folder
from skysift.operators import detect, incidents, rescue
from skysift.plans.detection import CATEGORY, VALIDATED, validated
from skysift.plans.localization import CENTRE, TRACKED, trackable
from skysift.plans.registry import FX, R, RS, query
from skysift.plans.triage import MERGE_A, OK, PEOPLE, people
from skysift.sources import readers, sinks
from skysift.streaming import incidents as stream_incidents
from skysift.streaming import rollup, tracker


@query(
    "a01_read_frames", "cam",
    """f AS (SELECT mission_id, frame_idx, printf('%06d', (frame_idx * 37) % 1000003) AS stem, CASE WHEN frame_idx % 9 = 0 THEN 'MP4' WHEN frame_idx % 11 = 0 THEN 'txt' ELSE 'jpg' END AS ext FROM cam)
    SELECT 'mission_' || mission_id AS mission, CASE ext WHEN 'MP4' THEN 'clip' ELSE 'image' END AS kind, frame_idx % 5 + 1 AS size_bytes,
      printf('frame_%05d.jpg', row_number() OVER (PARTITION BY mission_id ORDER BY stem) - 1) AS name FROM f WHERE ext <> 'txt'""",
)
def _(v):
    """A file for each frame of the events, in folders by mission, listed again."""
    folder = shared_folder(v.spark, "frames")
    frames = v.cam.select("mission_id", "frame_idx")
    frames.mapInPandas(lambda batches: _put_frames(batches, folder), "mission_id long").write.format("noop").mode("overwrite").save()
    return readers.read_frames(v.spark, folder).select("mission", "kind", "size_bytes", "name")


def _put_frames(batches, folder: str):
    store, root = fs.FileSystem.from_uri(folder)
    for batch in batches:
        for mission, frame in zip(batch["mission_id"].tolist(), batch["frame_idx"].tolist(), strict=True):
            suffix = "MP4" if frame % 9 == 0 else "txt" if frame % 11 == 0 else "jpg"
            store.create_dir(f"{root}/mission_{mission}", recursive=True)
            with store.open_output_stream(f"{root}/mission_{mission}/{frame * 37 % 1000003:06d}.{suffix}") as out:
                out.write(b"x" * (frame % 5 + 1))
        yield batch[["mission_id"]]


@query(
    "a02_sample_folder", "cam",
    """n AS (SELECT cam.mission_id, cam.frame_idx, count(*) OVER (PARTITION BY mission_id) AS n FROM cam)
    SELECT mission_id, frame_idx FROM n WHERE frame_idx % CASE WHEN n > 12 THEN greatest(1, CAST(floor(n / 12) AS BIGINT)) ELSE 1 END = 0
    AND frame_idx / CASE WHEN n > 12 THEN greatest(1, CAST(floor(n / 12) AS BIGINT)) ELSE 1 END < 12""",
)
def _(v):
    return readers.sample_folder(v.cam.select("mission_id", "frame_idx"), 12)


FPS = "CASE WHEN mission_id % 3 = 0 THEN 0e0 WHEN mission_id % 3 = 1 THEN 25e0 ELSE 29.97e0 END"


@query(
    "a02_sample_clip", "cam",
    f"""i AS (SELECT mission_id, frame_idx, CASE WHEN 6 < {FPS} THEN greatest(2, round_even({FPS} / 6e0, 0)) ELSE 2 END AS gap FROM cam)
    SELECT mission_id, frame_idx FROM i WHERE frame_idx % gap = 0 AND frame_idx / gap < 8""",
)
def _(v):
    return readers.sample_clip(v.cam.select("mission_id", "frame_idx"), _fps(), 6.0, 8, 2)


def _fps():
    rest = F.col("mission_id") % 3
    return F.when(rest == 0, F.lit(0.0)).when(rest == 1, F.lit(25.0)).otherwise(F.lit(29.97))


@query(
    "a03_clip_summary", "cam",
    f"""SELECT mission_id, count(*) AS frame_count, {R(f'max({FPS})', 2)} AS fps, {R(f'CASE WHEN max({FPS}) > 0 THEN count(*) / max({FPS}) ELSE 0e0 END', 2)} AS duration_seconds,
    '1920x1080' AS resolution, {R('sum(frame_idx * 20000 + 1000) / 1048576', 2)} AS file_size_mb FROM cam GROUP BY 1""",
)
def _(v):
    frames = v.cam.select(
        "mission_id", "frame_idx", F.col("img_w").alias("width"), F.col("img_h").alias("height"), (F.col("frame_idx") * 20000 + 1000).alias("size_bytes")
    )
    return readers.clip_summary(frames, _fps())


def _cases(v) -> DataFrame:
    return boxes.margin_box(detect.hard_case_category(validated(v)))


CASES = CATEGORY + """, hc AS (SELECT printf('frame_%04d.jpg', frame_idx) AS frame_id, frame_idx, track_id, raw_class AS raw_yolo_class, conf AS raw_yolo_confidence, final_class AS validated_class,
    validation_conf AS validation_confidence, validation_evidence, category, x1, CAST(greatest(0, x1 - trunc(greatest(1, x2 - x1) * 0.15e0)) AS BIGINT) AS crop_x1 FROM cased WHERE category IS NOT NULL)"""


@query("a10_write_hard_cases", "trk", VALIDATED + CASES + " SELECT * FROM hc")
def _(v):
    folder = shared_folder(v.spark, "hard-cases")
    sinks.write_hard_cases(_cases(v), folder)
    read = v.spark.read.schema(sinks.hard_case_records(_cases(v)).schema).json(folder)
    return read.drop("_folder").select(
        "frame_id", "frame_idx", "track_id", "raw_yolo_class", "raw_yolo_confidence", "validated_class", "validation_confidence",
        "validation_evidence", "category", F.col("original_bbox")[0].alias("x1"), F.col("cropped_bbox")[0].alias("crop_x1"),
    )


@query(
    "a04_read_detections", "det",
    "SELECT mission_id, frame_idx, printf('frame_%04d.jpg', frame_idx) AS frame_id, det_id, raw_class, conf, x1, y1, x2, y2 FROM det",
)
def _(v):
    folder = shared_folder(v.spark, "detections")
    v.det.withColumn("frame_id", F.format_string("frame_%04d.jpg", F.col("frame_idx"))).write.partitionBy("slot").json(folder)
    return readers.read_detections(v.spark, folder).select(
        "mission_id", "frame_idx", "frame_id", "det_id", "raw_class", "conf", "x1", "y1", "x2", "y2"
    )


def _csv(v, folder: str) -> DataFrame:
    """Exported text with empty fields read as nothing; every column stays text."""
    return v.spark.read.option("header", True).option("nullValue", "").csv(folder)


@query(
    "a05_write_incidents", "inc",
    f"""RECURSIVE {MERGE_A} SELECT printf('INC-%03d', k) AS incident_id, type AS incident_type, 'MEDIUM' AS severity, CAST(confidence AS VARCHAR) AS confidence, printf('frame_%04d.jpg', frame_ids[1]) AS source_frame_id,
    coalesce(CAST(x AS VARCHAR), 'N/A') AS world_x, coalesce(CAST(y AS VARCHAR), 'N/A') AS world_y, coalesce(CAST(z AS VARCHAR), 'N/A') AS world_z, 'NONE' AS flood_status, 'No evidence summary provided.' AS summary, CAST(NULL AS VARCHAR) AS timestamp FROM res""",
)
def _(v):
    merged = incidents.normalize_incidents(incidents.merge_incidents(v.inc), v.inc).withColumns(
        {"source_frame_id": F.format_string("frame_%04d.jpg", F.col("frame_ids")[0]), "timestamp": F.lit(None).cast("string")}
    )
    folder = shared_folder(v.spark, "incidents")
    sinks.write_incidents(merged, folder)
    return _csv(v, f"{folder}/incidents_csv")


@query(
    "a06_write_priorities", "person",
    f"""{PEOPLE} SELECT CAST(track_id AS VARCHAR) AS victim_id, CAST(track_id AS VARCHAR) AS track_id, printf('frame_%04d.jpg', frame_idx) AS frame_id, rescue_priority, CAST(priority_score AS VARCHAR) AS priority_score, isolation_type,
    CAST(surrounding_flood_pct AS VARCHAR) AS surrounded_pct, 'N/A' AS nearest_water_dist_m, coalesce(CAST({R('x', 2)} AS VARCHAR), 'N/A') AS world_x, coalesce(CAST({R('y', 2)} AS VARCHAR), 'N/A') AS world_y,
    coalesce(CAST({R('z', 2)} AS VARCHAR), 'N/A') AS world_z, recommended_action AS rationale FROM pe""",
)
def _(v):
    ranked = rescue.score_people(people(v)).withColumns(
        {
            "victim_id": F.col("track_id"), "frame_id": F.format_string("frame_%04d.jpg", F.col("frame_idx")),
            "nearest_water_distance_m": F.lit(None).cast("double"),
        }
    )
    folder = shared_folder(v.spark, "priorities")
    sinks.write_priorities(ranked, folder)
    return _csv(v, f"{folder}/rescue_priorities")


@query(
    "a07_write_detections", "obs",
    f"""SELECT CAST(det_id AS VARCHAR) AS detection_id, raw_class AS class_name, CAST(conf AS VARCHAR) AS confidence, CAST(frame_idx AS VARCHAR) AS frame_idx, CAST(CAST(x1 AS DOUBLE) AS VARCHAR) AS bbox_x1, CAST(CAST(y1 AS DOUBLE) AS VARCHAR) AS bbox_y1,
    CAST(CAST(x2 AS DOUBLE) AS VARCHAR) AS bbox_x2, CAST(CAST(y2 AS DOUBLE) AS VARCHAR) AS bbox_y2, coalesce(CAST({R('x', 3)} AS VARCHAR), 'N/A') AS world_x, coalesce(CAST({R('y', 3)} AS VARCHAR), 'N/A') AS world_y,
    coalesce(CAST({R('z', 3)} AS VARCHAR), 'N/A') AS world_z, CASE WHEN slot > 6 THEN 'true' ELSE 'false' END AS is_tiled FROM obs""",
)
def _(v):
    rows = v.obs.withColumns(
        {"class_name": F.col("raw_class"), "tile_id": F.when(F.col("slot") > 6, F.concat(F.lit("tile_"), F.col("slot").cast("string")))}
    )
    folder = shared_folder(v.spark, "objects")
    sinks.write_detections(rows, folder)
    return _csv(v, f"{folder}/detected_objects")


PT = """kept AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY point_id) AS id FROM pts)"""


@query(
    "a09_write_colmap_text", "pts cam",
    f"""{PT}, w AS (SELECT *, sqrt(1e0 + r00 + r11 + r22) / 2e0 AS w, row_number() OVER (PARTITION BY mission_id ORDER BY frame_idx) AS id FROM cam)
    SELECT 'points3D' AS part, scene_id AS scene, id || ' ' || {FX('x', 6)} || ' ' || {FX('y', 6)} || ' ' || {FX('z', 6)} || ' ' || CAST(floor(least(255e0, red * 255e0)) AS BIGINT) || ' ' || CAST(floor(least(255e0, grn * 255e0)) AS BIGINT)
      || ' ' || CAST(floor(least(255e0, blu * 255e0)) AS BIGINT) || ' 0.5' AS value FROM kept
    UNION ALL SELECT 'cameras', mission_id, id || ' PINHOLE 392 392 300.0 300.0 196.0 196.0' FROM w""",
)
def _(v):
    folder = shared_folder(v.spark, "text")
    sinks.write_colmap_text(v.pts, v.cam, folder)

    def part(name: str, key: str) -> DataFrame:
        rows = v.spark.read.schema(f"value string, {key} long").text(f"{folder}/{name}")
        return rows.select(F.lit(name).alias("part"), F.col(key).alias("scene"), "value")

    return part("points3D", "scene_id").unionByName(part("cameras", "mission_id"))


@query(
    "a11_write_poses", "cam",
    f"SELECT mission_id, frame_idx, [{R(CENTRE[0], 3)}, {R(CENTRE[1], 3)}, {R(CENTRE[2], 3)}] AS position FROM cam",
)
def _(v):
    folder = shared_folder(v.spark, "poses")
    sinks.write_poses(v.cam, folder)
    return v.spark.read.schema("frame_idx long, position array<double>, mission_id long").json(folder).select("mission_id", "frame_idx", "position")


# ------------------------------------------------------------------ streams


def _event_stream(v) -> DataFrame:
    schema = v.table("events").schema
    stream = v.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(v.folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _drain(v, stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all present input into a folder and read it back."""
    folder = shared_folder(v.spark, "stream")

    def store(batch: DataFrame, number: int) -> None:
        target = f"{folder}/out" if mode == "complete" else f"{folder}/out/batch={number}"
        batch.write.mode("overwrite").parquet(target)

    run = stream.writeStream.outputMode(mode).foreachBatch(store).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return v.spark.read.schema(stream.schema).parquet(f"{folder}/out")


CLS = "CASE event_type WHEN 'view' THEN 'person' WHEN 'click' THEN 'vehicle' WHEN 'error' THEN 'vehicle' WHEN 'purchase' THEN 'boat' ELSE 'building' END"


def _streamed_detections(v) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for x in ("view", "person", "click", "car", "error", "truck", "purchase", "boat", "signup", "building")])
    return _event_stream(v).select(
        "ts", F.floor(F.col("event_id") / 500).alias("mission_id"), F.element_at(kinds, F.col("event_type")).alias("raw_class"),
        (((F.col("event_id") * 7919) % 1000).cast("double") / 1000.0).alias("conf"), F.col("user_id").alias("source"),
    )


@query(
    "d05_class_rollup_stream",
    sql=f"""SELECT CAST(time_bucket(INTERVAL '6 hours', ts) AS VARCHAR) AS window_start, CAST(floor(event_id / 500) AS BIGINT) AS mission_id, {CLS} AS cls, count(*) AS n,
    {RS('avg(((event_id * 7919) % 1000) / 1000e0)', 4)} AS mean_conf, max(((event_id * 7919) % 1000) / 1000e0) AS max_conf FROM events GROUP BY 1, 2, 3""",
)
def _(v):
    out = _drain(v, rollup.class_rollup(_streamed_detections(v), "6 hours"))
    return out.withColumns(
        {"mean_conf": half_even(half_even(F.col("mean_conf"), 9), 4), "window_start": F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")}
    )


@query(
    "d05_flood_rollup_stream",
    sql="""WITH f AS (SELECT ts, CAST(floor(event_id / 500) AS BIGINT) AS mission_id, (event_id % 40) / 100e0 AS r FROM events)
    SELECT CAST(time_bucket(INTERVAL '6 hours', ts) AS VARCHAR) AS window_start, mission_id, max(r) AS max_ratio, count(*) FILTER (r > 0.3e0) AS validated_frames, count(*) FILTER (r > 0.1e0 AND r <= 0.3e0) AS potential_frames FROM f GROUP BY 1, 2""",
)
def _(v):
    ratio = F.col("water_ratio")
    flood = _event_stream(v).select(
        "ts", F.floor(F.col("event_id") / 500).alias("mission_id"), ((F.col("event_id") % 40) / 100.0).alias("water_ratio")
    ).withColumn(
        "water_state", F.when(ratio > 0.3, F.lit("VALIDATED_INUNDATION")).when(ratio > 0.1, F.lit("POTENTIAL_INUNDATION")).otherwise(F.lit("NO_WATER"))
    )
    out = _drain(v, rollup.flood_rollup_stream(flood, "6 hours"))
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query(
    "d05_mission_sessions_stream",
    sql="""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL '3 hours' THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id AS source, CAST(min(ts) AS VARCHAR) AS started, count(*) AS n FROM s GROUP BY user_id, k""",
)
def _(v):
    out = _drain(v, rollup.mission_sessions(_streamed_detections(v), "3 hours"))
    started = F.date_format("started", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return out.select("source", F.regexp_replace(F.regexp_replace(started, "0+$", ""), r"\.$", "").alias("started"), "n")


@query("d03_track_stream", "det", f"{TRACKED} SELECT mission_id, frame_idx, m.det AS det_id, m.id AS track_id, m.len AS track_length FROM trk1")
def _(v):
    """The event table replayed as a stream; a closing row moves the watermark on."""
    rows = trackable(v).join(v.table("events").select(F.col("event_id").alias("det_id"), F.col("ts").cast("timestamp").alias("ts")), "det_id").select(
        "mission_id", "frame_idx", "det_id", "conf", "class_name", "x1", "y1", "x2", "y2", "cx", "cy", "ts"
    )
    folder = shared_folder(v.spark, "replay")
    rows.write.parquet(f"{folder}/a")
    last = v.spark.read.parquet(f"{folder}/a").agg(F.max("ts").alias("ts"))
    closing = last.select((F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"), F.lit(-1).cast("long").alias("mission_id"))
    v.spark.read.parquet(f"{folder}/a").limit(0).unionByName(closing, allowMissingColumns=True).coalesce(1).write.parquet(f"{folder}/b")
    stream = v.spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(folder)
    return _drain(v, tracker.track_stream(stream, "0 seconds"), "append").drop("batch")


@query("d04_incident_stream", "inc", f"RECURSIVE {MERGE_A} SELECT * EXCLUDE (k), printf('INC-%03d', k) AS incident_id FROM res")
def _(v):
    folder = shared_folder(v.spark, "reports")
    reports = v.inc.drop("rescue_priority")
    reports.repartition(3, "frame_idx").write.parquet(f"{folder}/in")
    source = v.spark.readStream.schema(reports.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    stream_incidents.incident_stream(source, folder, f"{folder}/state").awaitTermination()
    return stream_incidents.read_incidents(v.spark, folder)
