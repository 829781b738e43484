"""Incidents: builders, merging of repeated observations, upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.functions.numeric import fixed, half_even, norm
from skysift.lineage import cut, is_empty
from skysift.operators import merging
from skysift.operators.ordering import BLOCK, numbered
from skysift.operators.spatial import cells, components, radius_pairs_once, ring
from skysift.sources.versioned import latest

GROUP_LIMIT = 20_000


def near_incidents(inc: DataFrame, radius: float = 2.0) -> DataFrame:
    """Pairs of localised incidents of one type closer than ``radius``."""
    placed = inc.filter(F.col("x").isNotNull()).withColumn(
        "site", F.concat_ws("|", F.col("mission_id").cast("string"), "type")
    )
    return radius_pairs_once(placed, radius, "site", "seq")


def merge_frames(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def union_incidents(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def _split(inc: DataFrame, radius: float, link: Column, limit: int) -> DataFrame:
    """Cut large (mission, type) groups into parts that can never merge.

    Two reports can only meet over a shared ``link`` (track or object) or a chain
    of occupied grid cells; the components of that graph are independent.  Cells
    are adjacent when they touch, so no pair of reports is ever formed.
    """
    group = ["mission_id", "type"]
    # Always zero, but no literal: a literal key would be optimised out of the grouping
    # and the fold would lose its partitioning.
    whole = F.col("seq") - F.col("seq")
    hot = inc.groupBy(*group).count().filter(F.col("count") > limit).select(*group)
    if is_empty(hot):
        return inc.withColumn("_part", whole)
    hot = cut(hot)
    rest = inc.join(hot, group, "left_anti").withColumn("_part", whole)
    names = ["_gx", "_gy", "_gz"]
    placed = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()
    big = cells(inc.join(hot, group, "left_semi"), radius, ["x", "y", "z"], names)
    big = cut(
        big.withColumns(
            {
                "_cell": F.when(placed, F.xxhash64(F.lit("cell"), *names)),
                "_tie": F.when(link.isNotNull(), F.xxhash64(F.lit("link"), link.cast("string"))),
            }
        )
    )
    occupied = big.filter(F.col("_cell").isNotNull()).select(*group, *names, F.col("_cell").alias("b")).distinct()
    around = ring(occupied.withColumnRenamed("b", "a"), names)
    adjacent = around.join(occupied, [*group, *names]).select(*group, "a", "b")
    linked = big.filter(F.col("_cell").isNotNull() & F.col("_tie").isNotNull()).select(
        *group, F.col("_cell").alias("a"), F.col("_tie").alias("b")
    ).distinct()
    anchor = F.coalesce("_cell", "_tie", F.xxhash64(F.lit("alone"), "seq"))
    anchored = big.withColumn("v", anchor)
    labels = components(anchored.select(*group, "v").distinct(), adjacent.unionByName(linked), group)
    return rest.unionByName(
        anchored.join(labels, [*group, "v"]).withColumn("_part", F.col("label")).select(*rest.columns)
    )


def _merged(inc: DataFrame, link: Column, radius: float, rule: type[merging.MergeWalk], limit: int) -> DataFrame:
    parts = _split(inc.withColumn("_link", link.cast("string")), radius, F.col("_link"), limit)
    # Both uses of the walk's answers read one written copy.
    return merging.collected(cut(merging.walk(parts, F.col("_link"), radius, rule, ["_part"])))


def _numbered_ids(merged: DataFrame, pattern: str) -> DataFrame:
    placed = numbered(
        merged, ["mission_id"], F.floor(F.col("frame") / BLOCK), [F.col("frame"), F.col("seq")], "_n"
    )
    return placed.withColumn("incident_id", F.format_string(pattern, F.col("_n"))).drop("_n")


def merge_incidents(inc: DataFrame, radius: float = 2.0, limit: int = GROUP_LIMIT) -> DataFrame:
    """Merge by track and type, else by place; ids ``INC-nnn`` in order of arrival.

    A track match unites the frames, keeps the higher confidence and fills a
    missing location; a place match only unites the frames.
    """
    return finish(_merged(inc, F.col("track_id"), radius, merging.ByTrack, limit), "INC-%03d")


def merge_incidents_boost(inc: DataFrame, radius: float = 3.0, limit: int = GROUP_LIMIT) -> DataFrame:
    """Merge by object or place, first match; repeated sight raises confidence.

    The location moves to a report that is nearly as sure as the incident; ids
    ``INCIDENT_nnn``.
    """
    link = F.when(F.col("object_id") != "N/A", F.col("object_id"))
    return finish(_merged(inc, link, radius, merging.Boosting, limit), "INCIDENT_%03d")


def finish(merged: DataFrame, pattern: str) -> DataFrame:
    """Numbered incidents from the rows of a walk (``merging.collected``)."""
    placed = F.col("x").isNotNull()
    return _numbered_ids(merged, pattern).select(
        "mission_id", "incident_id", "type", F.col("seq").alias("first_seq"), F.col("link").alias("linked_to"),
        F.col("frames").alias("frame_ids"), F.col("n").alias("observation_count"), F.col("conf").alias("confidence"), "x", "y", "z",
        F.when(placed, F.lit("LOCALIZED_3D")).otherwise(F.lit("UNAVAILABLE")).alias("location_status"),
        F.col("err").alias("reprojection_error_px"),
    )


# Defaults of the canonical incident record.
DEFAULTS = {
    "severity": "MEDIUM",
    "evidence": "No evidence summary provided.",
    "flood_context": "NONE",
    "rescue_priority": "LOW",
    "validation_status": "VALIDATED",
}


def normalize_incidents(merged: DataFrame, reports: DataFrame) -> DataFrame:
    """Merged incidents with severity, texts and states of the founding report, or their defaults."""
    present = [c for c in DEFAULTS if c in reports.columns]
    first = reports.select("mission_id", F.col("seq").alias("first_seq"), *present)
    joined = merged.join(first, ["mission_id", "first_seq"], "left")
    return joined.withColumns(
        {c: F.coalesce(F.col(c), F.lit(d)) if c in present else F.lit(d) for c, d in DEFAULTS.items()}
    )


def canonical_records(merged: DataFrame, reports: DataFrame) -> DataFrame:
    """The canonical record of each merged incident: twenty fields and the mission.

    Confidence, frames and location come from the merge, all else from the founding report where it has the column and a
    value.  ``summary`` stands for ``evidence`` and ``flood_status`` for ``flood_context`` where only one of the two is
    known.  ``location_status`` tells whether the founding report was placed; ``location_3d`` may be filled later.
    """
    kinds = {
        "severity": "string", "summary": "string", "evidence": "string", "track_id": "long", "source_frame_id": "string",
        "bbox_2d": "array<long>", "flood_context": "string", "flood_status": "string", "isolation_score": "double",
        "rescue_priority": "string", "validation_status": "string",
    }
    has = lambda name: name in reports.columns
    facts = [(F.col(c) if has(c) else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()]
    placed = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()
    first = reports.select("mission_id", F.col("seq").alias("first_seq"), F.col("frame_idx").alias("_frame"), placed.alias("_placed"), *facts)
    joined = merged.join(first, ["mission_id", "first_seq"], "left")
    text = F.coalesce("summary", "evidence", F.lit(DEFAULTS["evidence"]))
    image = F.concat(F.lit("frame_"), F.format_string("%04d", "_frame"), F.lit(".jpg"))
    known = lambda c: F.coalesce(F.col(c), F.lit(DEFAULTS[c]))
    return joined.select(
        "mission_id", F.col("incident_id").alias("id"), "incident_id", "type", F.col("type").alias("incident_type"),
        known("severity").alias("severity"), "confidence", text.alias("evidence"), text.alias("summary"), "track_id", "frame_ids",
        F.coalesce("source_frame_id", image).alias("source_frame_id"),
        F.coalesce("bbox_2d", F.array(*[F.lit(0).cast("long")] * 4)).alias("bbox_2d"),
        F.struct("x", "y", "z", F.col("location_status").alias("status")).alias("location_3d"),
        F.when(F.col("_placed"), F.lit("LOCALIZED")).otherwise(F.lit("UNLOCALIZED")).alias("location_status"),
        "reprojection_error_px",
        F.coalesce("flood_context", "flood_status", F.lit(DEFAULTS["flood_context"])).alias("flood_context"),
        F.coalesce("flood_status", "flood_context", F.lit(DEFAULTS["flood_context"])).alias("flood_status"),
        half_even(F.coalesce("isolation_score", F.lit(0.0)), 2).alias("isolation_score"),
        known("rescue_priority").alias("rescue_priority"), known("validation_status").alias("validation_status"),
    )


def upsert_incidents(existing: DataFrame, batch: DataFrame, key: str = "incident_id") -> DataFrame:
    """Latest row per key over a table and a batch; ``VersionedTable.upsert`` does the same for a stored table."""
    return latest(existing, batch, key)


# ------------------------------------------------------------------ builders


def flood_incidents(flood: DataFrame, centroid_points: DataFrame) -> DataFrame:
    """Incident of each flooded frame, placed where the water centroid hits the point map.

    ``centroid_points`` has the point map value at the centroid of the frame.
    """
    ratio = F.col("water_ratio")
    near_zero = norm(F.col("px"), F.col("py"), F.col("pz")) <= 1e-8
    placed = F.col("px").isNotNull() & ~near_zero
    joined = flood.join(centroid_points, ["mission_id", "frame_idx"], "left")
    return joined.select(
        "mission_id", "frame_idx", F.lit("FLOOD_ZONE").alias("type"),
        F.when(ratio > 0.30, F.lit("CRITICAL")).otherwise(F.lit("HIGH")).alias("severity"),
        F.lit(0.90).alias("confidence"),
        *[F.when(placed, half_even(F.col(f"p{c}"), 2)).alias(c) for c in "xyz"],
        F.when(placed, F.lit("LOCALIZED_3D")).otherwise(F.lit("UNAVAILABLE")).alias("location_status"),
        F.col("water_state").alias("flood_context"),
        F.concat(F.lit("Inundation confirmed with "), fixed(ratio * 100.0, 1), F.lit("% water surface coverage.")).alias("evidence"),
    )


def centroid_points(mask: DataFrame, points: DataFrame, image: tuple[int, int], grid: tuple[int, int]) -> DataFrame:
    """Point map value under the water centroid of each frame; sizes are (rows, columns)."""
    centre = mask.filter("is_water").groupBy("mission_id", "frame_idx").agg(
        F.floor(F.avg("r")).alias("_my"), F.floor(F.avg("c")).alias("_mx")
    )
    inside = lambda v, n: F.least(F.lit(n - 1), F.greatest(F.lit(0), v)).cast("long")
    spot = centre.select(
        "mission_id", "frame_idx",
        inside(F.floor(F.col("_my") * grid[0] / image[0]), grid[0]).alias("r"),
        inside(F.floor(F.col("_mx") * grid[1] / image[1]), grid[1]).alias("c"),
    )
    return spot.join(points, ["mission_id", "frame_idx", "r", "c"]).select("mission_id", "frame_idx", "px", "py", "pz")


def victim_incidents(people: DataFrame) -> DataFrame:
    """Incident of each triaged person; type from isolation, severity from priority."""
    kind, priority = F.col("isolation_type"), F.col("rescue_priority")
    placed = F.col("x").isNotNull()
    return people.select(
        "mission_id", "frame_idx", "det_id", "track_id",
        F.when(kind.contains("STRANDED"), F.lit("STRANDED_PERSON")).when(kind.contains("ISOLATED"), F.lit("ISOLATED_PERSON")).otherwise(F.lit("PERSON_IN_DISTRESS")).alias("type"),
        F.when(priority == "HIGH", F.lit("CRITICAL")).when(priority == "MEDIUM", F.lit("HIGH")).otherwise(F.lit("LOW")).alias("severity"),
        F.lit(0.88).alias("confidence"),
        *[half_even(F.col(c), 2).alias(c) for c in "xyz"],
        F.when(placed, F.lit("LOCALIZED_3D")).otherwise(F.lit("UNAVAILABLE")).alias("location_status"),
        kind.alias("flood_context"), F.col("recommended_action").alias("evidence"),
    )


def vehicle_incidents(vehicles: DataFrame) -> DataFrame:
    """Incident of each certain vehicle; uncertain objects never become one."""
    state = F.col("water_state")
    flooded = state.contains("INUNDATION")
    placed = F.col("x").isNotNull()
    return vehicles.filter(~F.upper("final_class").contains("UNCERTAIN")).select(
        "mission_id", "frame_idx", "det_id", "track_id",
        F.when(flooded, F.lit("VEHICLE_IN_FLOOD")).otherwise(F.lit("VEHICLE_DETECTED")).alias("type"),
        F.when(flooded, F.lit("HIGH")).otherwise(F.lit("LOW")).alias("severity"),
        half_even(F.col("validation_conf"), 2).alias("confidence"),
        *[half_even(F.col(c), 2).alias(c) for c in "xyz"],
        F.when(placed, F.lit("LOCALIZED_3D")).otherwise(F.lit("UNAVAILABLE")).alias("location_status"),
        state.alias("flood_context"),
        F.concat(F.lit("Vehicle located in aerial frame ("), state, F.lit(").")).alias("evidence"),
    )


def object_incidents(detections: DataFrame, hazards: DataFrame, damage: DataFrame) -> DataFrame:
    """Incidents of persons and flooded structures, given the hazards of their frame.

    Reads ``class_name, conf, water_overlap`` of each detection.
    """
    frame = ["mission_id", "frame_idx"]
    danger = hazards.select(*frame, (F.col("incident_type") == "FLOOD_ZONE").alias("wet")).unionByName(
        damage.select(*frame, F.lit(False).alias("wet"))
    ).groupBy(*frame).agg(F.bool_or("wet").alias("flooded"), F.lit(True).alias("active"))
    joined = detections.join(danger, frame, "left").na.fill(False, ["flooded", "active"])
    active, frame_no = F.col("active"), F.col("frame_idx").cast("string")
    person = F.col("class_name") == "person"
    structure = F.col("class_name").isin("building", "structure") & F.col("flooded") & (F.col("water_overlap") > 0.02)
    return joined.filter(person | structure).select(
        *frame, "det_id",
        F.when(person & active, F.lit("VICTIM_PERSON_DETECTED")).when(person, F.lit("PERSON_DETECTED")).otherwise(F.lit("FLOODED_STRUCTURE")).alias("type"),
        F.when(person & active, F.lit("CRITICAL")).when(person, F.lit("LOW")).otherwise(F.lit("HIGH")).alias("severity"),
        F.col("conf").alias("confidence"),
        F.when(person & active, F.concat(F.lit("Person / potential victim located in active disaster zone (frame "), frame_no, F.lit(").")))
        .when(person, F.concat(F.lit("Civilian person observed during aerial monitoring (frame "), frame_no, F.lit(").")))
        .otherwise(F.concat(F.lit("Flooded structure inundated by water ("), fixed(F.col("water_overlap") * 100.0, 1), F.lit("% water contact) in aerial frame "), frame_no, F.lit(".")))
        .alias("evidence"),
    )


def incident_rows(inc: DataFrame) -> DataFrame:
    """Flat display row of each incident."""
    placed = (F.col("location_status") == "LOCALIZED_3D") & F.col("x").isNotNull()
    err = F.col("reprojection_error_px")
    suffix = F.when(err.isNotNull(), F.concat(F.lit(" ("), err.cast("string"), F.lit("px)"))).otherwise(F.lit(""))
    where = F.concat(F.lit("X:"), fixed(F.col("x"), 2), F.lit(", Y:"), fixed(F.col("y"), 2), F.lit(", Z:"), fixed(F.col("z"), 2), suffix)
    return inc.select(
        "mission_id", "incident_id", "type", "severity", fixed(F.col("confidence"), 2).alias("confidence"),
        F.when(F.col("linked_to").isNotNull(), F.concat(F.lit("TRK-"), F.col("linked_to"))).otherwise(F.lit("N/A")).alias("track"),
        F.when(placed, where).otherwise(F.lit("UNAVAILABLE")).alias("location"),
        "flood_context", "rescue_priority", "validation_status",
        F.concat(F.lit("Frames ["), F.array_join(F.transform("frame_ids", lambda f: f.cast("string")), ", "), F.lit("]")).alias("frames"),
    )
