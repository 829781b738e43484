"""Roll-ups and audits over the operator outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysift.functions.numeric import half_even


def class_counts(validated: DataFrame, temporal: DataFrame) -> DataFrame:
    """Validated objects per class and class switches, per mission."""
    names = {
        "people": "PERSON",
        "vehicles": "VEHICLE",
        "buildings": "BUILDING",
        "boats": "BOAT",
        "uncertain": "UNCERTAIN_OBJECT",
    }
    counts = validated.groupBy("mission_id").agg(
        *[F.count_if(F.col("final_class") == cls).alias(name) for name, cls in names.items()]
    )
    switches = temporal.groupBy("mission_id").agg(F.sum("switch_count").alias("switches"))
    return counts.join(switches, "mission_id")


def funnel(stages: list[tuple[str, DataFrame, str | None]]) -> DataFrame:
    """Rows (or distinct values of a column) per mission and stage, in stage order."""
    out = None
    for number, (name, rows, distinct) in enumerate(stages, start=1):
        size = F.count(F.lit(1)) if distinct is None else F.count_distinct(F.col(distinct))
        part = rows.groupBy("mission_id").agg(size.alias("n")).select(
            "mission_id", F.lit(number).alias("stage_no"), F.lit(name).alias("stage"), "n"
        )
        out = part if out is None else out.unionByName(part)
    return out


def person_funnel(
    raw: DataFrame, gated: DataFrame, kept: DataFrame, validated: DataFrame, targets: DataFrame
) -> DataFrame:
    """How many persons survive each stage from detection to rescue target."""
    certain = validated.filter(F.col("final_class") == "PERSON")
    state, error = F.col("detection_state"), F.col("reprojection_error_px")
    return funnel(
        [
            ("raw", raw, None),
            ("confidence", gated, None),
            ("suppression", kept, None),
            ("tracks", kept, "track_id"),
            ("validated", certain, None),
            ("uncertain", validated.filter(F.col("final_class") != "PERSON"), None),
            ("fused", targets, None),
            ("localized", targets.filter(F.col("localization_status") == "LOCALIZED_3D"), None),
            ("reprojection_valid", targets.filter(error <= 25.0), None),
            ("stranded", targets.filter(state == "POTENTIAL STRANDED PERSON"), None),
            ("rescue", targets.filter(state == "VALIDATED RESCUE TARGET"), None),
        ]
    )


def track_audit(person: DataFrame) -> DataFrame:
    """Frames, 3D candidates and reprojections of each person track."""
    err = F.col("reprojection_error_px")
    return person.groupBy("mission_id", "track_id").agg(
        F.count(F.lit(1)).alias("observations"),
        F.sort_array(F.collect_set("frame_idx")).alias("frames"),
        F.count_if(F.col("x").isNotNull()).alias("candidates"),
        F.count_if(err <= 25.0).alias("valid"),
        F.count(err).alias("reprojections"),
        half_even(F.min(err), 4).alias("best_error"),
        half_even(half_even(F.avg(err), 9), 4).alias("mean_error"),
    )


def frame_audit(raw: DataFrame, kept: DataFrame, validated: DataFrame) -> DataFrame:
    """Persons per frame before and after suppression and validation, with tracks."""
    keys = ["mission_id", "frame_idx"]
    before = raw.groupBy(*keys).agg(F.count(F.lit(1)).alias("raw_person"))
    after = kept.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("after_nms"), F.sort_array(F.collect_set("track_id")).alias("tracks")
    )
    sure = validated.groupBy(*keys).agg(F.count_if(F.col("final_class") == "PERSON").alias("validated_person"))
    joined = before.join(after, keys, "left").join(sure, keys, "left").na.fill(0, ["after_nms", "validated_person"])
    densest = joined.groupBy("mission_id").agg(
        F.max_by("frame_idx", F.struct(F.col("after_nms"), -F.col("frame_idx"))).alias("_top")
    )
    return joined.join(densest, "mission_id").withColumn("is_densest", F.col("frame_idx") == F.col("_top")).drop("_top")


def pipeline_status(counts: DataFrame) -> DataFrame:
    """Status of the stages of each mission from its counts.

    Reads ``frames, localized, valid_reprojections, targets, flood_frames``.
    """

    def status(ok: str, partial: str | None) -> object:
        good = F.when(F.col(ok) > 0, F.lit("SUCCESS"))
        if partial is None:
            return good.otherwise(F.lit("FAILED"))
        return good.when(F.col(partial) > 0, F.lit("PARTIAL")).otherwise(F.lit("FAILED"))

    stages = F.array(
        F.struct(F.lit("FRAMES").alias("stage"), status("frames", None).alias("status")),
        F.struct(F.lit("2D-3D").alias("stage"), status("localized", "frames").alias("status")),
        F.struct(F.lit("REPROJECTION").alias("stage"), status("valid_reprojections", "localized").alias("status")),
        F.struct(F.lit("TRACKING").alias("stage"), status("targets", "frames").alias("status")),
        F.struct(F.lit("FLOOD").alias("stage"), status("flood_frames", None).alias("status")),
    )
    return counts.select("mission_id", F.explode(stages).alias("s")).select("mission_id", "s.*")


def report_summary(frames: DataFrame, selected: DataFrame, detections: DataFrame, risk: DataFrame) -> DataFrame:
    """Headline figures of each mission."""
    total = frames.groupBy("mission_id").agg(F.count(F.lit(1)).alias("frames"))
    chosen = selected.groupBy("mission_id").agg(F.count(F.lit(1)).alias("selected_frames"))
    objects = detections.groupBy("mission_id").agg(
        F.count_if(F.col("final_class") == "PERSON").alias("people"),
        F.count_if(F.col("final_class").isin("VEHICLE", "BOAT")).alias("vehicles"),
    )
    joined = total.join(chosen, "mission_id", "left").join(objects, "mission_id", "left").join(
        risk.select("mission_id", "risk_level", "risk_score"), "mission_id", "left"
    )
    return joined.na.fill(0, ["selected_frames", "people", "vehicles"])
