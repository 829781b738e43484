"""People: fusion of observations, rescue priority, triage, scene risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.functions.numeric import clip, fixed, half_even, is_finite, norm, settled
from skysift.lineage import cut
from skysift.operators.ordering import BLOCK, numbered, top_rows

TARGET = ["mission_id", "track_key"]

# Order of the detection states and of the priorities.
STATES = (
    "VALIDATED RESCUE TARGET",
    "POTENTIAL STRANDED PERSON",
    "PERSON REPROJECTION VALID",
    "PERSON 3D LOCALIZED",
    "PERSON 3D CANDIDATE",
    "PERSON CONTEXTUALIZED",
    "PERSON TRACKED",
    "PERSON DETECTED",
)
PRIORITIES = ("HIGH", "MEDIUM", "LOW")


def _place(value: Column, names: tuple[str, ...]) -> Column:
    """Position of a name in a fixed order, after the last when unknown."""
    at = F.array_position(F.array(*[F.lit(n) for n in names]), value)
    return F.when(at > 0, at - 1).otherwise(F.lit(len(names)))


# ----------------------------------------------------------------- priority


def rescue_priority(
    classification: Column, isolation: Column, flood_pct: Column, elevated: Column,
    conf: Column, localized: Column, error: Column, observations: Column,
) -> dict[str, Column]:
    """Priority of one person with its score, action and explanation."""
    quality = (
        F.when(localized & error.isNotNull(), F.greatest(F.lit(0.20), 1.0 - error / 40.0))
        .when(localized, F.lit(0.85))
        .otherwise(F.lit(0.30))
    )
    seen = F.least(F.lit(1.0), 0.60 + observations * 0.10)
    score = settled(0.35 * isolation + 0.25 * (flood_pct / 100.0) + 0.15 * conf + 0.15 * quality + 0.10 * seen, 3)
    high = (
        (classification == "POTENTIAL_STRANDED_PERSON")
        | ((score >= 0.55) & (flood_pct > 20.0))
        | ((flood_pct > 40.0) & elevated)
    )
    medium = (
        (classification == "POTENTIAL_ISOLATED_PERSON") | ((score >= 0.40) & (flood_pct > 10.0)) | (flood_pct > 15.0)
    )
    # The action texts of the priorities.
    priority = F.when(high, F.lit("HIGH")).when(medium, F.lit("MEDIUM")).otherwise(F.lit("LOW"))
    return {
        "rescue_priority": priority,
        "rescue_score": score,
        "recommended_action": F.when(high, F.lit("Urgent aerial/boat rescue required. Target is stranded/isolated by floodwater."))
        .when(medium, F.lit("Prioritize monitoring and prepare evacuation route. Person in proximity to advancing water."))
        .otherwise(F.lit("Routine monitoring. Person is located on accessible dry ground.")),
        "priority_explanation": F.concat(
            F.lit("Priority "), priority, F.lit(" (Score: "), fixed(score, 2), F.lit(") | Detection Conf: "), fixed(half_even(conf, 9), 2),
            F.lit(" | Isolation: "), fixed(half_even(isolation, 9), 2), F.lit(" | Surrounding Flood: "),
            fixed(half_even(flood_pct, 9), 0), F.lit("% | 3D Status: "), F.when(localized, F.lit("LOCALIZED_3D")).otherwise(F.lit("UNLOCALIZED")),
        ),
    }


# ------------------------------------------------------------------- fusion


def fuse_tracks(person: DataFrame) -> DataFrame:
    """One rescue target per person track, from all its observations.

    Reads ``track_id, frame_idx, det_id, conf, box, u, v, x, y, z,
    reprojection_error_px`` and the surroundings of each observation.
    """
    key = F.coalesce(
        F.col("track_id").cast("string"), F.col("det_id").cast("string"),
        F.concat(F.lit("UNTRACKED_"), F.col("frame_idx").cast("string")),
    )
    err, at = F.col("reprojection_error_px"), F.struct("frame_idx", "det_id")
    placed = is_finite(F.col("x"), F.col("y"), F.col("z"))
    seen_err = F.when(placed, err)
    good = placed & (err <= 25.0)
    point = F.struct("x", "y", "z")
    flood, iso = F.col("surrounding_flood_pct"), F.col("isolation_score")
    best = F.struct(F.col("conf"), -F.col("frame_idx"), -F.col("det_id"))
    fused = person.withColumn("track_key", key).groupBy(*TARGET).agg(
        F.count(F.lit(1)).alias("observation_count"),
        F.avg("conf").alias("_mean"), F.max("conf").alias("_max"),
        F.sort_array(F.collect_set("frame_idx")).alias("source_frames"),
        F.min("frame_idx").alias("_f1"), F.max("frame_idx").alias("_f2"), F.min(at).alias("_first"),
        F.count_if(placed).alias("num_3d_candidates"),
        F.count_if(good).alias("num_valid_reprojections"),
        F.min(seen_err).alias("_best"), F.avg(seen_err).alias("_avg"), F.avg(F.when(good, err)).alias("_avg_good"),
        F.min_by(F.when(good, point), F.when(good, F.struct(err, at))).alias("_p_good"),
        F.min_by(F.when(placed, point), F.when(placed, at)).alias("_p_any"),
        *[F.stddev_pop(F.when(placed, F.col(c))).alias(f"_s{c}") for c in "xyz"],
        F.avg(flood).alias("_flood"), F.stddev_pop(flood).alias("_flood_sd"), F.avg(iso).alias("_iso"),
        F.mode("elevation_context", True).alias("elevation_context"),
        F.mode("flood_proximity", True).alias("flood_proximity"),
        F.max_by(F.struct("x1", "y1", "x2", "y2", "u", "v"), best).alias("_box"),
    )
    n, valid, cand = (F.col(c) for c in ("observation_count", "num_valid_reprojections", "num_3d_candidates"))
    zero = F.struct(*[F.lit(0.0).alias(c) for c in "xyz"])
    spread = F.when(cand >= 2, norm(F.col("_sx"), F.col("_sy"), F.col("_sz"))).otherwise(F.lit(0.0))
    placed_df = fused.withColumns(
        {
            "localization_status": F.when(valid > 0, F.lit("LOCALIZED_3D")).when(cand > 0, F.lit("REPROJECT_REJECTED")).otherwise(F.lit("UNLOCALIZED")),
            "_p": F.when(valid > 0, F.col("_p_good")).when(cand > 0, F.col("_p_any")).otherwise(zero),
            "_spread": F.when(cand > 0, spread).otherwise(F.lit(999.0)),
            "_best": half_even(F.col("_best"), 2),
            "_avg": settled(F.col("_avg"), 2),
            "_flood": half_even(F.col("_flood"), 9),
            "_iso": half_even(F.col("_iso"), 9),
            "_mean": half_even(F.col("_mean"), 9),
        }
    )
    local = F.col("localization_status") == "LOCALIZED_3D"
    mean, flood_m, iso_m = F.col("_mean"), F.col("_flood"), F.col("_iso")
    error = F.when(local, F.col("_best")).otherwise(F.col("_avg"))
    stranded = (flood_m > 25.0) | (iso_m > 0.5)
    ranked = rescue_priority(
        F.when(stranded, F.lit("POTENTIAL_STRANDED_PERSON")).otherwise(F.lit("NORMAL_PERSON")), iso_m, flood_m,
        F.col("elevation_context") == "ELEVATED_STRUCTURE", mean, local, error, n,
    )
    # The ladder is read many times below, so it is finished once per target here.
    graded = cut(placed_df.withColumns({"reprojection_error_px": error, "rescue_priority": ranked["rescue_priority"], "rescue_score": ranked["rescue_score"]}))
    priority = F.col("rescue_priority")
    ground = settled(clip(1.0 - iso_m, 0.0, 1.0), 3)
    distress = priority.isin("HIGH", "MEDIUM") | (iso_m > 0.35) | (flood_m > 15.0)
    # The reason texts of the targets.
    reason = (
        F.when(priority == "HIGH", F.concat(
            F.lit("Person observed across "), n.cast("string"), F.lit(" frame(s) on "),
            F.when(F.col("elevation_context").contains("ELEVATED"), F.lit("elevated structure")).otherwise(F.lit("isolated high ground")),
            F.lit(" surrounded by "), fixed(flood_m, 0), F.lit("% floodwater with limited apparent egress.")))
        .when(priority == "MEDIUM", F.concat(
            F.lit("Person detected in proximity to active flood boundary ("), fixed(flood_m, 0), F.lit("% surrounding water, isolation "),
            fixed(iso_m, 2), F.lit("). Evacuation monitoring recommended.")))
        .otherwise(F.concat(
            F.lit("Person located on accessible terrain ("), fixed(ground * 100.0, 0), F.lit("% dry ground egress) with minimal flood hazard.")))
    )
    state = (
        F.when(local & distress, F.lit(STATES[0]))
        .when(distress, F.lit(STATES[1]))
        .when(local, F.lit(STATES[2]))
        .when(cand > 0, F.lit(STATES[3]))
        .when(n > 0, F.lit(STATES[5]))
        .when(n > 1, F.lit(STATES[6]))
        .otherwise(F.lit(STATES[7]))
    )
    named = numbered(graded, ["mission_id"], F.floor(F.col("_f1") / BLOCK), [F.col("_first")], "_idx")
    return named.select(
        *TARGET,
        F.format_string("PERSON #%02d", F.col("_idx")).alias("target_id"),
        half_even(mean, 3).alias("person_confidence"),
        half_even(F.col("_max"), 3).alias("max_confidence"),
        "observation_count", "source_frames",
        half_even(n / F.greatest(F.lit(1), F.col("_f2") - F.col("_f1") + 1), 3).alias("persistence"),
        "num_3d_candidates", "num_valid_reprojections",
        F.col("_best").alias("best_reprojection_error_px"), F.col("_avg").alias("mean_reprojection_error_px"),
        settled(F.col("_avg_good"), 2).alias("mean_valid_reprojection_error_px"),
        "localization_status", "reprojection_error_px",
        *[F.col(f"_p.{c}").alias(c) for c in "xyz"],
        F.when(F.col("_spread") < 100, settled(F.col("_spread"), 3)).alias("dispersion_3d_m"),
        F.when(cand > 0, settled(clip(1.0 - F.col("_spread") / 3.0, 0.1, 1.0), 3)).otherwise(F.lit(0.0)).alias("consistency_3d_score"),
        settled(clip(1.0 - F.when(n > 1, F.col("_flood_sd")).otherwise(F.lit(0.0)) / 50.0, 0.2, 1.0), 3).alias("flood_context_consistency"),
        "flood_proximity", "elevation_context",
        half_even(flood_m / 100.0, 3).alias("surrounding_flood_ratio"),
        half_even(iso_m, 3).alias("isolation_score"),
        ground.alias("accessible_ground_score"),
        F.col("_box.x1").alias("x1"), F.col("_box.y1").alias("y1"), F.col("_box.x2").alias("x2"), F.col("_box.y2").alias("y2"),
        F.col("_box.u").alias("u"), F.col("_box.v").alias("v"),
        "rescue_priority", "rescue_score", state.alias("detection_state"),
        (local & distress).alias("is_validated"), reason.alias("reason"),
    )


def _number(name: str) -> Column:
    """The last number in an id, as a number: #9 stands before #10."""
    return F.nullif(F.regexp_extract(name, r"(\d+)\D*$", 1), F.lit("")).cast("long")


def order_targets(targets: DataFrame) -> DataFrame:
    """Rank of each target in its mission: state, priority, isolation, then the number in its id (first seen first)."""
    state, priority = _place(F.col("detection_state"), STATES), _place(F.col("rescue_priority"), PRIORITIES)
    block = state * 4 + priority
    order = [state, priority, F.col("isolation_score").desc(), _number("target_id"), F.col("target_id")]
    return numbered(targets, ["mission_id"], block, order, "target_rank")


def sanitize_target(targets: DataFrame) -> DataFrame:
    """Unknown priorities become LOW; targets without three coordinates are dropped."""
    known = F.upper(F.col("rescue_priority"))
    fixed_priority = F.when(known.isin(*PRIORITIES), known).otherwise(F.lit("LOW"))
    return targets.filter(F.size("location_3d") == 3).withColumn("rescue_priority", fixed_priority)


def is_rescue_target(targets: DataFrame) -> Column:
    error = F.col("reprojection_error_px")
    flag = F.col("is_validated") if "is_validated" in targets.columns else F.lit(False)
    distress = (
        F.upper("rescue_priority").isin("HIGH", "MEDIUM")
        | (F.col("isolation_score") > 0.35)
        | (F.col("surrounding_flood_ratio") > 0.15)
    )
    proven = error.isNotNull() & (error <= 25.0) & (F.col("localization_status") == "LOCALIZED_3D") & distress
    return F.coalesce(flag, F.lit(False)) | F.coalesce(proven, F.lit(False))


def rescue_targets(targets: DataFrame) -> DataFrame:
    return targets.filter(is_rescue_target(targets))


def unfused_persons(person: DataFrame, targets: DataFrame) -> DataFrame:
    """First observation of every track without a fused target."""
    key = F.coalesce(F.col("track_id").cast("string"), F.col("det_id").cast("string"))
    loose = person.withColumn("track_key", key).join(targets.select(*TARGET), TARGET, "left_anti")
    columns = [c for c in loose.columns if c not in TARGET]
    first = loose.groupBy(*TARGET).agg(F.min_by(F.struct(*columns), F.struct("frame_idx", "det_id")).alias("_o"))
    return first.select(*TARGET, *[F.col("_o")[c].alias(c) for c in columns])


# ------------------------------------------------------------------- triage


def score_people(person: DataFrame) -> DataFrame:
    """Priority of each observed person from its own surroundings."""
    around = F.col("surrounding_flood_pct")
    ranked = rescue_priority(
        F.col("isolation_type"), around / 100.0, around, F.col("elevation_relative_m") > 1.5, F.col("conf"),
        F.col("x").isNotNull(), F.col("reprojection_error_px"), F.lit(1),
    )
    return person.withColumns(ranked).withColumn("priority_score", half_even(F.col("rescue_score") * 100.0, 1))


def rank_by_score(people: DataFrame) -> DataFrame:
    """Place of each person in its mission by falling score, then arrival."""
    block = F.floor(100.0 - F.col("priority_score"))
    order = [F.col("priority_score").desc(), F.col("frame_idx"), F.col("det_id")]
    return numbered(people, ["mission_id"], block, order, "rank")


def rank_priorities(person: DataFrame) -> DataFrame:
    return rank_by_score(cut(score_people(person)))


def representative(seen: DataFrame, keys: list[str]) -> DataFrame:
    """Detections of the highest and the lowest confidence of each key; of equal ones the smaller id."""
    best, worst = F.struct(F.col("conf"), -F.col("det_id")), F.struct("conf", "det_id")
    return seen.groupBy(*keys).agg(F.max_by("det_id", best).alias("best_det"), F.min_by("det_id", worst).alias("worst_det"))


def top_k(people: DataFrame, k: int = 5) -> DataFrame:
    order = [F.col("priority_score").desc(), F.col("frame_idx"), F.col("det_id")]
    return top_rows(people, ["mission_id"], order, k)


# --------------------------------------------------------------- scene risk


def _listed(*items: Column) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def _people(targets: DataFrame) -> DataFrame:
    priority = F.col("rescue_priority")
    return targets.groupBy("mission_id").agg(
        F.count(F.lit(1)).alias("people"), F.count_if(priority == "HIGH").alias("high"), F.count_if(priority == "MEDIUM").alias("medium")
    )


def scene_risk(flood: DataFrame, targets: DataFrame) -> DataFrame:
    """Scene risk from flood states and rescue targets of each mission."""
    state = F.col("water_state")
    water = flood.groupBy("mission_id").agg(
        F.bool_or(state == "VALIDATED_INUNDATION").alias("sure"), F.bool_or(state == "POTENTIAL_INUNDATION").alias("maybe"),
        F.max("water_ratio").alias("ratio"),
    )
    df = water.join(_people(targets), "mission_id", "full").na.fill(0, ["people", "high", "medium"]).na.fill(0.0, ["ratio"])
    df = df.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("sure", "maybe")})
    sure, maybe, high, medium = (F.col(c) for c in ("sure", "maybe", "high", "medium"))
    covered = F.col("ratio") * 100.0
    percent = fixed(covered, 1)
    base = (
        F.when(sure, 45.0 + F.least(F.lit(30.0), covered)).when(maybe, 25.0 + F.least(F.lit(15.0), covered)).otherwise(F.lit(0.0))
        + F.when(high > 0, 25.0 + F.least(F.lit(15.0), high * 5.0)).otherwise(F.lit(0.0))
        + F.when(medium > 0, 10.0 + F.least(F.lit(10.0), medium * 3.0)).otherwise(F.lit(0.0))
    )
    level = (
        F.when((high > 0) & sure, F.lit("CRITICAL"))
        .when(sure | (high > 0), F.lit("HIGH"))
        .when(maybe | (medium > 0), F.lit("MEDIUM"))
        .otherwise(F.lit("LOW / NO DISASTER EVIDENCE"))
    )
    nobody = F.col("people") == 0
    reasons = _listed(
        F.when(sure, F.concat(F.lit("Validated flood inundation confirmed covering "), percent, F.lit("% of aerial scene.")))
        .when(maybe, F.concat(F.lit("Potential flood inundation detected covering "), percent, F.lit("% of scene.")))
        .otherwise(F.lit("No active flood inundation evidence detected across analyzed frames.")),
        F.when(high > 0, F.concat(F.lit("CRITICAL SAR: "), high.cast("string"), F.lit(" potentially stranded person(s) isolated by floodwater."))),
        F.when(medium > 0, F.concat(F.lit("Monitoring: "), medium.cast("string"), F.lit(" person(s) in proximity to active flood boundary."))),
        F.when(nobody, F.lit("Zero persons detected in available aerial frames (continuous optical search active).")),
    )
    actions = _listed(
        F.when(high > 0, F.concat(F.lit("Dispatch rescue team to "), high.cast("string"), F.lit(" high-priority stranded victim location(s)."))),
        F.when(medium > 0, F.concat(F.lit("Establish evacuation route for "), medium.cast("string"), F.lit(" person(s) near flood perimeter."))),
        F.when(nobody & sure, F.lit("Area inundation response active; continue aerial search for potential submerged victims."))
        .when(nobody, F.lit("Routine aerial patrol. No emergency rescue operations required.")),
    )
    return df.withColumn("risk_level", level).select(
        "mission_id", "risk_level",
        F.when(F.col("risk_level").startswith("LOW"), F.lit(0.0)).otherwise(half_even(clip(base, 0.0, 100.0), 1)).alias("risk_score"),
        reasons.alias("risk_reasons"), actions.alias("rescue_priorities"),
    )


def scene_risk_ratio(scenes: DataFrame) -> DataFrame:
    """Scene risk from ``flood_ratio, is_active, people, high`` of each mission."""
    ratio, high = F.col("flood_ratio"), F.col("high") > 0
    flooded, wet = F.col("is_active") | (ratio >= 0.15), ratio >= 0.04
    base = 50.0 + F.least(F.lit(40.0), ratio * 100.0)
    score = (
        F.when(flooded & high, F.least(F.lit(100.0), base + 20.0)).when(flooded, base).when(wet, F.lit(35.0)).otherwise(F.lit(10.0))
    )
    percent = fixed(ratio * 100.0, 1)
    return scenes.select(
        "mission_id",
        F.when(flooded & high, F.lit("CRITICAL")).when(flooded, F.lit("HIGH")).when(wet, F.lit("MEDIUM")).otherwise(F.lit("LOW")).alias("risk_level"),
        half_even(score, 1).alias("risk_score"),
        _listed(
            F.when(flooded, F.concat(F.lit("Validated flood inundation confirmed covering "), percent, F.lit("% of aerial scene.")))
            .when(wet, F.concat(F.lit("Potential flood inundation detected covering "), percent, F.lit("% of scene.")))
            .otherwise(F.lit("Routine aerial monitoring. No active flood inundation evidence detected.")),
            F.when(flooded & high, F.concat(F.lit("CRITICAL SAR: "), F.col("high").cast("string"), F.lit(" stranded victim(s) isolated by floodwaters.")))
            .when(flooded & (F.col("people") == 0), F.lit("Zero persons detected in available aerial frames (continuous optical search active).")),
        ).alias("risk_reasons"),
    )


def hazard_risk(detections: DataFrame, hazards: DataFrame, damage: DataFrame) -> DataFrame:
    """Scene risk by points for people, flood, damage and debris."""
    people = detections.groupBy("mission_id").agg(F.count_if(F.col("class_name") == "person").alias("people"))
    kind = F.col("incident_type")
    found = hazards.groupBy("mission_id").agg(
        F.count(F.lit(1)).alias("hazards"),
        F.max(F.when(kind == "FLOOD_ZONE", F.col("coverage_pct"))).alias("cover"),
        F.count_if(kind == "BLOCKED_ROAD_DEBRIS").alias("debris"),
    )
    broken = damage.groupBy("mission_id").agg(
        F.count(F.lit(1)).alias("damages"), F.count_if(F.col("severity").isin("HIGH", "CRITICAL")).alias("severe")
    )
    df = people.join(found, "mission_id", "left").join(broken, "mission_id", "left").na.fill(0, ["hazards", "debris", "damages", "severe"])
    active = (F.col("hazards") > 0) | (F.col("damages") > 0)
    n = F.col("people")
    life, flood = F.least(F.lit(40.0), n * 20.0), F.when(
        F.col("cover").isNotNull(), F.least(F.lit(50.0), 25.0 + F.col("cover") * 0.6)
    )
    zero = F.lit(0.0)
    score = (
        F.when(active & (n > 0), life).otherwise(zero) + F.coalesce(flood, zero)
        + F.when(F.col("severe") > 0, F.lit(25.0)).otherwise(zero) + F.when(F.col("debris") > 0, F.lit(15.0)).otherwise(zero)
    )
    df = df.withColumns({"_s": F.when(active, score).otherwise(zero), "_a": active})
    s = F.col("_s")
    reasons = _listed(
        F.when((n > 0) & F.col("_a"), F.concat(F.lit("+ "), n.cast("string"), F.lit(" Person(s) detected in active disaster zone (+"), fixed(life, 0), F.lit(" pts)")))
        .when(n > 0, F.concat(F.lit("Information: "), n.cast("string"), F.lit(" Person(s) detected in normal environment (No emergency exposure).")))
        .otherwise(F.lit("No person detected in analyzed drone imagery.")),
        F.when(F.col("cover").isNotNull(), F.concat(F.lit("+ Active flood water coverage detected ("), fixed(F.col("cover"), 1), F.lit("% area) (+"), fixed(flood, 0), F.lit(" pts)"))),
        F.when(F.col("severe") > 0, F.concat(F.lit("+ Visual structural damage / roof disruption detected on "), F.col("severe").cast("string"), F.lit(" building(s) (+25 pts)"))),
        F.when(F.col("debris") > 0, F.lit("+ Ground route obstruction / debris blockage detected (+15 pts)")),
    )
    return df.select(
        "mission_id",
        F.when(~F.col("_a"), F.lit("LOW / NO DISASTER EVIDENCE")).when(s >= 75, F.lit("CRITICAL")).when(s >= 45, F.lit("HIGH")).when(s >= 20, F.lit("MEDIUM")).otherwise(F.lit("LOW")).alias("risk_level"),
        F.least(F.lit(100.0), half_even(s, 1)).alias("risk_score"),
        reasons.alias("risk_reasons"),
    )
