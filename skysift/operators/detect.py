"""Detection rules: class history, physical validation, routing, hard cases."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skysift.config import VEHICLE_CLASSES, ClassRules
from skysift.functions.boxes import bbox_metrics, tiles
from skysift.functions.numeric import fixed, half_even, settled
from skysift.operators.frames import uniform_subsample
from skysift.operators.ordering import BLOCK, previous

TRACK = ["mission_id", "track_id"]

# The categories of exported hard cases.
HARD_CASES = (
    "building_as_vehicle",
    "vehicle_as_building",
    "false_person",
    "false_boat",
    "correct_vehicle",
    "correct_building",
    "correct_person",
    "correct_boat",
)


def history_class(raw: Column) -> Column:
    return F.when(F.lower(raw).isin(*VEHICLE_CLASSES, "vehicle"), F.lit("vehicle")).otherwise(F.lower(raw))


def class_switches(det: DataFrame) -> DataFrame:
    """How often consecutive observations of a track differ in class."""
    seen = det.filter(F.col("track_id").isNotNull()).select(
        *TRACK, "frame_idx", "det_id", history_class(F.col("raw_class")).alias("cls")
    )
    block = F.floor(F.col("frame_idx") / BLOCK)
    ordered = previous(seen, TRACK, ["frame_idx", "det_id"], {"cls": "before"}, block)
    changed = F.col("before").isNotNull() & (F.col("before") != F.col("cls"))
    return ordered.groupBy(*TRACK).agg(F.sum(changed.cast("long")).alias("switch_count"))


def temporal_metrics(det: DataFrame) -> DataFrame:
    """Dominant class of a track with its vote ratio, confidence and switches."""
    seen = det.filter(F.col("track_id").isNotNull()).withColumn("cls", history_class(F.col("raw_class")))
    per_class = seen.groupBy(*TRACK, "cls").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("conf").alias("mean"),
        F.min(F.struct("frame_idx", "det_id")).alias("first"),
    )
    order = F.struct(F.col("n"), F.col("mean"), -F.col("first.frame_idx"), -F.col("first.det_id"))
    votes = per_class.groupBy(*TRACK).agg(
        F.max_by(F.struct("cls", "n", "mean"), order).alias("top"),
        F.sum("n").alias("observations"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("cls", "n")))).alias("class_distribution"),
    )
    return votes.join(class_switches(det), TRACK).select(
        *TRACK,
        F.col("top.cls").alias("dominant_class"),
        half_even(F.col("top.n") / F.col("observations"), 3).alias("vote_ratio"),
        settled(F.col("top.mean"), 3).alias("mean_class_conf"),
        "switch_count",
        "observations",
        "class_distribution",
    )


def with_history(det: DataFrame, temporal: DataFrame) -> DataFrame:
    """Detections with the history of their track; no track, no history."""
    history = temporal.select(*TRACK, "dominant_class", "vote_ratio", "switch_count")
    return det.join(history, TRACK, "left")


def _validation_class() -> Column:
    raw = F.lower(F.col("raw_class"))
    return F.when(raw.isin("car", "truck", "bus", "motorcycle", "vehicle"), F.lit("vehicle")).otherwise(raw)


def validate(det: DataFrame, temporal: DataFrame, rules: ClassRules = ClassRules()) -> DataFrame:
    """Physical, environmental and temporal validation of each detection.

    Reads ``raw_class, conf, x1..y2, water_overlap`` and the track histories of
    :func:`temporal_metrics`.  Adds the final class, its confidence, the evidence
    text and whether the class moved; the raw columns stay as they were.

    The shape rules run below the join with the history, so that filters on the
    final class see one finished code column instead of the whole ladder.
    """
    base = bbox_metrics(det).withColumns(
        {
            "_cls": _validation_class(),
            "_water": F.coalesce(F.col("water_overlap"), F.lit(0.0)),
        }
    )
    cls, conf, area, aspect, water = (F.col(c) for c in ("_cls", "conf", "area", "aspect", "_water"))
    shape = F.col("bw") / F.col("bh")
    text = {
        "area": area.cast("string"),
        "aspect": fixed(aspect, 2),
        "conf": fixed(conf, 2),
        "water": fixed(water * 100.0, 0),
        "water1": fixed(water * 100.0, 1),
    }

    def say(*parts: str | Column) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    bar = (
        F.when(cls == "person", F.lit(rules.person_conf))
        .when(cls == "vehicle", F.lit(rules.vehicle_conf))
        .when(cls == "boat", F.lit(rules.boat_conf))
        .when(cls == "building", F.lit(rules.building_conf))
        .otherwise(F.lit(rules.other_conf))
    )
    weak = conf < bar
    none = F.lit("UNCERTAIN_OBJECT")
    person, vehicle, building, boat = (cls == c for c in ("person", "vehicle", "building", "boat"))
    dry = water < rules.boat_min_overlap
    oversize = area > rules.vehicle_max_area
    roof = (area >= rules.building_min_area) & shape.between(rules.building_min_aspect, rules.building_max_aspect)
    mirrored = (water > 0.85) & (conf < 0.25)
    compact = (area < 1200) & aspect.between(rules.vehicle_min_aspect, rules.vehicle_max_aspect)
    footprint = area >= rules.building_min_area
    carlike = (area <= rules.vehicle_max_area) & aspect.between(1.1, 3.5)
    v_max, v_min = f"{rules.vehicle_max_area:.0f}", f"{rules.vehicle_min_area:.0f}"

    # Each case: condition, final class, confidence, changed, evidence.
    # The evidence texts, read by users of the exported records.
    cases: list[tuple[Column, Column, Column, bool, Column]] = [
        (weak, none, conf * 0.5, True,
         say("Confidence ", text["conf"], " below class threshold ", fixed(bar, 2), " for ", cls, ".")),
        (person & (area > rules.person_max_area), none, F.lit(0.0), True,
         say("Person bbox area ", text["area"], f"px exceeds plausible human bounds (max {rules.person_max_area:.0f}px).")),
        (person & (area < rules.person_min_area), none, F.lit(0.0), True,
         say("Sub-pixel noise (area ", text["area"], f"px < {rules.person_min_area:.0f}px).")),
        (person & (aspect > rules.person_max_aspect), none, F.lit(0.0), True,
         say("Extreme aspect ratio ", text["aspect"], f" exceeds max {rules.person_max_aspect:.1f}.")),
        (person, F.lit("PERSON"), conf, False,
         say("Valid aerial person geometry (area=", text["area"], "px, aspect=", text["aspect"], ").")),
        (vehicle & oversize & roof, F.lit("BUILDING"), F.least(F.lit(0.85), conf + 0.15), True,
         say("Building-like geometry (area=", text["area"], f"px > {v_max}px, aspect=", text["aspect"],
             "); remapped from oversized vehicle.")),
        (vehicle & oversize, none, F.lit(0.0), True,
         say("Oversized vehicle detection (area=", text["area"], "px) with conflicting shape; flagged uncertain.")),
        (vehicle & (area < rules.vehicle_min_area), none, F.lit(0.0), True,
         say("Undersized vehicle candidate (area=", text["area"], f"px < {v_min}px); noise suppression.")),
        (vehicle & mirrored, none, F.lit(0.0), True,
         say("Deep water overlap (", text["water"], "%) with low confidence (", text["conf"],
             "); likely water reflection artifact.")),
        (vehicle, F.lit("VEHICLE"), conf, False,
         say("Vehicle geometry confirmed (area=", text["area"], "px, aspect=", text["aspect"],
             ", water overlap=", text["water"], "%).")),
        (building & compact, F.lit("VEHICLE"), conf, True,
         say("Compact object (area=", text["area"], "px, aspect=", text["aspect"],
             ") matches ground vehicle bounds; remapped from building.")),
        (building & footprint, F.lit("BUILDING"), F.greatest(conf, F.lit(0.70)), False,
         say("Persistent structural footprint (area=", text["area"], "px, aspect=", text["aspect"],
             ", water overlap=", text["water"], "%).")),
        (building, F.lit("BUILDING"), conf, False, say("Structure geometry (area=", text["area"], "px).")),
        (boat & dry & footprint, F.lit("BUILDING"), F.least(F.lit(0.80), conf + 0.10), True,
         say("Boat predicted on dry structure (area=", text["area"], "px, water overlap=", text["water1"],
             "%); remapped to BUILDING.")),
        (boat & dry & carlike, F.lit("VEHICLE"), conf, True,
         say("Boat detected on dry ground with vehicle dimensions (area=", text["area"], "px, aspect=",
             text["aspect"], "); remapped to VEHICLE.")),
        (boat & dry, none, F.lit(0.0), True,
         say("Boat detected on dry terrain without water proximity (overlap=", text["water1"], "%); unsupported.")),
        (boat, F.lit("BOAT"), conf, False,
         say("Vessel confirmed in water context (overlap=", text["water1"], "%, aspect=", text["aspect"], ").")),
    ]
    code = None
    for i, case in enumerate(cases):
        code = F.when(case[0], F.lit(i)) if code is None else code.when(case[0], F.lit(i))
    labels = F.array(*[case[1] for case in cases])
    staged = with_history(base.withColumn("_code", code.otherwise(F.lit(len(cases)))), temporal)
    step_code = F.col("_code")
    step_class = F.coalesce(F.get(labels, step_code), F.upper(cls))

    # History may override the shape rules, and an unsteady track voids the class.
    # The two never meet: one needs a clear vote, the other a split one.
    if rules.unstable_ratio > rules.override_ratio:
        raise ValueError("unstable_ratio must not exceed override_ratio")
    voted = F.upper(F.col("dominant_class"))
    vote, switches = F.col("vote_ratio"), F.col("switch_count")
    clear = F.coalesce(
        (vote >= max(rules.vote_ratio, rules.override_ratio))
        & voted.isin("PERSON", "VEHICLE", "BUILDING", "BOAT", "UNCERTAIN_OBJECT"),
        F.lit(False),
    )
    split = F.coalesce((switches >= rules.switch_limit) & (vote < rules.unstable_ratio), F.lit(False))
    open_case = (step_code != 0) & (step_class != "PERSON")
    final = (
        F.when(~open_case, step_class).when(clear, voted).when(split, none).otherwise(step_class)
    )
    override = open_case & clear & (voted != step_class)
    unstable = open_case & split

    def by_code(position: int, default: Column) -> Column:
        out = None
        for i, case in enumerate(cases):
            value = case[position]
            out = F.when(step_code == i, value) if out is None else out.when(step_code == i, value)
        return out.otherwise(default)

    moved = step_code.isin(*[i for i, case in enumerate(cases) if case[3]])
    notes = F.concat_ws(
        " | ",
        by_code(4, F.lit(None).cast("string")),
        F.when(
            override,
            say("Temporal track consistency overrode transient ", step_class, " -> ", voted,
                " (vote ratio: ", fixed(vote, 2), ", ", switches.cast("string"), " switches)."),
        ),
        F.when(
            unstable,
            say("Excessive class oscillations (", switches.cast("string"),
                " switches across track); flagged UNCERTAIN_OBJECT."),
        ),
    )
    return staged.withColumns(
        {
            "final_class": final,
            "validation_conf": half_even(F.when(unstable, F.lit(0.0)).otherwise(by_code(2, conf)), 4),
            "is_changed": moved | override | unstable,
            "validation_evidence": F.when(notes == "", F.lit("Validated by physical context.")).otherwise(notes),
        }
    ).drop("_cls", "_water", "_code")


def actionable(df: DataFrame) -> DataFrame:
    return df.filter(~F.upper(F.col("final_class")).isin("UNCERTAIN_OBJECT", "UNKNOWN", "NONE"))


def route(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Persons, and vehicles with boats."""
    return df.filter(F.col("final_class") == "PERSON"), df.filter(F.col("final_class").isin("VEHICLE", "BOAT"))


def hard_case_category(df: DataFrame) -> DataFrame:
    """Category of each hard case by ordered rules; other detections are dropped."""
    raw, final, conf = F.lower("raw_class"), F.upper("final_class"), F.col("validation_conf")
    car = raw.isin("vehicle", "car", "truck", "bus")
    rejected = final.isin("UNCERTAIN_OBJECT", "BUILDING", "VEHICLE")
    category = (
        F.when(car & (final == "BUILDING"), F.lit("building_as_vehicle"))
        .when((raw == "building") & (final == "VEHICLE"), F.lit("vehicle_as_building"))
        .when((raw == "person") & rejected, F.lit("false_person"))
        .when((raw == "boat") & rejected, F.lit("false_boat"))
        .when(car & (final == "VEHICLE") & (conf >= 0.15), F.lit("correct_vehicle"))
        .when((final == "BUILDING") & (conf >= 0.20), F.lit("correct_building"))
        .when((raw == "person") & (final == "PERSON") & (conf >= 0.08), F.lit("correct_person"))
        .when((raw == "boat") & (final == "BOAT") & (conf >= 0.15), F.lit("correct_boat"))
    )
    return df.withColumn("category", category).filter(F.col("category").isNotNull())


def hard_case_counts(cases: DataFrame) -> DataFrame:
    """Count per category, with zeros for the absent ones."""
    every = cases.sparkSession.createDataFrame([(c,) for c in HARD_CASES], "category string")
    counts = cases.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return every.join(counts, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))


def union_detections(full: DataFrame, tiled: DataFrame) -> DataFrame:
    return full.withColumn("tile_id", F.lit("full_frame")).unionByName(
        tiled.withColumn(
            "tile_id", F.concat(F.lit("tile_"), F.col("tile_x").cast("string"), F.lit("_"), F.col("tile_y").cast("string"))
        ).drop("tile_x", "tile_y")
    )


def detect_with(
    frames: DataFrame,
    fn: Callable[[Iterator], Iterator],
    schema: StructType | str,
    tile: int = 640,
    overlap_ratio: float = 0.20,
) -> DataFrame:
    """Run a user's detector over every tile of every frame, in Arrow batches."""
    return tiles(frames, tile, overlap_ratio).mapInPandas(fn, schema)


def segment_with(pixels: DataFrame, fn: Callable, schema: StructType | str) -> DataFrame:
    """Run a user's segmenter once per frame; a frame is bounded by its image size."""
    return pixels.groupBy("mission_id", "frame_idx").applyInPandas(fn, schema)


def infer_mission_with(frames: DataFrame, fn: Callable, schema: StructType | str, most: int = 24, window: int | None = None) -> DataFrame:
    """Run a user's multi-view model once per mission, on ``most`` frames at even distances at most.

    The selection comes before the call, so no mission is larger than that in its task.  With ``window`` a mission is cut into
    stretches of so many frame indices instead, for models that work on such, and all frames are used.
    """
    if window is None:
        chosen = uniform_subsample(frames, most).select(*frames.columns)
        return chosen.groupBy("mission_id").applyInPandas(fn, schema)
    return frames.groupBy("mission_id", F.floor(F.col("frame_idx") / window)).applyInPandas(fn, schema)
