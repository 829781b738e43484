"""Flood, hazard, damage and surroundings of objects, from pixels and boxes.

Boxes are half-open raster boxes in the columns named by ``BOX``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysift.functions.numeric import clip, fixed, half_even, is_finite, norm, settled
from skysift.lineage import cut
from skysift.operators.folds import ordered_walk
from skysift.operators.raster import FRAME, laplacian
from skysift.operators.spatial import box_pixels, box_sums, label_runs

BOX = ("rx1", "ry1", "rx2", "ry2")


# ------------------------------------------------------------------ masks


def water_overlap(boxes: DataFrame, pixels: DataFrame, flag: str = "is_water", tile: int = 64) -> DataFrame:
    """Share of the pixels of each box that carry the flag; 0 for an empty box."""
    sums = box_sums(boxes, pixels, FRAME, "det_id", BOX, {"hit": F.col(flag).cast("long")}, tile)
    share = F.coalesce(F.col("hit") / F.col("pixels"), F.lit(0.0))
    return boxes.join(sums, [*FRAME, "det_id"], "left").withColumn("water_overlap", share).drop("hit", "pixels")


def mask_parts(pixels: DataFrame, min_share: float = 0.005, tile: int = 64) -> tuple[DataFrame, DataFrame]:
    """Labelled runs of the water mask, and one row per component.

    A component counts as ``valid`` from ``min_share`` of the frame on.
    """
    sizes = pixels.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("total"))
    runs = cut(label_runs(pixels.filter("is_water"), FRAME, tile))
    parts = (
        runs.groupBy(*FRAME, "label")
        .agg(
            F.sum(F.col("c2") - F.col("c1") + 1).alias("area"),
            (F.max("c2") - F.min("c1") + 1).alias("box_w"),
            (F.max("r") - F.min("r") + 1).alias("box_h"),
        )
        .join(sizes, FRAME)
        .withColumn("valid", F.col("area") >= F.floor(F.col("total") * min_share))
    )
    return runs, parts


def largest_part(parts: DataFrame) -> DataFrame:
    """Validated water, largest component and its aspect per frame with water."""
    rank = F.struct(F.col("area"), -F.col("label"))
    top = parts.groupBy(*FRAME).agg(
        F.max("total").alias("total"),
        F.sum("area").alias("water"),
        F.sum(F.when(F.col("valid"), F.col("area")).otherwise(F.lit(0))).alias("validated"),
        F.max_by(F.struct("area", "box_w", "box_h"), rank).alias("top"),
    )
    wide, tall = F.col("top.box_w"), F.col("top.box_h")
    return top.select(
        *FRAME,
        "total",
        "water",
        "validated",
        F.col("top.area").alias("largest"),
        (F.greatest(wide, tall) / F.greatest(F.lit(1), F.least(wide, tall))).alias("aspect"),
    )


def valid_mask(pixels: DataFrame, runs: DataFrame, parts: DataFrame) -> DataFrame:
    """Pixels with ``is_valid``: water in a component that is large enough."""
    kept = runs.join(parts.filter("valid").select(*FRAME, "label"), [*FRAME, "label"], "left_semi")
    cells = kept.select(*FRAME, "r", F.explode(F.sequence("c1", "c2")).alias("c"), F.lit(True).alias("is_valid"))
    return pixels.join(cells, [*FRAME, "r", "c"], "left").withColumn("is_valid", F.coalesce("is_valid", F.lit(False)))


def depth_flatness(pixels: DataFrame, flag: str = "is_valid", min_water: int = 100, min_depth: int = 50) -> DataFrame:
    """One minus the variation of the depth over water; 0.5 without enough pixels."""
    wet = F.col(flag)
    good = wet & is_finite(F.col("depth")) & (F.col("depth") > 0.1)
    value = F.when(good, F.col("depth"))
    stats = pixels.groupBy(*FRAME).agg(
        F.count_if(wet).alias("_w"), F.count_if(good).alias("_n"),
        F.stddev_pop(value).alias("_s"), F.avg(value).alias("_m"),
    )
    enough = (F.col("_w") > min_water) & (F.col("_n") > min_depth)
    flat = clip(1.0 - F.col("_s") / (F.col("_m") + 1e-4), 0.0, 1.0)
    return stats.select(*FRAME, F.when(enough, flat).otherwise(F.lit(0.5)).alias("depth_flatness"))


def overlap_context(boxes: DataFrame, mask: DataFrame, flag: str = "is_valid", tile: int = 64) -> DataFrame:
    """Largest water share of buildings and vehicles, and any contact, per frame."""
    met = water_overlap(boxes, mask, flag, tile)
    share, cls = F.col("water_overlap"), F.col("class_name")
    building = cls.isin("building", "structure", "house")
    road = cls.isin("car", "truck", "bus", "vehicle", "traffic light")
    contact = (road | cls.isin("person", "boat")) & (share > 0.05)
    return met.groupBy(*FRAME).agg(
        F.coalesce(F.max(F.when(building, share)), F.lit(0.0)).alias("building_overlap"),
        F.coalesce(F.max(F.when(road, share)), F.lit(0.0)).alias("road_overlap"),
        F.bool_or(contact).alias("contact"),
    )


# ------------------------------------------------------------- flood state


def flood_state(
    pixels: DataFrame,
    boxes: DataFrame,
    min_share: float = 0.005,
    min_water: int = 100,
    min_depth: int = 50,
    tile: int = 64,
) -> DataFrame:
    """Water state of each frame from coverage, components, depth and contacts."""
    runs, parts = mask_parts(pixels, min_share, tile)
    parts = cut(parts)
    mask = valid_mask(pixels, runs, parts)
    base = pixels.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("_total"), F.count_if("is_water").alias("_water"))
    joined = (
        base.join(largest_part(parts).select(*FRAME, "validated", "largest", "aspect"), FRAME, "left")
        .join(depth_flatness(mask, "is_valid", min_water, min_depth), FRAME, "left")
        .join(overlap_context(boxes, mask, "is_valid", tile), FRAME, "left")
    )
    zero, total = F.lit(0.0), F.col("_total")
    filled = joined.select(
        *FRAME,
        (F.col("_water") / total).alias("cand"),
        F.coalesce(F.col("validated") / total, zero).alias("ratio"),
        F.coalesce(F.col("largest") / total, zero).alias("largest"),
        F.coalesce("aspect", F.lit(1.0)).alias("aspect"),
        F.coalesce("depth_flatness", F.lit(0.5)).alias("flat"),
        F.coalesce("building_overlap", zero).alias("bldg"),
        F.coalesce("road_overlap", zero).alias("road"),
        F.coalesce("contact", F.lit(False)).alias("contact"),
    )
    return cut(_state_ladder(filled))


def _state_ladder(df: DataFrame) -> DataFrame:
    ratio, cand, bldg, road, contact = (F.col(c) for c in ("ratio", "cand", "bldg", "road", "contact"))
    channel = (F.col("aspect") >= 3.5) & (bldg < 0.02) & (road < 0.02) & ~contact & (ratio <= 0.20)
    touched = (bldg > 0.02) | (road > 0.03) | contact
    code = (
        F.when((ratio < 0.02) & (cand < 0.03), F.lit(0))
        .when(channel, F.lit(1))
        .when((ratio >= 0.20) | ((ratio >= 0.06) & touched), F.lit(2))
        .when((ratio >= 0.04) | (cand >= 0.06), F.lit(3))
        .otherwise(F.lit(4))
    )
    coded = df.withColumn("_code", code)
    pick = lambda *values: F.element_at(F.array(*values), F.col("_code") + 1)
    # State names and evidence texts.
    states = ("NO_WATER", "WATER_BODY", "VALIDATED_INUNDATION", "POTENTIAL_INUNDATION", "WATER_BODY")
    sure = F.least(F.lit(1.0), 0.40 + ratio * 1.5 + bldg * 0.3 + F.col("flat") * 0.2)
    percent = fixed(ratio * 100.0, 1)
    return coded.select(
        *FRAME,
        pick(*[F.lit(s) for s in states]).alias("water_state"),
        half_even(ratio, 4).alias("water_ratio"),
        half_even(cand, 4).alias("candidate_ratio"),
        half_even(pick(F.lit(0.0), F.lit(0.15), sure, clip(0.35 + ratio, 0.30, 0.75), F.lit(0.10)), 3).alias("flood_confidence"),
        settled(F.col("flat"), 3).alias("depth_flatness"),
        half_even(bldg, 3).alias("building_overlap"),
        half_even(road, 3).alias("road_overlap"),
        half_even(F.col("largest"), 4).alias("largest_component_ratio"),
        pick(*[F.lit(g) for g in ("FAIL", "FAIL", "PASS", "PASS", "FAIL")]).alias("incident_gate"),
        pick(
            F.lit("Water candidate coverage is negligible (<2% of image area)."),
            F.concat(F.lit("Water detected but confined in natural channel/canal (aspect ratio "), fixed(F.col("aspect"), 1),
                     F.lit(":1, no infrastructure inundation).")),
            F.concat(F.lit("Confirmed inundation across "), percent, F.lit("% of scene contacting built infrastructure/terrain.")),
            F.concat(F.lit("Potential flood inundation detected ("), percent, F.lit("% surface coverage).")),
            F.lit("Minor water body candidate detected without signs of hazardous flooding."),
        ).alias("summary_evidence"),
    )


def flood_evidence(pixels: DataFrame, boxes: DataFrame, tile: int = 64) -> DataFrame:
    """Fused flood score of each frame and its state."""
    _, parts = mask_parts(pixels, 0.0, tile)
    base = pixels.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("_n"), F.count_if("is_water").alias("_w"))
    tops = parts.groupBy(*FRAME).agg(F.max("area").alias("_top"))

    covered = box_pixels(
        boxes.filter(F.col("class_name").isin("building", "road")).select(*FRAME, "class_name", *BOX),
        pixels.select(*FRAME, "r", "c", "is_water"), FRAME, BOX, tile,
    ).groupBy(*FRAME, "r", "c", "is_water").agg(
        F.bool_or(F.col("class_name") == "building").alias("_b"), F.bool_or(F.col("class_name") == "road").alias("_o")
    )
    wet = F.col("is_water")
    contact = covered.groupBy(*FRAME).agg(
        (F.count_if(wet & F.col("_b")) / (F.count_if("_b") + 1e-6)).alias("_bldg"),
        (F.count_if(wet & F.col("_o")) / (F.count_if("_o") + 1e-6)).alias("_road"),
    )
    built = boxes.filter(F.col("class_name").isin("building", "road")).select(*FRAME).distinct().withColumn("_built", F.lit(True))
    zero = F.lit(0.0)
    df = (
        base.join(tops, FRAME, "left").join(contact, FRAME, "left").join(built, FRAME, "left")
        .select(
            *FRAME,
            (F.col("_w") / F.col("_n")).alias("ratio"),
            F.coalesce(F.col("_top") / (F.col("_w") + 1e-6), zero).alias("coherence"),
            F.coalesce("_bldg", zero).alias("bldg"),
            F.coalesce("_road", zero).alias("road"),
            F.coalesce("_built", F.lit(False)).alias("built"),
        )
    )
    ratio = F.col("ratio")
    df = df.withColumns(
        {
            "semantic": F.when(ratio > 0.02, F.least(F.lit(1.0), ratio * 3.0)).otherwise(zero),
            "inundation": F.when(F.col("built"), F.least(F.lit(1.0), 0.30 + F.col("bldg") * 1.5 + F.col("road") * 1.2)).otherwise(
                F.least(F.lit(0.30), ratio * 0.8)
            ),
        }
    )
    score = 0.40 * (F.col("semantic") * F.col("coherence")) + 0.50 * F.col("inundation") + 0.10 * F.least(F.lit(1.0), ratio * 4.0)
    df = df.withColumn("score", score)
    state = (
        F.when(ratio < 0.03, F.lit("NO_WATER"))
        .when(F.col("score") >= 0.45, F.lit("FLOOD_ZONE"))
        .when(F.col("score") >= 0.35, F.lit("POTENTIAL_INUNDATION"))
        .otherwise(F.lit("WATER_BODY"))
    )
    return cut(
        df.withColumn("water_state", state).select(
            *FRAME,
            half_even(ratio, 4).alias("water_ratio"),
            half_even(F.col("semantic"), 4).alias("semantic_confidence"),
            half_even(F.col("inundation"), 4).alias("inundation_confidence"),
            half_even(F.col("coherence"), 4).alias("spatial_coherence"),
            half_even(F.col("bldg"), 4).alias("building_overlap_ratio"),
            half_even(F.col("road"), 4).alias("road_overlap_ratio"),
            half_even(F.col("score"), 4).alias("flood_score"),
            "water_state",
            F.when(F.col("water_state").isin("FLOOD_ZONE", "POTENTIAL_INUNDATION"), F.lit("PASS")).otherwise(F.lit("FAIL")).alias("incident_gate"),
        )
    )


def flood_rollup(flood: DataFrame) -> DataFrame:
    """Flood summary of a mission over its frames."""
    state = F.col("water_state")
    counted = flood.groupBy("mission_id").agg(
        F.max("water_ratio").alias("max_ratio"),
        F.count_if(state == "VALIDATED_INUNDATION").alias("validated_frames"),
        F.count_if(state == "POTENTIAL_INUNDATION").alias("potential_frames"),
        F.count(F.lit(1)).alias("frames"),
    )
    return counted.withColumns(
        {
            "is_flooded": (F.col("validated_frames") > 0) | (F.col("max_ratio") >= 0.05),
            "dominant_state": F.when(F.col("validated_frames") > 0, F.lit("VALIDATED_INUNDATION"))
            .when(F.col("potential_frames") > 0, F.lit("POTENTIAL_INUNDATION"))
            .when(F.col("max_ratio") > 0.01, F.lit("WATER_BODY"))
            .otherwise(F.lit("NO_WATER")),
        }
    )


# --------------------------------------------------------- scene and hazards


def scene_class(frames: DataFrame) -> DataFrame:
    """Scene class from the fire, water and debris ratios, in that order."""
    fire, water, debris = F.col("fire_ratio"), F.col("water_ratio"), F.col("debris_ratio")
    burning, flooded, rubble = fire > 0.02, water > 0.28, debris > 0.35
    return frames.withColumns(
        {
            "scene_class": F.when(burning, F.lit("FIRE")).when(flooded, F.lit("FLOOD")).when(rubble, F.lit("EARTHQUAKE_DAMAGE")).otherwise(F.lit("NORMAL")),
            "scene_confidence": half_even(
                F.when(burning, F.lit(0.90))
                .when(flooded, F.least(F.lit(0.95), 0.50 + water * 1.5))
                .when(rubble, F.least(F.lit(0.90), 0.40 + debris * 1.2))
                .otherwise(F.lit(0.95)), 6,
            ),
            "is_disaster": burning | flooded | rubble,
        }
    )


def hazards(frames: DataFrame) -> DataFrame:
    """Zero to three hazard rows per frame: flood, debris, fire.

    Reads the flood evidence columns, ``debris_ratio``, ``fire_ratio`` and
    ``has_road``.
    """
    water, debris, fire = F.col("water_ratio"), F.col("debris_ratio"), F.col("fire_ratio")

    def row(kind: Column, hazard: str, conf: Column, severity: Column, ratio: Column, text: Column) -> Column:
        return F.struct(
            kind.alias("incident_type"), F.lit(hazard).alias("hazard_class"), conf.alias("confidence"),
            severity.alias("severity"), half_even(ratio * 100.0, 1).alias("coverage_pct"), text.alias("evidence"),
        )

    flood = row(
        F.lit("FLOOD_ZONE"), "flood", half_even(F.col("flood_score"), 3),
        F.when(water > 0.35, F.lit("CRITICAL")).otherwise(F.lit("HIGH")), water,
        F.concat(F.lit("Flooded water inundation detected ("), fixed(water * 100.0, 1), F.lit("% area, Score: "),
                 fixed(F.col("flood_score"), 2), F.lit("). State: "), F.col("water_state"), F.lit(".")),
    )
    rubble = row(
        F.when(F.col("has_road"), F.lit("BLOCKED_ROAD_DEBRIS")).otherwise(F.lit("POTENTIAL_GROUND_OBSTRUCTION")), "debris",
        F.least(F.lit(0.90), half_even(0.40 + debris * 1.1, 3)),
        F.when(debris > 0.45, F.lit("HIGH")).otherwise(F.lit("MEDIUM")), debris,
        F.concat(F.lit("Severe rubble concentration ("), fixed(debris * 100.0, 1), F.lit("% area) "),
                 F.when(F.col("has_road"), F.lit("obstructing road")).otherwise(F.lit("on ground region")), F.lit(".")),
    )
    flame = row(
        F.lit("FIRE_SMOKE_HAZARD"), "fire", F.least(F.lit(0.95), half_even(0.60 + fire * 10.0, 3)), F.lit("CRITICAL"), fire,
        F.concat(F.lit("Visible high-temperature flame / active fire hue detected over "), fixed(fire * 100.0, 2), F.lit("% frame area.")),
    )
    found = F.array(
        F.when(F.col("incident_gate") == "PASS", flood), F.when(debris > 0.35, rubble), F.when(fire > 0.015, flame)
    )
    return frames.select(*FRAME, F.explode(F.filter(found, lambda h: h.isNotNull())).alias("h")).select(*FRAME, "h.*")


# ----------------------------------------------------------------- damage


def damage_candidates(boxes: DataFrame, min_side: int = 30) -> DataFrame:
    cls = F.col("class_name")
    wanted = cls.isNull() | cls.isin("building", "structure") | F.coalesce(F.col("object_id").contains("STRUCTURE"), F.lit(False))
    tall = (F.col(BOX[2]) - F.col(BOX[0]) >= min_side) & (F.col(BOX[3]) - F.col(BOX[1]) >= min_side)
    return boxes.filter(wanted & tall)


def depth_gradient(crops: DataFrame, key: str = "det_id") -> DataFrame:
    """Central difference of the depth inside each crop, one-sided at its edges."""
    row = Window.partitionBy(*FRAME, key, "r").orderBy("c")
    column = Window.partitionBy(*FRAME, key, "c").orderBy("r")

    def slope(window) -> Column:
        here = F.col("depth")
        # A pixel that exists but has no depth must void the slope, so neighbours
        # are told from missing ones by their position.
        axis = "c" if window is row else "r"
        before, after = F.lag(F.struct("depth", axis)).over(window), F.lead(F.struct("depth", axis)).over(window)
        both = (after["depth"] - before["depth"]) / 2.0
        return F.when(before.isNotNull() & after.isNotNull(), both).when(
            after.isNotNull(), after["depth"] - here
        ).when(before.isNotNull(), here - before["depth"])

    return crops.withColumn("_gx", slope(row)).withColumn("_gy", slope(column)).withColumn(
        "depth_gradient", norm(F.col("_gx"), F.col("_gy"))
    ).drop("_gx", "_gy")


def damage(pixels: DataFrame, boxes: DataFrame, min_side: int = 30, tile: int = 64) -> DataFrame:
    """Structural damage of building boxes from surface and depth disorder."""
    wanted = damage_candidates(boxes, min_side)
    textured = laplacian(pixels)
    crops = box_pixels(
        wanted.select(*FRAME, "det_id", *BOX), textured.select(*FRAME, "r", "c", "depth", "laplacian"), FRAME, BOX, tile
    )
    steep = depth_gradient(crops)
    usable = is_finite(F.col("depth_gradient")) & (F.col("depth") > 0.1)
    lap = F.col("laplacian").cast("double")
    stats = steep.groupBy(*FRAME, "det_id").agg(
        F.var_pop(lap).alias("_lap"),
        F.coalesce(F.count_if(usable & (F.col("depth_gradient") > 0.20)) / F.nullif(F.count_if(usable), F.lit(0)), F.lit(0.0)).alias("_ratio"),
    )
    lap_var, ratio = F.col("_lap"), F.col("_ratio")
    level = (
        F.when((ratio > 0.22) & (lap_var > 1400), F.lit("potential_major_damage"))
        .when((ratio > 0.15) & (lap_var > 900), F.lit("minor_damage"))
    )
    conf = settled(F.least(F.lit(0.5), lap_var / 2500.0 * 0.5) + F.least(F.lit(0.5), ratio / 0.40 * 0.5), 3)
    return stats.withColumn("damage_level", level).filter(F.col("damage_level").isNotNull()).select(
        *FRAME, "det_id", "damage_level",
        F.when(F.col("damage_level") == "minor_damage", F.lit("MEDIUM")).otherwise(F.lit("HIGH")).alias("severity"),
        clip(conf, 0.40, 0.92).alias("confidence"),
        settled(lap_var, 2).alias("laplacian_variance"),
        half_even(ratio, 4).alias("gradient_ratio"),
    )


# ------------------------------------------------------------ surroundings


class _Distances:
    """Exact distances of the probes of one frame: along each image row by runs, then over the rows of the probe's column."""

    def __init__(self, key: tuple):
        self.key, self.parts = key, []

    def take(self, rows: dict[str, np.ndarray]) -> list[tuple]:
        self.parts.append(rows)
        return []

    def close(self) -> list[tuple]:
        kind, rows, columns, dets = (np.concatenate([p[c] for p in self.parts]) for c in ("kind", "r", "columns", "det_id"))
        wet, probes = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        if not len(wet) or not len(probes):
            return []
        places = np.concatenate([p["c"] for p in self.parts])[probes]
        wet = wet[np.argsort(rows[wet], kind="stable")]
        r, sizes = rows[wet], [len(columns[i]) for i in wet]
        c, of = np.concatenate([np.asarray(columns[i], np.int64) for i in wet]), np.repeat(np.arange(len(wet)), sizes)
        begin = np.concatenate([[True], (np.diff(c) != 1) | (np.diff(of) != 0)])
        first, last = c[begin], c[np.concatenate([begin[1:], [True]])]
        row_start = np.searchsorted(of[begin], np.arange(len(wet)))
        out = []
        for column in np.unique(places):
            gap = np.maximum(0, np.maximum(first - column, column - last))
            nearest = np.minimum.reduceat(gap, row_start) ** 2
            for i in probes[places == column]:
                out.append((*self.key, int(dets[i]), float(np.sqrt((nearest + (r - rows[i]) ** 2).min()))))
        return out


def nearest_flag(det: DataFrame, pixels: DataFrame, flag: str = "is_water") -> DataFrame:
    """Distance from each centre ``pc, pr`` to the nearest flagged pixel, 0 inside.

    A separable distance transform that is evaluated at the probes alone.  Flagged pixels of an image row are packed before
    the shuffle; a task holds one frame, so the raster bounds it.
    """
    zero, long = F.lit(0).cast("long"), lambda c: F.col(c).cast("long")
    wet = pixels.filter(F.col(flag)).groupBy(*FRAME, "r").agg(F.array_sort(F.collect_set(long("c"))).alias("columns"))
    rows = wet.select(*FRAME, F.lit(0).alias("kind"), long("r").alias("r"), zero.alias("c"), "columns", zero.alias("det_id"))
    probes = det.select(*FRAME, F.lit(1).alias("kind"), long("pr").alias("r"), long("pc").alias("c"), F.array().cast("array<bigint>").alias("columns"), "det_id")
    return ordered_walk(rows.unionByName(probes), FRAME, [F.col("kind")], _Distances, "mission_id long, frame_idx long, det_id long, flood_distance_px double")


def person_context(
    persons: DataFrame, pixels: DataFrame, image: tuple[int, int] = (1080, 1920), tile: int = 64
) -> DataFrame:
    """Isolation of each person: nearest water, water around, height over ground.

    ``image`` is the raster size (rows, columns).
    """
    height, width = image
    x1, y1, x2, y2 = (F.col(c) for c in BOX)
    bw, bh = F.greatest(F.lit(1), x2 - x1), F.greatest(F.lit(1), y2 - y1)
    base = persons.withColumns(
        {
            "pc": clip(F.floor((x1 + x2) / 2.0), F.lit(0), F.lit(width - 1)).cast("long"),
            "pr": clip(F.floor((y1 + y2) / 2.0), F.lit(0), F.lit(height - 1)).cast("long"),
            "ox1": F.greatest(F.lit(0), x1 - F.floor(bw * 1.5)),
            "oy1": F.greatest(F.lit(0), y1 - F.floor(bh * 1.5)),
            "ox2": F.least(F.lit(width), x2 + F.floor(bw * 1.5)),
            "oy2": F.least(F.lit(height), y2 + F.floor(bh * 1.5)),
        }
    )
    ring = ("ox1", "oy1", "ox2", "oy2")
    key = [*FRAME, "det_id"]
    scene = pixels.groupBy(*FRAME).agg((F.count_if("is_water") > 0.01 * F.count(F.lit(1))).alias("_wet"))
    around = box_sums(base, pixels, FRAME, "det_id", ring, {"_hit": F.col("is_water").cast("long")}, tile).select(
        *key, (F.col("_hit") / F.col("pixels")).alias("_ratio")
    )
    seen = box_pixels(
        base.select(*key, *BOX, *ring),
        pixels.filter(is_finite(F.col("depth")) & (F.col("depth") > 0.1)).select(*FRAME, "r", "c", "depth"),
        FRAME, ring, tile,
    )
    inside = (F.col("r") >= y1) & (F.col("r") < y2) & (F.col("c") >= x1) & (F.col("c") < x2)
    heights = seen.groupBy(*key).agg(
        F.count_if(inside).alias("_np"), F.count(F.lit(1)).alias("_ns"),
        F.median(F.when(inside, F.col("depth"))).alias("_dp"), F.median("depth").alias("_ds"),
    )
    raised = (F.col("_np") > 5) & (F.col("_ns") > 20) & (F.col("_ds") - F.col("_dp") > 0.80)
    joined = cut(
        base.join(scene, FRAME, "left")
        .join(nearest_flag(base, pixels), key, "left")
        .join(around, key, "left")
        .join(heights, key, "left")
        .withColumns(
            {
                "_wet": F.coalesce("_wet", F.lit(False)),
                "_ratio": F.coalesce("_ratio", F.lit(0.0)),
                "_up": F.coalesce(raised, F.lit(False)),
                "_d": F.col("flood_distance_px"),
            }
        )
        .drop("pc", "pr", *ring, "_np", "_ns", "_dp", "_ds", "flood_distance_px")
    )
    d, ratio, up, wet = (F.col(c) for c in ("_d", "_ratio", "_up", "_wet"))
    score = half_even(
        0.45 * clip(1.0 - d / 120.0, 0.0, 1.0)
        + 0.35 * clip(ratio * 1.5, 0.0, 1.0)
        + 0.20 * F.when(up, F.lit(0.85)).otherwise(F.lit(0.30)), 3,
    )
    stranded = (d == 0) | (ratio > 0.55) | (up & (ratio > 0.35))
    isolated = (d < 150.0) | (ratio > 0.20)

    def pick(dry, a, b, c) -> Column:
        cases = [v if isinstance(v, Column) else F.lit(v) for v in (dry, a, b, c)]
        return F.when(~wet, cases[0]).when(stranded, cases[1]).when(isolated, cases[2]).otherwise(cases[3])

    percent = half_even(ratio * 100.0, 1)
    near, share = fixed(d, 0), fixed(ratio * 100.0, 0)
    # Fixed texts: they must equal the published ones.
    evidence = pick(
        "Person observed in dry environment with no significant floodwater detected.",
        F.when(
            up,
            F.concat(F.lit("Person is isolated on an elevated structure surrounded by floodwater ("), share, F.lit("% water perimeter coverage; distance to water: "), near, F.lit("px).")),
        ).otherwise(F.concat(F.lit("Person is located in/adjacent to floodwater ("), share, F.lit("% water contact) with restricted dry ground access."))),
        F.concat(F.lit("Person detected within "), near, F.lit("px of floodwater with potential access route.")),
        F.concat(F.lit("Person observed on accessible dry ground ("), near, F.lit("px from floodwater).")),
    )
    return joined.withColumns(
        {
            "classification": pick("NORMAL_PERSON", "POTENTIAL_STRANDED_PERSON", "POTENTIAL_ISOLATED_PERSON", "NORMAL_PERSON"),
            "flood_proximity": pick("NONE", "HIGH (INUNDATED SURROUNDINGS)", "MODERATE", "LOW"),
            "accessible_dry_area": pick("HIGH", "LOW / SEVERELY RESTRICTED", "PARTIALLY ACCESSIBLE", "HIGH"),
            "flood_distance_px": F.when(wet, half_even(d, 1)).otherwise(F.lit(999.0)),
            "surrounding_flood_pct": F.when(wet, percent).otherwise(F.lit(0.0)),
            "nearest_water_distance_m": F.when(wet, half_even(d * 0.05, 2)).otherwise(F.lit(99.0)),
            "elevation_context": F.when(wet & up, F.lit("ELEVATED_STRUCTURE")).otherwise(F.lit("GROUND_LEVEL")),
            "elevation_relative_m": F.when(wet & up, F.lit(2.0)).otherwise(F.lit(0.0)),
            "isolation_score": F.when(wet, score).otherwise(F.lit(0.0)),
            "evidence": evidence,
        }
    ).drop("_d", "_ratio", "_up", "_wet")


def vehicle_context(vehicles: DataFrame, pixels: DataFrame, tile: int = 64) -> DataFrame:
    """Water contact of each vehicle and what follows from it."""
    met = water_overlap(vehicles, pixels, "is_water", tile)
    share = F.col("water_overlap")
    deep, near = share > 0.35, share > 0.05
    return met.withColumns(
        {
            "classification": F.when(deep, F.lit("FLOODED_VEHICLE")).when(near, F.lit("VEHICLE_NEAR_FLOOD")).otherwise(F.lit("NORMAL_VEHICLE")),
            "severity": F.when(deep, F.lit("HIGH")).when(near, F.lit("MEDIUM")).otherwise(F.lit("LOW")),
            "water_contact_pct": half_even(share * 100.0, 1),
        }
    )
