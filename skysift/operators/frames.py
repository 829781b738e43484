"""Frame selection: quality gate, near-duplicate removal, uniform thinning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.config import FrameRules
from skysift.functions.numeric import fixed, settled
from skysift.lineage import cut
from skysift.operators.ordering import BLOCK, numbered, top_rows
from skysift.operators.successors import verdicts

DEDUP_BLOCK = 256


def reject_reason(frames: DataFrame, rules: FrameRules = FrameRules()) -> DataFrame:
    """First failed quality criterion of a frame with its value, null when it passes."""
    percent = lambda c: fixed(F.col(c) * 100.0, 1)
    reason = (
        F.when(F.col("sharpness") < rules.min_sharpness, F.concat(F.lit("Blurry (sharpness: "), fixed(F.col("sharpness"), 2), F.lit(f" < {rules.min_sharpness:.1f})")))
        .when(F.col("underexposed_ratio") > rules.max_under, F.concat(F.lit("Underexposed ("), percent("underexposed_ratio"), F.lit("%)")))
        .when(F.col("overexposed_ratio") > rules.max_over, F.concat(F.lit("Overexposed ("), percent("overexposed_ratio"), F.lit("%)")))
        .when(F.col("mean_brightness") < rules.min_brightness, F.concat(F.lit("Too dark (brightness: "), fixed(F.col("mean_brightness"), 2), F.lit(")")))
        .when(F.col("sky_ratio") > rules.max_sky, F.concat(F.lit("Sky dominant ("), percent("sky_ratio"), F.lit("%)")))
    )
    return frames.withColumn("reject_reason", reason)


def relax_if_few(judged: DataFrame, min_pass: int = 3, k: int = 24) -> DataFrame:
    """Frames that pass; a mission with too few keeps its ``k`` best of all frames.

    ``seq`` is the order in which the frames are then compared.
    """
    passed = F.col("reject_reason").isNull()
    counts = judged.groupBy("mission_id").agg(F.count_if(passed).alias("_passed"))
    known = judged.join(counts, "mission_id")
    usual = known.filter(passed & (F.col("_passed") >= min_pass)).withColumn("seq", F.col("frame_idx"))
    best = top_rows(
        known.filter(F.col("_passed") < min_pass), ["mission_id"],
        [F.col("quality_score").desc(), F.col("frame_idx")], k,
    ).withColumn("seq", (F.col("rank") - 1).cast("long")).drop("rank")
    return usual.unionByName(best).drop("_passed")


def dedup_frames(
    frames: DataFrame, threshold: float = 0.994, order: str = "frame_idx", block: int = DEDUP_BLOCK
) -> DataFrame:
    """Compare each frame with the last kept one and drop near duplicates.

    A duplicate that is a quarter sharper replaces the kept frame.  Reads
    ``fingerprint, sharpness``; returns the outcome and the similarity of every
    frame: ``kept``, ``replaced`` or ``duplicate``.  A frame without a fingerprint is like
    no other.  ``block`` frames are looked at together (``successors``).
    """
    placed = numbered(frames, ["mission_id"], F.floor(F.col(order) / BLOCK), [F.col(order)], "pos", start=0)
    columns = [F.col(order).cast("long").alias("at"), F.col("fingerprint").cast("array<double>").alias("fingerprint")]
    rows = placed.select(F.col("mission_id").cast("long").alias("mission_id"), F.col("pos").cast("long").alias("pos"), *columns, F.col("sharpness").cast("double").alias("sharpness"))
    events = cut(verdicts(rows, threshold, block))
    gone = events.filter(F.col("verdict") == "replaces").select(
        "mission_id", F.col("against").alias("at"), F.col("similarity").alias("_by")
    )
    outcome = F.when(F.col("_by").isNotNull(), F.lit("replaced")).when(
        F.col("verdict") == "duplicate", F.lit("duplicate")
    ).otherwise(F.lit("kept"))
    return events.join(gone, ["mission_id", "at"], "left").select(
        "mission_id", F.col("at").alias(order), outcome.alias("outcome"),
        F.coalesce("_by", "similarity").alias("similarity"),
    )


def number_frames(frames: DataFrame, order: str = "frame_idx") -> DataFrame:
    """Position of each selected frame within its mission, from zero."""
    return numbered(frames, ["mission_id"], F.floor(F.col(order) / BLOCK), [F.col(order)], "position", start=0)


def uniform_subsample(frames: DataFrame, k: int = 24, order: str = "frame_idx") -> DataFrame:
    """Keep ``k`` frames at evenly spaced positions of each mission.

    Whether a position is hit is a local test, so no list of positions is joined.
    """
    placed = number_frames(frames, order)
    sizes = placed.groupBy("mission_id").agg(F.count(F.lit(1)).alias("_n"))
    step = (F.col("_n") - 1) / F.lit(float(max(1, k - 1)))
    guess = F.floor(F.col("position") / step)
    hit = F.lit(False)
    for shift in (-1, 0, 1):
        i = guess + shift
        hit = hit | (i.between(0, k - 1) & (F.rint(i * step) == F.col("position")))
    return placed.join(sizes, "mission_id").filter((F.col("_n") <= k) | hit).drop("_n")


def selection_stats(frames: DataFrame) -> DataFrame:
    """Counts by outcome and averages over the kept frames of each mission."""
    kept = F.col("outcome") == "kept"
    return frames.groupBy("mission_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(kept).alias("selected"),
        F.count_if(F.col("outcome") == "rejected").alias("rejected_quality"),
        F.count_if(F.col("outcome").isin("duplicate", "replaced")).alias("rejected_redundant"),
        settled(F.avg(F.when(kept, F.col("sharpness"))), 2).alias("average_sharpness"),
        settled(F.avg(F.when(kept, F.col("quality_score"))), 2).alias("average_quality"),
    )
