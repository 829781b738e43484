"""Depth maps: statistics, alignment to a second map, agreement, confidence.

``depth`` has one row per pixel: ``mission_id, frame_idx, depth, mono_depth,
depth_conf``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.functions.numeric import clip, is_finite, settled
from skysift.lineage import cut
from skysift.operators.ordering import crowded, quantiles
from skysift.operators.raster import FRAME


def depth_stats(depth: DataFrame) -> DataFrame:
    """Valid share, range and spread of the depth of each frame, with a verdict."""
    d = F.col("depth")
    good = is_finite(d) & (d > 0.05) & (d < 200.0)
    value = F.when(good, d)
    stats = depth.groupBy(*FRAME).agg(
        (F.count_if(good) / F.count(F.lit(1))).alias("valid_ratio"),
        F.min(value).alias("min_depth"),
        F.max(value).alias("max_depth"),
        F.stddev_pop(value).alias("std_depth"),
    )
    enough = F.col("valid_ratio") >= 0.05
    return stats.select(
        *FRAME, "valid_ratio",
        *[F.when(enough, F.col(c)).alias(c) for c in ("min_depth", "max_depth", "std_depth")],
        F.coalesce(enough & (F.col("std_depth") >= 1e-4), F.lit(False)).alias("is_valid"),
    )


def _usable(min_depth: float, max_depth: float, conf: float | None) -> Column:
    y, x = F.col("depth"), F.col("mono_depth")
    good = is_finite(y, x) & (y > min_depth) & (y < max_depth) & (x > 1e-4)
    return good if conf is None else good & (F.col("depth_conf") >= conf)


def _solve(rows: DataFrame, weight: Column) -> DataFrame:
    """Weighted straight line per frame from five sums."""
    x, y = F.col("mono_depth"), F.col("depth")
    sums = rows.groupBy(*FRAME).agg(
        F.sum(weight).alias("_w"), F.sum(weight * x).alias("_x"), F.sum(weight * x * x).alias("_xx"),
        F.sum(weight * y).alias("_y"), F.sum(weight * x * y).alias("_xy"),
    )
    w, sx, sxx, sy, sxy = (F.col(c) for c in ("_w", "_x", "_xx", "_y", "_xy"))
    spread = w * sxx - sx * sx
    flat = spread <= 1e-12 * w * sxx
    # All x equal: the smallest solution of scale * x + shift = y.
    mean_x, mean_y = sx / w, sy / w
    scale = F.when(flat, mean_y * mean_x / (mean_x * mean_x + 1.0)).otherwise((w * sxy - sx * sy) / F.when(~flat, spread))
    solved = sums.withColumn("scale", scale)
    return solved.select(*FRAME, "scale", ((F.col("_y") - F.col("scale") * F.col("_x")) / F.col("_w")).alias("shift"))


def align_depth(
    depth: DataFrame,
    method: str = "robust",
    min_depth: float = 0.1,
    max_depth: float = 100.0,
    conf: float | None = 1.0,
    min_valid: int = 100,
) -> DataFrame:
    """Scale and shift of the second map per frame; identity without enough pixels.

    The robust method reweights three times by the residual over its median; the
    weights act on both sides of the system, so their squares enter the sums.
    """
    rows = cut(depth.filter(_usable(min_depth, max_depth, conf)).select(*FRAME, "depth", "mono_depth"))
    sizes = rows.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_valid)
    rows = rows.join(sizes.select(*FRAME), FRAME, "left_semi")
    large = crowded(rows, FRAME)
    if method == "median_ratio":
        ratio = rows.withColumn("_ratio", F.col("depth") / (F.col("mono_depth") + 1e-8))
        line = quantiles(ratio, FRAME, "_ratio", {"scale": 0.5}, large=large).withColumn("shift", F.lit(0.0))
    else:
        line = cut(_solve(rows, F.lit(1.0)))
        for _ in range(3):
            residual = F.abs(F.col("mono_depth") * F.col("scale") + F.col("shift") - F.col("depth"))
            judged = rows.join(line, FRAME).withColumn("_r", residual).drop("scale", "shift")
            middle = quantiles(judged, FRAME, "_r", {"_med": 0.5}, large=large)
            weight = 1.0 / F.greatest(F.lit(1.0), F.col("_r") / (1.345 * (F.col("_med") + 1e-6)))
            line = cut(_solve(judged.join(middle, FRAME), weight * weight))
        line = line.withColumn("scale", F.greatest(F.lit(1e-4), "scale"))
    every = depth.select(*FRAME).distinct()
    return every.join(line, FRAME, "left").select(
        *FRAME, F.coalesce("scale", F.lit(1.0)).alias("scale"), F.coalesce("shift", F.lit(0.0)).alias("shift"),
        F.col("scale").isNotNull().alias("is_aligned"),
    )


def apply_alignment(depth: DataFrame, line: DataFrame, min_depth: float = 0.1, max_depth: float = 100.0) -> DataFrame:
    """Aligned second map, clipped; a frame left at identity keeps its raw values."""
    moved = clip(F.col("scale") * F.col("mono_depth") + F.col("shift"), min_depth, max_depth)
    return depth.join(line, FRAME).withColumn(
        "aligned_depth", F.when(F.col("is_aligned"), moved).otherwise(F.col("mono_depth"))
    )


def align_residual(
    depth: DataFrame, line: DataFrame, min_depth: float = 0.1, max_depth: float = 100.0, conf: float | None = 1.0
) -> DataFrame:
    """Root mean square residual and valid share of the alignment of each frame."""
    good = _usable(min_depth, max_depth, conf)
    applied = apply_alignment(depth, line, min_depth, max_depth)
    miss = F.col("aligned_depth") - F.col("depth")
    return applied.groupBy(*FRAME).agg(
        F.first("is_aligned").alias("_ok"),
        F.sqrt(F.avg(F.when(good, miss * miss))).alias("_rmse"),
        (F.count_if(good) / F.count(F.lit(1))).alias("valid_pixel_ratio"),
    ).select(
        *FRAME, F.when(F.col("_ok"), settled(F.col("_rmse"), 5)).otherwise(F.lit(0.0)).alias("residual_rmse"),
        settled(F.col("valid_pixel_ratio"), 6).alias("valid_pixel_ratio"),
    )


def consistency(applied: DataFrame, sigma: float = 0.5, max_diff: float = 5.0) -> DataFrame:
    """Absolute difference of both maps and its agreement score per pixel."""
    raw = F.abs(F.col("depth") - F.col("aligned_depth"))
    diff = F.when(is_finite(raw), raw).otherwise(F.lit(max_diff))
    return applied.withColumn("abs_diff", diff).withColumn(
        "agreement", F.exp(-F.col("abs_diff") / (sigma + 1e-6))
    )


def consistency_stats(scored: DataFrame) -> DataFrame:
    """Mean, median and share of high agreement over the valid pixels of each frame."""
    valid = scored.filter(
        (F.col("depth") > 0.1) & (F.col("aligned_depth") > 0.1) & ~F.isnan("depth") & (F.col("depth_conf") > 0.5)
    )
    middle = quantiles(valid, FRAME, "abs_diff", {"_med": 0.5})
    sums = valid.groupBy(*FRAME).agg(
        F.avg("abs_diff").alias("_mean"), (F.count_if(F.col("agreement") > 0.6) / F.count(F.lit(1)) * 100.0).alias("_high")
    )
    zero = F.lit(0.0)
    every = scored.select(*FRAME).distinct()
    return every.join(sums, FRAME, "left").join(middle, FRAME, "left").select(
        *FRAME,
        settled(F.coalesce("_mean", zero), 5).alias("mean_difference"),
        settled(F.coalesce("_med", zero), 5).alias("median_difference"),
        settled(F.coalesce("_high", zero), 4).alias("high_consistency_pct"),
    )


def fuse_confidence(scored: DataFrame, own_weight: float = 0.6, other_weight: float = 0.4) -> DataFrame:
    """Normalised depth confidence blended with the agreement, per pixel."""
    span = scored.groupBy(*FRAME).agg(F.min("depth_conf").alias("_lo"), F.max("depth_conf").alias("_hi"))
    lo, hi = F.col("_lo"), F.col("_hi")
    scaled = F.when(hi > lo, (F.col("depth_conf") - lo) / F.when(hi > lo, hi - lo)).otherwise(F.lit(1.0))
    return scored.join(span, FRAME).withColumn(
        "fused_conf", own_weight * scaled + other_weight * F.col("agreement")
    ).drop("_lo", "_hi")
