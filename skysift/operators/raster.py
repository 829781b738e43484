"""Pixel operators: stencils, frame statistics, fingerprints, masks.

``pixels`` has one row per pixel: ``mission_id, frame_idx, r, c`` plus colours,
flags or depth.  Stencils work on image rows as arrays: neighbours in the row by index, in the rows above and below by a
window over rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysift.functions.colour import fire_colour, sky_flag, to_hsv, water_colour
from skysift.functions.numeric import clip, half_even, norm, settled
from skysift.operators.ordering import quantiles

FRAME = ["mission_id", "frame_idx"]


def image_rows(pixels: DataFrame, frame: list[str] = FRAME) -> DataFrame:
    """One row per image row: ``c0``, its first column, and ``px``, its pixels from there on (null where one is missing).

    Pixels of an image row that lie together in the input are packed before the shuffle.
    """
    others = [c for c in pixels.columns if c not in (*frame, "r", "c")]
    packed = pixels.groupBy(*frame, "r").agg(F.array_sort(F.collect_list(F.struct("c", *others))).alias("px"))
    first, last = F.col("px")[0]["c"], F.element_at("px", -1)["c"]
    filled = F.transform(F.sequence(first, last), lambda c: F.get(F.filter("px", lambda p: p["c"] == c), 0))
    whole = F.size("px") == last - first + 1
    return packed.select(*frame, "r", first.alias("c0"), F.when(whole, F.col("px")).otherwise(filled).alias("px"))


def pixels_of(rows: DataFrame, columns: list[str], made: dict[str, str], frame: list[str] = FRAME) -> DataFrame:
    """Back to one row per pixel: ``columns``, and for each array column of ``made`` its value under the new name."""
    zipped = F.explode(F.arrays_zip("px", *[F.col(a) for a in made])).alias("_p")
    flat = rows.select(*frame, "r", zipped).filter(F.col("_p.px").isNotNull())
    inner = [c for c in columns if c not in (*frame, "r")]
    return flat.select(*frame, "r", *[F.col("_p.px")[c].alias(c) for c in inner], *[F.col("_p")[a].alias(n) for a, n in made.items()]).select(*columns, *made.values())


def _sides(values: Column, i: Column, own: Column) -> tuple[Column, Column]:
    """Left and right neighbour in an array, mirrored at the border."""
    left, right = F.get(values, i - 1), F.get(values, i + 1)
    return F.coalesce(left, right, own), F.coalesce(right, left, own)


def with_neighbour_rows(rows: DataFrame, columns: list[str], frame: list[str] = FRAME) -> DataFrame:
    """The rows above and below as structs ``_up`` and ``_down`` with ``c0`` and the array columns."""
    down_the_frame = Window.partitionBy(*frame).orderBy("r")
    row = F.struct("c0", *columns)
    return rows.withColumns({"_up": F.lag(row).over(down_the_frame), "_down": F.lead(row).over(down_the_frame)})


def _above_below(column: str, i: Column, own: Column) -> tuple[Column, Column]:
    """Neighbours in the rows above and below, mirrored at the border."""
    at = lambda row: F.get(F.col(row)[column], (i + F.col("c0") - F.col(row)["c0"]).cast("int"))
    up, down = at("_up"), at("_down")
    return F.coalesce(up, down, own), F.coalesce(down, up, own)


def laplacian(pixels: DataFrame, value: str = "gray") -> DataFrame:
    """3x3 Laplacian; image rows are shuffled, never single pixels."""
    rows = image_rows(pixels).withColumn("_v", F.transform("px", lambda p: p[value]))

    def at(own: Column, i: Column) -> Column:
        left, right = _sides(F.col("_v"), i, own)
        up, down = _above_below("_v", i, own)
        return left + right + up + down - 4 * own

    full = with_neighbour_rows(rows, ["_v"]).withColumn("_lap", F.transform("_v", at))
    return pixels_of(full, pixels.columns, {"_lap": "laplacian"})


def gradient(pixels: DataFrame, value: str = "gray") -> DataFrame:
    """3x3 Sobel magnitude: smooth along one axis, difference along the other."""

    def across(own: Column, i: Column, values: Column) -> Column:
        left, right = _sides(values, i, own)
        return F.struct((right - left).alias("d"), (left + 2 * own + right).alias("s"))

    rows = image_rows(pixels).withColumn("_v", F.transform("px", lambda p: p[value]))
    rows = rows.withColumn("_row", F.transform("_v", lambda own, i: across(own, i, F.col("_v"))))

    def at(own: Column, i: Column) -> Column:
        up, down = _above_below("_row", i, own)
        gx = (up["d"] + 2 * own["d"] + down["d"]).cast("double")
        gy = (down["s"] - up["s"]).cast("double")
        return norm(gx, gy)

    full = with_neighbour_rows(rows, ["_row"]).withColumn("_size", F.transform("_row", at))
    return pixels_of(full, pixels.columns, {"_size": "gradient"})


def smooth_surface(pixels: DataFrame, threshold: float = 28.0) -> DataFrame:
    return gradient(pixels).withColumn("is_smooth", F.col("gradient") < threshold).drop("gradient")


def water_candidates(pixels: DataFrame, threshold: float = 28.0) -> DataFrame:
    """Blue or turbid colour on a smooth surface."""
    smooth = smooth_surface(to_hsv(pixels), threshold)
    return smooth.withColumn("is_candidate", water_colour() & F.col("is_smooth"))


def edge_density(pixels: DataFrame, half: int = 12) -> DataFrame:
    """Mean of the edge flag over a square window, cut off at the border."""
    flag = lambda p: F.struct(F.coalesce(p["is_edge"].cast("long"), F.lit(0)).alias("s"), p["is_edge"].isNotNull().cast("long").alias("n"))
    none = F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("n"))
    plus = lambda a, b: F.struct((a["s"] + b["s"]).alias("s"), (a["n"] + b["n"]).alias("n"))
    rows = image_rows(pixels).withColumn("_f", F.transform("px", flag))

    def across(_, i: Column) -> Column:
        low = F.greatest(F.lit(0), i - half)
        window = F.slice("_f", low + 1, i + half + 1 - low)
        return F.aggregate(window, none, plus)

    summed = rows.withColumn("_h", F.transform("_f", across))
    around = Window.partitionBy(*FRAME).orderBy("r").rowsBetween(-half, half)
    stacked = summed.withColumn("_stack", F.collect_list(F.struct("c0", "_h")).over(around))

    def density(_, i: Column) -> Column:
        at = lambda row: F.coalesce(F.get(row["_h"], (i + F.col("c0") - row["c0"]).cast("int")), none)
        total = F.aggregate("_stack", none, lambda acc, row: plus(acc, at(row)))
        return total["s"] / total["n"]

    full = stacked.withColumn("_density", F.transform("_h", density))
    return pixels_of(full, pixels.columns, {"_density": "edge_density"})


def frame_rows(pixels: DataFrame) -> DataFrame:
    """Sums of each image row; all frame statistics follow from these few rows.

    Reads ``gray`` and ``b, g, rd``; sums are integers, so their order is free.
    """
    full = laplacian(to_hsv(pixels))
    gray, lap = F.col("gray"), F.col("laplacian")
    return full.groupBy(*FRAME, "r").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(gray).alias("s1"),
        F.sum(gray * gray).alias("s2"),
        F.sum(lap).alias("l1"),
        F.sum(lap * lap).alias("l2"),
        F.count_if(gray < 12).alias("under"),
        F.count_if(gray > 245).alias("over"),
        F.count_if(sky_flag()).alias("sky"),
    )


def exposure(rows: DataFrame) -> DataFrame:
    total = rows.groupBy(*FRAME).agg(*[F.sum(c).alias(c) for c in ("n", "s1", "s2", "under", "over")])
    mean = F.col("s1") / F.col("n")
    return total.select(
        *FRAME,
        half_even(mean, 2).alias("mean_brightness"),
        settled(F.sqrt(F.col("s2") / F.col("n") - mean * mean), 2).alias("std_contrast"),
        half_even(F.col("under") / F.col("n"), 4).alias("underexposed_ratio"),
        half_even(F.col("over") / F.col("n"), 4).alias("overexposed_ratio"),
    )


def sharpness(rows: DataFrame) -> DataFrame:
    """Variance of the Laplacian."""
    total = rows.groupBy(*FRAME).agg(*[F.sum(c).alias(c) for c in ("n", "l1", "l2")])
    mean = F.col("l1") / F.col("n")
    return total.select(*FRAME, (F.col("l2") / F.col("n") - mean * mean).alias("sharpness"))


def sky_ratio(rows: DataFrame, upper: float = 0.7) -> DataFrame:
    """Sky pixels in the upper part of the frame over all pixels."""
    heights = rows.groupBy(*FRAME).agg((F.max("r") + 1).alias("_h"), F.sum("n").alias("_n"))
    above = rows.join(heights, FRAME).groupBy(*FRAME).agg(
        F.sum(F.when(F.col("r") < F.floor(F.col("_h") * upper), F.col("sky")).otherwise(F.lit(0))).alias("_sky"),
        F.max("_n").alias("_n"),
    )
    return above.select(*FRAME, half_even(F.col("_sky") / F.col("_n"), 4).alias("sky_ratio"))


def quality(pixels: DataFrame) -> DataFrame:
    """Frame quality: sharpness, exposure, sky, composite score and validity."""
    rows = frame_rows(pixels)
    joined = exposure(rows).join(sharpness(rows), FRAME).join(sky_ratio(rows), FRAME)
    sharp, under, over = F.col("sharpness"), F.col("underexposed_ratio"), F.col("overexposed_ratio")
    score = (
        F.least(F.lit(60.0), F.log1p(sharp) * 8.0)
        + 40.0
        - (under + over) * 50.0
        - F.abs(F.col("mean_brightness") - 128.0) / 128.0 * 15.0
        - F.greatest(F.lit(0.0), F.col("sky_ratio") - 0.4) * 25.0
    )
    return joined.withColumns(
        {
            "is_valid": (sharp > 20.0) & (under < 0.25) & (over < 0.35),
            "quality_score": settled(clip(score, 0.0, 100.0), 2),
            "sharpness": settled(sharp, 2),
        }
    )


def fingerprint(pixels: DataFrame, grid: int = 16) -> DataFrame:
    """Colour histogram (8x4x4) and luminance grid, each and together of unit length."""
    hsv = to_hsv(pixels)
    sizes = pixels.groupBy(*FRAME).agg((F.max("r") + 1).alias("_h"), (F.max("c") + 1).alias("_w"))
    bin_of = F.floor(F.col("h") / 22.5) * 16 + F.floor(F.col("s") / 64) * 4 + F.floor(F.col("v") / 64)
    cell_of = F.floor(F.col("r") * grid / F.col("_h")) * grid + F.floor(F.col("c") * grid / F.col("_w"))
    parts = F.array(
        F.struct(F.lit(0).alias("part"), bin_of.alias("slot"), F.lit(1).cast("long").alias("v")),
        F.struct(F.lit(1).alias("part"), cell_of.alias("slot"), F.col("gray").cast("long").alias("v")),
    )
    slots = (
        hsv.join(sizes, FRAME)
        .select(*FRAME, F.explode(parts).alias("p"))
        .groupBy(*FRAME, "p.part", "p.slot")
        .agg(F.sum("p.v").alias("s"), F.count(F.lit(1)).alias("n"))
    )
    value = F.when(F.col("part") == 0, F.col("n").cast("double")).otherwise(F.col("s") / F.col("n") / 255.0)
    maps = slots.withColumn("value", value).groupBy(*FRAME).agg(
        *[
            F.map_from_entries(F.collect_list(F.when(F.col("part") == p, F.struct("slot", "value")))).alias(f"_m{p}")
            for p in (0, 1)
        ]
    )

    def dense(name: str, size: int) -> Column:
        return F.transform(
            F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long")),
            lambda i: F.coalesce(F.element_at(F.col(name), i), F.lit(0.0)),
        )

    def unit(vector: Column, guard: float) -> Column:
        length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x)) + F.lit(guard)
        return F.transform(F.arrays_zip(vector.alias("x"), F.array_repeat(length, F.size(vector)).alias("n")), lambda z: z["x"] / z["n"])

    filled = maps.select(*FRAME, dense("_m0", 128).alias("_a"), dense("_m1", grid * grid).alias("_b"))
    halves = filled.select(*FRAME, unit(F.col("_a"), 0.0).alias("_a"), unit(F.col("_b"), 1e-7).alias("_b"))
    whole = halves.select(*FRAME, F.concat("_a", "_b").alias("_f"))
    return whole.select(*FRAME, unit(F.col("_f"), 1e-7).alias("fingerprint"))


def cosine(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def mask_stats(pixels: DataFrame, flag: str = "is_water") -> DataFrame:
    """Share and centroid of the flagged pixels of each frame."""
    on = F.col(flag)
    return pixels.groupBy(*FRAME).agg(
        F.count(F.lit(1)).alias("pixels"),
        F.count_if(on).alias("flagged"),
        half_even(F.count_if(on) / F.count(F.lit(1)), 6).alias("ratio"),
        settled(F.avg(F.when(on, F.col("r"))), 4).alias("centroid_r"),
        settled(F.avg(F.when(on, F.col("c"))), 4).alias("centroid_c"),
    )


def fire_ratio(pixels: DataFrame) -> DataFrame:
    return to_hsv(pixels).groupBy(*FRAME).agg(
        half_even(F.count_if(fire_colour()) / F.count(F.lit(1)), 6).alias("fire_ratio")
    )


def mask_points(mask: DataFrame, points: DataFrame, mask_size: tuple[int, int], map_size: tuple[int, int]) -> DataFrame:
    """Point-map pixels whose nearest mask pixel is flagged; sizes are (rows, columns)."""
    mr = F.floor(F.col("r") * mask_size[0] / map_size[0])
    mc = F.floor(F.col("c") * mask_size[1] / map_size[1])
    flagged = mask.filter("is_water").select(*FRAME, F.col("r").alias("_mr"), F.col("c").alias("_mc"))
    return points.withColumns({"_mr": mr, "_mc": mc}).join(flagged, [*FRAME, "_mr", "_mc"], "left_semi").drop("_mr", "_mc")


def stretch(pixels: DataFrame, value: str = "depth") -> DataFrame:
    """Percentile stretch (2nd to 98th) of the positive values of each frame."""
    limits = quantiles(pixels.filter(F.col(value) > 0), FRAME, value, {"p2": 0.02, "p98": 0.98})
    spread = (F.col(value) - F.col("p2")) / (F.col("p98") - F.col("p2") + 1e-6)
    return pixels.join(limits, FRAME).withColumn("stretched", clip(spread, 0.0, 1.0))
