"""Bounding-box expressions: clipping, metrics, overlap, relabelling, tiling.

Boxes are the four columns ``x1, y1, x2, y2`` of a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.config import VEHICLE_CLASSES
from skysift.functions.numeric import clip, half_even, truncate


def box_columns(prefix: str = "") -> list[Column]:
    return [F.col(prefix + name) for name in ("x1", "y1", "x2", "y2")]


def normalize_class(df: DataFrame) -> DataFrame:
    """Canonical class plus the detection label of the raw class."""
    raw = F.col("raw_class")
    vehicle = raw.isin(*VEHICLE_CLASSES)
    return df.withColumns(
        {
            "class_name": F.when(vehicle, F.lit("vehicle")).otherwise(raw),
            "detection_label": F.when(raw == "person", F.lit("PERSON_DETECTED"))
            .when(vehicle, F.concat(F.lit("VEHICLE_"), F.upper(raw)))
            .otherwise(F.upper(raw)),
        }
    )


def confidence_gate(df: DataFrame, conf: float = 0.08, person_conf: float = 0.08) -> DataFrame:
    bar = F.when(F.col("raw_class") == "person", F.lit(person_conf)).otherwise(F.lit(conf))
    return df.filter(F.col("conf") >= bar)


def bbox_to_frame(
    df: DataFrame,
    scale_x: Column,
    scale_y: Column,
    offset_x: Column,
    offset_y: Column,
) -> DataFrame:
    """Tile coordinates to frame coordinates, clamped to the frame and ordered."""
    width, height = F.col("image_width").cast("double"), F.col("image_height").cast("double")
    fx1 = clip(F.col("x1") * scale_x + offset_x, 0.0, width)
    fy1 = clip(F.col("y1") * scale_y + offset_y, 0.0, height)
    fx2 = F.greatest(fx1, F.least(width, F.col("x2") * scale_x + offset_x))
    fy2 = F.greatest(fy1, F.least(height, F.col("y2") * scale_y + offset_y))
    return df.withColumns(
        {
            "fx1": half_even(fx1, 2),
            "fy1": half_even(fy1, 2),
            "fx2": half_even(fx2, 2),
            "fy2": half_even(fy2, 2),
        }
    )


def clip_box(df: DataFrame, offset_x: Column | None = None, offset_y: Column | None = None) -> DataFrame:
    """Detector box to integer image box with width, height, centre and area."""
    ox = offset_x if offset_x is not None else F.lit(0)
    oy = offset_y if offset_y is not None else F.lit(0)
    width, height = F.col("image_width"), F.col("image_height")
    x1 = truncate(clip((F.col("x1") + ox).cast("double"), 0.0, (width - 1).cast("double")))
    y1 = truncate(clip((F.col("y1") + oy).cast("double"), 0.0, (height - 1).cast("double")))
    x2 = truncate(clip((F.col("x2") + ox).cast("double"), 0.0, (width - 1).cast("double")))
    y2 = truncate(clip((F.col("y2") + oy).cast("double"), 0.0, (height - 1).cast("double")))
    sized = df.withColumns({"x1": x1, "y1": y1, "x2": x2, "y2": y2}).withColumns(
        {
            "bw": F.greatest(F.lit(1), F.col("x2") - F.col("x1")),
            "bh": F.greatest(F.lit(1), F.col("y2") - F.col("y1")),
        }
    )
    return sized.withColumns(
        {
            "cx": truncate(F.col("x1") + F.col("bw") / 2.0),
            "cy": truncate(F.col("y1") + F.col("bh") / 2.0),
            "area": F.col("bw") * F.col("bh"),
        }
    )


def bbox_metrics(df: DataFrame) -> DataFrame:
    """Width and height of at least one, area, long-to-short aspect."""
    sized = df.withColumns(
        {
            "bw": F.greatest(F.lit(1), F.col("x2") - F.col("x1")),
            "bh": F.greatest(F.lit(1), F.col("y2") - F.col("y1")),
        }
    )
    return sized.withColumns(
        {
            "area": F.col("bw") * F.col("bh"),
            "aspect": F.greatest(F.col("bw") / F.col("bh"), F.col("bh") / F.col("bw")),
        }
    )


def overlap_plus_one(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union with inclusive pixel edges."""
    iw = F.greatest(F.lit(0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]) + 1)
    ih = F.greatest(F.lit(0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]) + 1)
    inter = iw * ih
    area_a = (a[2] - a[0] + 1) * (a[3] - a[1] + 1)
    area_b = (b[2] - b[0] + 1) * (b[3] - b[1] + 1)
    return inter / (area_a + area_b - inter + F.lit(1e-6))


def overlap(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union with exclusive edges and a union of at least one."""
    iw = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    ih = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    inter = iw * ih
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    ratio = inter / F.greatest(F.lit(1.0), union.cast("double"))
    return F.when((iw > 0) & (ih > 0), ratio).otherwise(F.lit(0.0))


def anti_boat(df: DataFrame) -> DataFrame:
    """Boats as large or as square as roofs become buildings; raw fields stay."""
    area = F.col("bw") * F.col("bh")
    shape = F.col("bw") / (F.col("bh") + F.lit(1e-6))
    boat = F.col("raw_class") == "boat"
    roof = boat & ((area > 2000) | (shape.between(0.5, 2.0) & (area > 800)))
    return df.withColumns(
        {
            "class_name": F.when(roof, F.lit("building")).otherwise(F.col("class_name")),
            "validated_conf": F.when(roof, F.lit(0.0)).otherwise(F.col("conf")),
            "note": F.when(
                roof, F.lit("COCO boat misclassification remapped to flooded structure roof.")
            ),
        }
    )


def margin_box(df: DataFrame, ratio: float = 0.15) -> DataFrame:
    """Context crop: the box grown by a share of its size, inside the image."""
    mx = truncate(F.greatest(F.lit(1), F.col("x2") - F.col("x1")) * F.lit(ratio))
    my = truncate(F.greatest(F.lit(1), F.col("y2") - F.col("y1")) * F.lit(ratio))
    return df.withColumns(
        {
            "crop_x1": F.greatest(F.lit(0), F.col("x1") - mx),
            "crop_y1": F.greatest(F.lit(0), F.col("y1") - my),
            "crop_x2": F.least(F.col("image_width"), F.col("x2") + mx),
            "crop_y2": F.least(F.col("image_height"), F.col("y2") + my),
        }
    )


def tiles(frames: DataFrame, tile: int = 640, overlap_ratio: float = 0.20) -> DataFrame:
    """One row per tile of each frame; the last tile sits flush with the edge."""
    step = int(tile * (1.0 - overlap_ratio))

    def starts(size: Column) -> Column:
        last = F.greatest(F.lit(0), size - tile).cast("long")
        regular = F.sequence(F.lit(0).cast("long"), last, F.lit(step).cast("long"))
        return F.array_union(regular, F.array(last))

    return (
        frames.withColumn("tile_y", F.explode(starts(F.col("image_height"))))
        .withColumn("tile_x", F.explode(starts(F.col("image_width"))))
        .withColumns(
            {
                "tile_x2": F.least(F.col("image_width"), F.col("tile_x") + tile),
                "tile_y2": F.least(F.col("image_height"), F.col("tile_y") + tile),
            }
        )
    )
