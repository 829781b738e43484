"""Sources: frame manifests, clip metadata, detection and hard-case files."""

from __future__ import annotations

import os
import re
from functools import reduce

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.functions.numeric import half_even
from skysift.lineage import cut, fan_out, is_empty
from skysift.operators.ordering import numbered
from skysift.schemas import DETECTION, HARD_CASE

# File extensions of frames and clips.
IMAGES = ("jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp")
CLIPS = ("mp4", "avi", "mov", "mkv", "webm", "m4v")


def number_by_path(files: DataFrame) -> DataFrame:
    """Frame numbers per mission in path order, for any number of files.

    Files are range-partitioned by path once; the partition serves as the block.
    """
    spread = cut(files.repartitionByRange("mission", "path").withColumn("_at", F.spark_partition_id()))
    return numbered(spread, ["mission"], F.col("_at"), [F.col("path")], "frame_idx", start=0).drop("_at")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, length`` of all files below ``path``: folders are listed by tasks, level by level, so no listing reaches the driver.

    Names that begin with a dot or an underscore are left out, as Spark's readers do.
    """
    start = path if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path) else os.path.abspath(path)
    store, root = fs.FileSystem.from_uri(start)
    prefix = "file:" if store.type_name == "local" else start[: start.rindex(root)] if root in start else ""

    def listed(batches):
        store, _ = fs.FileSystem.from_uri(start)
        for batch in batches:
            for folder in batch["path"]:
                found = store.get_file_info(fs.FileSelector(folder))
                rows = [(x.path, x.size or 0, x.type == fs.FileType.Directory) for x in found if not x.base_name.startswith((".", "_"))]
                yield pd.DataFrame(rows, columns=["path", "length", "folder"]).astype({"path": object, "length": "int64", "folder": bool})

    todo, files = spark.createDataFrame([(root,)], "path string"), []
    while not is_empty(todo):
        level = cut(fan_out(todo, "path").mapInPandas(listed, "path string, length long, folder boolean"))
        files.append(level.filter(~F.col("folder")))
        todo = level.filter("folder").select("path")
    return reduce(DataFrame.unionByName, files).select(F.concat(F.lit(prefix), "path").alias("path"), "length")


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Manifest of the images and clips below ``path``; file contents stay unread.

    The parent folder names the mission.
    """
    listed = list_files(spark, path)
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    known = listed.withColumn("_ext", suffix).filter(F.col("_ext").isin(*IMAGES, *CLIPS))
    named = known.select(
        F.element_at(F.split("path", "/"), -2).alias("mission"), "path",
        F.when(F.col("_ext").isin(*CLIPS), F.lit("clip")).otherwise(F.lit("image")).alias("kind"),
        F.col("length").alias("size_bytes"),
    )
    name = F.format_string("frame_%05d.jpg", F.col("frame_idx"))
    return number_by_path(named).withColumn("name", name)


def sample_folder(frames: DataFrame, max_frames: int, key: str = "mission_id") -> DataFrame:
    """Every n-th frame of a folder, at most ``max_frames`` of each mission."""
    sizes = frames.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    step = F.when(F.col("_n") > max_frames, F.greatest(F.lit(1), F.floor(F.col("_n") / max_frames))).otherwise(F.lit(1))
    at = F.col("frame_idx")
    return frames.join(sizes, key).filter((at % step == 0) & (at / step < max_frames)).drop("_n")


def sample_clip(frames: DataFrame, fps: Column, target_fps: float, max_frames: int, min_gap: int = 1, key: str = "mission_id") -> DataFrame:
    """Frames of a clip thinned to a target rate, at most ``max_frames`` each."""
    slower = (F.lit(target_fps) > 0) & (F.lit(target_fps) < fps)
    interval = F.when(slower, F.greatest(F.lit(min_gap), F.rint(fps / F.lit(target_fps)))).otherwise(F.lit(max(1, min_gap)))
    at = F.col("frame_idx")
    return frames.filter((at % interval == 0) & (at / interval < max_frames))


def clip_summary(frames: DataFrame, fps: Column, key: str = "mission_id") -> DataFrame:
    """Frames, duration, resolution and size of each clip.

    Reads ``width, height, size_bytes`` of the frames.
    """
    stats = frames.withColumn("_fps", fps).groupBy(key).agg(
        F.count(F.lit(1)).alias("frame_count"), F.max("_fps").alias("_fps"), F.max("width").alias("_w"),
        F.max("height").alias("_h"), F.sum("size_bytes").alias("_bytes"),
    )
    duration = F.when(F.col("_fps") > 0, F.col("frame_count") / F.col("_fps")).otherwise(F.lit(0.0))
    return stats.select(
        key, "frame_count",
        half_even(F.col("_fps"), 2).alias("fps"),
        half_even(duration, 2).alias("duration_seconds"),
        F.concat(F.col("_w").cast("string"), F.lit("x"), F.col("_h").cast("string")).alias("resolution"),
        half_even(F.col("_bytes") / (1024 * 1024), 2).alias("file_size_mb"),
    )


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DETECTION).option("recursiveFileLookup", True).json(path)


def read_hard_cases(spark: SparkSession, path: str) -> DataFrame:
    """Hard-case records: one JSON document per file, or one per line."""
    return (
        spark.read.schema(HARD_CASE).option("multiLine", True).option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json").json(path)
    )
