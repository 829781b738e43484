"""Windowed roll-ups of detections and flood states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.operators.detect import history_class


def _window(size: str, slide: str | None) -> Column:
    return F.window("ts", size, slide) if slide else F.window("ts", size)


def class_rollup(det: DataFrame, size: str = "10 minutes", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Class votes of each mission and window; works on streams and tables."""
    return (
        det.withWatermark("ts", delay)
        .groupBy(_window(size, slide).alias("w"), "mission_id", history_class(F.col("raw_class")).alias("cls"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg("conf").alias("mean_conf"), F.max("conf").alias("max_conf"))
        .select(F.col("w.start").alias("window_start"), "mission_id", "cls", "n", "mean_conf", "max_conf")
    )


def flood_rollup_stream(flood: DataFrame, size: str = "10 minutes", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Flood summary of each mission and window."""
    state = F.col("water_state")
    return (
        flood.withWatermark("ts", delay)
        .groupBy(_window(size, slide).alias("w"), "mission_id")
        .agg(
            F.max("water_ratio").alias("max_ratio"),
            F.count_if(state == "VALIDATED_INUNDATION").alias("validated_frames"),
            F.count_if(state == "POTENTIAL_INUNDATION").alias("potential_frames"),
        )
        .select(F.col("w.start").alias("window_start"), "mission_id", "max_ratio", "validated_frames", "potential_frames")
    )


def mission_sessions(det: DataFrame, gap: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Flights of each source, parted by a gap without detections."""
    return (
        det.withWatermark("ts", delay)
        .groupBy(F.session_window("ts", gap).alias("w"), "source")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("source", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")
    )
