"""Colour-space expressions on 8-bit pixel columns ``b, g, rd``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_hsv(df: DataFrame) -> DataFrame:
    """Hue 0-179, saturation and value 0-255, and luma, from blue, green, red."""
    b, g, r = F.col("b"), F.col("g"), F.col("rd")
    top, low = F.greatest(b, g, r), F.least(b, g, r)
    span = (top - low).cast("double")
    safe = F.when(span > 0, span)
    degrees = (
        F.when(span == 0, F.lit(0.0))
        .when(top == r, 60.0 * (g - b) / safe)
        .when(top == g, 120.0 + 60.0 * (b - r) / safe)
        .otherwise(240.0 + 60.0 * (r - g) / safe)
    )
    turned = F.when(degrees < 0, degrees + 360.0).otherwise(degrees)
    hue = F.floor(turned / 2.0 + 0.5)
    return df.withColumns(
        {
            "h": F.when(hue >= 180, hue - 180).otherwise(hue),
            "s": F.when(top > 0, F.floor(255.0 * span / F.when(top > 0, top) + 0.5)).otherwise(
                F.lit(0).cast("long")
            ),
            "v": top,
            "luma": F.floor(0.299 * r + 0.587 * g + 0.114 * b + 0.5),
        }
    )


def sky_flag() -> Column:
    h, s, v = F.col("h"), F.col("s"), F.col("v")
    cloud = (v > 190) & (s < 60)
    blue = h.between(85, 135) & (v > 140) & (s >= 30)
    return cloud | blue


def water_colour() -> Column:
    """Blue water with a blue tendency, or turbid brown water."""
    h, s, v = F.col("h"), F.col("s"), F.col("v")
    blue = h.between(80, 135) & (s >= 25) & v.between(30, 245) & (F.col("b") >= F.col("rd") - 10)
    turbid = h.between(6, 35) & s.between(15, 220) & v.between(35, 230)
    return blue | turbid


def fire_colour() -> Column:
    return (F.col("h") <= 25) & (F.col("s") >= 120) & (F.col("v") >= 200)
