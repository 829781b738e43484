"""Nearest neighbours by a pyramid of cells.

Cells of all sizes know their number of points and a tight box.  A group of neighbouring points (a cell of the given size, or
a smaller one inside it where that is crowded) starts from the finest level whose 27 cells hold enough points, so its neighbours
lie within the 27 cells two levels up.  The boxes found there bound the distance to the k-th neighbour from above; boxes
beyond that bound go, and crowded or coarse ones are halved and bounded again.  Points are met once, in the boxes that
are left.  So an isolated group opens the near side of a distant crowd, not the crowd, and nothing but cells takes part in rounds.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skysift.lineage import cut, is_empty
from skysift.operators.spatial import ring

AXES = ("x", "y", "z")
INDEX = ["cx", "cy", "cz"]
GROUP = ["scene_id", "_level", *[f"_{c}" for c in INDEX]]
FINER = 3
HEAVY = 256


def _up(levels) -> list:
    """Indices of the cell that holds a cell, so many levels up."""
    return [F.call_function("shiftright", F.col(c), levels.cast("int")).alias(c) for c in INDEX]


def pyramid(places: DataFrame, levels: int) -> DataFrame:
    """Cells of every level with number, weight and tight box; level ``FINER`` has cells of the given size."""
    rows = places.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    corners = [f(c).alias(f"{n}_{c}") for c in AXES for n, f in (("lo", F.min), ("hi", F.max))]
    return rows.select("scene_id", "level", *AXES, "w", *_up(F.col("level"))).groupBy("scene_id", "level", *INDEX).agg(
        F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), *corners
    )


def _bounded(pairs: DataFrame, k: int) -> DataFrame:
    """Pairs of a group with boxes that may hold one of the ``k`` nearest points of some point of the group."""
    inner, outer = [], []
    for c in AXES:
        apart = F.greatest(F.lit(0.0), F.col(f"lo_{c}") - F.col(f"_hi_{c}"), F.col(f"_lo_{c}") - F.col(f"hi_{c}"))
        across = F.greatest(F.col(f"hi_{c}") - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"lo_{c}"))
        inner.append(apart * apart)
        outer.append(across * across)
    measured = pairs.withColumns({"gap": F.sqrt(inner[0] + inner[1] + inner[2]), "far": F.sqrt(outer[0] + outer[1] + outer[2])})
    nearer = Window.partitionBy(*GROUP).orderBy("far", "level", *INDEX).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = measured.withColumn("_held", F.sum("w").over(nearer))
    bound = F.min(F.when(F.col("_held") >= k, F.col("far"))).over(Window.partitionBy(*GROUP))
    return held.withColumn("_bound", bound).filter(F.col("_bound").isNull() | (F.col("gap") <= F.col("_bound"))).drop("gap", "far", "_held", "_bound")


def _means(k: int):
    def run(key: tuple, own: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        xyz, other = own[list(AXES)].to_numpy(float), near[list(AXES)].to_numpy(float)
        weight, out = near["w"].to_numpy(np.int64), np.zeros(len(own))
        step = max(1, 4_000_000 // max(1, len(other)))
        for i in range(0, len(xyz), step):
            d = np.sqrt(sum((xyz[i : i + step, None, j] - other[None, :, j]) ** 2 for j in range(3)))
            few = min(k, d.shape[1])
            first = np.argpartition(d, few - 1, axis=1)[:, :few]
            first = np.take_along_axis(first, np.argsort(np.take_along_axis(d, first, axis=1), axis=1, kind="stable"), axis=1)
            d, w = np.take_along_axis(d, first, axis=1), weight[first]
            taken = np.clip(k - (np.cumsum(w, axis=1) - w), 0, w)
            out[i : i + step] = (d * taken).sum(axis=1) / taken.sum(axis=1)
        return pd.DataFrame({"scene_id": key[0], **{c: xyz[:, j] for j, c in enumerate(AXES)}, "mean_distance": out})

    return run


def nearest_means(places: DataFrame, k: int) -> DataFrame:
    """``scene_id, x, y, z, mean_distance``: mean distance of each position to its ``k`` nearest points.

    ``places`` has distinct positions with weight ``w`` and ``size``, the cell size of the scene.
    """
    unit = F.col("size") / float(2**FINER)
    indexed = cut(places.select("scene_id", *AXES, "w", "size", *[F.floor(F.col(c) / unit).alias(i) for c, i in zip(AXES, INDEX, strict=True)]))
    spans = indexed.groupBy("scene_id").agg(*[(F.max(c) - F.min(c)).alias(c) for c in INDEX]).agg(F.max(F.greatest(*INDEX))).first()[0]
    if spans is None:
        return places.sparkSession.createDataFrame([], "scene_id long, x double, y double, z double, mean_distance double")
    # At the last level any two cells of a scene touch.
    levels = max(FINER, math.ceil(math.log2(spans + 1)) if spans else 0)
    nodes = cut(pyramid(indexed, levels))
    large = nodes.filter(F.col("level") >= FINER)
    around = ring(large.select("scene_id", "level", *INDEX, *[F.col(c).alias(f"_{c}") for c in INDEX]), INDEX).join(large.select("scene_id", "level", *INDEX, "w"), ["scene_id", "level", *INDEX])
    enough = around.groupBy("scene_id", "level", *[F.col(f"_{c}").alias(c) for c in INDEX]).agg(F.sum("w").alias("w")).filter(F.col("w") >= k).drop("w")
    # The finest level with enough points, for every cell of the given size.
    cells = large.filter(F.col("level") == FINER).select("scene_id", "n", *[F.col(c).alias(f"_{c}") for c in INDEX])
    climbing = cells.withColumn("level", F.explode(F.sequence(F.lit(FINER), F.lit(levels)))).select(
        "scene_id", "level", "n", *[f"_{c}" for c in INDEX], *[F.call_function("shiftright", F.col(f"_{c}"), F.col("level") - FINER).alias(c) for c in INDEX]
    )
    found = climbing.join(enough.withColumn("_ok", F.lit(True)), ["scene_id", "level", *INDEX], "left")
    starts = found.groupBy("scene_id", "n", *[f"_{c}" for c in INDEX]).agg(F.coalesce(F.min(F.when(F.col("_ok"), F.col("level"))), F.lit(levels)).alias("start"))
    home = starts.select("scene_id", "start", *[F.col(f"_{c}").alias(c) for c in INDEX])
    box = [f"{e}_{c}" for c in AXES for e in ("lo", "hi")]
    # A group is the largest cell, up to the given size, that is not crowded, or one of the finest cells; so it shares what it meets.
    upper = ["level", *[f"up_{c}" for c in INDEX]]
    small = nodes.filter(F.col("level") <= FINER).withColumns({f"up_{c}": F.call_function("shiftright", F.col(c), F.lit(1)) for c in INDEX})
    parted = nodes.filter(F.col("level").between(1, FINER) & (F.col("n") > HEAVY)).select("scene_id", (F.col("level") - 1).alias("level"), *[F.col(c).alias(f"up_{c}") for c in INDEX])
    held = small.filter(F.col("level") == FINER).unionByName(small.join(parted, ["scene_id", *upper], "left_semi").select(*small.columns))
    own = held.filter((F.col("n") <= HEAVY) | (F.col("level") == 0)).select(
        "scene_id", F.col("level").alias("_level"), *[F.col(c).alias(f"_{c}") for c in INDEX], *[F.col(c).alias(f"_{c}") for c in box],
        *[F.call_function("shiftright", F.col(c), F.lit(FINER) - F.col("level")).alias(c) for c in INDEX],
    )
    groups = own.join(home, ["scene_id", *INDEX])
    top = F.least(F.col("start") + 2, F.lit(levels))
    asking = groups.withColumn("_top", top).select(*GROUP, *[f"_{c}" for c in box], F.col("start").alias("level"), *[F.call_function("shiftright", F.col(c), F.col("_top") - FINER).alias(c) for c in INDEX])
    asking = ring(asking, INDEX).toDF(*[f"up_{c}" if c in INDEX else c for c in asking.columns])
    lifted = nodes.withColumn("_lift", F.least(F.lit(2), F.lit(levels) - F.col("level")))
    keyed = lifted.select("*", *[F.call_function("shiftright", F.col(c), F.col("_lift")).alias(f"up_{c}") for c in INDEX]).drop("_lift")
    ups = [f"up_{c}" for c in INDEX]
    pairs = _bounded(asking.join(keyed, ["scene_id", "level", *ups]).drop(*ups), k)
    split = (F.col("level") > FINER) | ((F.col("n") > HEAVY) & (F.col("level") > 0))
    done, children = None, nodes.select("scene_id", F.col("level").alias("_child"), "n", "w", *box, *INDEX, *[F.call_function("shiftright", F.col(c), F.lit(1)).alias(f"up_{c}") for c in INDEX])
    while True:
        pairs = cut(pairs)
        open_groups = cut(pairs.filter(split).select(*GROUP).distinct())
        whole = pairs.join(open_groups, GROUP, "left_anti")
        done = whole if done is None else done.unionByName(whole)
        if is_empty(open_groups):
            break
        rest = pairs.join(open_groups, GROUP, "left_semi")
        outer = [*GROUP, *[f"_{c}" for c in box]]
        parents = rest.filter(split).select(*outer, (F.col("level") - 1).alias("level"), *[F.col(c).alias(f"up_{c}") for c in INDEX])
        halves = parents.join(children.withColumnRenamed("_child", "level"), ["scene_id", "level", *ups]).drop(*ups)
        pairs = _bounded(rest.filter(~split).unionByName(halves.select(*rest.columns)), k)
    at_level = indexed.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(FINER)))).select("scene_id", "level", *AXES, "w", *_up(F.col("level")))
    near = done.select(*GROUP, "level", *INDEX).join(at_level, ["scene_id", "level", *INDEX]).select(*GROUP, *AXES, "w")
    members = at_level.select("scene_id", F.col("level").alias("_level"), *[F.col(c).alias(f"_{c}") for c in INDEX], *[F.col(c).alias(c) for c in AXES])
    mine = members.join(groups.select(*GROUP), GROUP, "left_semi")
    kinds = dict(places.dtypes)
    schema = f"scene_id {kinds['scene_id']}, x double, y double, z double, mean_distance double"
    return mine.groupBy(*GROUP).cogroup(near.select(*[F.col(c).alias(c) for c in near.columns]).groupBy(*GROUP)).applyInPandas(_means(k), schema)
