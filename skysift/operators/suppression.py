"""Class-aware non-maximum suppression.

Ordinary frames run as one array fold per (mission, frame, pool).  A pool with
more boxes than ``limit`` is walked: its boxes stream past the kept ones, best
first, after one sort.  One with more than ``walk`` never meets in one task: it is
settled in rounds, where a box is kept once it is the best of its grid
neighbourhood and then removes the boxes it overlaps.  All give the greedy result.
Detection ids need to be unique within a frame only.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.functions.boxes import overlap_plus_one
from skysift.lineage import cut, fan_out, is_empty

GROUP = ["mission_id", "frame_idx", "_person"]
BOX = ["x1", "y1", "x2", "y2"]


def nms(det: DataFrame, iou: float = 0.45, person_iou: float = 0.40, limit: int = 2048, walk: int = 65_536) -> DataFrame:
    """Greedy suppression by confidence; ties keep the higher detection id."""
    pooled = det.withColumn("_person", F.col("raw_class") == "person")
    sizes = cut(pooled.groupBy(*GROUP).count().filter(F.col("count") > limit))
    if is_empty(sizes):
        return _fold(pooled, iou, person_iou).drop("_person")
    out = _fold(pooled.join(sizes, GROUP, "left_anti"), iou, person_iou)
    middle = pooled.join(sizes.filter(F.col("count") <= walk), GROUP, "left_semi").select(*out.columns)
    out = out.unionByName(_walk(middle, iou, person_iou))
    hot = sizes.filter(F.col("count") > walk)
    if not is_empty(hot):
        crowd = pooled.join(hot, GROUP, "left_semi")
        kept = _rounds(crowd, iou, person_iou)
        out = out.unionByName(crowd.join(kept, [*GROUP, "det_id"], "left_semi").select(*out.columns))
    return out.drop("_person")


def _bar(iou: float, person_iou: float) -> Column:
    return F.when(F.col("_person"), F.lit(person_iou)).otherwise(F.lit(iou))


def _fold(pooled: DataFrame, iou: float, person_iou: float) -> DataFrame:
    item = F.struct(
        (-F.col("conf")).alias("_o1"), (-F.col("det_id")).alias("_o2"), *[F.col(c) for c in pooled.columns]
    )
    grouped = fan_out(pooled, *GROUP).groupBy(*GROUP).agg(F.array_sort(F.collect_list(item)).alias("_all"))
    empty = F.expr("filter(_all, x -> false)")

    def clash(a: Column, b: Column) -> Column:
        return overlap_plus_one([a[c] for c in BOX], [b[c] for c in BOX]) > _bar(iou, person_iou)

    kept = F.aggregate(
        "_all",
        empty,
        lambda acc, x: F.when(F.exists(acc, lambda k: clash(k, x)), acc).otherwise(
            F.concat(acc, F.array(x))
        ),
    )
    rows = grouped.select(F.explode(kept).alias("_row"))
    return rows.select(*[F.col("_row")[c].alias(c) for c in pooled.columns])


def _overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``overlap_plus_one`` of every box of ``a`` with every box of ``b``."""
    iw = np.maximum(0, np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0]) + 1)
    ih = np.maximum(0, np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1]) + 1)
    inter = iw * ih
    area = lambda x: (x[:, 2] - x[:, 0] + 1) * (x[:, 3] - x[:, 1] + 1)
    return inter / (area(a)[:, None] + area(b)[None, :] - inter + 1e-6)


def _greedy(boxes: np.ndarray, kept: list[np.ndarray], bar: float) -> np.ndarray:
    """Which of some boxes, best first, are kept beside the ``kept`` ones of their pool."""
    alive = np.ones(len(boxes), bool)
    for block in kept:
        alive &= ~(_overlaps(block, boxes) > bar).any(axis=0)
    clash = _overlaps(boxes, boxes) > bar
    for i in range(len(boxes)):
        if alive[i]:
            alive[i + 1 :] &= ~clash[i, i + 1 :]
    return alive


def _walk(pooled: DataFrame, iou: float, person_iou: float, piece: int = 128, block: int = 4096) -> DataFrame:
    """Greedy walk over the sorted boxes of each pool; a task holds the kept boxes of one pool and an Arrow batch."""

    def run(batches):
        here, kept, bar = None, [], 0.0
        for batch in batches:
            keys = list(zip(*[batch.column(name).to_pylist() for name in GROUP], strict=True))
            boxes = np.stack([batch.column(name).to_numpy(zero_copy_only=False).astype(float) for name in BOX], axis=1)
            starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            stay = np.zeros(len(keys), bool)
            for low, high in zip(starts, [*starts[1:], len(keys)], strict=True):
                if keys[low] != here:
                    here, kept, bar = keys[low], [], person_iou if keys[low][-1] else iou
                for at in range(low, high, piece):
                    part = boxes[at : min(high, at + piece)]
                    alive = _greedy(part, kept, bar)
                    stay[at : at + len(part)] = alive
                    if kept and len(kept[-1]) < block:
                        kept[-1] = np.concatenate([kept[-1], part[alive]])
                    else:
                        kept.append(part[alive])
            yield batch.filter(pa.array(stay))

    order = [(-F.col("conf")).asc(), (-F.col("det_id")).asc()]
    return fan_out(pooled, *GROUP).sortWithinPartitions(*GROUP, *order).mapInArrow(run, pooled.schema)


def _grids(df: DataFrame, bar: float, neighbours: bool) -> DataFrame:
    """Grid slots of each box.

    An overlap above ``bar`` bounds the ratio of the sides by ``1/bar`` and the
    centre offset by ``(1 - bar)`` of the longer side.  Levels grow by ``1/bar``,
    so a pair shares a level when each box enters its own level and the next.
    """
    base = 1.0 / bar
    level = lambda side: F.floor(F.log(side.cast("double")) / math.log(base))
    width, height = F.col("x2") - F.col("x1") + 1, F.col("y2") - F.col("y1") + 1
    out = df.withColumn("_lx", F.explode(F.array(level(width), level(width) + 1))).withColumn(
        "_ly", F.explode(F.array(level(height), level(height) + 1))
    )
    side = lambda lv: F.lit(1.0 - bar) * F.pow(F.lit(base), lv + 1) + 1.0
    out = out.withColumns(
        {
            "_gx": F.floor((F.col("x1") + F.col("x2")) / 2.0 / side(F.col("_lx"))),
            "_gy": F.floor((F.col("y1") + F.col("y2")) / 2.0 / side(F.col("_ly"))),
        }
    )
    if neighbours:
        for name in ("_gx", "_gy"):
            out = out.withColumn(name, F.explode(F.sequence(F.col(name) - 1, F.col(name) + 1)))
    return out


def _rounds(pooled: DataFrame, iou: float, person_iou: float) -> DataFrame:
    """Keep-and-remove rounds over grid cells; the work per round is linear."""
    bar = min(iou, person_iou)
    slots = [*GROUP, "_lx", "_ly", "_gx", "_gy"]
    score = F.struct(F.col("conf").alias("conf"), F.col("det_id").alias("det_id"))
    # Exact copies always lose to their best one, so one box stands for all of them.
    waiting = cut(pooled.groupBy(*GROUP, *BOX).agg(F.max(score).alias("_score")))
    kept = None
    while not is_empty(waiting):
        best = _grids(waiting, bar, False).groupBy(*slots).agg(F.max("_score").alias("_best"))
        around = (
            _grids(waiting, bar, True)
            .join(best, slots)
            .groupBy(*GROUP, *BOX, "_score")
            .agg(F.max("_best").alias("_best"))
        )
        winners = cut(around.filter(F.col("_best") == F.col("_score")).drop("_best"))
        near = _grids(winners, bar, True).select(
            *slots, F.col("_score").alias("_win"), *[F.col(c).alias("w" + c) for c in BOX]
        )
        a, b = [F.col("w" + c) for c in BOX], [F.col(c) for c in BOX]
        beaten = (
            _grids(waiting, bar, False)
            .join(near, slots)
            .filter(overlap_plus_one(a, b) > _bar(iou, person_iou))
            .select(*GROUP, "_score")
            .distinct()
        )
        done = beaten.unionByName(winners.select(*GROUP, "_score"))
        waiting = cut(waiting.join(done, [*GROUP, "_score"], "left_anti"))
        kept = winners if kept is None else kept.unionByName(winners)
    return kept.select(*GROUP, F.col("_score.det_id").alias("det_id"))
