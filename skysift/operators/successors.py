"""Sequential frame selection by successor pointers.

The state of the walk is the last selected frame alone, so a frame has one successor: the next frame that would be selected if
it were the last one.  Chains of successors are followed inside blocks of frames, all blocks at once.  A frame whose successor lies
beyond its block looks for it in a tree of blocks: a node knows a ball that holds all its fingerprints and the largest
sharpness, and is passed whole where nothing in the ball can be selected.  Pointers between blocks are then doubled until
every block knows the frame that is selected when it begins.  Rounds grow with the logarithm of the number of
blocks, and no task holds more than two blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysift.lineage import cut, fan_out, is_empty

SHARPER = 1.25
NODE = "mission_id long, level int, idx long, rep array<double>, angle double, low_norm double, sharp double"
VERDICT = "mission_id long, at long, verdict string, similarity double, against long"


def stacked(values: pd.Series) -> np.ndarray:
    """Fingerprints as a matrix; a missing one is all zeros and so like no other."""
    width = max((len(v) for v in values if v is not None), default=0)
    return np.stack([np.zeros(width) if v is None else np.asarray(v, float) for v in values]) if len(values) else np.zeros((0, width))


def first_break(print_: np.ndarray, sharp: float, prints: np.ndarray, sharps: np.ndarray, start: int, threshold: float) -> tuple[int, np.ndarray]:
    """First row from ``start`` that is selected after the given frame (or the end), and the similarities up to it."""
    seen, at, step = [], start, 16
    if prints.shape[1] != len(print_):  # all of one side is missing
        prints, print_ = np.zeros((len(prints), 1)), np.zeros(1)
    while at < len(prints):
        # Row sums, not a matrix product: the same pair always gives the same bits.
        sims = (prints[at : at + step] * print_).sum(axis=1)
        seen.append(sims)
        hits = np.flatnonzero(~(sims > threshold) | (sharps[at : at + step] > sharp * SHARPER))
        if len(hits):
            return at + int(hits[0]), np.concatenate(seen)[: at + int(hits[0]) - start + 1]
        at, step = at + step, step * 2
    return len(prints), np.concatenate(seen) if seen else np.zeros(0)


def _sorted(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    pdf = pdf.sort_values("pos", kind="stable").reset_index(drop=True)
    return pdf, stacked(pdf["fingerprint"]), pdf["sharpness"].to_numpy(float)


def _leaves(threshold: float):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, prints, sharps = _sorted(pdf)
        last = np.arange(len(pdf))
        for i in range(len(pdf) - 1, -1, -1):
            j, _ = first_break(prints[i], sharps[i], prints, sharps, i + 1, threshold)
            last[i] = last[j] if j < len(pdf) else i
        pos = pdf["pos"].to_numpy()
        return pd.DataFrame({"mission_id": key[0], "block": key[1], "pos": pos, "leave": pos[last]})

    return run


def _balls(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    _, prints, sharps = _sorted(pdf)
    norms = np.sqrt((prints * prints).sum(axis=1))
    cosines = (prints * prints[0]).sum(axis=1) / np.maximum(norms * norms[0], 1e-300)
    angle = float(np.arccos(np.clip(cosines, -1.0, 1.0)).max()) if norms.min() > 0 else math.pi
    top = float(np.nanmax(sharps)) if not np.isnan(sharps).all() else None
    return pd.DataFrame([(key[0], 0, key[1], prints[0].tolist(), angle, float(norms.min()), top)], columns=["mission_id", "level", "idx", "rep", "angle", "low_norm", "sharp"])


def _renewed(df: DataFrame) -> DataFrame:
    """The same columns under new identities, so that both sides of a cogroup may come from one table."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def _angle(a: Column, b: Column) -> Column:
    """Angle between two vectors; half a turn where one has no direction."""
    size = F.sqrt(_dot(a, a) * _dot(b, b))
    return F.when(size > 0, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _dot(a, b) / size)))).otherwise(F.lit(math.pi))


def _tree(blocks: DataFrame) -> DataFrame:
    """Balls of all levels above the blocks: a node covers two nodes below it."""
    level, found = cut(blocks), []
    while True:
        found.append(level)
        if is_empty(level.filter("idx > 0")):
            break
        one, two = F.min_by(F.struct("rep", "angle"), "idx"), F.max_by(F.struct("rep", "angle"), "idx")
        pairs = level.groupBy("mission_id", (F.col("level") + 1).alias("level"), F.floor(F.col("idx") / 2).alias("idx")).agg(
            one.alias("a"), two.alias("b"), F.min("low_norm").alias("low_norm"), F.max("sharp").alias("sharp")
        )
        wide = F.greatest(F.col("a.angle"), _angle(F.col("a.rep"), F.col("b.rep")) + F.col("b.angle"))
        level = cut(pairs.select("mission_id", "level", "idx", F.col("a.rep").alias("rep"), wide.alias("angle"), "low_norm", "sharp"))
    out = found[0]
    for one in found[1:]:
        out = out.unionByName(one)
    return out


def _open(threshold: float):
    """Successors of waiting frames inside one block."""

    def run(key: tuple, waiting: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        block, prints, sharps = _sorted(block)
        waiting, theirs, their_sharps = _sorted(waiting)
        pos, out = block["pos"].to_numpy(), []
        for i, start in enumerate(waiting["pos"].tolist()):
            j, _ = first_break(theirs[i], their_sharps[i], prints, sharps, 0, threshold)
            out.append((key[0], start, key[1], int(pos[j]) if j < len(pos) else None))
        return pd.DataFrame(out, columns=["mission_id", "pos", "idx", "hop"]).astype({"hop": "Int64"})

    return run


def successors_beyond(rows: DataFrame, leaves: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """``mission_id, pos, hop``: the successor of every frame that is the last of a chain in its block, where there is one."""
    keys = ["mission_id", "block", "pos"]
    ends = leaves.select("mission_id", "block", F.col("leave").alias("pos")).distinct()
    active = cut(ends.join(rows.select(*keys, "fingerprint", "sharpness"), keys).withColumns({"level": F.lit(0), "idx": F.col("block") + 1}))
    ball = nodes.select("mission_id", "level", "idx", "rep", "angle", "low_norm", F.col("sharp").alias("top"))
    size = F.sqrt(_dot(F.col("fingerprint"), F.col("fingerprint")))
    reach = _angle(F.col("fingerprint"), F.col("rep")) + F.col("angle") + 1e-6
    alike = (reach < math.pi / 2) & (size * F.col("low_norm") * F.cos(reach) > threshold + 1e-9)
    calm = F.coalesce(~(F.col("top") > F.col("sharpness") * SHARPER), F.lit(True))
    found = None
    while True:
        met = cut(active.join(ball, ["mission_id", "level", "idx"]).withColumn("_pass", F.coalesce(alike & calm, F.lit(False))).drop("rep", "angle", "low_norm", "top"))
        opened = met.filter("NOT _pass AND level = 0")
        wanted = opened.select("mission_id", "idx", F.col("block").alias("own")).distinct()
        copies = rows.select("mission_id", F.col("block").alias("idx"), "pos", "fingerprint", "sharpness").join(wanted, ["mission_id", "idx"])
        group = ["mission_id", "idx", "own"]  # at most a block of waiting frames and a block to look into
        asked = opened.withColumnRenamed("block", "own").groupBy(*group).cogroup(_renewed(copies).groupBy(*group))
        answers = cut(asked.applyInPandas(_open(threshold), "mission_id long, pos long, idx long, hop long"))
        hits = answers.filter("hop IS NOT NULL").select("mission_id", "pos", "hop")
        found = hits if found is None else found.unionByName(hits)
        missed = met.join(answers.filter("hop IS NULL").select("mission_id", "pos"), ["mission_id", "pos"], "left_semi")
        after = F.col("idx") + 1
        up = after % 2 == 0
        onward = met.filter("_pass").unionByName(missed).withColumns(
            {"level": F.when(up, F.col("level") + 1).otherwise(F.col("level")), "idx": F.when(up, F.floor(after / 2)).otherwise(after)}
        )
        down = met.filter("NOT _pass AND level > 0").withColumns({"level": F.col("level") - 1, "idx": F.col("idx") * 2})
        active = cut(onward.unionByName(down).drop("_pass"))
        if is_empty(active):
            return cut(found)


def selected_starts(leaves: DataFrame, hops: DataFrame) -> DataFrame:
    """``mission_id, pos``: the frames on the chain from the first frame that are the first of their block, by doubling."""
    starts = leaves.filter("pos = 0").select("mission_id", "pos").unionByName(hops.select("mission_id", F.col("hop").alias("pos"))).distinct()
    steps = hops.select("mission_id", F.col("pos").alias("leave"), "hop")
    jump = cut(leaves.join(starts, ["mission_id", "pos"], "left_semi").join(steps, ["mission_id", "leave"]).select("mission_id", "pos", "hop"))
    marks = leaves.filter("pos = 0").select("mission_id", "pos")
    while not is_empty(jump):
        reached = marks.join(jump, ["mission_id", "pos"]).select("mission_id", F.col("hop").alias("pos"))
        marks = cut(marks.unionByName(reached).distinct())
        further = jump.select("mission_id", F.col("pos").alias("hop"), F.col("hop").alias("_far"))
        jump = cut(jump.join(further, ["mission_id", "hop"]).select("mission_id", "pos", F.col("_far").alias("hop")))
    return marks


def _entries(leaves: DataFrame, marks: DataFrame, rows: DataFrame) -> DataFrame:
    """The selected frame with which each block begins, but for blocks without one before."""
    passed = leaves.join(marks, ["mission_id", "pos"]).groupBy("mission_id", "block").agg(F.max("leave").alias("leave"))
    blocks = leaves.select("mission_id", "block").distinct().join(passed, ["mission_id", "block"], "left")
    before = Window.partitionBy("mission_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    known = blocks.select("mission_id", "block", F.max("leave").over(before).alias("pos")).filter("pos IS NOT NULL")
    return known.join(rows.drop("block"), ["mission_id", "pos"])


def _judge(threshold: float):
    def run(key: tuple, pdf: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        pdf, prints, sharps = _sorted(pdf)
        at, n = pdf["at"].tolist(), len(pdf)
        out, i = [], 0
        if len(entry):
            last, sharp, where = stacked(entry["fingerprint"])[0], float(entry["sharpness"].iloc[0]), int(entry["at"].iloc[0])
        else:
            out, i = ([(key[0], at[0], "kept", None, None)], 1) if n else ([], 0)
            last, sharp, where = (prints[0], float(sharps[0]), at[0]) if n else (None, 0.0, None)
        while i < n:
            j, sims = first_break(last, sharp, prints, sharps, i, threshold)
            out += [(key[0], at[k], "duplicate", float(sims[k - i]), where) for k in range(i, j)]
            if j < n:
                sim = float(sims[j - i])
                out.append((key[0], at[j], "replaces" if sim > threshold else "kept", sim, where))
                last, sharp, where = prints[j], float(sharps[j]), at[j]
            i = j + 1
        return pd.DataFrame(out, columns=["mission_id", "at", "verdict", "similarity", "against"]).astype({"against": "Int64"})

    return run


def verdicts(rows: DataFrame, threshold: float, size: int) -> DataFrame:
    """Verdict on every frame of ``mission_id, pos, at, fingerprint, sharpness``; ``pos`` counts from zero in each mission."""
    keys = ["mission_id", "block"]
    rows = cut(fan_out(rows.withColumn("block", F.floor(F.col("pos") / size)), *keys))
    judge = _judge(threshold)
    if is_empty(rows.filter("block > 0")):
        none = pd.DataFrame(columns=["fingerprint", "sharpness", "at"])
        return rows.groupBy(*keys).applyInPandas(lambda key, pdf: judge(key, pdf, none), VERDICT)
    leaves = cut(rows.groupBy(*keys).applyInPandas(_leaves(threshold), "mission_id long, block long, pos long, leave long"))
    nodes = cut(_tree(rows.groupBy(*keys).applyInPandas(_balls, NODE)))
    hops = successors_beyond(rows, leaves, nodes, threshold)
    entries = cut(_entries(leaves, selected_starts(leaves, hops), rows))
    return rows.groupBy(*keys).cogroup(_renewed(entries).groupBy(*keys)).applyInPandas(judge, VERDICT)
