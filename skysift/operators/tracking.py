"""Multi-frame trackers.

No track outlives ``IDLE_FRAMES`` frames without a detection, so the frames of a mission are cut where detections pause for
longer: the segments are independent and walk at once.  A walk streams its frames once and holds one frame and the
live tracks, whatever the length of the segment.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.functions.boxes import overlap
from skysift.functions.numeric import half_even, norm
from skysift.lineage import cut
from skysift.operators.folds import edges, ordered_walk
from skysift.operators.ordering import BLOCK, numbered, runs

IDLE_FRAMES = 5
CELL = 128

FOUND = "mission_id long, det_id long, founder long, f_frame long, f_pos long, length long"
INPUT = ["frame_idx", "det_id", "conf", "class_name", "x1", "y1", "x2", "y2", "cx", "cy"]


def tracking_confidence(length: Column) -> Column:
    grown = F.least(F.lit(1.0), half_even(0.4 + 0.15 * F.least(length, F.lit(4)), 3))
    return F.when(length <= 1, F.lit(0.55)).otherwise(grown)


BOX = ("x1", "y1", "x2", "y2", "cx", "cy")


def new_track(d: dict[str, np.ndarray], i: int, frame: int, position: int) -> dict:
    return {
        "founder": int(d["det_id"][i]), "f_frame": frame, "f_pos": position,
        **{name: float(d[name][i]) for name in BOX},
        "cls": d["class_name"][i], "last_frame": frame, "length": 1,
    }


def observe(track: dict, d: dict[str, np.ndarray], i: int, frame: int) -> None:
    for name in BOX:
        track[name] = float(d[name][i])
    track["last_frame"] = frame
    track["length"] += 1


def pair_scores(tracks: list[dict], d: dict[str, np.ndarray], frame: int) -> tuple[np.ndarray, np.ndarray]:
    """Score of every (track, detection) of a frame and whether the pair may match."""
    t = {k: np.array([tr[k] for tr in tracks])[:, None] for k in BOX}
    t_cls = np.array([tr["cls"] for tr in tracks], dtype=object)[:, None]
    d_cls = d["class_name"][None, :]
    missed = np.array([frame - tr["last_frame"] for tr in tracks], dtype=float)[:, None]
    iw = np.minimum(t["x2"], d["x2"]) - np.maximum(t["x1"], d["x1"])
    ih = np.minimum(t["y2"], d["y2"]) - np.maximum(t["y1"], d["y1"])
    inter = np.where((iw > 0) & (ih > 0), iw * ih, 0.0)
    areas = (t["x2"] - t["x1"]) * (t["y2"] - t["y1"]) + (d["x2"] - d["x1"]) * (d["y2"] - d["y1"])
    iou = inter / np.maximum(1.0, areas - inter)
    dist = np.hypot(t["cx"] - d["cx"], t["cy"] - d["cy"])
    same = t_cls == d_cls
    persons = (t_cls == "person") & (d_cls == "person")
    radius = 250.0 + 30.0 * np.maximum(0.0, missed - 1.0)
    person_score = np.maximum(iou, np.maximum(0.0, 1.0 - dist / radius)) + 0.25
    other_score = np.maximum(iou, 0.5 * np.maximum(0.0, 1.0 - dist / 200.0)) + np.where(same, 0.15, 0.0)
    far = ~same & (iou < 0.20) & (dist > 45.0)
    allowed = np.where(persons, dist <= radius, ~far & (other_score > 0.15))
    return np.where(persons, person_score, other_score), allowed.astype(bool) & (missed <= IDLE_FRAMES)


def in_order(d: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Detections of one frame: persons first, then by confidence, then the higher id."""
    order = np.lexsort((-d["det_id"].astype(np.int64), -d["conf"].astype(float), d["class_name"] != "person"))
    return {k: v[order] for k, v in d.items()}


def advance(tracks: list[dict], d: dict[str, np.ndarray], frame: int) -> tuple[list[dict], list[dict]]:
    """Match the detections of one frame (``in_order``) to the live tracks, best pairs first; the rest found new tracks.

    Returns the track of every detection and the tracks that are live afterwards.  ``tracks`` are in order of their founding.
    """
    tracks = [t for t in tracks if frame - t["last_frame"] <= IDLE_FRAMES]
    owner: dict[int, dict] = {}
    if tracks:
        score, allowed = pair_scores(tracks, d, frame)
        ti, di = np.nonzero(allowed)
        best = np.lexsort((di, ti, -score[ti, di]))
        taken: set[int] = set()
        for a, b in zip(ti[best].tolist(), di[best].tolist(), strict=True):
            if a not in taken and b not in owner:
                taken.add(a)
                owner[b] = tracks[a]
    out = []
    for i in range(len(d["det_id"])):
        track = owner.get(i)
        if track is None:
            track = new_track(d, i, frame, i)
            tracks.append(track)
        else:
            observe(track, d, i, frame)
        out.append(track)
    return out, tracks


class GreedyWalk:
    """Frames of one segment; the last frame waits until a later one shows that it is whole."""

    def __init__(self, mission: int):
        self.mission, self.tracks = mission, []
        self.waiting: list[dict[str, np.ndarray]] = []

    def take(self, rows: dict[str, np.ndarray]) -> list[tuple]:
        out: list[tuple] = []
        cuts = edges(rows, ["frame_idx"], len(rows["frame_idx"]))
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            if self.waiting and self.waiting[0]["frame_idx"][0] != rows["frame_idx"][low]:
                out += self.close()
            self.waiting.append({c: rows[c][low:high] for c in INPUT})
        return out

    def close(self) -> list[tuple]:
        if not self.waiting:
            return []
        frame = int(self.waiting[0]["frame_idx"][0])
        d = in_order({c: np.concatenate([w[c] for w in self.waiting]) for c in INPUT})
        self.waiting = []
        found, self.tracks = advance(self.tracks, d, frame)
        return [(self.mission, det, t["founder"], t["f_frame"], t["f_pos"], t["length"]) for det, t in zip(d["det_id"].tolist(), found, strict=True)]


class NearestWalk:
    """Detections of one class; each joins its best track, and tracks never expire.

    A track is listed in the cells that its box touches.  A detection looks into the cells of its box widened by the
    reach: a box that overlaps it, or a centre within the reach, stands in one of them.
    """

    reach, least_iou = 60.0, 0.2

    def __init__(self, key: tuple, legacy_iou: bool):
        self.mission, self.cls = key
        self.legacy = legacy_iou
        self.tracks: list[tuple[float, ...]] = []
        self.cells: dict[tuple[int, int], set[int]] = defaultdict(set)

    @staticmethod
    def _cells(x1: float, y1: float, x2: float, y2: float, pad: float):
        left, right = math.floor((min(x1, x2) - pad) / CELL), math.floor((max(x1, x2) + pad) / CELL)
        top, bottom = math.floor((min(y1, y2) - pad) / CELL), math.floor((max(y1, y2) + pad) / CELL)
        return [(i, j) for i in range(left, right + 1) for j in range(top, bottom + 1)]

    @staticmethod
    def _extent(box: tuple[float, ...]) -> tuple[float, float, float, float]:
        """The box with its centre, which need not lie inside."""
        x1, y1, x2, y2, cx, cy = box
        return min(x1, cx), min(y1, cy), max(x2, cx), max(y2, cy)

    def best(self, box: tuple[float, ...]) -> int | None:
        """Track of the highest score, the oldest of equals."""
        x1, y1, x2, y2, cx, cy = box
        near = set().union(*(self.cells.get(c, ()) for c in self._cells(*self._extent(box), self.reach)))
        found, top_score = None, -1.0
        for number in sorted(near):
            a1, b1, a2, b2, ax, ay = self.tracks[number]
            dist = math.hypot(cx - ax, cy - ay)
            iw = max(0.0, min(x2, a2) - max(x1, a1) + 1)
            ih = max(0.0, min(y2, b2) - max(y1, b1) + 1)
            top, old_top = (x1, a1) if self.legacy else (y1, b1)
            areas = (x2 - x1 + 1) * (y2 - top + 1) + (a2 - a1 + 1) * (b2 - old_top + 1)
            iou = iw * ih / (areas - iw * ih + 1e-6)
            if iou > self.least_iou or dist < self.reach:
                score = iou + 1.0 / (1.0 + dist)
                if score > top_score:
                    found, top_score = number, score
        return found

    def take(self, rows: dict[str, np.ndarray]) -> list[tuple]:
        out = []
        boxes = zip(*(rows[c].astype(float).tolist() for c in BOX), strict=True)
        for det, box in zip(rows["det_id"].tolist(), boxes, strict=True):
            number = self.best(box)
            if number is None:
                number = len(self.tracks)
                self.tracks.append(box)
            else:
                for cell in self._cells(*self._extent(self.tracks[number]), 1.0):
                    self.cells[cell].discard(number)
                self.tracks[number] = box
            for cell in self._cells(*self._extent(box), 1.0):  # touching boxes overlap by a pixel
                self.cells[cell].add(number)
            out.append((self.mission, det, f"{self.cls.upper()}_{number + 1:03d}"))
        return out

    def close(self) -> list[tuple]:
        return []


def track(det: DataFrame) -> DataFrame:
    """Persistent track ids per mission, increasing in order of first sight.

    Reads ``class_name, conf, x1..y2, cx, cy``; adds ``track_id, track_length``
    and ``tracking_conf``.
    """
    rows = runs(det.select("mission_id", *INPUT), ["mission_id"], "frame_idx", IDLE_FRAMES, "segment")
    order = [F.col("frame_idx"), F.col("det_id")]
    found = cut(ordered_walk(rows, ["mission_id", "segment"], order, lambda key: GreedyWalk(int(key[0])), FOUND))
    block = F.floor(F.col("f_frame") / BLOCK)
    founders = numbered(
        found.filter(F.col("det_id") == F.col("founder")).select("mission_id", "founder", "f_frame", "f_pos"),
        ["mission_id"], block, [F.col("f_frame"), F.col("f_pos")], "track_id",
    ).select("mission_id", "founder", "track_id")
    ids = found.join(founders, ["mission_id", "founder"]).select(
        "mission_id", "det_id", "track_id", F.col("length").alias("track_length"),
        tracking_confidence(F.col("length")).alias("tracking_conf"),
    )
    return det.join(ids, ["mission_id", "det_id"])


def track_simple(det: DataFrame, legacy_iou: bool = False) -> DataFrame:
    """Nearest-track tracker without expiry; object ids ``CLASS_nnn`` per mission and class.

    Only tracks of a detection's own class can take it, so the classes of a mission walk at once.
    """
    order = [F.col("frame_idx"), F.col("det_id")]
    rows = det.select("mission_id", *INPUT)
    ids = ordered_walk(rows, ["mission_id", "class_name"], order, lambda key: NearestWalk(key, legacy_iou), "mission_id long, det_id long, object_id string")
    return det.join(ids, ["mission_id", "det_id"])


def score_pairs(tracks: DataFrame, det: DataFrame, tile: int = 512) -> DataFrame:
    """Admissible (track, detection) pairs of a frame with their scores.

    ``tracks`` carries ``track_key, frame_idx`` (the frame to match),
    ``frames_missed`` and the last box; a pair must share a tile of the frame.
    """
    radius = 250.0 + 30.0 * F.greatest(F.lit(0), F.col("frames_missed") - 1)

    def spread(df: DataFrame, pad: Column) -> DataFrame:
        lo_x, hi_x = F.least(F.col("x1"), F.col("cx") - pad), F.greatest(F.col("x2"), F.col("cx") + pad)
        lo_y, hi_y = F.least(F.col("y1"), F.col("cy") - pad), F.greatest(F.col("y2"), F.col("cy") + pad)
        return df.withColumn("_tx", F.explode(F.sequence(F.floor(lo_x / tile), F.floor(hi_x / tile)))).withColumn(
            "_ty", F.explode(F.sequence(F.floor(lo_y / tile), F.floor(hi_y / tile)))
        )

    slots = ["mission_id", "frame_idx", "_tx", "_ty"]
    box = ["x1", "y1", "x2", "y2", "cx", "cy"]
    left = spread(tracks, radius).select(
        *slots, "track_key", "frames_missed", F.col("class_name").alias("t_cls"), *[F.col(c).alias("t_" + c) for c in box]
    )
    right = spread(det, F.lit(0.0)).select(*slots, "det_id", "class_name", *box)
    iou = overlap([F.col("t_" + c) for c in box[:4]], [F.col(c) for c in box[:4]])
    dist = norm((F.col("t_cx") - F.col("cx")).cast("double"), (F.col("t_cy") - F.col("cy")).cast("double"))
    pairs = (
        left.join(right, slots)
        .withColumns({"_iou": iou, "_dist": dist})
        .dropDuplicates(["mission_id", "frame_idx", "track_key", "det_id"])
    )
    same = F.col("t_cls") == F.col("class_name")
    persons = same & (F.col("class_name") == "person")
    person = F.greatest(F.col("_iou"), 1.0 - F.col("_dist") / radius) + 0.25
    other = F.greatest(F.col("_iou"), 0.5 * F.greatest(F.lit(0.0), 1.0 - F.col("_dist") / 200.0)) + F.when(
        same, F.lit(0.15)
    ).otherwise(F.lit(0.0))
    far = ~same & (F.col("_iou") < 0.20) & (F.col("_dist") > 45.0)
    allowed = F.when(persons, F.col("_dist") <= radius).otherwise(~far & (other > 0.15))
    return (
        pairs.withColumn("score", F.when(persons, person).otherwise(other))
        .filter(allowed & (F.col("frames_missed") <= IDLE_FRAMES))
        .select("mission_id", "frame_idx", "track_key", "det_id", half_even(F.col("score"), 6).alias("score"))
    )
