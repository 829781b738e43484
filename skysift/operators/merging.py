"""Merging of incident reports in order of arrival, one pass over the reports.

The state of a (mission, type) is its list of incidents with two indexes: grid cell to the incidents that stand in
it, and track or object to the first incident that carries it.  A report looks into 27 cells and one link, so its
cost does not grow with the incidents before it.  Frames and counts are not part of the state: every report is
answered with its incident, and Spark groups the answers.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.operators.folds import ordered_walk

#: What an incident is known by between two walks.
STATE = "mission_id long, type string, seq long, frame long, conf double, x double, y double, z double, err double, link string"
OUTPUT = "kind int, mission_id long, type string, report long, frame_idx long, seq long, frame long, conf double, x double, y double, z double, err double, link string"


def rounded(value: float, places: int) -> float:
    unit = float(10**places)
    return float(np.rint(value * unit)) / unit + 0.0


class Incidents:
    """Incidents of one group, in order of creation."""

    def __init__(self, key: tuple, radius: float):
        self.mission, self.type = key[:2]
        self.radius = radius
        self.rows: list[list] = []  # seq, frame, conf, x, y, z, err, link
        self.cells: dict[tuple, list[int]] = defaultdict(list)
        self.links: dict[str, int] = {}

    def _cell(self, x: float, y: float, z: float) -> tuple:
        return math.floor(x / self.radius), math.floor(y / self.radius), math.floor(z / self.radius)

    def add(self, row: list) -> int:
        number = len(self.rows)
        self.rows.append(row)
        if row[7] is not None:
            self.links.setdefault(row[7], number)
        if row[3] is not None:
            self.cells[self._cell(*row[3:6])].append(number)
        return number

    def move(self, number: int, x: float, y: float, z: float, err: float | None) -> None:
        row = self.rows[number]
        if row[3] is not None:
            self.cells[self._cell(*row[3:6])].remove(number)
        row[3:7] = x, y, z, err
        self.cells[self._cell(x, y, z)].append(number)

    def near(self, x: float, y: float, z: float) -> int | None:
        """First incident closer than the radius."""
        cx, cy, cz = self._cell(x, y, z)
        best = None
        for i in (cx - 1, cx, cx + 1):
            for j in (cy - 1, cy, cy + 1):
                for k in (cz - 1, cz, cz + 1):
                    for number in self.cells.get((i, j, k), ()):
                        if best is None or number < best:
                            _, _, _, a, b, c, _, _ = self.rows[number]
                            if math.sqrt((a - x) * (a - x) + (b - y) * (b - y) + (c - z) * (c - z)) < self.radius:
                                best = number
        return best


class MergeWalk(Incidents):
    """Reports in order of arrival; rows with ``known`` restore incidents of an earlier walk."""

    places = 2

    def take(self, rows: dict[str, np.ndarray]) -> list[tuple]:
        out = []
        columns = (rows[c].tolist() for c in ("known", "seq", "frame_idx", "confidence", "x", "y", "z", "reprojection_error_px", "_link"))
        for known, seq, frame, conf, x, y, z, err, link in zip(*columns, strict=True):
            here = not (x is None or y is None or z is None or math.isnan(x) or math.isnan(y) or math.isnan(z))
            spot = (x, y, z) if here else (None, None, None)
            err = None if err is None or math.isnan(err) else err
            if known:
                self.add([seq, frame, conf, *spot, err, link])
                continue
            number = self.match(conf, spot, err, link)
            if number is None:
                number = self.add([seq, frame, rounded(conf, self.places), *spot, err, link])
            out.append((0, self.mission, self.type, seq, frame, self.rows[number][0], *[None] * 7))
        return out

    def match(self, conf: float, spot: tuple, err: float | None, link: str | None) -> int | None:
        raise NotImplementedError

    def close(self) -> list[tuple]:
        return [(1, self.mission, self.type, None, None, *row) for row in self.rows]


class ByTrack(MergeWalk):
    """Same track: keep the higher confidence and fill a missing location; else same place."""

    def match(self, conf, spot, err, link):
        number = self.links.get(link) if link is not None else None
        if number is None:
            return self.near(*spot) if spot[0] is not None else None
        row = self.rows[number]
        if conf > row[2]:
            row[2] = conf
        if row[3] is None and spot[0] is not None:
            self.move(number, *spot, err)
        return number


class Boosting(MergeWalk):
    """Same object or same place, whichever incident is older; each sight raises the confidence."""

    places = 3

    def match(self, conf, spot, err, link):
        by_link = self.links.get(link) if link is not None else None
        by_place = self.near(*spot) if spot[0] is not None else None
        found = [n for n in (by_link, by_place) if n is not None]
        if not found:
            return None
        row = self.rows[min(found)]
        row[2] = rounded(min(0.98, max(row[2], conf) + 0.04), 3)
        if spot[0] is not None and (row[3] is None or conf > row[2] - 0.05):
            self.move(min(found), *spot, err)
        return min(found)


def walk(reports: DataFrame, link: Column, radius: float, rule: type[MergeWalk], part: list[str], known: DataFrame | None = None) -> DataFrame:
    """Answers (``kind`` 0) and incidents (``kind`` 1) of every (mission, type) and ``part``; schema ``OUTPUT``.

    ``known`` restores the incidents of an earlier walk (``STATE``) before the reports are read.
    """
    columns = ["confidence", "x", "y", "z", "reprojection_error_px"]
    ready = reports.select("mission_id", "type", *part, F.lit(0).alias("known"), "frame_idx", "seq", *[F.col(c).cast("double") for c in columns], link.cast("string").alias("_link"))
    if known is not None:
        ready = ready.unionByName(
            known.select(
                "mission_id", "type", *part, F.lit(1).alias("known"), F.col("frame").alias("frame_idx"), "seq", F.col("conf").alias("confidence"),
                "x", "y", "z", F.col("err").alias("reprojection_error_px"), F.col("link").alias("_link"),
            )
        )
    order = [F.col("known").desc(), F.col("frame_idx"), F.col("seq")]
    return ordered_walk(ready, ["mission_id", "type", *part], order, lambda key: rule(key, radius), OUTPUT)


def collected(answers: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Incidents with ``frames`` and ``n``; ``before`` has the frames and counts of an earlier walk (by mission, type, seq)."""
    keys = ["mission_id", "type", "seq"]
    seen = answers.filter("kind = 0").groupBy(*keys).agg(
        F.array_sort(F.collect_set("frame_idx")).alias("frames"), F.count(F.lit(1)).alias("n")
    )
    incidents = answers.filter("kind = 1").drop("kind", "report", "frame_idx")
    if before is None:
        return incidents.join(seen, keys)
    old = before.select(*keys, F.col("frames").alias("_frames"), F.col("n").alias("_n"))
    both = incidents.join(seen, keys, "left").join(old, keys, "left")
    none = F.array().cast("array<bigint>")
    frames = F.array_sort(F.array_union(F.coalesce("_frames", none), F.coalesce("frames", none)))
    return both.withColumns({"frames": frames, "n": F.coalesce("_n", F.lit(0)) + F.coalesce("n", F.lit(0))}).drop("_frames", "_n")
