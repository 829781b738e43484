"""Streaming tracker: the batch match of one frame at a time, fed by the watermark.

State per mission in the RocksDB store: waiting detections in blocks of frames, and the live tracks with the next id.  Each
call to the store is a message between Python and the JVM, so a block or all live tracks move in one; rows of a batch touch
their own blocks only.  A mission has one timer in force, for the first frame that waits: it is the one that all others wait for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skysift.operators.tracking import BOX, IDLE_FRAMES, INPUT, advance, in_order

OUTPUT = "mission_id long, frame_idx long, det_id long, track_id long, track_length long"
NAMES = [part.strip().split(" ")[0] for part in OUTPUT.split(",")]
#: Frames of a block of waiting detections.
BLOCK = 64
#: Waiting detections of a block, column by column (six box numbers for each), in order of their frames; ``at`` is the time of each.
WAITING = "frame array<long>, at array<long>, det_id array<long>, conf array<double>, class_name array<string>, boxes array<double>"
#: Live tracks, column by column, and the next track id.
TRACKS = "next_id long, id array<long>, boxes array<double>, class_name array<string>, last_frame array<long>, length array<long>"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def latest(frames: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows in order of their frames: where each frame begins, where it ends, and its last time."""
    begins = np.flatnonzero(np.concatenate([[True], frames[1:] != frames[:-1]]))
    return begins, np.append(begins[1:], len(frames)), np.maximum.reduceat(at, begins)


class Tracker(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "block long", WAITING)
        self.tracks = handle.getValueState("tracks", TRACKS)
        self.first = handle.getValueState("first", "frame_idx long, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Store the detections, and wake up when the watermark has passed the last one of the first frame that waits."""
        parts = [pdf[pdf["det_id"].notna()] for pdf in rows]
        new = pd.concat(parts) if len(parts) > 1 else parts[0] if parts else None
        if new is not None and len(new):
            wakes = self.first.get() if self.first.exists() else None
            soonest = None
            for block, part in new.groupby(new["frame_idx"] // BLOCK):
                slot = (int(block),)
                mine = (part["frame_idx"].to_numpy(np.int64), part["at"].to_numpy(np.int64), part["det_id"].to_numpy(np.int64), part["conf"].to_numpy(float), part["class_name"].to_numpy(object), part[list(BOX)].to_numpy(float))
                if wakes is not None and self.waiting.containsKey(slot):
                    mine = tuple(np.concatenate(pair) for pair in zip(self._columns(self.waiting.getValue(slot)), mine, strict=True))
                order = np.argsort(mine[0], kind="stable")
                mine = tuple(column[order] for column in mine)
                self._store(slot, mine)
                if soonest is None:
                    begins, _, at = latest(mine[0], mine[1])
                    soonest = (int(mine[0][begins[0]]), int(at[0]))
            if wakes is None or soonest[0] < wakes[0] or (soonest[0] == wakes[0] and soonest[1] != wakes[1]):
                self._wake(wakes, soonest)
        yield pd.DataFrame({name: pd.Series(dtype="int64") for name in NAMES})

    def _columns(self, value) -> tuple[np.ndarray, ...]:
        frame, at, det_id, conf, cls, boxes = value
        return np.array(frame, np.int64), np.array(at, np.int64), np.array(det_id, np.int64), np.array(conf, float), np.array(cls, object), np.array(boxes, float).reshape(-1, len(BOX))

    def _store(self, slot: tuple[int], columns: tuple[np.ndarray, ...]) -> None:
        self.waiting.updateValue(slot, tuple(column.reshape(-1).tolist() for column in columns))

    def _wake(self, old: tuple | None, new: tuple[int, int] | None) -> None:
        """The timer of frame ``new`` in place of that of ``old``; it fires at a watermark beyond the frame's time."""
        if old is not None:
            self.handle.deleteTimer(old[1] + 1)
        if new is None:
            self.first.clear()
            return
        self.handle.registerTimer(new[1] + 1)
        self.first.update(new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Walk the frames that the watermark has passed, in order; a frame never goes before an earlier one that waits."""
        passed = timerValues.getCurrentWatermarkInMs()
        out: list[tuple] = []
        if self.first.exists() and self.first.get()[1] < passed:
            wakes, tracks, next_id = self.first.get(), [], 1
            if self.tracks.exists():
                next_id, ids, boxes, cls, seen, length = self.tracks.get()
                numbers = np.array(boxes, float).reshape(-1, len(BOX)).tolist()
                tracks = [{"id": n, **dict(zip(BOX, box, strict=True)), "cls": c, "last_frame": f, "length": k} for n, box, c, f, k in zip(ids, numbers, cls, seen, length, strict=True)]
            then = None
            for slot in sorted(self.waiting.keys()):
                columns = self._columns(self.waiting.getValue(slot))
                begins, ends, at = latest(columns[0], columns[1])
                late = np.flatnonzero(at >= passed)
                ready = int(late[0]) if len(late) else len(begins)
                for low, high in zip(begins[:ready].tolist(), ends[:ready].tolist(), strict=True):
                    frame, _, det_id, conf, cls, boxes = (column[low:high] for column in columns)
                    d = {"det_id": det_id, "conf": conf, "class_name": cls} | {name: boxes[:, i] for i, name in enumerate(BOX)}
                    d = in_order(d)
                    now = int(frame[0])
                    found, tracks = advance(tracks, d, now)
                    for number, t in zip(d["det_id"].tolist(), found, strict=True):
                        if "id" not in t:
                            t["id"], next_id = next_id, next_id + 1
                        out.append((key[0], now, number, t["id"], t["length"]))
                if ready < len(begins):
                    then = (int(columns[0][begins[ready]]), int(at[ready]))
                    if ready:
                        self._store(slot, tuple(column[begins[ready] :] for column in columns))
                    break
                self.waiting.removeKey(slot)
            live = [t for t in tracks if now + 1 - t["last_frame"] <= IDLE_FRAMES]
            self.tracks.update((next_id, [int(t["id"]) for t in live], [float(t[c]) for t in live for c in BOX], [t["cls"] for t in live], [int(t["last_frame"]) for t in live], [int(t["length"]) for t in live]))
            self._wake(wakes, then)
        yield pd.DataFrame.from_records(out, columns=NAMES).astype("int64")

    def close(self) -> None:
        pass


def track_stream(det: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Track ids of a detection stream with an event time column ``ts``.

    A row older than the watermark is dropped by Spark and counted in the progress metric of late rows.  Rows without
    ``det_id`` only move the watermark.  State needs the RocksDB provider, which is set for streams started afterwards.
    """
    det.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    timed = det.withColumn("at", F.unix_millis("ts")).withWatermark("ts", delay)
    return (
        timed.select("mission_id", "ts", "at", *INPUT)
        .groupBy("mission_id")
        .transformWithStateInPandas(Tracker(), OUTPUT, "Append", "EventTime")
    )
