"""Integer vectors: components on a grid of 1/256, exact sums by group, and exact means.

All arithmetic is on 64-bit integers, so results do not depend on the order in which tasks end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A scaled component stays below this, so that the squared distance of vectors of 64 components fits a signed long.
LIMIT = 1 << 27
SUMS = "slot int, pos int, total long, n long"


def finite(vector: str) -> Column:
    """True where a vector is not null and holds neither null nor non-finite components."""
    inside = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(vector).isNotNull() & F.coalesce(inside, F.lit(False))


def integer_vectors(rows: DataFrame, *more: str) -> DataFrame:
    """``vec_id, v`` and ``more`` for every finite vector; ``v`` is ``array<int>``, floor(256 x) of each component as a double.

    A component of 524,288 or more has no place on the grid and stops the job with its reason.
    """
    reason = F.raise_error(F.lit("a vector has a component of 524288 or more: squared distances would not fit a long")).cast("int")

    def scaled(x: Column) -> Column:
        size = F.abs(x * F.lit(256.0))  # of any value: the optimizer may ask for a length before vectors are filtered
        return F.when(size < F.lit(float(LIMIT)), F.floor(x * F.lit(256.0)).cast("int")).when(F.abs(x) < F.lit(float("inf")), reason)

    found = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"), *more)
    return found.where(finite("x")).select("vec_id", F.transform("x", scaled).alias("v"), *more)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column without nulls, all lists of ``width``, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * width, pa.array(values.reshape(-1)))


class Sums:
    """Per-slot counts and component sums of the vectors that one task has seen."""

    def __init__(self, slots: int, width: int):
        self.totals = np.zeros((slots, width), np.int64)
        self.counts = np.zeros(slots, np.int64)

    def add(self, slots: np.ndarray, vectors: np.ndarray) -> None:
        n = len(self.counts)
        self.counts += np.bincount(slots, minlength=n)
        for j in range(vectors.shape[1]):  # below 2^53: exact as doubles
            self.totals[:, j] += np.bincount(slots, vectors[:, j], n).astype(np.int64)

    def rows(self) -> pa.RecordBatch:
        used = np.flatnonzero(self.counts)
        width = self.totals.shape[1]
        columns = (np.repeat(used, width).astype(np.int32), np.tile(np.arange(width, dtype=np.int32), len(used)), self.totals[used].reshape(-1), np.repeat(self.counts[used], width))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["slot", "pos", "total", "n"])


def moved(centres: np.ndarray, sums: DataFrame) -> np.ndarray:
    """``centres`` (slots x width) with floor(sum / count) for every slot that has vectors; the others stay.

    ``sums`` has a row for each task, slot and position (``SUMS``), so the driver gets slots x width rows.
    """
    exact = lambda name: F.sum(F.col(name).cast("decimal(38,0)")).alias(name)
    out = centres.copy()
    for r in sums.groupBy("slot", "pos").agg(exact("total"), exact("n")).collect():
        out[r.slot, r.pos] = int(r.total) // int(r.n)
    return out
