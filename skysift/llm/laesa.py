"""Centroid clustering with a LAESA pivot table.

The distances of every vector to a few fixed pivots are computed once and written beside it.  In each round the distances of
the centroids to the same pivots are known too, and by the triangle inequality the difference of the two bounds the
distance from vector to centroid from below.  A vector meets its centroids in ascending order of that bound, gets an
exact integer distance to each, and stops at the first bound above the best distance found; no other centroid can win
or tie.

Each round reads the table once and returns one row per task, centroid and position; vectors are never shuffled, so a vector
that stands for a third of all rows costs no more than others.

Defined results: vectors that are null, have another number of components than ``dim`` or hold null or non-finite ones are
dropped; a null ``vec_id`` is clustered but never starts a centroid, and without any id there are no centroids and no rows; an
empty table gives no rows; repeated rows count once each; equal distances go to the smaller number; ids are longs of any
size; extra columns of any name are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysift.llm.common import materialize
from skysift.llm.vectors import SUMS, Sums, integer_vectors, lists, matrix, moved

PIVOTS = 8


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of ``a`` to those of ``b``, pair by pair."""
    gap = a.astype(np.int64) - b
    return np.einsum("ij,ij->i", gap, gap)


def table_of(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances to each pivot: vectors x pivots."""
    return np.sqrt(np.stack([squares(vectors, p) for p in pivots], axis=1).astype(float)) if len(pivots) else np.zeros((len(vectors), 0))


def choose_pivots(points: np.ndarray, count: int) -> np.ndarray:
    """Of ``points``, those with the largest sum of distances to the ones chosen before; equal points are chosen once."""
    points = np.unique(points, axis=0)
    chosen, far = [], np.zeros(len(points))
    while len(chosen) < min(count, len(points)):
        far[chosen] = -1
        chosen.append(int(np.argmax(far)))
        far += np.sqrt(squares(points, points[chosen[-1]]).astype(float))
    return points[chosen]


def nearest(vectors: np.ndarray, stored: np.ndarray, centroids: np.ndarray, centroid_table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each vector: number of its nearest centroid, squared distance, and how many centroids got an exact distance."""
    n, k = len(vectors), len(centroids)
    low = np.zeros((n, k))
    for p in range(stored.shape[1]):
        np.maximum(low, np.abs(stored[:, p, None] - centroid_table[None, :, p]), out=low)
    low = np.maximum(low - 1e-6, 0.0) ** 2 * (1 - 1e-12)  # rounding of the roots never lifts a bound above its distance
    order = np.argsort(low, axis=1, kind="stable")
    best, number, tried = np.full(n, np.iinfo(np.int64).max), np.full(n, k), np.zeros(n, np.int64)
    live = np.arange(n)
    for step in range(k):
        c = order[live, step]
        go = low[live, c] <= best[live]
        live, c = live[go], c[go]
        if not len(live):
            break
        d = squares(vectors[live], centroids[c])
        tried[live] += 1
        wins = (d < best[live]) | ((d == best[live]) & (c < number[live]))
        best[live[wins]], number[live[wins]] = d[wins], c[wins]
    return number, best, tried


def seeds(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors whose ids have the smallest SHA-256, in ascending order of it."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.where("vec_id IS NOT NULL").select(rank.alias("rank"), "v").orderBy("rank", "v").limit(k).collect()
    return np.array([r.v for r in first], np.int64)


def cluster(embeddings: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, seed: int = 2, pivots: int = PIVOTS) -> DataFrame:
    """One row per vector: ``vec_id, cluster, distance`` (squared), ``cluster_inertia``, ``inertia``, ``centroid_sha256`` and ``exact_distances``.

    The driver holds k centroids of ``dim`` components, whatever the number of vectors.
    """
    vectors = integer_vectors(embeddings).where(F.size("v") == dim)
    centroids = seeds(vectors, k, seed)
    if not len(centroids):
        empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, exact_distances long"
        return embeddings.sparkSession.createDataFrame([], empty)
    fixed = choose_pivots(centroids, pivots)

    def measure(batches):
        for b in batches:
            v = matrix(b.column("v"), dim)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), lists(table_of(v, fixed))], ["vec_id", "v", "d"])

    table = materialize(vectors.mapInArrow(measure, "vec_id long, v array<int>, d array<double>"), "pivot-table")

    def assigned(batches, now: np.ndarray):
        there = table_of(now, fixed)
        for b in batches:
            v = matrix(b.column("v"), dim)
            yield b, v, nearest(v, matrix(b.column("d"), len(fixed)), now, there)

    def summing(now: np.ndarray):
        def run(batches):
            sums = Sums(len(now), dim)
            for _, v, (number, _, _) in assigned(batches, now):
                sums.add(number, v)
            yield sums.rows()

        return run

    for _ in range(rounds):
        centroids = moved(centroids, table.select("v", "d").mapInArrow(summing(centroids), SUMS))

    def label(batches):
        for b, _, (number, best, tried) in assigned(batches, centroids):
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(best), pa.array(tried)], ["vec_id", "cluster", "distance", "exact_distances"])

    final = materialize(table.mapInArrow(label, "vec_id long, cluster int, distance long, exact_distances long"), "clusters")
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    inertia = {r.cluster: int(r.total) for r in final.groupBy("cluster").agg(exact.alias("total")).collect()}
    facts = [(c, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c in inertia]
    known = embeddings.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return final.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "exact_distances")
