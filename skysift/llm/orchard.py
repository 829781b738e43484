"""Vector code compression with Orchard's search.

A vector is cut into equal parts, and each part is replaced by the number of the nearest entry in the codebook of its
position.  Every entry has a list of the other entries, sorted by distance to it.  A search starts at some entry, walks its list,
marks what it visits, and jumps to the list of a better entry as soon as it meets one; it stops where the list is
beyond twice the current distance, since no entry further away can be as near.  The walks of a batch advance together on
numpy arrays.

The codebooks (parts x entries) live on the driver and travel with each round's tasks; vectors are read once a round and never
shuffled.  Errors of equal labels are summed before the shuffle and joined back.

Defined results: vectors that are null or hold null or non-finite components are dropped; of the rest, those count whose length
is the most frequent multiple of ``parts`` (the smaller of two); a null ``vec_id`` is encoded but never starts an entry, and
without any id there are no codebooks and no rows; repeated rows count once each, also as starting entries; equal distances
go to the lower index; an empty table gives no rows; null labels form one label; ids are longs of any size; extra columns of
any name are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysift.llm.common import materialize
from skysift.llm.laesa import squares
from skysift.llm.vectors import SUMS, Sums, integer_vectors, matrix, moved

PARTS = 16
ENTRIES = 64


class Orchard:
    """Nearest entries of one codebook (entries x width)."""

    def __init__(self, book: np.ndarray):
        self.book = book
        n = len(book)
        gaps = np.stack([squares(book, e) for e in book])
        gaps[np.arange(n), np.arange(n)] = -1  # itself comes first and is cut off
        self.lists = np.argsort(gaps, axis=1, kind="stable")[:, 1:]
        last = np.full((n, 1), np.iinfo(np.int64).max)
        self.gaps = np.hstack([np.take_along_axis(gaps, self.lists, axis=1), last])
        self.lists = np.hstack([self.lists, np.zeros((n, 1), np.int64)])
        sums = book.sum(axis=1)
        self.by_sum = np.argsort(sums, kind="stable")
        self.sums = sums[self.by_sum]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and squared distance, for each row of ``parts``."""
        n = len(parts)
        here = self.by_sum[np.minimum(np.searchsorted(self.sums, parts.sum(axis=1)), len(self.book) - 1)]
        best = squares(parts, self.book[here])
        visited = np.zeros((n, len(self.book)), bool)
        visited[np.arange(n), here] = True
        at, live = np.zeros(n, np.int64), np.arange(n)
        while True:
            live = live[self.gaps[here[live], at[live]] <= 4 * best[live]]
            if not len(live):
                return here, best
            entry = self.lists[here[live], at[live]]
            at[live] += 1
            new = ~visited[live, entry]
            q, e = live[new], entry[new]
            visited[q, e] = True
            d = squares(parts[q], self.book[e])
            wins = (d < best[q]) | ((d == best[q]) & (e < here[q]))
            q = q[wins]
            here[q], best[q], at[q] = e[wins], d[wins], 0


def encode(vectors: np.ndarray, searches: list[Orchard]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (vectors x parts) and squared distances of the same shape."""
    width = vectors.shape[1] // len(searches)
    found = [s.nearest(vectors[:, p * width : (p + 1) * width].astype(np.int64)) for p, s in enumerate(searches)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def train(table: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """Codebooks (parts x entries x width) after so many rounds; unused entries stay."""
    parts, entries, width = books.shape

    def summing(now: np.ndarray):
        def run(batches):
            searches, sums = [Orchard(b) for b in now], Sums(parts * entries, width)
            for b in batches:
                v = matrix(b.column("v"), parts * width)
                codes, _ = encode(v, searches)
                for p in range(parts):
                    sums.add(codes[:, p] + p * entries, v[:, p * width : (p + 1) * width])
            yield sums.rows()

        return run

    for _ in range(rounds):
        books = moved(books.reshape(-1, width), table.select("v").mapInArrow(summing(books), SUMS)).reshape(books.shape)
    return books


def compress(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = 2) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, label, code, error`` per vector, and the codebooks; ``code`` has two hex digits a part, so 256 entries at most."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits for each part: 1 to 256 entries")
    vectors = integer_vectors(embeddings, "label")
    lengths = vectors.where((F.size("v") > 0) & (F.size("v") % parts == 0)).groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    shape = "vec_id long, label {}, code string, error long".format(embeddings.schema["label"].dataType.simpleString())
    spark = embeddings.sparkSession
    if not lengths:
        return spark.createDataFrame([], shape), np.zeros((parts, 0, 0), np.int64)
    dim = lengths[0].n
    table = materialize(vectors.where(F.size("v") == dim), "integer-vectors")
    first = np.array([r.v for r in table.where("vec_id IS NOT NULL").select("vec_id", "v").orderBy("vec_id", "v").limit(entries).collect()], np.int64)
    if not len(first):
        return spark.createDataFrame([], shape), np.zeros((parts, 0, dim // parts), np.int64)
    books = train(table, np.stack(np.split(first, parts, axis=1)), rounds)

    def write(batches):
        searches = [Orchard(b) for b in books]
        for b in batches:
            codes, errors = encode(matrix(b.column("v"), dim), searches)
            digits = [row.tobytes().hex() for row in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(digits, pa.string()), pa.array(errors.sum(axis=1))], ["vec_id", "label", "code", "error"])

    return table.mapInArrow(write, shape), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def with_label_errors(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256``; labels meet by a null-safe equality join, split where one is hot."""
    codes = materialize(codes, "codes")
    totals = codes.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    joined = codes.join(materialize(totals, "label-errors"), F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
