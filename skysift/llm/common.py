"""Helpers shared by the operators of this package."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.lineage import shared_folder

#: ``bytes.split()`` and ``bytes.lower()`` know ASCII only, which is what the word rule asks for.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with null texts empty; other columns are left out, so none can clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def texts_by_name(docs: DataFrame) -> DataFrame:
    """``texts`` with the id as a string: beside a null, pandas would turn longs into doubles and lose digits above 2^53."""
    return texts(docs).withColumn("doc_id", F.col("doc_id").cast("string"))


def with_long(df: DataFrame, *names: str) -> DataFrame:
    """Ids that travelled as strings, as longs again."""
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lost executors recompute nothing before it."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def utf8(text: str) -> bytes:
    """UTF-8 bytes; lone surrogates cannot come out of Spark strings, but must not stop a job."""
    return text.encode("utf-8", "surrogatepass")


class WordHashes(dict):
    """Word (bytes) to its 64-bit hash; forgets everything when it holds ``limit`` words."""

    def __init__(self, limit: int = 500_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value

    def of(self, text: str) -> np.ndarray:
        """Hashes of the lower-cased (A-Z) words of a text."""
        words = utf8(text).lower().split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def sorted_groups(batches, keys: list[str]):
    """Groups of consecutive rows with equal ``keys`` as dicts of arrays, across the batches of a sorted partition."""
    held: list[dict] = []

    def joined():
        return {c: np.concatenate([x[c] for x in held]) for c in held[0]} if len(held) > 1 else held[0]

    for batch in batches:
        if not len(batch):
            continue
        columns = {c: batch[c].to_numpy() for c in batch.columns}
        n = len(batch)
        new = np.zeros(n, bool)
        for k in keys:
            new[1:] |= columns[k][1:] != columns[k][:-1]
        if held and any(held[-1][k][-1] != columns[k][0] for k in keys):
            yield joined()
            held = []
        edges = [0, *np.flatnonzero(new).tolist(), n]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            held.append({c: v[a:b] for c, v in columns.items()})
            if b < n:
                yield joined()
                held = []
    if held:
        yield joined()
