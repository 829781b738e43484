"""Token files as wavelet matrices.

A shard holds the ids of consecutive documents as bit-planes, highest bit first; after each plane the ids are parted stably,
zeros before ones.  Planes are cut into blocks of bits that are compressed one by one, with a directory of offsets and of
the ones before each block.  From one file, ``access`` gives the id at a place, ``rank`` counts an id before a place and
``select`` finds its n-th occurrence, each opening only a few blocks for every plane; ``decode`` gives all ids.

File: magic, length of the directory (8 bytes), directory (JSON, deflated), compressed blocks.
"""

from __future__ import annotations

import json
import struct
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skysift.lineage import shared_folder
from skysift.llm import encode, files
from skysift.llm.common import materialize, texts, with_long

MAGIC = b"WVLT0001"
BLOCK = 1 << 18  # bits
INDEX = "part long, shard long, file string, first_doc long, n_docs long, n_tokens long"


def build(ids: np.ndarray, doc_ids: list, lengths: list[int], block: int = BLOCK) -> bytes:
    """The file of a shard with ``ids`` (unsigned) of the documents ``doc_ids``, ``lengths`` ids each."""
    now = np.asarray(ids, np.uint32)
    width = max(1, int(now.max()).bit_length() if len(now) else 1)
    now = now.astype(np.uint16) if width <= 16 else now
    planes, body, at = [], [], 0
    for bit in range(width - 1, -1, -1):
        ones = (now & now.dtype.type(1 << bit)) != 0
        offsets, before, count = [], [], 0
        for i in range(0, len(ones), block):
            piece = ones[i : i + block]
            packed = zlib.compress(np.packbits(piece).tobytes(), 1)
            offsets.append(at)
            before.append(count)
            body.append(packed)
            at += len(packed)
            count += int(np.count_nonzero(piece))
        planes.append({"offsets": [*offsets, at], "before": [*before, count]})
        now = np.concatenate([now[~ones], now[ones]])
    directory = zlib.compress(json.dumps({"n": len(now), "width": width, "block": block, "planes": planes, "doc_ids": doc_ids, "lengths": lengths}).encode())
    return b"".join([MAGIC, struct.pack("<Q", len(directory)), directory, *body])


class Wavelet:
    """Reads a file; ``fetch(offset, length)`` gives its bytes, so that a store is asked for ranges only."""

    def __init__(self, fetch):
        head = fetch(0, 16)
        if head[:8] != MAGIC:
            raise ValueError("not a token file")
        size = struct.unpack("<Q", head[8:])[0]
        d = json.loads(zlib.decompress(fetch(16, size)))
        self.n, self.width, self.block, self.planes = d["n"], d["width"], d["block"], d["planes"]
        self.doc_ids, self.lengths = d["doc_ids"], d["lengths"]
        self._fetch, self._start = fetch, 16 + size
        self._bits = lru_cache(maxsize=64)(self._open)

    def _open(self, plane: int, k: int) -> np.ndarray:
        a, b = self.planes[plane]["offsets"][k : k + 2]
        size = min(self.block, self.n - k * self.block)
        return np.unpackbits(np.frombuffer(zlib.decompress(self._fetch(self._start + a, b - a)), np.uint8), count=size)

    def _ones(self, plane: int, i: int) -> int:
        """Ones before place ``i`` of a plane."""
        k = min(i // self.block, max(len(self.planes[plane]["offsets"]) - 2, 0))
        inside = i - k * self.block
        return self.planes[plane]["before"][k] + (int(np.count_nonzero(self._bits(plane, k)[:inside])) if inside else 0)

    def _zeros(self, plane: int) -> int:
        return self.n - self.planes[plane]["before"][-1]

    def access(self, i: int) -> int:
        value = 0
        for plane in range(self.width):
            bit = int(self._bits(plane, i // self.block)[i % self.block])
            value = value << 1 | bit
            i = self._zeros(plane) + self._ones(plane, i) if bit else i - self._ones(plane, i)
        return value

    def rank(self, value: int, i: int) -> int:
        """How often ``value`` stands before place ``i``."""
        if value >> self.width:
            return 0
        low, high = self._range(value, i)
        return high - low

    def _range(self, value: int, i: int) -> tuple[int, int]:
        low, high = 0, i
        for plane in range(self.width):
            if value >> (self.width - 1 - plane) & 1:
                low, high = (self._zeros(plane) + self._ones(plane, x) for x in (low, high))
            else:
                low, high = (x - self._ones(plane, x) for x in (low, high))
        return low, high

    def select(self, value: int, k: int) -> int:
        """Place of the ``k``-th ``value``, from 0; -1 if there are fewer."""
        if value >> self.width:
            return -1
        low, high = self._range(value, self.n)
        if k >= high - low:
            return -1
        at = low + k
        for plane in range(self.width - 1, -1, -1):
            one = value >> (self.width - 1 - plane) & 1
            at = self._nth(plane, at - self._zeros(plane) if one else at, one)
        return at

    def _nth(self, plane: int, k: int, one: int) -> int:
        before = np.array(self.planes[plane]["before"][:-1])
        if not one:
            before = np.arange(len(before)) * self.block - before
        b = int(np.searchsorted(before, k, side="right")) - 1
        return b * self.block + int(np.flatnonzero(self._bits(plane, b) == one)[k - before[b]])

    def decode(self) -> np.ndarray:
        """All ids, from the last plane upwards."""
        now = np.zeros(self.n, np.uint16 if self.width <= 16 else np.uint32)
        for plane in range(self.width - 1, -1, -1):
            blocks = [self._open(plane, k) for k in range(len(self.planes[plane]["offsets"]) - 1)]
            ones = np.concatenate(blocks).view(bool) if blocks else np.zeros(0, bool)
            zeros, up = self._zeros(plane), np.empty_like(now)
            up[~ones] = now[:zeros]
            up[ones] = now[zeros:] | now.dtype.type(1 << (self.width - 1 - plane))
            now = up
        return now


def open_file(uri: str) -> Wavelet:
    return Wavelet(lambda offset, length: files.read(uri, offset, length))


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int, shard_tokens: int = 1 << 21, folder: str | None = None) -> DataFrame:
    """Encode all documents, in ascending order of ``doc_id``, into token files; returns the written index.

    Texts are range-partitioned by id before they are encoded, so each task writes consecutive documents; null ids come
    first, repeated ids by their text, null texts are empty (the end id alone).  A task closes a file at about
    ``shard_tokens`` ids; only a single longer document makes a larger one.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "tokens")

    def run(batches):
        part, shard = TaskContext.get().partitionId(), 0
        ids, doc_ids, lengths, total = [], [], [], 0
        enc = encode.encoder(vocabulary)
        end = end_id.to_bytes(4, "little")

        def close():
            nonlocal ids, doc_ids, lengths, total, shard
            name = files.new_name(folder, part, ".wvlt")
            with files.create(name) as f:
                f.write(build(np.frombuffer(b"".join(ids), "<u4"), doc_ids, lengths))
            row = pd.DataFrame([(part, shard, name, doc_ids[0], len(doc_ids), total)], columns=[x.split()[0] for x in INDEX.split(", ")])
            row["first_doc"] = pd.array([doc_ids[0]], "Int64")
            ids, doc_ids, lengths, total, shard = [], [], [], 0, shard + 1
            return row

        for batch in batches:
            for doc_id, own in encode.encoded(enc, batch):
                own += end
                ids.append(own)
                doc_ids.append(None if doc_id is None else int(doc_id))
                lengths.append(len(own) // 4)
                total += lengths[-1]
                if total >= shard_tokens:
                    yield close()
        if doc_ids:
            yield close()

    ordered = texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered = ordered.withColumn("doc_id", F.col("doc_id").cast("string"))  # as in texts_by_name
    return materialize(ordered.mapInPandas(run, INDEX), "token-index")


def read_tokens(index: DataFrame) -> DataFrame:
    """Per document, from the files: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts the ids of all earlier documents: those of earlier tasks (one row a task is summed), of earlier files
    of the task, and of earlier documents of the file.
    """
    parts = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = index.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(base, "part")

    def run(batches):
        for batch in batches:
            for name, start in zip(batch["file"], batch["base"] + batch["inside"], strict=True):
                data = memoryview(files.read(name))  # all of it is wanted
                wavelet = Wavelet(lambda offset, length, data=data: bytes(data[offset : offset + length]))
                ids = wavelet.decode().astype("<u4")
                ends = np.cumsum(wavelet.lengths)
                starts = ends - wavelet.lengths
                yield pd.DataFrame({
                    "doc_id": [None if x is None else str(x) for x in wavelet.doc_ids],
                    "start": starts + start,
                    "n_tokens": wavelet.lengths,
                    "ids_crc32": [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)],
                })

    tasks = max(1, index.count() // 2)  # a row stands for a whole file, so rows, not bytes, are dealt
    few = shards.select("file", "base", "inside").repartition(tasks, "file")
    return with_long(few.mapInPandas(run, "doc_id string, start long, n_tokens long, ids_crc32 long"), "doc_id")
