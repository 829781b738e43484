"""SimHash near-duplicates by deletion variants.

A fingerprint has 64 bits, one for each bit that is set in over half of the XXH64 hashes (seed 42) of the word shingles.
Two fingerprints link at ``distance`` (2) or fewer differing bits.  Cut into two segments of 32 bits, linked fingerprints
have a segment that differs by one bit at most, so they share the segment or one of its 32 variants with one bit wild.
Variants of distinct fingerprints are counted by key (combined before the shuffle), keys without a pair go, and the rest
meets in an equality join, where a wild bit joins zeros to ones; each pair is verified by its whole distance.

Keys with more pairs than ``crowd`` fingerprints have are not joined: their rows get finer keys by halves of the other
segment, again with one bit wild, and then by quarters.  A quarter key leaves 8 bits and the wild ones open, which bounds
its group whatever the input; no link is lost, as halves obey the same pigeonhole rule.

Documents with one fingerprint are one row here, whatever their number.

Defined results: null and empty texts have fingerprint zero and link like any other; repeated rows and null ids get one row
each, and a component of null ids alone has a null id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysift.lineage import by_sort
from skysift.llm.common import materialize, texts, utf8
from skysift.llm.links import components

SEED = 42
CROWD = 256


def shingle_hashes(text: str, size: int) -> np.ndarray:
    words = utf8(text).lower().split()  # ASCII letters and blanks only
    if not words:
        return np.zeros(0, np.uint64)
    hash64 = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([hash64(b" ".join(words), SEED)], np.uint64)
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.array([hash64(flat[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: str, size: int) -> int:
    hashes = shingle_hashes(text, size)
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint(t, size) for t in batch], dtype="int64")

    return texts(docs).select("doc_id", of("text").alias("fp"))


LEVELS = 3


def _keyed(rows: DataFrame, level: int) -> DataFrame:
    """One row per key of this level: all columns, ``k<level>`` and ``side``, with the new ``open``.

    ``open`` is the first of the ``64 >> level`` bits that are not yet keyed; they are cut into two segments.  A segment
    has one key as it is (for partners with the same bits; ``side`` is null) and one for each bit that is wild (for partners
    that differ in just that bit; ``side`` is the bit).
    """
    width = 32 >> level
    full = (1 << width) - 1
    choices = []
    for start in range(0, 64, 2 * width):
        for own, other in ((start, start + width), (start + width, start)):
            bits = F.shiftrightunsigned("fp", own).bitwiseAND(F.lit(full).cast("long"))
            here = F.col("open") == start
            for wild in range(-1, width):
                masked = bits.bitwiseAND(F.lit(full if wild < 0 else full ^ 1 << wild).cast("long"))
                side = F.lit(None).cast("long") if wild < 0 else F.shiftright(bits, wild).bitwiseAND(F.lit(1).cast("long"))
                code = (own // width * 64 + wild + 1) << 32
                choices.append(F.when(here, F.struct(masked.bitwiseOR(F.lit(code).cast("long")).alias("k"), side.alias("side"), F.lit(other).alias("open"))))
    kept = [c for c in rows.columns if c != "open"]
    return rows.select(*kept, F.explode(F.filter(F.array(*choices), lambda x: x.isNotNull())).alias("x")).select(
        *kept, F.col("x.k").alias(f"k{level}"), F.col("x.side").alias("side"), F.col("x.open").alias("open")
    )


def near_pairs(prints: DataFrame, distance: int = 2, crowd: int = CROWD) -> DataFrame:
    """Pairs ``a, b`` of distinct fingerprints (column ``fp``) within ``distance`` bits, for a distance of 2 at most."""
    if not 0 <= distance <= 2:
        raise ValueError("two segments with one wild bit find distances up to 2")
    rows, found = prints.select("fp", F.lit(0).alias("open")), None
    for level in range(LEVELS):
        keys = [f"k{i}" for i in range(level + 1)]
        keyed = _keyed(rows, level)
        ones, n = F.sum("side"), F.count("*")
        pairs = F.when(ones.isNull(), n * (n - 1) / 2).otherwise(ones * (n - ones))
        counts = keyed.groupBy(*keys).agg(pairs.alias("pairs")).where("pairs > 0")
        shared = materialize(keyed.join(by_sort(counts), keys), "variants")
        few = shared if level == LEVELS - 1 else shared.where(F.col("pairs") <= crowd * crowd)
        left = few.where("side IS NULL OR side = 0").select(*keys, F.col("fp").alias("a"))
        right = few.where("side IS NULL OR side = 1").select(*keys, F.col("fp").alias("b"), "side")
        linked = (
            left.join(by_sort(right), keys)
            .where((F.col("side").isNotNull() | (F.col("a") < F.col("b"))) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
            .select("a", "b")
        )
        found = linked if found is None else found.union(linked)
        rows = shared.where(F.col("pairs") > crowd * crowd).drop("pairs", "side")
        if rows.isEmpty():
            break
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def classes(docs: DataFrame, size: int = 3, distance: int = 2, crowd: int = CROWD) -> DataFrame:
    """One row per document: ``doc_id, fingerprint`` (16 hex digits) and ``component_id``, the smallest id reachable."""
    prints = materialize(fingerprints(docs, size), "fingerprints")
    smallest = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    nodes = components(near_pairs(smallest, distance, crowd))
    roots = smallest.join(by_sort(nodes), F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = materialize(roots.join(by_sort(ids), "root").select(F.col("fp").alias("own"), "component_id"), "components")
    return prints.join(by_sort(labels), F.col("fp") == F.col("own")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
