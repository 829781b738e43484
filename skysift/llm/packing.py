"""Best-fit packing by minimum bin slack.

A sequence holds at most ``size`` tokens, so only ``size`` lengths exist: whatever the number of documents, the pieces are
described by a histogram of at most ``size`` counts.  On it, each sequence starts with the longest piece that is left and is
filled by a bitset subset-sum over the lengths that are left; the fullest feasible combination is then removed as often as
the counts allow.  The plan (at most a few combinations for each length) is the only thing that passes the driver.

Pieces then find their places in parallel: their rank within their length (counts by task, summed over tasks) selects the
combination, the sequence and the offset.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skysift.llm import encode
from skysift.llm.common import materialize, texts_by_name, with_long

PIECES = "doc_id string, piece int, start long, length long, ids_crc32 long, part long, nth long"
PLACED = "doc_id string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def cut_points(n: int, size: int) -> list[tuple[int, int]]:
    """Start and length of each piece: only longer documents are cut, and only the first piece may be shorter."""
    if n <= size:
        return [(0, n)]
    first = n - size * ((n - 1) // size)
    return [(0, first)] + [(at, size) for at in range(first, n, size)]


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length make the largest sum up to ``room``; longer pieces are preferred.

    Bit ``s`` of a set says that the sum ``s`` can be made; each length's copies are added by doubling.
    """
    mask, sums, before = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        before.append((length, sums))
        copies, step = min(counts[length], room // length), 1
        while copies:
            take = min(step, copies)
            sums |= sums << (take * length) & mask
            copies, step = copies - take, step * 2
        if sums >> room & 1:
            break
    rest, out = sums.bit_length() - 1, {}
    for length, sums in reversed(before):
        used = 0
        while not sums >> rest & 1:
            rest, used = rest - length, used + 1
        if used:
            out[length] = used
    return out


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, dict[int, int]]]:
    """Combinations of lengths and how many sequences use each."""
    left = {k: int(v) for k, v in histogram.items() if v}
    steps = []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        combination = Counter(fullest(rest, size - longest))
        combination[longest] += 1
        times = min(left[x] // m for x, m in combination.items())
        steps.append((times, dict(combination)))
        for x, m in combination.items():
            left[x] -= times * m
            if not left[x]:
                del left[x]
    return steps


def slots(steps: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """The plan by length and rank: from which rank on a piece of a length goes to which sequences, at which offset."""
    rows, taken, sequence = [], Counter(), 0
    for times, combination in steps:
        offset = 0
        for length in sorted(combination, reverse=True):
            m = combination[length]
            rows.append((length, taken[length], sequence, m, offset))
            taken[length] += times * m
            offset += length * m
        sequence += times
    rows.sort()
    names = ("length", "rank", "sequence", "copies", "offset")
    table = {k: np.array(v, np.int64) for k, v in zip(names, zip(*rows, strict=True), strict=True)} if rows else {k: np.zeros(0, np.int64) for k in names}
    table["key"] = table["length"] << 48 | table["rank"]
    return table


def pieces(docs: DataFrame, vocabulary: str, end_id: int, size: int) -> DataFrame:
    """One written row per piece; ``nth`` counts the pieces of its length within its task ``part``.

    Encoding is done once: the table is written before it is counted.  Null texts are empty (the end id alone).
    """

    def run(batches):
        part, seen = TaskContext.get().partitionId(), Counter()
        enc, end = encode.encoder(vocabulary), end_id.to_bytes(4, "little")
        for batch in batches:
            rows = []
            for doc_id, ids in encode.encoded(enc, batch):
                ids += end
                for k, (start, length) in enumerate(cut_points(len(ids) // 4, size)):
                    rows.append((doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, seen[length]))
                    seen[length] += 1
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in PIECES.split(", ")])

    return materialize(texts_by_name(docs).mapInPandas(run, PIECES), "pieces")


def pack(docs: DataFrame, vocabulary: str, end_id: int, size: int = 1024) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``; sequences are gapless from offset 0.

    Repeated rows and null ids are documents like any other; an empty table gives no rows; other columns are ignored.
    """
    cut = pieces(docs, vocabulary, end_id, size)
    counts = materialize(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    where = slots(plan(histogram, size))
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))

    # ``base`` has up to ``size`` rows a task, so it grows with the tasks: it is merged in, never broadcast.
    def place(batches):
        for batch in batches:
            rank = (batch["base"] + batch["nth"]).to_numpy()
            length = batch["length"].to_numpy()
            k = np.searchsorted(where["key"], length << 48 | rank, side="right") - 1
            inside = rank - where["rank"][k]
            batch["sequence_id"] = where["sequence"][k] + inside // where["copies"][k]
            batch["offset"] = where["offset"][k] + inside % where["copies"][k] * length
            yield batch[[x.split()[0] for x in PLACED.split(", ")]]

    return with_long(cut.join(base.hint("merge"), ["length", "part"]).mapInPandas(place, PLACED), "doc_id")
