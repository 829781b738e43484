"""Exact substring dedup over suffix arrays of shards.

A byte is removed if it lies in a string of ``length`` (50) bytes that also starts in a document with a smaller id.  Equal
strings must meet, wherever their documents are, so texts are dealt by content: of all 16-byte grams inside a string, the one
with the smallest hash names its shard, and consecutive strings with the same gram travel as one record (on average about 18
strings in 67 bytes).  A map task sends equal records of a block of documents once, with the places that hold them.

In a shard, records whose gram occurs in one document only cannot match and go; equal records are joined.  The rest, each
closed by a separator, is suffix-sorted by external induction (see ``induced``).  Suffixes that follow each other with a
common prefix of ``length`` or more are equal strings; the smallest document of each such run decides for all its places.

The number of shards follows the bytes of the input, and shards are worked off in ``passes`` over the documents, so that only
a part of the records is on disk at a time.

Defined results: null and empty texts have nothing to remove; documents without id are kept whole and lend nothing; rows that
repeat an id are one document (no string is a repeat because of the other row) and lose the spans found in any of them; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysift.lineage import shared_folder
from skysift.llm import induced
from skysift.llm.common import materialize, sorted_groups, texts, utf8

GRAM = 16  # a power of two
BLOCK_BYTES = 4 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_VALUES = np.random.default_rng(20).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_POWERS = np.cumprod(np.full(256, _ODD, np.uint64), dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the gram at each place, by doubling."""
    out, step, power = _VALUES[data], 1, _ODD
    while step < GRAM:
        out = out[:-step] * power + out[step:]
        power = power * power
        step *= 2
    return _mixed(out)


def _window_lows(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _planes(values: np.ndarray, kind: str) -> bytes:
    """Differences byte by byte, so that the upper bytes compress to nothing."""
    v = np.asarray(values, kind)
    return np.diff(v, prepend=v.dtype.type(0)).view(np.uint8).reshape(-1, v.itemsize).T.tobytes()


def _unplanes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    flat = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T)
    return np.cumsum(flat.view(kind).reshape(-1), dtype=kind)


def _slices(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return data[np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]


def _record_hashes(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hash of each of the records that stand one after another in ``data``."""
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(data)) - np.repeat(starts, lengths)
    return _mixed(np.add.reduceat(_VALUES[data] * _POWERS[place], starts) + lengths.astype(np.uint64)) if len(starts) else np.zeros(0, np.uint64)


def _first_equal(data: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each record, the number of the first one that equals it (same group, same bytes)."""
    order = np.lexsort((np.arange(len(hashes)), hashes, group))
    h, g = hashes[order], group[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])]) if len(h) else np.zeros(0, bool)
    first = np.empty(len(hashes), np.int64)
    first[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))] if len(h) else []
    starts = np.cumsum(lengths) - lengths
    twins = np.flatnonzero((first != np.arange(len(first))) & (lengths[first] == lengths))
    differ = np.zeros(len(first), bool)
    differ[lengths[first] != lengths] = True
    if len(twins):
        n = lengths[twins]
        unequal = _slices(data, starts[twins], n) != _slices(data, starts[first[twins]], n)
        edge = np.cumsum(n) - n
        differ[twins] = np.logical_or.reduceat(unequal, edge)
    return np.where(differ, np.arange(len(first)), first)  # equal hashes of unequal records stay apart


def _records(ids: list[int], raws: list[bytes], shards: int, length: int, one_of: tuple[int, int]) -> Iterator[tuple[int, bytes]]:
    """Shard and packed records of a block of documents; ``one_of = (k, n)`` keeps the shards of pass ``k`` of ``n``."""
    data = np.frombuffer(b"".join(raws), np.uint8)
    if len(data) < length:
        return
    sizes = np.array([len(r) for r in raws], np.int64)
    ends = np.cumsum(sizes)
    hashes = _gram_hashes(data)
    keyed = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    lows = _window_lows(keyed, length - GRAM + 1)
    inside = np.flatnonzero(np.repeat(ends, sizes)[: len(lows)] - np.arange(len(lows)) >= length)
    if not len(inside):
        return
    gram = (lows[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (inside[1:] != inside[:-1] + 1)])
    starts = inside[new]
    last = inside[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(inside) - 1]])]
    gram = gram[new]
    shard = (_mixed(hashes[gram]) % np.uint64(shards)).astype(np.int64)
    mine = shard % one_of[1] == one_of[0]
    starts, last, gram, shard = starts[mine], last[mine], gram[mine], shard[mine]
    lengths = last - starts + length
    order = np.argsort(shard, kind="stable")
    starts, gram, shard, lengths = starts[order], gram[order], shard[order], lengths[order]
    body = _slices(data, starts, lengths)
    first = _first_equal(body, lengths, _record_hashes(body, lengths), shard)
    doc = np.searchsorted(ends, starts, side="right")
    doc_ids = np.array(ids, np.int64)[doc]
    inner = starts - (ends - sizes)[doc]
    place = np.cumsum(lengths) - lengths
    edges = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)] if len(shard) else [0]
    pack = zstandard.ZstdCompressor(3)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        own = np.unique(first[a:b])  # one of each
        number = np.searchsorted(own, first[a:b])
        back = np.argsort(number, kind="stable")
        parts = [
            lengths[own].astype(np.uint8).tobytes(),
            (gram[own] - starts[own]).astype(np.uint8).tobytes(),
            _planes(np.bincount(number, minlength=len(own)), "<u4"),
            _planes(doc_ids[a:b][back], "<i8"),
            _planes(inner[a:b][back], "<u4"),
            _slices(body, place[own], lengths[own]).tobytes(),
        ]
        head = np.array([len(p) for p in parts], "<u4").tobytes()
        yield int(shard[a]), pack.compress(head + b"".join(parts))


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(raw, "<u4", 6)
    parts, at = [], 24
    for n in sizes.tolist():
        parts.append(raw[at : at + n])
        at += n
    u8 = lambda x: np.frombuffer(x, np.uint8)
    return u8(parts[0]).astype(np.int64), u8(parts[1]).astype(np.int64), _unplanes(parts[2], "<u4").astype(np.int64), _unplanes(parts[3], "<i8"), _unplanes(parts[4], "<u4").astype(np.int64), u8(parts[5])


def repeats_in_shard(blobs: list[bytes], length: int, memory: int, folder: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and end of what the shard's strings cover (at most one stretch for each record and place)."""
    lengths, offsets, counts, docs, inner, body = (np.concatenate(x) for x in zip(*map(_unpack, blobs), strict=True))
    nothing = (np.zeros(0, np.int64),) * 3
    first = _first_equal(body, lengths, _record_hashes(body, lengths), np.zeros(len(lengths), np.int64))
    own = np.unique(first)
    number = np.searchsorted(own, first)
    holder = np.repeat(number, counts)  # which record each place holds
    order = np.argsort(holder, kind="stable")
    holder, docs, inner = holder[order], docs[order], inner[order]
    edges = np.flatnonzero(np.concatenate([[True], holder[1:] != holder[:-1]]))
    least, most = np.minimum.reduceat(docs, edges), np.maximum.reduceat(docs, edges)
    starts, sizes, offsets = (np.cumsum(lengths) - lengths)[own], lengths[own], offsets[own]

    grams = _record_hashes(_slices(body, starts + offsets, np.full(len(own), GRAM)), np.full(len(own), GRAM))
    order = np.argsort(grams, kind="stable")
    groups = np.flatnonzero(np.concatenate([[True], grams[order][1:] != grams[order][:-1]]))
    several = np.minimum.reduceat(least[order], groups) < np.maximum.reduceat(most[order], groups)
    keep = np.zeros(len(own), bool)
    keep[order] = np.repeat(several, np.diff(np.append(groups, len(order))))
    kept = np.flatnonzero(keep)
    if not len(kept):
        return nothing

    # letters are bytes plus one (UTF-8 has none over 0xF4), so 0 can close each record
    n = sizes[kept] + 1
    at = np.cumsum(n) - n
    text = np.zeros(int(n.sum()), np.uint8)
    letters = np.ones(len(text), bool)
    letters[at + n - 1] = False
    text[letters] = _slices(body, starts[kept], sizes[kept]) + np.uint8(1)
    record = np.repeat(np.arange(len(kept), dtype=np.int32), n)
    room = np.repeat(at + n - 1, n) - np.arange(len(text))  # bytes before the separator
    low_doc, high_doc = least[kept], most[kept]
    smallest = np.full(len(text), np.iinfo(np.int64).max)  # smallest document of the string at each place
    rounds = int(np.ceil(np.log2(max(2, int(n.max()) // 2)))) + 1  # ties beyond a separator do not matter
    for places, low in induced.suffixes(text, memory, folder, rounds):
        if text[places[0]] == 0:
            continue
        edge = np.flatnonzero(low < length)
        run = np.diff(np.append(edge, len(places)))
        low_of_run = np.minimum.reduceat(low_doc[record[places]], edge)
        whole = room[places] >= length
        smallest[places[whole]] = np.repeat(low_of_run, run)[whole]

    matched = np.minimum.reduceat(smallest, at) < high_doc
    chosen = np.zeros(len(own), np.int64) - 1
    chosen[kept[matched]] = np.flatnonzero(matched)
    hit = np.flatnonzero(chosen[holder] >= 0)
    if not len(hit):
        return nothing
    rec = chosen[holder[hit]]
    strings = sizes[kept][rec] - length + 1
    flat_rec_at = np.repeat(at[rec], strings)
    edge = np.cumsum(strings) - strings
    offset = np.arange(int(strings.sum())) - np.repeat(edge, strings)
    covered = smallest[flat_rec_at + offset] < np.repeat(docs[hit], strings)
    low = np.minimum.reduceat(np.where(covered, offset, 1 << 20), edge)
    high = np.maximum.reduceat(np.where(covered, offset, -1), edge)
    some = high >= 0
    start = inner[hit][some]
    return docs[hit][some], start + low[some], start + high[some] + length


def covered_spans(docs: DataFrame, length: int = 50, shard_bytes: int = 6 << 20, passes: int = 2, memory: int = 1 << 24) -> DataFrame:
    """``doc_id, start, end``: stretches of bytes that repeat a smaller document; they may overlap."""
    if not GRAM < length <= induced.CAP:
        raise ValueError(f"length must be over {GRAM} and at most {induced.CAP}, the length to which common prefixes are counted")
    spark = docs.sparkSession
    rows = texts(docs).where("doc_id IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-4 * total // shard_bytes))  # records have about four times the bytes of the texts
    folder = shared_folder(spark, "suffix-queues")
    found = None

    def dealing(k: int):
        def deal(batches):
            ids, raws, size = [], [], 0
            for batch in batches:
                out = []
                for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                    raw = utf8(text)
                    if len(raw) >= length:
                        ids.append(int(doc_id))
                        raws.append(raw)
                        size += len(raw)
                    if size >= BLOCK_BYTES:
                        out += _records(ids, raws, shards, length, (k, passes))
                        ids, raws, size = [], [], 0
                if out:
                    yield pd.DataFrame(out, columns=["shard", "records"])
            if ids:
                yield pd.DataFrame(_records(ids, raws, shards, length, (k, passes)), columns=["shard", "records"])

        return deal

    def sort(batches):
        for g in sorted_groups(batches, ["shard"]):
            doc, start, end = repeats_in_shard(list(g["records"]), length, memory, folder)
            if len(doc):
                yield pd.DataFrame({"doc_id": doc, "start": start.astype(np.int32), "end": end.astype(np.int32)})

    for k in range(passes):
        dealt = rows.mapInPandas(dealing(k), "shard long, records binary").repartition("shard").sortWithinPartitions("shard")
        spans = materialize(dealt.mapInPandas(sort, "doc_id long, start int, end int"), "covered")
        found = spans if found is None else found.union(spans)
        spark._jvm.System.gc()  # lets Spark drop the shuffle files of the pass that is done
    return found


def merged(starts, ends, size: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(zip(starts, ends, strict=True)):
        a, b = int(a), min(int(b), size)
        if a >= b:
            continue
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def dedup(docs: DataFrame, length: int = 50, with_kept: bool = False, **options) -> DataFrame:
    """Per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``; with ``with_kept`` also the bytes that remain."""
    spans = covered_spans(docs, length, **options)
    by_doc = spans.groupBy(F.col("doc_id").alias("own")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    fields = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept

    @F.pandas_udf(fields)
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, found in batches:
            out = []
            for t, s in zip(text, found, strict=True):
                raw = utf8(t)
                gone = merged([x["start"] for x in s], [x["end"] for x in s], len(raw)) if s is not None else []
                kept = without(raw, gone)
                out.append((len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept)[: 4 + with_kept])
            yield pd.DataFrame(out, columns=[x.split()[0] for x in fields.split(", ")])

    return texts(docs).join(by_doc, F.col("doc_id") == F.col("own"), "left").select("doc_id", cut("text", "spans").alias("x")).select("doc_id", "x.*")
