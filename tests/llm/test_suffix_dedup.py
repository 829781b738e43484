"""Exact substring dedup against a table of all strings."""

import hashlib
import random
from collections import Counter

import pytest

from skysift.llm import queries, suffix_dedup


def plain(rows, length):
    raws = [(d, (t or "").encode()) for d, t in rows]
    smallest = {}
    for d, raw in raws:
        for i in range(len(raw) - length + 1) if d is not None else ():
            s = raw[i : i + length]
            smallest[s] = min(d, smallest.get(s, d))
    out = []
    for d, raw in raws:
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1) if d is not None else ():
            if smallest[raw[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        spans = sum(x and not (i and gone[i - 1]) for i, x in enumerate(gone))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append(str((d, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())))
    return Counter(out)


def rows_of(df):
    return Counter(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in df.collect())


def test_documents_of_the_fixture(spark, folder, hard, monkeypatch):
    whole = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    docs = whole.union(hard.where("doc_id IS NULL OR doc_id <> 1009").select("doc_id", "text")).repartition(6)
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    want = plain([(r.doc_id, r.text) for r in docs.collect()], 50)
    assert rows_of(queries.op6_suffix_dedup(spark, folder)) == want
    assert sum(want.values()) == docs.count()
    assert rows_of(suffix_dedup.dedup(docs, shard_bytes=60_000, passes=3, memory=1000)) == want  # queues go to files


@pytest.mark.parametrize("length", [17, 50, 64])
def test_mixtures(spark, length):
    draw = random.Random(length)
    parts = ["".join(draw.choice("ab é\n") for _ in range(draw.randint(10, 160))) for _ in range(12)] + ["a" * 300, "ab" * 90]
    rows = [(draw.randint(0, 10**12), "".join(draw.choice(parts) for _ in range(draw.randint(0, 6)))) for _ in range(80)]
    docs = spark.createDataFrame([(*r, b"x", 5) for r in rows], "doc_id long, text string, kept binary, end int").repartition(4)
    assert rows_of(suffix_dedup.dedup(docs, length, shard_bytes=20_000)) == plain(rows, length)


def test_rows_of_one_id_and_empty_tables(spark):
    text = "".join(random.Random(3).choice("abcdefgh ") for _ in range(200))
    docs = spark.createDataFrame([(5, text), (5, text), (7, text[20:120] + "!"), (None, text), (9, text[:49])], "doc_id long, text string")
    got = {(r.doc_id, r.n_removed, r.n_spans, r.kept) for r in suffix_dedup.dedup(docs, with_kept=True).collect()}
    assert got == {(5, 0, 0, text.encode()), (7, 100, 1, b"!"), (None, 0, 0, text.encode()), (9, 0, 0, text[:49].encode())}
    assert suffix_dedup.dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("length", [16, 121, 128])
def test_lengths_beyond_the_counted_prefix_are_refused(spark, length):
    with pytest.raises(ValueError, match="length must be"):
        suffix_dedup.covered_spans(spark.createDataFrame([(1, "a")], "doc_id long, text string"), length=length)


def test_the_longest_length_is_exact(spark):
    draw = random.Random(2)
    text = "".join(draw.choice("abcdef ") for _ in range(230))
    docs = spark.createDataFrame([(1, text), (2, text[:200])], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in suffix_dedup.dedup(docs, length=120).collect()} == {1: 0, 2: 200}
