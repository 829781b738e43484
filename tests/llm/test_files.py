"""Token files, packing and archives: exact round trips and plain re-statements."""

import base64
import gzip
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from skysift.llm import encode, packing, queries, warc, wavelet

ODD = [
    "a  b", "a \n b", "a\n\nb", " lead", "trail ", "trail  \n", "\n", "it's we'll ''ll don'T", "x\x1cy \x1c z", "no break　wide   x", "tab\tab \t x",
    "<|endoftext|> in  <|endoftext|>\n text <|startoftext|>x", "é ́x Å", "ΣΑΣ ΟΔΟΣ Σ", "12345 6.7,8  ###  #", "🙂🙂 🙂", "\x00 \x7f", "", " ", "  ", "İıſK", "한국 어 ᄒ ᅡ",
]


@pytest.mark.parametrize("name", [encode.BYTE_LEVEL, encode.WORD_LEVEL])
def test_chunks_give_the_ids_of_whole_texts(spark, folder, name):
    path = encode.public_path(name)
    whole, own = Tokenizer.from_file(path), encode.Encoder(path, limit=3000, core=1000)
    draw = random.Random(1)
    pool = list(" \n\t\r\x0b\x85  　\x1c'sSa.,1é́世<|")
    made = ["".join(draw.choice(pool) for _ in range(draw.randint(1, 40))) for _ in range(3000)]
    texts = [*ODD, *made, "x\ue000 y", *(r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect())]
    for i in range(0, len(texts), 7):
        for text, ids in zip(texts[i : i + 7], own.ids(texts[i : i + 7]), strict=True):
            assert ids == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


@pytest.mark.parametrize("n", [0, 1, 7, 1000, 5000])
def test_wavelet_matches_arrays(n):
    rng = np.random.default_rng(n)
    ids = rng.zipf(1.3, n).clip(0, 70_000 if n == 5000 else 49_000)
    data = wavelet.build(ids, [1], [n], block=512)
    w = wavelet.Wavelet(lambda offset, length: data[offset : offset + length])
    assert (w.decode() == ids).all()
    for i in rng.integers(0, max(n, 1), 30 if n else 0):
        v = int(ids[i])
        places = np.flatnonzero(ids == v)
        assert w.access(int(i)) == v and w.rank(v, int(i)) == (ids[:i] == v).sum()
        assert [w.select(v, k) for k in range(min(5, len(places)))] == places[:5].tolist()
        assert w.select(v, len(places)) == -1
    assert w.rank(1 << 20, n) == 0 and w.select(60_001, 0) in (-1, *np.flatnonzero(ids == 60_001))


def test_token_files(spark, folder, hard, monkeypatch):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").union(hard.select("doc_id", "text"))
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    whole = Tokenizer.from_file(encode.public_path(encode.WORD_LEVEL))
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, start = [], 0
    for doc_id, text in rows:
        ids = [*whole.encode(text, add_special_tokens=False).ids, 1]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in queries.op8_wavelet_tokens(spark, folder).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    index = wavelet.write_tokens(docs, encode.public_path(encode.WORD_LEVEL), 1, shard_tokens=5000)
    assert index.count() > 10 and sorted(map(str, ((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in wavelet.read_tokens(index).collect()))) == sorted(map(str, want))
    one = index.orderBy("part", "shard").first()
    w = wavelet.open_file(one.file)
    assert [w.access(i) for i in range(20)] == w.decode()[:20].tolist()
    empty = wavelet.write_tokens(docs.limit(0), encode.public_path(encode.WORD_LEVEL), 1)
    assert wavelet.read_tokens(empty).count() == 0


def check_packing(rows, texts, size):
    whole = Tokenizer.from_file(encode.public_path(encode.BYTE_LEVEL))
    want = Counter()
    for doc_id, text in texts:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) - size * ((len(ids) - 1) // size) if len(ids) > size else len(ids)
        for k, (a, b) in enumerate([(0, first), *((i, i + size) for i in range(first, len(ids), size))]):
            want[str((doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))] += 1
    assert Counter(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for xs in by.values():
        at = 0
        for offset, length in sorted(xs):
            assert offset == at
            at += length
        assert at <= size
    return len(by), sum(r.length for r in rows)


def test_packing(spark, folder, hard, monkeypatch):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").union(hard.select("doc_id", "text"))
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    used, tokens = check_packing(queries.op4_packing(spark, folder).collect(), texts, 1024)
    assert used <= 1.01 * tokens / 1024 + 2
    check_packing(packing.pack(docs.repartition(7), encode.public_path(encode.BYTE_LEVEL), 2, 64).collect(), texts, 64)
    assert packing.pack(docs.limit(0), encode.public_path(encode.BYTE_LEVEL), 2).count() == 0


def test_fullest_is_the_best_sum():
    draw = random.Random(2)
    for _ in range(300):
        counts = {draw.randint(1, 30): draw.randint(1, 4) for _ in range(draw.randint(1, 6))}
        room = draw.randint(0, 60)
        sums = {0}
        for x, m in counts.items():
            sums = {s + x * k for s in sums for k in range(m + 1)}
        got = packing.fullest(counts, room)
        assert all(m <= counts[x] for x, m in got.items())
        assert sum(x * m for x, m in got.items()) == max(s for s in sums if s <= room)


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(4)
    histogram = Counter(rng.integers(1, 1025, 200_000).tolist()) + Counter({1024: 300_000, 100: 70_000})
    steps = packing.plan(histogram, 1024)
    used = Counter()
    for times, combination in steps:
        assert sum(x * m for x, m in combination.items()) <= 1024
        for x, m in combination.items():
            used[x] += times * m
    assert used == histogram
    bound = -(-sum(x * m for x, m in histogram.items()) // 1024)
    assert sum(t for t, _ in steps) <= 1.001 * bound and len(steps) < 10_000


PAGES = [
    (1, "http://a/1", "same"), (2, "http://a/2 x\r\ny", "same"), (3, None, None), (4, "", ""), (5, "http://é/", "é\r\n\r\nx"), (2, "http://a/2", "same"),
    (9, "http://b", "same"), (9, "http://b", "same"), (None, "u", "same"), (None, None, None), (7, "u", "z" * 300_000), (6, "u", "z" * 300_000), (6, "u", "other"),
]


def plain_archive(rows, least=0):
    out = []
    for page_id, html in rows:
        payload = (html or "").encode()
        heads = [p for p, h in rows if p is not None and (h or "") == (html or "")]
        revisit = len(payload) >= least and page_id is not None and page_id < max(heads)
        sha = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append(str((page_id, len(payload), sha, "revisit" if revisit else "response", max(heads) if revisit else None)))
    return sorted(out)


def test_archives(spark, folder, monkeypatch):
    pages = spark.createDataFrame([(*r, "x", 1) for r in PAGES], "page_id long, url string, html string, digest string, offset int").repartition(3)
    index = warc.write_archives(pages, file_bytes=2000)
    got = warc.read_records(index, gap=100, most=1000)
    state = lambda df: sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in df.collect())
    assert state(got) == plain_archive([(p, h) for p, _, h in PAGES])
    assert state(warc.read_records(warc.write_archives(pages, least=100))) == plain_archive([(p, h) for p, _, h in PAGES], 100)
    one = index.where("record_type = 'response' AND page_id = 5").first()
    with open(one.file.removeprefix("file:"), "rb") as f:
        data = f.read()
    fields, payload = warc.parse(gzip.decompress(data[one.offset : one.offset + one.length]))
    assert payload.decode() == "é\r\n\r\nx" and fields["WARC-Target-URI"] == "http://é/"
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == index.where(f"file = '{one.file}'").count()
    assert warc.read_records(index.where("page_id = 5")).count() == 1
    assert warc.read_records(warc.write_archives(pages.limit(0))).count() == 0
    whole = spark.read.parquet(f"{folder}/pages.parquet")
    monkeypatch.setattr(queries, "table", lambda *_: whole)
    assert state(queries.op9_warc_index(spark, folder)) == plain_archive([(r.page_id, r.html) for r in whole.collect()])


def test_ranges_are_coalesced():
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 50, 5), ("a", 200, 5), ("b", 205, 5), ("b", 210, 90), ("b", 300, 20)]
    assert warc.ranges(rows, 30, 100) == [["a", 0, 55, 3], ["a", 200, 205, 1], ["b", 205, 300, 2], ["b", 300, 320, 1]]
