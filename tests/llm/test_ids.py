"""Ids above 2^53 beside null ids, and encoding by chunks against the tokenizers on whole texts."""

import random

import pytest

from skysift.llm import encode, queries

BIG = [2**53 + 1, 2**53 - 3, 2**62 + 7, -(2**60) - 1, 5, None, None]


def with_tables(monkeypatch, **tables):
    monkeypatch.setattr(queries, "table", lambda spark, folder, name: tables[name])


def test_long_ids_beside_nulls(spark, folder, monkeypatch):
    words = "the quick brown fox jumps over the lazy dog again and again until it is tired of all that jumping around"
    docs = spark.createDataFrame([(i, f"{words} {n % 3}") for n, i in enumerate(BIG)], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(2**53 + 5, words), (None, "lazy dog again and again")], "item_id long, text string")
    pages = spark.createDataFrame([(i, "http://a", "same") for i in BIG], "page_id long, url string, html string").coalesce(1)
    with_tables(monkeypatch, documents=docs, benchmark=items, pages=pages)
    key = lambda x: (x is not None, x or 0)
    want = sorted(BIG, key=key)
    for name in ("op4_packing", "op8_wavelet_tokens"):
        got = getattr(queries, name)(spark, folder)
        assert dict(got.dtypes)["doc_id"] == "bigint"
        assert sorted((r.doc_id for r in got.collect()), key=key) == want
    got = queries.op3_decontaminate(spark, folder).collect()
    assert sorted({r.doc_id for r in got}, key=key) == sorted(set(BIG), key=key) and {r.item_id for r in got} == {2**53 + 5, None}
    got = queries.op9_warc_index(spark, folder).collect()
    assert sorted((r.page_id for r in got), key=key) == want
    top = max(i for i in BIG if i is not None)
    assert all(r.refers_to == (None if r.page_id in (None, top) else top) for r in got)


@pytest.mark.parametrize("name", [encode.BYTE_LEVEL, encode.WORD_LEVEL])
def test_chunks_give_the_ids_of_whole_texts(name):
    """Random texts of letters that the word-level vocabulary rewrites, marks, punctuation and all kinds of white space."""
    draw = random.Random(11)
    pieces = [*"aZséßİıſKÅﬁ½²Ⅷ漢ी̇́'’!*.,-#\"  \n\t\x0b\x1c  ‍09", "'s", "'ll", "<|", "word", "Ünder", "i̇*", "!!", "\r\n", "  "]
    texts = ["".join(draw.choice(pieces) for _ in range(draw.randint(1, 14))) for _ in range(12_000)] + ["hcİ*", "İ!", "aİ. b"]
    enc = encode.Encoder(encode.public_path(name))
    got = []
    for i in range(0, len(texts), 128):
        got += enc.ids(texts[i : i + 128])
    wrong = [t for t, ids in zip(texts, got, strict=True) if ids != enc._whole(t)]
    assert not wrong, wrong[:5]
