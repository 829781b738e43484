"""Language identification: kernels against sets of strings, held-out accuracy, and defined results."""

import re
import zlib

import numpy as np
import pytest

from skysift.llm import kernels, queries


def plain_grams(text, n):
    s = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    s = re.sub(" +", " ", s)
    return {s[i : i + n] for i in range(len(s) - n + 1)}


TEXTS = ["Der Hund, die Katze!", "le chien et le chat 12", "ÄÖÜ äöü ñandú", "x", "жук и жаба", "aaaa aaaa", "漢字仮名 漢字", "𝔘𝔫 test\x85test"]


def test_kernel_matches_sets(spark):
    marks = kernels.Landmarks(TEXTS[:5])
    got = marks.kernel([kernels.characters(t) for t in TEXTS])
    for i, a in enumerate(TEXTS):
        for j, b in enumerate(TEXTS[:5]):
            want = 0
            for n in kernels.ORDERS:
                known = set().union(*(plain_grams(t, n) for t in TEXTS[:5]))
                x, y = plain_grams(a, n) & known, plain_grams(b, n)
                want += len(x & y) / np.sqrt(max(len(x), 1) * len(y)) / len(kernels.ORDERS)
            assert got[i, j] == pytest.approx(want, abs=1e-5), (a, b)


def test_folded_weights_equal_the_kernel_form():
    marks = kernels.Landmarks(TEXTS)
    own = sum(p @ p.T for p in marks.presences) / len(kernels.ORDERS)
    labels = np.array([0, 1, 0, 1, 2, 1, 2, 0])
    fitted = kernels.solve(own, own, labels, 3, 0.01)
    model = kernels.Model(["a", "b", "c"], marks.vocabularies, [p.T @ fitted / len(kernels.ORDERS) for p in marks.presences])
    codes = [kernels.characters(t) for t in TEXTS]
    assert np.allclose(model.scores(codes), marks.kernel(codes) @ fitted, atol=1e-4)
    assert (model.scores(codes).argmax(axis=1) == labels).all()


def test_vocabulary_finds_what_it_holds():
    codes = np.unique(np.random.default_rng(4).integers(0, 1 << 62, 5000))
    book = kernels.Vocabulary(codes)
    assert len(book.layers) > 1
    asked = np.concatenate([codes, codes + 1, codes])
    assert sorted(book.find(asked).tolist()) == sorted([*range(5000), *range(5000), *np.flatnonzero(np.isin(codes, codes + 1))])
    assert len(kernels.Vocabulary(codes[:0]).find(codes)) == 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = queries.op12_language_kernels(spark, folder).collect()
    assert sorted(r.doc_id for r in got) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.97


def test_defined_results(spark, hard, folder, monkeypatch):
    known = spark.createDataFrame([(i, "the cat sat on the mat" if i % 2 else "der hund und die katze", "en" if i % 2 else "de", "s", 1, 1.0, "x", True) for i in range(2000, 2040)], hard.schema)
    docs = known.unionByName(hard.withColumn("lang", kernels.F.lit(None).cast("string")))
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    got = queries.op12_language_kernels(spark, folder).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    assert {by[i].lang_pred for i in (1001, 1002, 1003)} == {"und"} and by[1001].score == 0
    assert by[1007].lang_pred == "en" and by[2000].lang_pred == "de" and by[2001].lang_pred == "en"
    assert by[None].held_out is False
    monkeypatch.setattr(queries, "table", lambda *_: docs.limit(0))
    assert queries.op12_language_kernels(spark, folder).collect() == []
    monkeypatch.setattr(queries, "table", lambda *_: docs.withColumn("lang", kernels.F.lit(None).cast("string")))
    assert {r.lang_pred for r in queries.op12_language_kernels(spark, folder).collect()} == {"und"}


def test_held_out_labels_are_not_used(spark, folder, monkeypatch):
    """Wrong labels on held-out rows change nothing."""
    rows = [(i, f"the cat sat {i}" if i % 2 else f"der hund und {i}", "en" if i % 2 else "de") for i in range(400)]
    spoilt = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    found = []
    for now in (rows, spoilt):
        docs = spark.createDataFrame(now, "doc_id long, text string, lang string")
        monkeypatch.setattr(queries, "table", lambda *_, docs=docs: docs)
        found.append(sorted(tuple(r) for r in queries.op12_language_kernels(spark, folder).collect()))
    assert found[0] == found[1]
