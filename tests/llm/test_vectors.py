"""Vector codes and clusters against brute force in plain Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from skysift.llm import laesa, orchard, queries

SHAPE = "vec_id long, embedding array<float>, label int, code string, cluster int, distance long, v array<int>, error long"


def plain(x):
    return [math.floor(256 * float(c)) for c in x]


def near(v, centres):
    """Number and squared distance of the nearest centre; the first of equals."""
    gaps = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centres]
    return gaps.index(min(gaps)), min(gaps)


def means(vectors, numbers, centres):
    out = list(centres)
    for k in set(numbers):
        rows = [v for v, n in zip(vectors, numbers, strict=True) if n == k]
        out[k] = [sum(column) // len(rows) for column in zip(*rows, strict=True)]
    return out


def rows_of_every_kind(dim=64):
    draw = random.Random(3)
    vector = lambda: [float(np.float32(draw.gauss(0, 0.125))) for _ in range(dim)]
    hot = vector()
    rows = [(i, hot if i % 3 == 0 else vector(), i % 5 if i % 7 else None) for i in range(300)]
    rows += [(i + 1000, [round(draw.uniform(-1, 1)) / 4 for _ in range(dim)], None) for i in range(60)]  # many ties
    rows += [rows[4], rows[4], (None, vector(), 3), (-5, [-x for x in hot], 2), (7000, [1e5] * dim, 2)]
    bad = [(900, None, 1), (901, [], 1), (902, [None] + vector()[1:], 1), (903, [float("nan")] + vector()[1:], 1)]
    bad += [(904, [float("inf")] + vector()[1:], 1), (905, [-float("inf")] * dim, 1), (-9, vector() + [0.5], 1)]
    return rows, bad


def frame(spark, rows):
    """Extra columns carry names of results."""
    return spark.createDataFrame([(*r, "x", 1, 2, [3], 4) for r in rows], SHAPE).repartition(5)


def test_codes_match_brute_force(spark, folder, monkeypatch):
    rows, bad = rows_of_every_kind()
    monkeypatch.setattr(queries, "table", lambda *_: frame(spark, rows + bad))
    got = queries.op11_orchard_codes(spark, folder).collect()
    vectors = [plain(x) for _, x, _ in rows]
    split = lambda v, p: v[4 * p : 4 * p + 4]
    start = [v for _, v in sorted((r[0], v) for r, v in zip(rows, vectors, strict=True) if r[0] is not None)[:64]]
    codes, errors, text = [""] * len(rows), [0] * len(rows), []
    for p in range(16):
        parts, book = [split(v, p) for v in vectors], [split(v, p) for v in start]
        for _ in range(2):
            book = means(parts, [near(x, book)[0] for x in parts], book)
        for i, x in enumerate(parts):
            number, gap = near(x, book)
            codes[i] += f"{number:02x}"
            errors[i] += gap
        text += [str(c) for entry in book for c in entry]
    total = {}
    for (_, _, label), e in zip(rows, errors, strict=True):
        total[label] = total.get(label, 0) + e
    digest = hashlib.sha256(",".join(text).encode()).hexdigest()
    want = sorted((str(r[0]), c, e, total[r[2]], digest) for r, c, e in zip(rows, codes, errors, strict=True))
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == want


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [], 1)]])
def test_nothing_to_encode_or_cluster(spark, folder, monkeypatch, rows):
    monkeypatch.setattr(queries, "table", lambda *_: frame(spark, rows))
    assert queries.op11_orchard_codes(spark, folder).collect() == []
    assert queries.op13_laesa_clusters(spark, folder).collect() == []


@pytest.mark.parametrize("spread", [2, 40, 4000])
def test_orchard_search_is_exact(spread):
    draw = np.random.default_rng(spread)
    book = draw.integers(-spread, spread, (64, 4))
    book[40:44] = book[3]  # equal entries
    parts = np.concatenate([draw.integers(-2 * spread, 2 * spread, (3000, 4)), book])
    numbers, gaps = orchard.Orchard(book).nearest(parts)
    exact = ((parts[:, None] - book[None]) ** 2).sum(axis=2)
    assert (numbers == exact.argmin(axis=1)).all() and (gaps == exact.min(axis=1)).all()
    one = orchard.Orchard(book[:1]).nearest(parts)
    assert (one[0] == 0).all() and (one[1] == exact[:, 0]).all()


def test_a_search_visits_a_part_of_the_entries():
    draw = np.random.default_rng(1)
    book = draw.integers(-80, 80, (64, 4))
    search, asked = orchard.Orchard(book), []
    plain_squares, orchard.squares = orchard.squares, lambda a, b: (asked.append(len(a)), plain_squares(a, b))[1]
    try:
        search.nearest(draw.integers(-80, 80, (2000, 4)))
    finally:
        orchard.squares = plain_squares
    assert sum(asked) < 2000 * 40


def test_clusters_match_brute_force(spark, folder, monkeypatch):
    rows, bad = rows_of_every_kind()
    monkeypatch.setattr(queries, "table", lambda *_: frame(spark, rows + bad))
    got = queries.op13_laesa_clusters(spark, folder).collect()
    vectors = [plain(x) for _, x, _ in rows]
    ranked = sorted((hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), v) for r, v in zip(rows, vectors, strict=True) if r[0] is not None)
    centres = [v for _, v in ranked[:40]]
    for _ in range(5):
        centres = means(vectors, [near(v, centres)[0] for v in vectors], centres)
    last = [near(v, centres) for v in vectors]
    inertia = {k: sum(d for n, d in last if n == k) for k, _ in last}
    shown = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    want = sorted((str(r[0]), k, d, inertia[k], sum(inertia.values()), shown[k]) for r, (k, d) in zip(rows, last, strict=True))
    assert sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got) == want
    assert all(1 <= r.exact_distances <= 40 for r in got)


def test_pivot_bounds_spare_distances():
    draw = np.random.default_rng(2)
    centres = draw.integers(-4000, 4000, (40, 64))
    vectors = np.repeat(centres, 50, axis=0) + draw.integers(-300, 300, (2000, 64))
    fixed = laesa.choose_pivots(centres, 8)
    number, gap, tried = laesa.nearest(vectors, laesa.table_of(vectors, fixed), centres, laesa.table_of(centres, fixed))
    exact = ((vectors[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (number == exact.argmin(axis=1)).all() and (gap == exact.min(axis=1)).all()
    assert tried.mean() < 10


def test_components_beyond_the_grid_stop_the_job(spark, folder, monkeypatch):
    monkeypatch.setattr(queries, "table", lambda *_: frame(spark, [(1, [6e5] * 64, 1)]))
    with pytest.raises(Exception, match="524288"):
        queries.op13_laesa_clusters(spark, folder).collect()
