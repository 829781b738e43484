"""Edit matching against the plain distance table."""

import random

from skysift.llm import decontaminate, queries


def plain_best(item, text):
    """Smallest distance of ``item`` to any part of ``text``."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        up, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            up, row[j] = row[j], min(up + (c != d), row[j] + 1, row[j - 1] + 1)
    return min(row)


def edited(draw, text, n):
    for _ in range(n):
        i = draw.randrange(len(text))
        text = draw.choice([text[:i] + text[i + 1 :], text[:i] + draw.choice("abé ") + text[i:], text[:i] + draw.choice("xyz") + text[i + 1 :]])
    return text


def test_myers_matches_the_table():
    draw = random.Random(1)
    for _ in range(300):
        pattern = "".join(draw.choice("ab c") for _ in range(draw.randint(1, 70)))
        text = "".join(draw.choice("ab c") for _ in range(draw.randint(0, 60)))
        budget = draw.randint(0, len(pattern))
        ends = dict(decontaminate.ends_within(pattern, text, budget))
        for j in range(1, len(text) + 1):
            column = list(range(len(pattern) + 1))
            for c in text[:j]:
                column = _next(column, pattern, c)
            assert ends.get(j) == (column[-1] if column[-1] <= budget else None)


def _next(column, pattern, c, first=0):
    out = [first]
    for i, p in enumerate(pattern, 1):
        out.append(min(column[i - 1] + (p != c), column[i] + 1, out[i - 1] + 1))
    return out


def test_pieces_cover_the_budget():
    for m in (1, 2, 9, 81, 226, 394):
        for budget in {0, 1, m // 10, m // 5, m - 1}:
            if budget < m:
                parts = sorted(decontaminate.leaves(0, "x" * m, budget), key=lambda p: p.start)
                assert len(parts) == budget + 1 and parts[0].start == 0 and parts[-1].end == m
                assert all(a.end == b.start and a.start < a.end for a, b in zip(parts, [*parts[1:], None], strict=True) if b)


def test_no_match_within_the_budget_is_lost(prose):
    draw = random.Random(3)
    items = [(i, decontaminate.normal(prose(draw.randint(8, 45), i))) for i in range(12)]
    matcher = decontaminate.Matcher(items, 0.1)
    seen = 0
    for n in range(60):
        item_id, item = items[draw.randrange(len(items))]
        k = int(0.1 * len(item))
        text = decontaminate.normal(f"{prose(12, 900 + n)} {edited(draw, item, draw.randint(0, k + 3))} {prose(9, 1900 + n)}")
        want = {(i, d) for i, t in items if (d := plain_best(t, text)) <= int(0.1 * len(t))}
        got = matcher.find(text)
        assert {(i, d) for i, d, _, _ in got} == want
        seen += bool(want)
        for i, d, a, b in got:
            t = dict(items)[i]
            column = list(range(len(t) + 1))
            for c in text[a:b]:
                column = _next(column, t, c, column[0] + 1)
            assert column[-1] == d
    assert 20 < seen < 60


def test_query_and_filter(spark, folder, hard, prose):
    items = spark.createDataFrame([(1, prose(30, 1), "x"), (2, prose(20, 2), "y"), (3, None, "z"), (4, "", "z"), (None, prose(30, 1), "n"), (1, prose(25, 5), "r")], "item_id long, text string, start string")
    planted = [(1, prose(90, 7)), (2, f"{prose(40, 8)}\n{prose(30, 1).upper()}  {prose(10, 9)}"), (3, prose(30, 1).replace(" ", "\n ")), (4, prose(20, 2)[:-4]), (5, prose(25, 5))]
    docs = spark.createDataFrame([(i, t, "a") for i, t in planted], "doc_id long, text string, distance string").unionByName(hard.select("doc_id", "text", hard.lang.alias("distance")))
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, items).collect()}
    assert got == {(2, 1), (2, None), (3, 1), (3, None), (4, 2), (5, 1)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, items, block_chars=60).collect()} == got
    kept = decontaminate.keep_clean(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 4
    assert decontaminate.keep_clean(docs, items, block_chars=60).count() == docs.count() - 4
    assert decontaminate.matches(docs.limit(0), items).count() == 0 == decontaminate.matches(docs, items.limit(0)).count()
    bench, whole = spark.read.parquet(f"{folder}/benchmark.parquet"), spark.read.parquet(f"{folder}/documents.parquet")
    texts = [(r.item_id, decontaminate.normal(r.text)) for r in bench.collect()]
    exact = {(r.doc_id, i) for r in whole.collect() for i, t in texts if t in decontaminate.normal(r.text)}
    rows = queries.op3_decontaminate(spark, folder).collect()
    assert {(r.doc_id, r.item_id) for r in rows if r.distance == 0} == exact
