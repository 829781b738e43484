"""SimHash classes and components against all pairs on small fixtures."""

import random
import re

import pytest
import xxhash

from skysift.llm import queries, simhash
from skysift.llm.links import components


def roots_of(nodes, pairs):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if sum(h >> bit & 1 for h in hashes) * 2 > len(hashes))


def test_classes_match_all_pairs(spark, folder, hard, monkeypatch):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").union(hard.select("doc_id", "text"))
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
    prints = sorted({f for _, f in rows})
    root = roots_of(prints, [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 2])
    smallest = {}
    for doc_id, f in rows:
        if doc_id is not None:
            smallest[root[f]] = min(doc_id, smallest.get(root[f], doc_id))
    want = sorted(str((d, f"{f:016x}", smallest.get(root[f]))) for d, f in rows)
    got = queries.op2_simhash_variants(spark, folder).collect()
    assert sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in got) == want
    assert simhash.classes(docs.limit(0)).count() == 0


@pytest.mark.parametrize("crowd", [1, 3, 256])
def test_no_link_is_lost_in_crowds(spark, crowd):
    draw = random.Random(crowd)
    prints = {0, (1 << 64) - 1}
    for _ in range(6):
        centre = draw.getrandbits(64)
        for _ in range(40):
            x = centre
            for _ in range(draw.randint(0, 4)):
                x ^= 1 << draw.randrange(64)
            prints.add(x)
    low = draw.getrandbits(32)
    prints |= {low | draw.getrandbits(32) << 32 for _ in range(80)}  # one segment in common
    want = {tuple(sorted((a, b))) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 2}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = simhash.near_pairs(spark.createDataFrame([(signed(x),) for x in prints], "fp long"), crowd=crowd).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(sorted((r.a % (1 << 64), r.b % (1 << 64)))) for r in got} == want and len(want) > 100


def test_components_of_chains_and_stars(spark):
    draw = random.Random(5)
    nodes = list(range(2000))
    pairs = [(i, i + 1) for i in range(300)] + [(500, i) for i in range(501, 900)] + [(draw.choice(nodes[1000:]), draw.choice(nodes[1000:])) for _ in range(600)]
    draw.shuffle(pairs)
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = roots_of(nodes, pairs)
    assert got == {x: root[x] for a, b in pairs if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
