import random
import re

import pytest
import xxhash

from lodestone.llm import simhash
from lodestone.llm.graph import components


def brute_fp(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h) and h)


def brute_components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {n: find(n) for n in nodes}


def test_fingerprints_and_components(spark, odd_docs):
    rows = {(r.doc_id, r.text) for r in odd_docs.where("doc_id is not null").select("doc_id", "text").collect()}
    fps = {i: brute_fp(t) for i, t in rows}
    want = brute_components(fps, lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(odd_docs.where("doc_id is not null")).collect()}
    assert got == {i: (fps[i], want[i]) for i in fps}
    assert simhash.near_duplicates(odd_docs).count() == odd_docs.count()


def test_empty_table(no_docs):
    assert simhash.near_duplicates(no_docs).collect() == []


@pytest.mark.parametrize("hot", [20_000, 5])
def test_links_connect_what_all_pairs_connect(spark, hot):
    rng = random.Random(1)
    values = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        values.add(x)
        for _ in range(12):
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {r.node: r.component for r in components(simhash.links(df, hot)).collect()}
    want = brute_components(signed, lambda a, b: ((a ^ b) % 2**64).bit_count() <= 3)
    assert {v: got.get(v, v) for v in signed} == want


def test_components_of_paths_hubs_and_nothing(spark):
    rng = random.Random(2)
    order = list(range(60))
    rng.shuffle(order)
    edges = list(zip(order, order[1:])) + [(100, k) for k in range(101, 140)] + [(200, 200), (None, 3), (300, 301), (301, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {**dict.fromkeys(range(60), 0), **dict.fromkeys(range(100, 140), 100), 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
