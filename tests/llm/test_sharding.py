import random
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import sharding


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1000), min_size=3, max_size=3), max_size=30))
def test_differencing_keeps_every_slot(items):
    to, sums = sharding.differenced(items, 3)
    assert all(sorted(x) == [0, 1, 2] for x in to)
    again = [0, 0, 0]
    for x, t in zip(items, to):
        for j in range(3):
            again[t[j]] += x[j]
    assert again == list(sums) and sums == sorted(sums, reverse=True)


def test_differencing_of_a_known_case():
    # Two ways: 8, 7, 6, 5, 4 differ by 2 under the method (the best split has no difference).
    _, sums = sharding.differenced([[x, 0] for x in (8, 7, 6, 5, 4)], 2)
    assert sums == [16, 14]


def test_fillings():
    assert sharding.fillings([10, 4, 2, 0], 100) == [0, 6, 8, 10]
    assert sharding.fillings([10, 4, 2, 0], 6) == [0, 0, 2, 4]
    assert sharding.fillings([5, 5], 0) == [0, 0]


def held(rows, docs, k=8):
    """What every result must have; the sizes of the shards."""
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32) for r in rows) == sorted((i is not None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    assert all(r.law == "bytes" and r.grown_shard is None for r in rows)
    sizes, slots, where = [0] * k, defaultdict(list), defaultdict(set)
    for r in rows:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
        where[r.size, r.text_crc32].add(r.shard)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(len(x) == 1 for x in where.values())
    return sizes


def test_odd_documents(odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    sizes = held(sharding.sharded(odd_docs).collect(), docs)
    assert sum(sizes) == sum(len((t or "").encode()) + 1 for _, t in docs)
    assert sharding.sharded(no_docs).collect() == []


@pytest.mark.parametrize("copies, fan", [(0, 16), (60, 16), (700, 16), (700, 128)])
def test_many_chunks_and_levels(spark, copies, fan):
    """Small fans, so that chunks are differenced in levels; copies that make up to a third of all bytes."""
    rng = random.Random(3)
    docs = [(i, "x" * rng.randint(1, 400) + str(i)) for i in range(1500)] + [(5000 + i, "a copied text " * 15) for i in range(copies)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    sizes = sorted(held(sharding.sharded(df, fan=fan).collect(), docs))
    total, hot = sum(sizes), copies * 211
    if hot <= total / 8:
        assert sizes[-1] - sizes[0] <= 0.002 * total
    else:
        assert sizes[-1] - hot <= (0.01 if fan == 16 else 0.001) * total and sizes[-2] - sizes[0] <= (0.01 if fan == 16 else 0.001) * total


def test_one_chunk_is_plain_differencing(spark):
    rng = random.Random(4)
    docs = [(i, "y" * rng.randint(1, 3000) + str(i)) for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    sizes = held(sharding.sharded(df).collect(), docs)
    _, want = sharding.differenced(sorted(([len(t) + 1] + [0] * 7 for _, t in docs), reverse=True), 8)
    assert max(sizes) - min(sizes) <= 3 and sum(want) == sum(sizes)


def test_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    sizes = held(sharding.sharded(table).collect(), docs)
    assert max(sizes) - min(sizes) <= max(len((t or "").encode()) for _, t in docs) / 10
