import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import vector_codes as V


def plain(rows, parts=16, entries=64, rounds=2):
    """Every distance of every part, in Python integers."""
    kept = [(i, lab, [math.floor(256 * x) for x in v]) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(kept[0][2]) // parts
    cut = lambda v: [tuple(v[p * width : (p + 1) * width]) for p in range(parts)]
    split = [cut(v) for _, _, v in kept]
    books = [[x[p] for x in split[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda x, book: min((dist(x, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            members = [[] for _ in books[p]]
            for x in split:
                members[near(x[p], books[p])[1]].append(x[p])
            books[p] = [tuple(sum(c) // len(m) for c in zip(*m)) if m else e for m, e in zip(members, books[p])]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, by_label = [], {}
    for (i, lab, _), x in zip(kept, split):
        each = [near(x[p], books[p]) for p in range(parts)]
        out.append((i, lab, "".join(f"{k:02x}" for _, k in each), sum(d for d, _ in each)))
        by_label[lab] = by_label.get(lab, 0) + out[-1][3]
    return sorted(((i, code, e, by_label[lab], sha) for i, lab, code, e in out), key=str)


def found(df):
    return sorted((tuple(r) for r in V.digests(V.coded(df)).collect()), key=str)


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**9))
def test_balls_find_what_a_full_search_finds(seed):
    rng = np.random.default_rng(seed)
    n, k, w = rng.integers(1, 200), rng.integers(1, 20), rng.integers(1, 4)
    x, c = rng.integers(-6, 7, (n, w)), rng.integers(-6, 7, (k, w))
    known = rng.integers(0, k, n)
    near, d = V.full_search(x, c)
    got, e, _ = V.ball_search(x, c, known)
    assert (got == near).all() and (e == d).all()
    big = 1 << 25
    near, d = V.full_search(x * big // 6, c * big // 6)
    got, e, _ = V.ball_search(x * big // 6, c * big // 6, known)
    assert (got == near).all() and (e == d).all()


def test_balls_skip_work():
    rng = np.random.default_rng(1)
    c = rng.integers(-1000, 1000, (64, 4))
    x = c[rng.integers(0, 64, 5000)] + rng.integers(-60, 60, (5000, 4))
    known, _ = V.full_search(x, c)
    _, _, computed = V.ball_search(x, c, known)
    assert computed < 0.2 * len(x) * 64


def test_table_against_plain(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").limit(150)
    rows = [(r.vec_id, list(r.embedding), r.label) for r in df.collect()]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert found(df) == plain(rows)


def test_odd_rows(spark):
    rng = random.Random(2)
    vec = lambda: [rng.choice((-1.5, -0.25, 0.0, 0.1, 0.7, 3.0)) for _ in range(32)]
    rows = [(i, vec(), rng.choice((1, 2, None))) for i in range(120)]
    rows += [(7, rows[7][1], 1), (8, vec(), 2), (None, vec(), None), (None, vec(), 1)]
    rows += [(-5, None, 1), (-4, [None] + vec()[1:], 1), (-3, [float("nan")] + vec()[1:], 2), (-2, [float("-inf")] + vec()[1:], 2)]
    df = spark.createDataFrame([(i, v, lab, "v", 9) for i, v, lab in rows], "vec_id long, embedding array<double>, label int, v string, error int")
    assert found(df) == plain(rows)
    few = spark.createDataFrame(rows[:5], "vec_id long, embedding array<double>, label int")
    assert found(few) == plain(rows[:5])
    assert found(few.limit(0)) == []
    other = few.union(spark.createDataFrame([(900, [1.0] * 16, 1), (901, [1e30] * 32, 1), (902, [], 1)], few.schema))
    assert found(other) == plain(rows[:5])
    with pytest.raises(ValueError, match="divide"):
        V.coded(spark.createDataFrame([(1, [1.0] * 17, 1)], few.schema))


def test_reconstruction(spark):
    df = spark.createDataFrame([(i, [i / 4 + j for j in range(16)], 0) for i in range(40)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.v for r in V.reconstructed(V.coded(df)).collect()}
    assert got == {i: [i / 4 + j for j in range(16)] for i in range(40)}
