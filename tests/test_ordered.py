"""Running sums, order statistics and inversion counts range by range, against plain versions."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.operators import metrics, ordered, stats


@pytest.fixture()
def ranges(monkeypatch):
    """Columns of over 256 distinct values have eight ranges."""
    monkeypatch.setattr(ordered, "FEW", 16)


def numbers(spark, n, seed=1):
    return spark.range(n).select("id", (F.randn(seed) * 100).alias("v"), (F.col("id") % 7).alias("g"), (F.col("id") % 3 + 1).alias("w"))


def test_ranges_of_continuous_values_are_alike(spark, ranges):
    df = numbers(spark, 200_000).union(spark.range(100_000).selectExpr("id", "0.5D", "id % 7", "1L"))  # a third are ties
    edges = ordered.boundaries(df, "v")
    assert len(edges) == 7 and edges == sorted(edges)
    cells = df.groupBy("v").count().select(ordered.range_of(F.col("v"), edges, "double").alias("r"), "v")
    sizes = {r.r: r["count"] for r in cells.groupBy("r").count().collect()}
    assert sorted(sizes) == list(range(8)) and max(sizes.values()) < 2 * sum(sizes.values()) / 8
    v = np.array([r.v for r in df.select("v").collect()])
    got = df.select("v", ordered.range_of(F.col("v"), edges, "double").alias("r")).sample(0.01, 3).collect()
    assert all(r.r == np.searchsorted(edges, r.v, "right") for r in got)
    n, s = len(v), np.sort(v)
    row = stats.value_statistics(df, "v").first()
    assert [row[f"p{p}"] for p in stats.PERCENTS] == [s[min(n * p // 100, n - 1)] for p in stats.PERCENTS]
    assert row["median"] == np.median(v)
    ps = (0, 0.1, 33.3, 50, 99.9, 100)
    assert {r.percent: pytest.approx(r.value, abs=1e-9) for r in stats.percentiles(df, "v", ps).collect()} == {float(p): np.percentile(v, p) for p in ps}


def test_only_ranges_with_a_position_are_sorted(spark, ranges):
    df = numbers(spark, 20_000)
    out = ordered.at_positions(df, "v", [("first", "0"), ("last", "total - 1")])
    v = sorted(r.v for r in df.select("v").collect())
    assert tuple(out.first()) == (v[0], v[-1])
    assert ordered.at_positions(df.where("v is null"), "v", [("first", "0")]).first()[0] is None


def test_groups_nulls_and_strings(spark, ranges):
    df = numbers(spark, 6000).withColumn("g", F.when(F.col("g") > 0, F.col("g"))).withColumn("v", F.when(F.col("id") % 10 > 0, F.col("v")))
    rows = df.collect()
    got = {r.g: r["median"] for r in metrics.per_class(df, "v", "g").collect()}
    assert got == {g: pytest.approx(np.median([r.v for r in rows if r.g == g and r.v is not None])) for g in {r.g for r in rows}}
    names = df.select(F.concat(F.lit("k"), F.col("id") % 3000).alias("k"))
    rank = {r.k: r["rank"] for r in stats.dense_ranks(names, "k").collect()}
    assert rank == {k: i for i, k in enumerate(sorted({f"k{i % 3000}" for i in range(6000)}))}


def test_running_sums(spark, ranges):
    df = numbers(spark, 3000).withColumn("v", F.round("v", 1))
    rows = sorted((r.v, r.w, r.g) for r in df.collect())
    got = ordered.running(df, "v", ["w"], by=["g"]).collect()
    sample = random.Random(1).sample(got, 60)
    assert all(r.upto_w == sum(w for v, w, g in rows if g == r.g and v <= r.v) for r in sample)
    assert len(got) == 3000


def plain_weighted(pairs, p):
    total, points, cum = sum(w for _, w in pairs), [], 0
    for v in sorted({v for v, _ in pairs}):
        w = sum(x for u, x in pairs if u == v)
        points.append((100 * (cum + w / 2) / total, v))
        cum += w
    if p <= points[0][0]:
        return points[0][1]
    for (m, v), (m2, v2) in zip(points, points[1:]):
        if m <= p < m2:
            return v + (v2 - v) * (p - m) / (m2 - m)
    return points[-1][1]


def test_weighted_percentiles(spark, ranges):
    df = numbers(spark, 2000)
    pairs = [(r.v, r.w) for r in df.collect()]
    ps = (0, 0.001, 10, 50, 77.7, 100)
    assert {r.percent: r.value for r in stats.weighted_percentiles(df, "v", "w", ps).collect()} == {float(p): pytest.approx(plain_weighted(pairs, p)) for p in ps}
    assert stats.weighted_percentiles(df.where("v is null"), "v", "w", ps).collect() == []


def plain_net(x, y, w):
    sign = lambda d: int(d > 0) - int(d < 0)
    n = len(x)
    return sum(int(w[i]) * int(w[j]) * sign(x[i] - x[j]) * sign(y[i] - y[j]) for i in range(n) for j in range(i))


@settings(max_examples=120, deadline=None)
@given(st.integers(0, 10**9))
def test_net_order(seed):
    rng = np.random.default_rng(seed)
    n, top = int(rng.integers(1, 70)), int(rng.integers(1, 40))
    x, y, w = rng.integers(0, top, n).astype(float), rng.normal(size=n).round(int(rng.integers(0, 3))), rng.integers(1, 5, n)
    assert ordered.net_order(x, y, w) == plain_net(x, y, w)
    big = w * (10**9)  # sums of products beyond 64 bits
    assert ordered.net_order(x, y, big) == plain_net(x, y, w) * 10**18


@pytest.mark.parametrize("digits", [9, 1, 0])
def test_kendall_across_ranges(spark, ranges, digits):
    """Distinct values, and ties of all kinds, over several ranges of both columns."""
    rng = np.random.default_rng(digits)
    a = rng.normal(size=2500).round(digits)
    b = (a + rng.normal(size=2500)).round(digits) * (10 if digits == 0 else 1)
    df = spark.createDataFrame([*zip(a.tolist(), b.tolist()), (None, 1.0), (1.0, None)], "a double, b double")
    row = metrics.rank_correlations(df, "a", "b").first()
    da, db = np.sign(a[:, None] - a), np.sign(b[:, None] - b)
    assert row.kendall == pytest.approx((da * db).sum() / math.sqrt((da != 0).sum() * (db != 0).sum()), abs=1e-12)
    assert row.n == 2500 and row.pearson == pytest.approx(np.corrcoef(a, b)[0, 1])
    ranked = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    assert row.spearman == pytest.approx(np.corrcoef(ranked(a), ranked(b))[0, 1])


def test_kendall_of_large_columns_has_no_cross_join(spark, ranges):
    df = numbers(spark, 30_000).select("v", (F.col("v") + F.randn(5) * 50).alias("u"))
    plan = metrics.rank_correlations(df, "v", "u")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    rows = df.collect()
    want = ordered.net_order(np.array([r.v for r in rows]), np.array([r.u for r in rows]), np.ones(len(rows), np.int64))
    every = len(rows) * (len(rows) - 1) // 2
    assert metrics.rank_correlations(df, "v", "u").first().kendall == pytest.approx(want / every, abs=1e-12)


def test_auc_of_continuous_scores(spark, ranges):
    df = numbers(spark, 3000).withColumn("y", F.col("v") + F.randn(9) * 80 > 0)
    rows = df.collect()
    v, y = np.array([r.v for r in rows]), np.array([r.y for r in rows])
    want = (v[y][:, None] > v[~y]).mean()
    assert metrics.auc(df, "v", F.col("y")).first()[0] == pytest.approx(want)
    three = df.withColumn("r", F.col("y").cast("int") + (F.col("g") > 4).cast("int"))
    r = np.array([x.r for x in three.collect()])
    each = [(v[r >= k][:, None] > v[r < k]).mean() for k in (1, 2)]
    assert metrics.auc_with_ties(three, "v", "r").first().macro == pytest.approx(np.mean(each))


def test_one_vs_rest_of_many_scores(spark, ranges):
    df = numbers(spark, 2000).select(F.when(F.col("id") > 3, F.col("g") % 3).alias("t"), F.create_map(F.lit("0"), F.abs("v"), F.lit("2"), F.round("v", 0), F.lit("9"), F.lit(0.5)).alias("p"))
    rows = [r for r in df.collect() if r.t is not None]
    got = {r.label: (r.auc, r.positives) for r in metrics.one_vs_rest(df, "p", "t").collect()}
    want = {}
    for c in ("0", "1", "2"):
        pos, neg = (np.array([r.p.get(c, 0.0) for r in rows if (str(r.t) == c) == hit]) for hit in (True, False))
        d = pos[:, None] - neg
        want[c] = (pytest.approx((d > 0).mean() + (d == 0).mean() / 2), len(pos))
    assert got == {**want, "9": (None, 0)}
    assert metrics.macro_auc(metrics.one_vs_rest(df, "p", "t")).first()[0] is None
