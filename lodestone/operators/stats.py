"""Order statistics by position, distributions, buckets, and (weighted) percentiles.

Positions and running sums are found range by range (:mod:`lodestone.operators.ordered`), so neither a
task nor the driver holds a column's values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.ordered import MEDIAN, at_positions, median, running

PERCENTS = (10, 25, 50, 75, 90)


def value_statistics(df: DataFrame, value: str, percents: Sequence[int] = PERCENTS) -> DataFrame:
    """Count, mean, sample deviation, extremes, median and positional percentiles."""
    v = F.col(value)
    base = df.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    placed = at_positions(df, value, [*MEDIAN, *((f"p{p}", f"least(cast(floor(total * {p} / 100) as long), total - 1)") for p in percents)])
    return base.crossJoin(placed.select(median().alias("median"), *(f"p{p}" for p in percents)))  # one row each


def extent(df: DataFrame, value: str) -> DataFrame:
    """One row: ``n, different, min, max`` of the values that are not null."""
    v = F.col(value)
    return df.agg(F.count(v).alias("n"), F.count_distinct(v).alias("different"), F.min(v).alias("min"), F.max(v).alias("max"))


def distribution(df: DataFrame, label: str, ordinal: bool = True) -> DataFrame:
    """Counts with shares and running shares; by label, or by count."""
    order = [F.col("label")] if ordinal else [F.col("n").desc(), F.col("label")]
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.withColumns({"percent": 100.0 * F.col("n") / total, "cumulative": 100.0 * F.sum("n").over(Window.orderBy(*order)) / total})


def equal_width(df: DataFrame, value: str, buckets: int = 10) -> DataFrame:
    """``bucket, low, n`` with empty buckets; a constant has width 1."""
    edge = df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    edge = edge.withColumn("size", F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / buckets).otherwise(1.0))
    placed = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(edge)).groupBy(F.least(F.floor((F.col(value) - F.col("lo")) / F.col("size")), F.lit(buckets - 1)).alias("bucket")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(buckets).withColumnRenamed("id", "bucket").crossJoin(F.broadcast(edge))
    return every.join(F.broadcast(placed), "bucket", "left").select("bucket", (F.col("lo") + F.col("bucket") * F.col("size")).alias("low"), F.coalesce("n", F.lit(0)).alias("n"))


def bin_edges(df: DataFrame, value: str, bins: int) -> list[float]:
    """Equal-count edges: the smallest, those at floor(i n / bins) in sorted order, the largest."""
    if df.select(F.countDistinct(value)).first()[0] < bins:
        raise ValueError("more bins than different values")
    row = at_positions(df, value, [("lo", "0"), *((f"e{i}", f"cast(floor({i} * total / {bins}) as long)") for i in range(1, bins)), ("hi", "total - 1")]).first()
    return [float(x) for x in row]


def bin_of(value: Column, edges: Sequence[float]) -> Column:
    """The first bin with low <= value < high (or equal, where they are one); the largest and all else: the last."""
    last = len(edges) - 2
    out = F.when(F.lit(False), F.lit(last))
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        inside = (value == lo) if lo == hi else (value >= lo) & (value < hi)
        out = out.when(inside, F.lit(i))
    return out.otherwise(F.lit(last))


def quantile_boundaries(df: DataFrame, value: str, buckets: int = 10) -> list[int]:
    """Positions floor(i n / buckets) in sorted order, without repeats, and one past the largest."""
    row = at_positions(df, value, [*((f"e{i}", f"cast(floor({i} * total / {buckets}) as long)") for i in range(buckets)), ("hi", "total - 1")]).first()
    return sorted({int(x) for x in row[:-1]}) + [int(row[-1]) + 1]


def quantile_buckets(df: DataFrame, value: str, buckets: int = 10) -> DataFrame:
    """``low, high, n`` between quantile boundaries."""
    edges = quantile_boundaries(df, value, buckets)
    place = F.size(F.filter(F.array(*(F.lit(e) for e in edges)), lambda e: F.col(value) >= e)) - 1
    lows, highs = F.array(*(F.lit(e) for e in edges)), F.array(*(F.lit(e) for e in edges[1:]))
    return df.where(F.col(value).isNotNull()).groupBy(place.alias("i")).agg(F.count("*").alias("n")).select(F.element_at(lows, F.col("i") + 1).alias("low"), F.element_at(highs, F.col("i") + 1).alias("high"), "n")


def percentiles(df: DataFrame, value: str, percents: Sequence[float]) -> DataFrame:
    """``percent, value`` with linear interpolation; null and non-numeric values are skipped."""
    numbers = df.select(F.col(value).try_cast("double").alias("v"))
    wanted = [(f"{side}{i}", f"cast({side}((total - 1) * {p / 100.0!r}D) as long)") for i, p in enumerate(percents) for side in ("floor", "ceil")]
    row = at_positions(numbers, "v", [*wanted, ("n", "0")]).crossJoin(numbers.agg(F.count("v").alias("total")))  # one row each

    def between(i: int, p: float) -> Column:
        low, high, part = F.col(f"floor{i}"), F.col(f"ceil{i}"), (F.col("total") - 1) * F.lit(p / 100.0)
        return F.when(low == high, low).otherwise(low * (F.ceil(part) - part) + high * (part - F.floor(part)))

    return row.select(F.explode(F.array(*(F.struct(F.lit(float(p)).alias("percent"), between(i, p).alias("value")) for i, p in enumerate(percents)))).alias("z")).select("z.percent", "z.value")


def weighted_percentiles(df: DataFrame, value: str, weight: str, percents: Sequence[float]) -> DataFrame:
    """``percent, value``: midpoints of cumulative weight, linear between them, clamped at the ends.

    Rows of one value are one point that has their whole weight.
    """
    rows = df.where(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(F.col(value).cast("double").alias("v")).agg(F.sum(weight).alias("w"))
    whole = rows.agg(F.sum("w").alias("total"))
    mid = 100.0 * (F.col("upto_w") - F.col("w") / 2) / F.col("total")
    points = running(rows, "v", ["w"]).crossJoin(F.broadcast(whole)).select("v", mid.alias("mid"))  # whole is one row
    # The last point at or below each percent and the first above it.
    point = F.struct("mid", "v")
    ends = [f(F.when(ok, point)).alias(f"{name}{i}") for i, p in enumerate(percents) for f, ok, name in ((F.max, F.col("mid") <= p, "low"), (F.min, F.col("mid") > p, "high"))]
    one = points.agg(*ends)

    def at(i: int, p: float) -> Column:
        low, high = F.col(f"low{i}"), F.col(f"high{i}")
        inside = low["v"] + (high["v"] - low["v"]) * (p - low["mid"]) / (high["mid"] - low["mid"])
        return F.when(low.isNull(), high["v"]).when(high.isNull(), low["v"]).otherwise(inside)

    return one.select(F.explode(F.array(*(F.struct(F.lit(float(p)).alias("percent"), at(i, float(p)).alias("value")) for i, p in enumerate(percents)))).alias("z")).select("z.percent", "z.value").where("value is not null")


def weighted_moments(df: DataFrame, value: str, weight: str) -> DataFrame:
    """Weighted mean and population deviation."""
    v, w = F.col(value), F.col(weight)
    m = df.agg(F.sum(w).alias("w"), F.sum(v * w).alias("vw"), F.sum(v * v * w).alias("vvw"))
    mean = F.try_divide("vw", "w")
    return m.select(mean.alias("mean"), F.sqrt(F.greatest(F.try_divide("vvw", "w") - mean * mean, F.lit(0.0))).alias("std"))


def dense_ranks(df: DataFrame, label: str) -> DataFrame:
    """``df`` with ``rank``: the place of its label among the distinct sorted labels, from 0."""
    labels = df.select(label).distinct().where(F.col(label).isNotNull()).withColumn("_one", F.lit(1))
    ranks = running(labels, label, ["_one"]).select(label, (F.col("upto__one") - 1).cast("int").alias("rank"))
    return df.join(ranks, label)
