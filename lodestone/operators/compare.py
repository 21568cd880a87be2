"""Keyed annotation sets: agreement, confusion, and the rows that differ between two datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_by_key(df: DataFrame, key: Column, value: Column, order: Column) -> DataFrame:
    """``key_hash, value``: sha256 of the key as text; of rows with one key the last in ``order``."""
    keyed = df.select(F.sha2(key.cast("string"), 256).alias("key_hash"), value.alias("value"), order.alias("_order"))
    return keyed.where("key_hash is not null").groupBy("key_hash").agg(F.max_by("value", "_order").alias("value"))


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """``key_hash, l1, l2`` of keys in both."""
    return a.select("key_hash", F.col("value").alias("l1")).join(b.select("key_hash", F.col("value").alias("l2")), "key_hash")


def coverage(a: DataFrame, b: DataFrame) -> DataFrame:
    """``only_1, only_2, common`` keys: one shuffle."""
    x, y = a.select("key_hash", F.lit(1).alias("x")), b.select("key_hash", F.lit(1).alias("y"))
    both = x.join(y, "key_hash", "full_outer")
    return both.agg(F.count_if(F.expr("y is null")).alias("only_1"), F.count_if(F.expr("x is null")).alias("only_2"), F.count_if(F.expr("x is not null and y is not null")).alias("common"))


def contingency(pairs: DataFrame) -> DataFrame:
    """``l1, l2, n``: small however many rows there are."""
    return pairs.groupBy("l1", "l2").agg(F.count("*").alias("n"))


def interpretation(kappa: Column) -> Column:
    words = [(0.0, "poor"), (0.2, "slight"), (0.4, "fair"), (0.6, "moderate"), (0.8, "substantial")]
    out = F.lit("almost perfect")
    for limit, word in reversed(words):
        out = F.when(kappa < limit, word).otherwise(out)
    return out


def agreement(pairs: DataFrame, ordinal: bool = False) -> DataFrame:
    """One row: n, agreements, rate, kappa (quadratic weights by class index if ``ordinal``), MAE, RMSE, Pearson."""
    cells = contingency(pairs)
    labels = cells.select(F.explode(F.array("l1", "l2")).alias("label")).distinct().withColumn("i", F.dense_rank().over(Window.orderBy("label")) - 1)
    one = cells.join(labels.select(F.col("label").alias("l1"), F.col("i").alias("i1")), "l1").join(labels.select(F.col("label").alias("l2"), F.col("i").alias("i2")), "l2")
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    rows = cells.groupBy("l1").agg(F.sum("n").alias("r")).join(labels.withColumnsRenamed({"label": "l1", "i": "i1"}), "l1")
    columns = cells.groupBy("l2").agg(F.sum("n").alias("c")).join(labels.withColumnsRenamed({"label": "l2", "i": "i2"}), "l2")
    weight = (lambda: (F.col("i1") - F.col("i2")) ** 2) if ordinal else (lambda: (F.col("i1") != F.col("i2")).cast("double"))
    observed = one.agg(F.sum(weight() * F.col("n")).alias("wo"), F.sum("n").alias("n"), F.sum(F.when(F.col("i1") == F.col("i2"), F.col("n")).otherwise(0)).alias("agreements"))
    # Labels by labels: both sides are distinct labels.
    expected = rows.crossJoin(F.broadcast(columns)).agg(F.sum(weight() * F.col("r") * F.col("c")).alias("we"))
    out = observed.crossJoin(expected)
    kappa = 1 - F.coalesce(F.try_divide(F.col("wo") * F.col("n"), F.col("we")), F.lit(0.0))
    out = out.select("n", "agreements", F.try_divide(F.col("agreements"), F.col("n")).alias("rate"), kappa.alias("kappa")).withColumn("interpretation", interpretation(F.col("kappa")))
    if ordinal:
        out = out.crossJoin(paired_errors(cells))
    return out


def paired_errors(cells: DataFrame) -> DataFrame:
    """MAE, RMSE and Pearson r (0 without variance) of numeric labels, from counts."""
    a, b, n = F.col("l1").cast("double"), F.col("l2").cast("double"), F.col("n")
    s = cells.agg(F.sum(n).alias("n"), F.sum(F.abs(a - b) * n).alias("ae"), F.sum((a - b) ** 2 * n).alias("se"), *(F.sum(x * n).alias(k) for k, x in (("a", a), ("b", b), ("aa", a * a), ("bb", b * b), ("ab", a * b))))
    cov = F.col("ab") / F.col("n") - F.col("a") * F.col("b") / F.col("n") ** 2
    var = lambda k: F.greatest(F.col(k * 2) / F.col("n") - (F.col(k) / F.col("n")) ** 2, F.lit(0.0))
    return s.select((F.col("ae") / F.col("n")).alias("mae"), F.sqrt(F.col("se") / F.col("n")).alias("rmse"), F.coalesce(F.try_divide(cov, F.sqrt(var("a") * var("b"))), F.lit(0.0)).alias("pearson"))


def confusion(pairs: DataFrame, labels: Sequence) -> DataFrame:
    """A row for each label of the first set, a count column for each of the second."""
    return pairs.groupBy("l1").pivot("l2", list(labels)).count().na.fill(0)


def differences(pairs: DataFrame) -> DataFrame:
    """``difference, n``: second label minus first."""
    return pairs.groupBy((F.col("l2") - F.col("l1")).alias("difference")).agg(F.count("*").alias("n"))


def side_by_side(pairs: DataFrame) -> DataFrame:
    """``label, n1, n2``."""
    long = pairs.select(F.explode(F.array(F.struct(F.col("l1").alias("label"), F.lit(1).alias("side")), F.struct(F.col("l2").alias("label"), F.lit(2).alias("side")))).alias("x"))
    return long.groupBy("x.label").agg(F.count_if(F.col("x.side") == 1).alias("n1"), F.count_if(F.col("x.side") == 2).alias("n2"))


def chain(sets: Sequence[DataFrame], ordinal: bool = False) -> DataFrame:
    """Agreement of each consecutive pair, with ``pair`` (1, 2, ...); empty pairs have n null."""
    out = None
    for i, (a, b) in enumerate(zip(sets, sets[1:]), 1):
        row = agreement(paired(a, b), ordinal).withColumn("pair", F.lit(i))
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("at least two sets are needed")
    return out


def first_disagreements(pairs: DataFrame, n: int = 10) -> DataFrame:
    return pairs.where(~F.col("l1").eqNullSafe(F.col("l2"))).orderBy("key_hash").limit(n)


def keyed_diff(a: DataFrame, b: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Keys in both whose values differ (two nulls are equal), with both whole rows as structs."""
    def side(df: DataFrame, name: str) -> DataFrame:
        row = F.struct(*df.columns)
        return df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("key")).agg(F.max_by(row, order).alias(name))

    both = side(a, "row1").join(side(b, "row2"), "key")
    return both.select("key", F.col(f"row1.{value}").alias("value1"), F.col(f"row2.{value}").alias("value2"), "row1", "row2").where("not (value1 <=> value2)")


def diff_statistics(a: DataFrame, b: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """``only_1, only_2, common, different, rate``."""
    one = a.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(value), order).alias("v1"))
    two = b.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(value), order).alias("v2"))
    both = one.join(two, key, "full_outer")
    out = both.agg(F.count_if(F.expr("v2 is null")).alias("only_1"), F.count_if(F.expr("v1 is null")).alias("only_2"), F.count_if(F.expr("v1 is not null and v2 is not null")).alias("common"), F.count_if(F.expr("v1 is not null and v2 is not null and not (v1 <=> v2)")).alias("different"))
    return out.withColumn("rate", F.try_divide(F.col("different"), F.col("common")))
