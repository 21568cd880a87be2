"""Balancing, sampling, splitting, shuffling and resharding: deterministic by a hash of seed and row id.

The unit number of a row does not depend on partitioning, and any engine with md5 gives the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.ordered import numbered, running


def unit(seed: int, key: str | Column) -> Column:
    """A number in [0, 1) by seed and row id."""
    key = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0


def split(df: DataFrame, key: str, seed: int = 42, test: float = 0.1, valid: float = 0.0) -> DataFrame:
    """``split`` by hash: no shuffle."""
    u = unit(seed, key)
    return df.withColumn("split", F.when(u < valid, "valid").when(u < valid + test, "test").otherwise("train"))


def label_counts(df: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """Counts with the smallest count of the group and what share of each label to keep."""
    by = by or []
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    counts = df.groupBy(*by, label).agg(F.count("*").alias("n"))
    return counts.withColumn("target", F.min("n").over(w)).withColumn("ratio", F.col("target") / F.col("n"))


def balance(df: DataFrame, label: str, key: str, seed: int = 42, by: list[str] | None = None, exact: bool = False) -> DataFrame:
    """Keep each label's rows with the probability smallest / own count; ``exact`` keeps that many."""
    by = by or []
    # A row a label: few, and broadcast by size as the planner sees it.
    rates = label_counts(df, label, by).select(*by, label, "target", "ratio")
    joined = df.join(rates, [*by, label])
    if exact:
        w = Window.partitionBy(*by, label).orderBy(unit(seed, key), key)
        return joined.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= F.col("target")).select(*df.columns)
    return joined.where(unit(seed, key) < F.col("ratio")).select(*df.columns)


def sample_rate(df: DataFrame, rate: float, key: str, seed: int = 42) -> DataFrame:
    if not 0 < rate <= 1:
        raise ValueError("the rate must be in (0, 1]")
    return df.where(unit(seed, key) < rate)


def choose_files(files: DataFrame, target: int, seed: int = 42) -> DataFrame:
    """Whole files in hash order until their sizes reach ``target``; ``files`` has file and size, a row a file."""
    w = Window.orderBy(unit(seed, "file"), "file").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("before", F.coalesce(F.sum("size").over(w), F.lit(0))).where(F.col("before") < target).drop("before")


def sample_bytes(df: DataFrame, target: int, key: str, size: Column, file: str, seed: int = 42) -> DataFrame:
    """About ``target`` bytes: each file gives its share; under 5 percent, whole files are chosen first."""
    weighed = df.withColumn("_size", size)
    files = weighed.groupBy(F.col(file).alias("file")).agg(F.sum("_size").alias("size"))
    total = files.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    if target >= total:
        return df
    if target < 0.05 * total:
        files = choose_files(files, target, seed)
        total = files.agg(F.sum("size")).first()[0]
    kept = weighed.join(files.select(F.col("file").alias(file)), file, "left_semi")
    return kept.where(unit(seed, key) < target / total).select(*df.columns)


def file_quota(df: DataFrame, quota: int, key: str, file: str, seed: int = 42) -> DataFrame:
    """At most ``quota`` rows of each file, the first in hash order: a sampling operator."""
    w = Window.partitionBy(file).orderBy(unit(seed, key), key)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= quota).drop("_rank")


def allotment(files: DataFrame, total: int) -> DataFrame:
    """``file, size, quota``: ``total`` shared out in proportion to ``size`` by largest remainders (then by name).

    The quotas add up to ``total`` unless all sizes are 0. ``files`` has a row a file.
    """
    whole = files.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("_all"))
    exact = files.crossJoin(F.broadcast(whole)).where("_all > 0")  # whole is one row
    # Integers throughout: floor(total * size / all) and its remainder.
    product = F.col("size").cast("decimal(38,0)") * F.lit(total).cast("decimal(19,0)")
    parts = exact.select("file", "size", "_all", product.cast("decimal(38,0)").alias("_p"))
    parts = parts.select("file", "size", F.floor(F.col("_p") / F.col("_all")).cast("long").alias("_f"), (F.col("_p") % F.col("_all")).cast("decimal(38,0)").alias("_r"))
    left = parts.agg((F.lit(total) - F.coalesce(F.sum("_f"), F.lit(0))).alias("_left"))
    ranked = numbered(parts.withColumn("_down", -F.col("_r")), "_down", ["file"], out="_rank").crossJoin(F.broadcast(left))
    return ranked.select("file", "size", (F.col("_f") + F.when(F.col("_rank") < F.col("_left"), 1).otherwise(0)).alias("quota"))


def proportional_rows(df: DataFrame, files: DataFrame, total: int, key: str, file: str, seed: int = 42) -> DataFrame:
    """``total`` rows, each file's number in proportion to its size: the first of the file in hash order.

    A file with fewer rows than its quota gives all it has.
    """
    quotas = allotment(files, total).select(F.col("file").alias("_file"), "quota")
    hashed = df.withColumn("_u", unit(seed, key))
    ranked = numbered(hashed, "_u", [key], by=[file], out="_rank")
    return ranked.join(quotas, ranked[file] == quotas["_file"]).where("_rank < quota").select(*df.columns)


def byte_budget(df: DataFrame, files: DataFrame, target: int, key: str, size: Column, file: str, seed: int = 42) -> DataFrame:
    """About ``target`` bytes: each file's budget is in proportion to its size, and its rows are kept in hash order
    while what was kept before stays under the budget. A file within its budget is kept whole.
    """
    budgets = allotment(files, target).select(F.col("file").alias("_file"), "size", F.col("quota").alias("_budget"))
    hashed = df.withColumns({"_u": unit(seed, key), "_size": size.cast("long")})
    # Rows of one hash are peers: they are kept or left together, so the order is by hash alone.
    upto = running(hashed, "_u", ["_size"], by=[file])
    kept = upto.join(budgets, upto[file] == budgets["_file"]).where((F.col("size") <= F.col("_budget")) | (F.col("upto__size") - F.col("_size") < F.col("_budget")))
    return kept.select(*df.columns)


def positions(df: DataFrame, key: str, seed: int = 42, out: str = "position") -> DataFrame:
    """A shuffled position for each row, from 0: in the order of its hash number, range by range."""
    return numbered(df.withColumn("_u", unit(seed, key)), "_u", [key], out=out).drop("_u")


def allotted(total: int, size: float | int) -> int:
    """Rows of a split: a share if given as float, else that many."""
    return round(total * size) if isinstance(size, float) else size


def reshard(df: DataFrame, key: str, files: int, test: float | int = 0, valid: float | int = 0, seed: int = 42) -> DataFrame:
    """``split`` and ``shard`` of each row: shuffled, cut into valid, test and train, each into nearly equal files."""
    rows = df.count()
    n_test, n_valid = allotted(rows, test), allotted(rows, valid)
    n_train = rows - n_test - n_valid
    if n_train < 0:
        raise ValueError("the splits ask for more rows than there are")
    share = lambda n: max(1, round(files * n / rows)) if n else 0
    f_valid, f_test = share(n_valid), share(n_test)
    f_train = files - f_valid - f_test
    if n_train and f_train < 1:
        raise ValueError("too few files for the splits")
    out, p = positions(df, key, seed), F.col("position")
    parts = [("train", 0, n_train, 0, f_train), ("valid", n_train, n_valid, f_train, f_valid), ("test", n_train + n_valid, n_test, f_train + f_valid, f_test)]
    split_, shard = F.lit(None).cast("string"), F.lit(None).cast("long")
    for name, first, n, base, count in parts:
        inside = (p >= first) & (p < first + n)
        split_ = F.when(inside, name).otherwise(split_)
        shard = F.when(inside, base + F.floor((p - first) * count / max(n, 1))).otherwise(shard)
    return out.withColumns({"split": split_, "shard": shard})


def class_weights(df: DataFrame, label: str, root: bool = False) -> DataFrame:
    """n / (classes x count), its root if asked, scaled to sum 1."""
    every = Window.partitionBy(F.lit(0))
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    raw = F.sum("n").over(every) / (F.count("*").over(every) * F.col("n"))
    weighed = counts.withColumn("w", F.sqrt(raw) if root else raw)
    return weighed.withColumn("weight", F.col("w") / F.sum("w").over(every)).select(label, "n", "weight")
