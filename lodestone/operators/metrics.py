"""Classification, ranking, regression and calibration metrics as plans over counts.

Everything reduces to a grouped table (of label pairs, or of distinct scores) before it is ordered.
Running sums and rank statistics of many different values go range by range
(:mod:`lodestone.operators.ordered`).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.ordered import MEDIAN, at_positions, boundaries, concordance, median, running


def argmax(probabilities: str) -> Column:
    """The first index of the largest element, from 0."""
    return F.array_position(probabilities, F.array_max(probabilities)) - 1


def report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """``label, precision, recall, f1, support`` for each true label; a division by zero gives 0."""
    cells = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    hit = F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0))
    gold = cells.groupBy(F.col("t").alias("label")).agg(F.sum("n").alias("support"), hit.alias("tp"))
    said = cells.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("said"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    both = gold.join(said, "label", "left").select("label", zero(F.try_divide("tp", "said")).alias("precision"), zero(F.try_divide("tp", "support")).alias("recall"), "support")
    f1 = zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return both.select("label", "precision", "recall", f1.alias("f1"), "support")


def macro(per_class: DataFrame) -> DataFrame:
    return per_class.agg(*(F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")), F.sum("support").alias("support"))


def auc(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """``auc``: the share of (positive, negative) pairs in order, ties counting half; null without both."""
    g = df.groupBy(F.col(score).alias("s")).agg(F.sum(positive.cast("long")).alias("p"), F.sum((~positive).cast("long")).alias("n"))
    below = F.col("upto_n") - F.col("n")
    parts = running(g, "s", ["n"]).select("p", "n", (F.col("p") * (below + F.col("n") / 2)).alias("u"))
    return parts.agg(F.try_divide(F.sum("u"), F.sum("p").cast("double") * F.sum("n")).alias("auc"))


def auc_with_ties(df: DataFrame, score: str, rank: str) -> DataFrame:
    """``macro, weighted, ordinal`` over the thresholds rank >= k and the pairs of neighbouring classes.

    One pass: counts by (score, rank), running counts for each class, and no pass for each threshold.
    """
    cells = df.groupBy(F.col(score).alias("s"), F.col(rank).alias("r")).agg(F.count("*").alias("n"))
    classes = cells.select("r").distinct()

    def judged(mode: str, k: DataFrame, keep: Column, positive: Column) -> DataFrame:
        return cells.crossJoin(F.broadcast(k.select(F.col("r").alias("k")))).where(keep).groupBy("k", "s").agg(F.sum(F.when(positive, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(positive, 0).otherwise(F.col("n"))).alias("q")).withColumn("mode", F.lit(mode))

    cumulative = judged("cumulative", classes, F.lit(True), F.col("r") >= F.col("k"))
    adjacent = judged("adjacent", classes, F.col("r").isin(F.col("k"), F.col("k") - 1), F.col("r") == F.col("k"))
    g = running(cumulative.unionByName(adjacent), "s", ["q"], by=["k", "mode"], edges=boundaries(cells, "s")).withColumn("below", F.col("upto_q") - F.col("q"))
    each = g.groupBy("mode", "k").agg(F.sum("p").alias("P"), F.sum("q").alias("Q"), F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)).alias("u")).where("P > 0 and Q > 0").withColumn("auc", F.col("u") / (F.col("P").cast("double") * F.col("Q")))
    cum = F.col("mode") == "cumulative"
    return each.agg(F.avg(F.when(cum, F.col("auc"))).alias("macro"), F.try_divide(F.sum(F.when(cum, F.col("auc") * F.col("P"))), F.sum(F.when(cum, F.col("P")))).alias("weighted"), F.avg(F.when(~cum, F.col("auc"))).alias("ordinal"))


def _average_ranks(df: DataFrame, column: str, edges: Sequence) -> DataFrame:
    """``value, rank``: average rank of each distinct value."""
    g = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return running(g.where("value is not null"), "value", ["n"], edges=edges).select("value", (F.col("upto_n") - (F.col("n") - 1) / 2).alias("rank"))


def pearson(a: Column, b: Column) -> Column:
    """Aggregate: r, 0 without variance."""
    return F.coalesce(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)), F.lit(0.0))


def rank_correlations(df: DataFrame, a: str, b: str) -> DataFrame:
    """``n, pearson, spearman, kendall``: tau-b from the table of (a, b) counts. Rows without a or b do not count."""
    df = df.select(F.col(a).alias("_a"), F.col(b).alias("_b")).where("_a is not null and _b is not null")
    a, b = "_a", "_b"
    edges = boundaries(df, a), boundaries(df, b)
    x = _average_ranks(df, a, edges[0]).select(F.col("value").alias(a), F.col("rank").alias("ra"))
    y = _average_ranks(df, b, edges[1]).select(F.col("value").alias(b), F.col("rank").alias("rb"))
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    ranked = cells.join(x, a).join(y, b)
    n = F.col("n").cast("double")

    def weighted(u: Column, v: Column) -> Column:
        s = lambda c: F.sum(c * n)
        cov = s(u * v) / F.sum(n) - s(u) * s(v) / F.sum(n) ** 2
        var = lambda c: F.greatest(s(c * c) / F.sum(n) - (s(c) / F.sum(n)) ** 2, F.lit(0.0))
        return F.coalesce(F.try_divide(cov, F.sqrt(var(u) * var(v))), F.lit(0.0))

    moments = ranked.agg(F.sum("n").alias("n"), weighted(F.col(a).cast("double"), F.col(b).cast("double")).alias("pearson"), weighted(F.col("ra"), F.col("rb")).alias("spearman"))
    net = concordance(cells, a, b, "n", edges)
    pairs = lambda c: F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("double")).alias(c)
    ta = df.groupBy(a).agg(F.count("*").alias("n")).agg(pairs("ta"))
    tb = df.groupBy(b).agg(F.count("*").alias("n")).agg(pairs("tb"))
    out = moments.crossJoin(net).crossJoin(ta).crossJoin(tb)  # one row each
    every = F.col("n") * (F.col("n") - 1) / 2
    return out.select("n", "pearson", "spearman", F.coalesce(F.try_divide(F.col("net").cast("double"), F.sqrt((every - F.col("ta")) * (every - F.col("tb")))), F.lit(0.0)).alias("kendall"))


def two_sided_p(r: float, n: int) -> float:
    """P value of a correlation by Student's t with n - 2 degrees, by the incomplete beta's fraction."""
    if n < 3 or abs(r) >= 1:
        return 0.0 if n >= 3 else float("nan")
    df = n - 2
    t2 = r * r * df / (1 - r * r)
    x, a, b = df / (df + t2), df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) if 0 < x < 1 else 0.0

    def fraction(x: float, a: float, b: float) -> float:
        c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (1 + num * d or 1e-300)
                c = 1 + num / c or 1e-300
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    if x < (a + 1) / (a + b + 2):
        return front * fraction(x, a, b) / a
    return 1 - front * fraction(1 - x, b, a) / b


def regression(df: DataFrame, predicted: str, truth: Column) -> DataFrame:
    """``mse, rmse, mae, r2``; r2 is 0 without variance."""
    p, t = F.col(predicted), truth
    s = df.agg(F.avg((p - t) ** 2).alias("mse"), F.avg(F.abs(p - t)).alias("mae"), F.var_pop(t).alias("var"))
    return s.select("mse", F.sqrt("mse").alias("rmse"), "mae", F.when(F.col("var") > 0, 1 - F.try_divide("mse", "var")).otherwise(0.0).alias("r2"))


def reliability(df: DataFrame, predicted: str, truth: Column, bins: int = 10) -> DataFrame:
    """``bin, n, mean_predicted, mean_truth``: edges i / bins, scores outside go to the end bins, empty bins are left out."""
    edges = F.array(*(F.lit(i / bins) for i in range(1, bins)))
    b = F.size(F.filter(edges, lambda e: F.col(predicted) >= e))
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(predicted).alias("mean_predicted"), F.avg(truth).alias("mean_truth"))


def calibration_error(bins: DataFrame) -> DataFrame:
    gap = F.abs(F.col("mean_predicted") - F.col("mean_truth"))
    return bins.agg((F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


def per_class(df: DataFrame, predicted: str, label: str) -> DataFrame:
    """``n, mean, std, min, max, median`` of the predictions of each label."""
    p = F.col(predicted)
    base = df.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("n"), F.avg(p).alias("mean"), F.stddev_pop(p).alias("std"), F.min(p).alias("min"), F.max(p).alias("max"))
    middle = at_positions(df, predicted, MEDIAN, by=[label]).select(F.col(label), median().alias("median"))
    both = base.join(middle, F.col("_label").eqNullSafe(F.col(label)), "left")
    return both.select(F.col("_label").alias(label), "n", "mean", "std", "min", "max", "median")


def one_vs_rest(df: DataFrame, probabilities: str, truth: str) -> DataFrame:
    """``label, auc, positives``: the AUC of each class's probability (map of class to number) against all others.

    A class that a row's map lacks has probability 0 there; rows without truth do not count. One
    tie-aware pass over the table of (class, score) counts. A class without true rows, or with no
    other rows, has no AUC.
    """
    df = df.where(F.col(truth).isNotNull())
    classes = df.select(F.explode(F.map_keys(probabilities)).alias("c")).union(df.select(F.col(truth).cast("string"))).where("c is not null").distinct()
    given = df.select(F.col(truth).cast("string").alias("t"), F.explode(probabilities).alias("c", "s")).withColumn("hit", F.col("c") == F.col("t"))
    # Probability 0 where it is not given: what a class's counts lack of all rows and of its true rows.
    cells = given.where("s is not null").groupBy("c", F.col("s").cast("double").alias("s")).agg(F.count_if("hit").alias("p"), F.count_if(~F.coalesce("hit", F.lit(False))).alias("q"))
    seen = cells.groupBy("c").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    true = df.groupBy(F.col(truth).cast("string").alias("c")).agg(F.count("*").alias("p"))
    rows = df.agg(F.count(truth).alias("rows"))
    rest = classes.join(seen, "c", "left").join(true.withColumnRenamed("p", "all_p"), "c", "left").crossJoin(F.broadcast(rows))  # rows is one row
    zero = lambda c: F.coalesce(c, F.lit(0))
    absent = rest.select("c", F.lit(0.0).alias("s"), (zero("all_p") - zero("p")).alias("p"), (F.col("rows") - zero("all_p") - zero("q")).alias("q"))
    whole = cells.unionByName(absent).groupBy("c", "s").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    parts = running(whole, "s", ["q"], by=["c"]).select("c", "p", "q", (F.col("p") * (F.col("upto_q") - F.col("q") / 2)).alias("u"))
    auc = F.try_divide(F.sum("u"), F.sum("p").cast("double") * F.sum("q"))
    return parts.groupBy(F.col("c").alias("label")).agg(auc.alias("auc"), F.sum("p").alias("positives"))


def macro_auc(per_label: DataFrame) -> DataFrame:
    """``macro_auc``: the mean over the classes of :func:`one_vs_rest`; null if one has no AUC."""
    return per_label.agg(F.when(F.count("auc") == F.count("*"), F.avg("auc")).alias("macro_auc"))


def prediction_range(df: DataFrame, predicted: str) -> DataFrame:
    return df.agg(F.min(predicted).alias("min"), F.max(predicted).alias("max"), F.count_if((F.col(predicted) < 0) | (F.col(predicted) > 1)).alias("outside"))
