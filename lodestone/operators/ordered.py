"""Running sums, order statistics and inversion counts over values of any number.

Nothing here sorts a whole column in one task. The values are cut into ranges at boundaries taken
from a bounded sample of the distinct values (those with the smallest hashes, so the cut is the same
each time); ranges hold like numbers of distinct values, whatever the ties. Sums of the ranges give
each its base by prefix sums, and only within a range are values sorted. A column of few distinct
values is one range.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Up to about so many distinct values are one range, which one task sorts.
FEW = 100_000
#: Distinct values sampled for each range; ranges at most.
OVER, MOST = 32, 1024


def boundaries(values: DataFrame, column: str, ranges: int | None = None) -> list:
    """Lower ends of all ranges but the first, in Spark's order; none if there are few distinct values.

    The driver holds OVER values for each range.
    """
    # A sketch counts the values without a shuffle, the same however they are partitioned.
    if values.agg(F.approx_count_distinct(column)).first()[0] < FEW:
        return []
    ranges = ranges or min(MOST, max(8, int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    size = OVER * ranges
    chosen = values.select(F.col(column).alias("v")).where("v is not null").distinct().orderBy(F.xxhash64("v"), "v").limit(size)
    rows = [r.v for r in chosen.orderBy("v").collect()]
    return [rows[len(rows) * i // ranges] for i in range(1, ranges)] if len(rows) >= size else []


def range_of(value: Column, edges: Sequence, kind: str) -> Column:
    """The number of ``edges`` that ``value`` reaches, found among their tops first; ``kind`` is the value's type."""
    if not edges:
        return F.lit(0)
    step = max(1, int(len(edges) ** 0.5))
    blocks = [edges[at : at + step] for at in range(0, len(edges), step)]
    lits = lambda xs: F.array(*(F.lit(x).cast(kind) for x in xs))
    reached = lambda xs: F.size(F.filter(xs, lambda e: value >= e))
    # Blocks whose first edge is reached; all but the last of them are reached as a whole.
    tops = reached(lits([b[0] for b in blocks]))
    inner = reached(F.element_at(F.array(*(lits(b) for b in blocks)), F.greatest(tops, F.lit(1))))
    return F.when(tops == 0, 0).otherwise((tops - 1) * step + inner)


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Keys of ``left`` equal ``_k0, _k1, ...`` of ``right``, nulls too."""
    out = F.lit(True)
    for i, k in enumerate(keys):
        out = out & left[k].eqNullSafe(right[f"_k{i}"])
    return out


def _named(df: DataFrame, keys: Sequence[str], *rest: str) -> DataFrame:
    return df.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *rest)


def running(cells: DataFrame, order: str, sums: Sequence[str], by: Sequence[str] = (), edges: Sequence | None = None) -> DataFrame:
    """``cells`` and ``upto_<s>`` for each of ``sums``: its sum over the cells of the same ``by`` up to this ``order``.

    Cells of one order are peers: each has the sum over all of them.
    """
    edges = boundaries(cells, order) if edges is None else edges
    if not edges:
        w = Window.partitionBy(*by).orderBy(order)
        return cells.withColumns({f"upto_{s}": F.sum(s).over(w) for s in sums})
    cut = cells.withColumn("_range", range_of(F.col(order), edges, cells.schema[order].dataType.simpleString()))
    keys = [*by, "_range"]
    w = Window.partitionBy(*keys).orderBy(order)
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    each = cut.groupBy(*keys).agg(*(F.sum(s).alias(f"_s_{s}") for s in sums))
    bases = _named(each.withColumns({f"_base_{s}": F.coalesce(F.sum(f"_s_{s}").over(before), F.lit(0)) for s in sums}), keys, *(f"_base_{s}" for s in sums))
    local = cut.withColumns({f"_local_{s}": F.sum(s).over(w) for s in sums})
    return local.join(bases, _same(local, bases, keys)).select(*cells.columns, *((F.col(f"_base_{s}") + F.col(f"_local_{s}")).alias(f"upto_{s}") for s in sums))


def at_positions(df: DataFrame, value: str, wanted: Sequence[tuple[str, str]], by: Sequence[str] = ()) -> DataFrame:
    """For each (name, SQL of a position from 0 over ``total``) the value there in sorted order; nulls do not count.

    One row (of nulls, where there are no values), or one for each group of ``by`` that has values.
    Of a column of many values only the ranges that hold a wanted position are sorted.
    """
    cells = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    edges = boundaries(cells, "_v")
    if not edges:
        whole, upto = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("_v")
        placed = cells.withColumns({"_upto": F.sum("_n").over(upto), "total": F.sum("_n").over(whole)})
        return placed.groupBy(*by).agg(*(F.min(F.when(F.col("_upto") > F.expr(sql), F.col("_v"))).alias(name) for name, sql in wanted))
    picks = [F.min(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name, _ in wanted]
    positions = F.explode(F.array(*(F.struct(F.lit(name).alias("_name"), F.expr(sql).cast("long").alias("_at")) for name, sql in wanted)))
    cut = cells.withColumn("_range", range_of(F.col("_v"), edges, cells.schema["_v"].dataType.simpleString()))
    keys = [*by, "_range"]
    each = cut.groupBy(*keys).agg(F.sum("_n").alias("_in"))
    whole = Window.partitionBy(*by)
    bases = each.withColumns({"total": F.sum("_in").over(whole), "_base": F.sum("_in").over(whole.orderBy("_range")) - F.col("_in")})
    held = _named(bases.select(*keys, "_in", "_base", positions.alias("_p")).select(*keys, "_in", "_base", "_p.*").where("_at >= _base and _at < _base + _in"), keys, "_base", "_name", "_at")
    needed = held.select(*(f"_k{i}" for i in range(len(keys))), "_base").distinct()
    inside = cut.join(needed, _same(cut, needed, keys)).withColumn("_upto", F.col("_base") + F.sum("_n").over(Window.partitionBy(*keys).orderBy("_v"))).drop("_base", *(f"_k{i}" for i in range(len(keys))))
    hits = inside.join(held, _same(inside, held, keys) & (F.col("_at") < F.col("_upto")) & (F.col("_at") >= F.col("_upto") - F.col("_n")))
    return hits.groupBy(*by).agg(*picks)


def numbered(df: DataFrame, order: str, ties: Sequence[str] = (), by: Sequence[str] = (), out: str = "position") -> DataFrame:
    """``df`` and ``out``: each row's place from 0 in the order of ``order``, then ``ties`` (within each group of ``by``).

    Ranges are counted, and a range's base is a prefix sum; rows are sorted within ranges only. Boundaries
    are values, so a task that is run again numbers the same rows.
    """
    edges = boundaries(df, order)
    cut = df.withColumn("_range", range_of(F.col(order), edges, df.schema[order].dataType.simpleString()))
    keys = [*by, "_range"]
    local = cut.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(order, *ties)).cast("long") - 1)
    if not edges:
        return local.drop("_range")
    each = cut.groupBy(*keys).agg(F.count("*").alias("_in"))
    before = F.sum("_in").over(Window.partitionBy(*by).orderBy("_range")) - F.col("_in")
    bases = _named(each.withColumn("_base", before), keys, "_base")
    return local.join(bases, _same(local, bases, keys)).select(*df.columns, (F.col(out) + F.col("_base")).alias(out))


MEDIAN = (("_low", "cast(floor((total - 1) / 2) as long)"), ("_high", "cast(ceil((total - 1) / 2) as long)"))


def median() -> Column:
    """The median from the two middle values of :data:`MEDIAN`."""
    return (F.col("_low").cast("double") + F.col("_high").cast("double")) / 2


def net_order(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> int:
    """Sum of w_i w_j sign(x_i - x_j) sign(y_i - y_j) over all pairs, by merging runs sorted by y.

    Pairs that tie in x or y count nothing.
    """
    order = np.lexsort((y, x))
    x, w = x[order], w[order]
    _, y = np.unique(y[order], return_inverse=True)
    n, top = len(x), int(y.max()) + 1 if len(y) else 0
    small = int(w.sum()) ** 2 < 1 << 62
    w = w if small else w.astype(object)
    total = 0
    # In order of x, a pair counts as y goes up or down; run by run of doubling length.
    at, by_y, size = np.arange(n), np.arange(n), 1
    while size < n:
        pair = at // (2 * size)
        merged = np.argsort(pair[by_y] * top + y[by_y], kind="stable")
        by_y = by_y[merged]
        left = (by_y // size) % 2 == 0
        key = pair[by_y] * top + y[by_y]
        lw = np.where(left, w[by_y], 0)
        upto = np.concatenate(([0], np.cumsum(lw)))
        begin = np.searchsorted(pair[by_y], np.arange(int(pair[-1]) + 2))
        first, last = np.searchsorted(key, key, "left"), np.searchsorted(key, key, "right")
        p = pair[by_y]
        less = upto[first] - upto[begin[p]]
        more = upto[begin[p + 1]] - upto[last]
        total += int(np.where(left, 0, w[by_y] * (less - more)).sum())
        size *= 2
    # Pairs with one x stand in order of y, so each with two y's was counted as going up.
    both = lambda keys: int(sum(s * s for s in _sums(keys, w)))
    if n:
        xs = np.cumsum(np.concatenate(([0], x[1:] != x[:-1])))
        total -= (both(xs) - both(xs * top + y)) // 2
    return total


def _sums(keys: np.ndarray, w: np.ndarray) -> list[int]:
    """Sums of ``w`` over runs of equal, sorted ``keys``."""
    cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return [int(s) for s in np.add.reduceat(w, cuts)]


def concordance(cells: DataFrame, a: str, b: str, n: str, edges: tuple[Sequence, Sequence] | None = None) -> DataFrame:
    """One row, ``net decimal(38,0)``: concordant less discordant pairs of rows, over the table of (a, b) counts.

    Pairs in one range of a are counted in that range, pairs in one range of b across ranges of a in
    that range, and all others over the table of counts by both ranges, which has at most MOST * MOST cells.
    """
    rows = cells.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(n).cast("long").alias("n")).where("a is not null and b is not null")
    of_a, of_b = edges or (boundaries(rows, "a"), boundaries(rows, "b"))
    kind = {c: rows.schema[c].dataType.simpleString() for c in "ab"}
    cut = rows.select(F.col("a").cast("double").alias("x"), F.col("b").cast("double").alias("y"), "n", range_of(F.col("a"), of_a, kind["a"]).alias("i"), range_of(F.col("b"), of_b, kind["b"]).alias("j"))
    strips = cut.select(F.lit(0).alias("kind"), F.col("i").alias("strip"), "x", "y", "n")
    if of_a:
        across = cut.groupBy("i", "j", "y").agg(F.sum("n").alias("n"))
        far = cut.groupBy("i", "j").agg(F.sum("n").alias("n"))
        strips = strips.unionByName(across.select(F.lit(1).alias("kind"), F.col("j").alias("strip"), F.col("i").cast("double").alias("x"), "y", "n"))
        strips = strips.unionByName(far.select(F.lit(2).alias("kind"), F.lit(0).alias("strip"), F.col("i").cast("double").alias("x"), F.col("j").cast("double").alias("y"), "n"))

    def run(group: pa.Table) -> pa.Table:
        x, y, w = (group.column(c).to_numpy() for c in ("x", "y", "n"))
        return pa.table({"net": [str(net_order(x, y, w))]})

    each = strips.groupBy("kind", "strip").applyInArrow(run, "net string")
    return each.agg(F.coalesce(F.sum(F.col("net").cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias("net"))
