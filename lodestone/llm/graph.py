"""Connected components of an edge table, by alternating minimum propagation and pointer jumping.

Only DataFrame operations: each round takes, for each node, the smallest label among its neighbours'
(a partial minimum before the shuffle, so a hub costs one row a task) and then jumps to the label's
label, which halves the depth of the trees that remain. Rounds grow with the logarithm of a
component's width. Each round is written to the shared folder; the driver sees one number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import written


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of ``edges`` (a, b).

    Self links and repeated edges are harmless; null ends are dropped; no edges give no rows.
    """
    kind = edges.schema["a"].dataType
    both = edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left = written(both.distinct(), "components-edges")
    # A round contracts each node into a smaller one; what edges remain join the contracted nodes.
    # The smallest node of a component never moves, so it is the label when no edge remains.
    parents: list[DataFrame] = []
    for _ in range(max_rounds):
        if left.isEmpty():
            break
        up = left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up"))
        up = written(up, "components-up")
        jumped = up.alias("x").join(up.alias("y"), F.col("x.up") == F.col("y.node"), "left").select(F.col("x.node").alias("node"), F.coalesce("y.up", "x.up").alias("up"))
        jumped = written(jumped, "components-jump")
        parents.append(jumped)
        at = lambda side: F.coalesce(F.col(f"{side}.up"), F.col(side + "0"))
        moved = (
            left.select(F.col("a").alias("a0"), F.col("b").alias("b0"))
            .join(jumped.select(F.col("node").alias("a0"), F.struct("up").alias("a")), "a0", "left")
            .join(jumped.select(F.col("node").alias("b0"), F.struct("up").alias("b")), "b0", "left")
            .select(at("a").alias("a"), at("b").alias("b"))
            .where("a <> b")
        )
        left = written(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "components-edges")
    else:
        raise RuntimeError(f"edges are left after {max_rounds} rounds")
    if not parents:
        return edges.sparkSession.createDataFrame([], f"node {kind.simpleString()}, component {kind.simpleString()}")
    # From the last round back: what a node moved to may itself have moved later.
    top = parents[-1].select("node", F.col("up").alias("component"))
    for earlier in reversed(parents[:-1]):
        now = earlier.join(top.withColumnRenamed("node", "up"), "up", "left").select("node", F.coalesce("component", "up").alias("component"))
        top = now.unionByName(top.join(earlier.select("node"), "node", "left_anti"))
    labelled = written(top, "components-labels")
    roots = labelled.select(F.col("component").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return labelled.unionByName(roots)
