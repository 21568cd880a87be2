"""Multi-layer heads over array features, trained by mini-batches that Spark sums.

A step's gradient is the sum of the partitions' gradients over the rows of one batch; the driver
holds the weights (their number depends on the layers, not on the rows) and takes an Adam step. A
share of the rows is held out by hash: training stops when its loss has not fallen for some passes,
the learning rate falls when it stalls, and the weights of the best pass are kept. Nothing depends
on how the rows are partitioned but the order of floating-point sums.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from lodestone.operators.sampling import class_weights, unit

KINDS = ("classes", "labels", "number")


@dataclass
class Head:
    """Layers of weights and biases; ReLU between them. What the last gives depends on ``kind``:

    the probabilities of ``names``, one of which is true (``classes``) or any of which may be (``labels``), or a ``number``.
    """

    kind: str
    names: list[str]
    layers: list[tuple[np.ndarray, np.ndarray]]
    history: list[float]

    def output(self, x: np.ndarray) -> np.ndarray:
        return _squashed(self.kind, _forward(self.layers, x)[-1])

    def column(self, features: str) -> Column:
        """An array of probabilities in the order of ``names``, or the number; null without features."""
        kind = T.DoubleType() if self.kind == "number" else T.ArrayType(T.DoubleType())

        def run(s: pd.Series) -> pd.Series:
            known = s.notna()
            y = iter(self.output(np.stack(s[known].to_list()).astype(np.float64)) if known.any() else ())
            own = (lambda r: float(r[0])) if self.kind == "number" else (lambda r: r)
            return pd.Series([own(next(y)) if k else None for k in known], index=s.index)

        return F.pandas_udf(run, kind)(F.col(features))

    def save(self, spark: SparkSession, path: str) -> None:
        flat = io.BytesIO()
        np.savez(flat, *(a for layer in self.layers for a in layer))
        said = json.dumps({"kind": self.kind, "names": self.names, "history": self.history})
        spark.createDataFrame([(said, bytearray(flat.getvalue()))], "head string, weights binary").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Head":
        row = spark.read.parquet(path).first()
        arrays = list(np.load(io.BytesIO(bytes(row.weights))).values())
        said = json.loads(row.head)
        return Head(said["kind"], said["names"], list(zip(arrays[::2], arrays[1::2])), said["history"])


def _forward(layers: Sequence[tuple[np.ndarray, np.ndarray]], x: np.ndarray) -> list[np.ndarray]:
    """What goes into each layer, and what comes out of the last."""
    seen = [x]
    for k, (w, b) in enumerate(layers):
        z = seen[-1] @ w + b
        seen.append(np.maximum(z, 0) if k + 1 < len(layers) else z)
    return seen


def _squashed(kind: str, z: np.ndarray) -> np.ndarray:
    if kind == "classes":
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)
    return 1 / (1 + np.exp(-np.clip(z, -500, 500))) if kind == "labels" else z


def loss_and_gradient(kind: str, layers: Sequence[tuple[np.ndarray, np.ndarray]], x: np.ndarray, y: np.ndarray, w: np.ndarray, gradient: bool = True) -> tuple[float, np.ndarray]:
    """Weighted sums over rows of the loss, and of its gradient by all weights and biases in order."""
    seen = _forward(layers, x)
    out = _squashed(kind, seen[-1])
    if kind == "number":
        loss = float((w * ((out - y) ** 2).mean(1)).sum())
        back = 2 * (out - y) / y.shape[1]
    else:
        p = np.clip(out, 1e-12, 1 - 1e-12)
        each = y * np.log(p) if kind == "classes" else (y * np.log(p) + (1 - y) * np.log(1 - p)) / y.shape[1]
        loss = float(-(w[:, None] * each).sum())
        back = (out - y) / (1 if kind == "classes" else y.shape[1])
    if not gradient:
        return loss, np.zeros(0)
    back = back * w[:, None]
    parts: list[np.ndarray] = []
    for k in range(len(layers) - 1, -1, -1):
        parts += [back.sum(0), (seen[k].T @ back).ravel()]
        if k:
            back = (back @ layers[k][0].T) * (seen[k] > 0)
    return loss, np.concatenate(parts[::-1])


def _shaped(flat: np.ndarray, widths: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in zip(widths, widths[1:]):
        out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def _summed(rows: DataFrame, kind: str, widths: Sequence[int], flat: np.ndarray, gradient: bool) -> tuple[float, float, np.ndarray]:
    """Loss, weight and gradient over ``rows`` (x, y, w).

    A task reports one packed sum; where tasks are many, their reports are summed in groups first.
    """
    shared = rows.sparkSession.sparkContext.broadcast(flat)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        layers, total = _shaped(shared.value, widths), None
        for b in batches:
            if not len(b):
                continue
            x, y = (b.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(b), n) for i, n in ((0, widths[0]), (1, widths[-1])))
            w = b.column(2).to_numpy(zero_copy_only=False)
            loss, g = loss_and_gradient(kind, layers, x, y, w, gradient)
            one = np.concatenate(([loss, w.sum()], g))
            total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def merged(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = None
        for b in batches:
            for s in b.column(0).to_pylist():
                one = np.frombuffer(s, np.float64)
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    told = rows.select("x", "y", "w").mapInArrow(run, "sums binary")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if tasks > 64:
        told = told.repartition(int(tasks**0.5)).mapInArrow(merged, "sums binary")
    got = [np.frombuffer(bytes(r.sums), np.float64) for r in told.collect()]
    shared.unpersist()
    total = np.sum(got, axis=0) if got else np.zeros(2 + (len(flat) if gradient else 0))
    return float(total[0]), float(total[1]), total[2:]


def targets(df: DataFrame, label: str, kind: str) -> tuple[list[str], Column]:
    """The names of the outputs, and each row's target array: one-hot, multi-hot (of an array of labels), or the number."""
    if kind == "number":
        return [], F.array(F.col(label).cast("double"))
    each = F.explode(F.col(label).cast("array<string>")) if kind == "labels" else F.col(label).cast("string")
    names = sorted(r.c for r in df.select(each.alias("c")).where("c is not null").distinct().collect())
    if kind == "labels":
        has = F.col(label).cast("array<string>")
        return names, F.array(*(F.array_contains(has, n).cast("double") for n in names))
    return names, F.array(*((F.col(label).cast("string") == n).cast("double") for n in names))


def train_head(
    df: DataFrame,
    features: str,
    label: str,
    key: str,
    kind: str = "classes",
    hidden: Sequence[int] = (512,),
    rate: float = 1e-3,
    batches: int = 16,
    passes: int = 100,
    patience: int = 5,
    stall: int = 2,
    held: float = 0.1,
    balanced: bool = False,
    seed: int = 42,
) -> Head:
    """A head of ``hidden`` layers (none: linear). Rows without features or label do not count.

    A pass goes over all rows in ``batches`` steps. After ``patience`` passes without a lower loss on the
    share ``held`` by a hash of ``key``, training ends; after ``stall`` such passes the rate is a tenth.
    ``balanced`` weighs rows of a class inversely to its count.
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {', '.join(KINDS)}")
    df = df.where(F.col(features).isNotNull() & F.col(label).isNotNull())
    names, target = targets(df, label, kind)
    if kind != "number" and not names or df.isEmpty():
        raise ValueError("no rows to learn from")
    weight = F.lit(1.0)
    if balanced and kind == "classes":
        df = df.join(class_weights(df, label).select(F.col(label).alias("_class"), (F.col("weight") * len(names)).alias("_weight")), F.col(label) == F.col("_class"))
        weight = F.col("_weight")
    u = unit(seed, key)
    batch = F.when(u < held, -1).otherwise(F.floor((u - held) / (1 - held) * batches)).cast("int")
    rows = df.select(F.col(features).cast("array<double>").alias("x"), target.alias("y"), weight.alias("w"), batch.alias("batch")).sortWithinPartitions("batch").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        width = rows.select(F.size("x")).first()[0]
        counts = {r.batch: r["count"] for r in rows.groupBy("batch").count().collect()}
        apart = rows.where("batch = -1") if counts.get(-1) else rows
        widths = [width, *hidden, max(1, len(names))]
        rng = np.random.default_rng(seed)
        flat = np.concatenate([np.concatenate((rng.uniform(-1, 1, a * b) * (6 / a) ** 0.5, np.zeros(b))) for a, b in zip(widths, widths[1:])])
        m, v, step = np.zeros_like(flat), np.zeros_like(flat), 0
        best, lowest, since, history = flat, float("inf"), 0, []
        for _ in range(passes):
            for k in rng.permutation(sorted(b for b in counts if b >= 0)).tolist():
                _, n, g = _summed(rows.where(F.col("batch") == k), kind, widths, flat, True)
                step, g = step + 1, g / max(n, 1e-12)
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                flat = flat - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            loss, n, _ = _summed(apart, kind, widths, flat, False)
            history.append(loss / max(n, 1e-12))
            if history[-1] < lowest - 1e-6:
                best, lowest, since = flat, history[-1], 0
                continue
            since += 1
            if since >= patience:
                break
            if since % stall == 0:
                rate /= 10
    finally:
        rows.unpersist()
    return Head(kind, names, _shaped(best, widths), history)


def evaluate_head(df: DataFrame, head: Head, features: str, label: str) -> DataFrame:
    """``label, prediction`` of each row with features: the likeliest name, or the number; for several labels those of 0.5 and more."""
    out = head.column(features)
    if head.kind == "number":
        return df.select(F.col(label).alias("label"), out.alias("prediction"))
    names = F.array(*map(F.lit, head.names))
    scored = df.select(F.col(label).alias("label"), out.alias("_p"))
    if head.kind == "labels":
        likely = F.filter(F.arrays_zip(names.alias("n"), F.col("_p").alias("p")), lambda z: z["p"] >= 0.5)
        return scored.select("label", F.transform(likely, lambda z: z["n"]).alias("prediction"))
    return scored.select("label", F.element_at(names, F.array_position("_p", F.array_max("_p")).cast("int")).alias("prediction"), F.map_from_arrays(names, "_p").alias("probabilities"))
