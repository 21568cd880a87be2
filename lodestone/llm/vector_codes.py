"""Vector codes of 16 parts by ball k-means, exact in integers.

Components become floor(256 x). Each part position has a codebook of at most 64 entries, at first
the parts of the vectors with the smallest ids. The first assignment reads all entries. The later
ones know each part's entry of the round before: the parts of an entry are its ball. Entries farther
than twice the ball's radius cannot win and are no neighbours. A part nearer to its entry than half
the way to the next entry is in the stable core and is not compared at all. The others lie in rings
between the half-ways to the neighbours, in order of distance, and are compared with the neighbours
up to their ring. All bounds are of squared integers and include equality, so ties go to the lower
index as in a full search.

A round's vectors are one written table, whose tasks also report their sums for each entry; what the
driver holds is the codebooks.

Rows with a null vector or with null or non-finite components are dropped, and so are components of
2^18 and more (their squares would leave 64 bits) and vectors whose length is not that of the kept
vector with the smallest id. Rows that repeat a vec_id count each; of equal ids the smaller vector
comes first. Null ids are coded and come last among those that start the codebooks. With fewer than
64 vectors the codebooks are as small. An empty table gives an empty result. A length that 16 parts
do not divide is an error. Columns other than the three named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import ship, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
_LIMIT = float(1 << 18)
#: Vectors that are compared at a time.
_BATCH = 20_000


def full_search(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of ``c`` to each row of ``x`` and the squared distance, all entries compared."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * top * top * max(1, c.shape[1]) < 1 << 53:  # then doubles are exact
        f, g = x.astype(np.float64), c.astype(np.float64)
        d = (f * f).sum(1)[:, None] - 2 * (f @ g.T) + (g * g).sum(1)
    else:
        d = np.zeros((len(x), len(c)), np.int64)
        for k in range(x.shape[1]):
            d += (x[:, k, None] - c[None, :, k]) ** 2
    near = d.argmin(1)
    return near, d[np.arange(len(x)), near].astype(np.int64)


def ball_search(x: np.ndarray, c: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """As :func:`full_search`, from the entries ``known`` before; also how many distances were computed."""
    own = ((x - c[known]) ** 2).sum(1)
    apart = np.zeros((len(c), len(c)), np.int64)
    for k in range(c.shape[1]):
        apart += (c[:, k, None] - c[None, :, k]) ** 2
    radius = np.zeros(len(c), np.int64)
    np.maximum.at(radius, known, own)
    order = np.argsort(apart, axis=1, kind="stable")
    steps = np.take_along_axis(apart, order, 1)
    rings = np.zeros(len(x), np.int64)
    by_ball = np.argsort(known, kind="stable")
    cuts = np.searchsorted(known[by_ball], np.arange(len(c) + 1))
    for j in np.flatnonzero(np.diff(cuts)):
        neighbours = int(np.searchsorted(steps[j], 4 * radius[j], "right"))
        points = by_ball[cuts[j] : cuts[j + 1]]
        rings[points] = np.searchsorted(steps[j, :neighbours], 4 * own[points], "right")
    # One entry within reach is the part's own: the stable core.
    open_ = np.flatnonzero(rings > 1)
    near, best = known.copy(), own.copy()
    n = rings[open_]
    first = np.cumsum(n) - n
    point = np.repeat(open_, n)
    entry = order[known[point], np.arange(len(point)) - np.repeat(first, n)]
    d = ((x[point] - c[entry]) ** 2).sum(1)
    if len(open_):
        best[open_] = np.minimum.reduceat(d, first)
        near[open_] = np.minimum.reduceat(np.where(d == best[point], entry, len(c)), first)
    return near, best, len(x) + len(point)


def assign(x: np.ndarray, books: np.ndarray, known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, parts) and squared distances summed over parts of the vectors ``x`` (n, parts, width)."""
    codes, error = np.empty(x.shape[:2], np.int64), np.zeros(len(x), np.int64)
    for p in range(x.shape[1]):
        part = np.ascontiguousarray(x[:, p])
        codes[:, p], d = full_search(part, books[p]) if known is None else ball_search(part, books[p], known[:, p])[:2]
        error += d
    return codes, error


def kept(vectors: DataFrame) -> DataFrame:
    """The written ``vec_id, label, v`` of the vectors that can be coded, as integers."""
    ship(vectors.sparkSession)
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("e"))
    bad = F.exists("e", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) >= _LIMIT))
    return written(x.where(~bad).select("vec_id", "label", F.transform("e", lambda e: F.floor(e * SCALE).cast("int")).alias("v")), "vectors")


def first_books(table: DataFrame, parts: int, entries: int, width: int) -> np.ndarray:
    """The starting codebooks (parts, entries, width)."""
    rows = table.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    v = np.array([r.v for r in rows], np.int64).reshape(len(rows), parts, width)
    return np.ascontiguousarray(v.transpose(1, 0, 2))


def _round(table: DataFrame, books: np.ndarray, ball: bool, last: bool) -> DataFrame:
    """``vec_id, label, v, code, error`` of the table's vectors, and each task's ``sums`` as a row of its own."""
    label = table.schema["label"].dataType.simpleString()
    parts, entries, width = books.shape
    kind = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        shape = None
        for whole in batches:
            for at in range(0, len(whole), _BATCH):
                batch = whole.slice(at, _BATCH)
                v = batch.column(2)
                x = v.flatten().to_numpy().astype(np.int64).reshape(len(batch), parts, width)
                known = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(len(batch), parts).astype(np.int64) if ball else None
                codes, error = assign(x, books, known)
                if not last:
                    for p in range(parts):
                        counts[p] += np.bincount(codes[:, p], minlength=entries)
                        np.add.at(sums[p], codes[:, p], x[:, p])
                code = pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary())
                none = pa.nulls(len(batch), kind)
                out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), v, code, pa.array(error), none], ["vec_id", "label", "v", "code", "error", "sums"])
                shape = out.schema
                yield out
        if shape is not None and not last:
            told = pa.array([np.concatenate((counts.ravel(), sums.ravel()))], kind)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in list(shape)[:-1]), told], schema=shape)

    out = table.mapInArrow(run, f"vec_id long, label {label}, v array<int>, code binary, error long, sums array<long>")
    return written(out, "codes")


def moved(table: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks whose entries are the floors of their parts' means; unused entries stay."""
    told = table.where("sums is not null").select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()
    if not told:
        return books
    flat = np.zeros(books.shape[0] * books.shape[1] * (1 + books.shape[2]), np.int64)
    for at, x in told:
        flat[at] = x
    counts, sums = np.split(flat, [books.shape[0] * books.shape[1]])
    counts = counts.reshape(books.shape[:2])[..., None]
    return np.where(counts > 0, sums.reshape(books.shape) // np.maximum(counts, 1), books)


@dataclass
class Coded:
    """``table``: vec_id, label, v, code (a byte for each part), error; ``books``: parts x entries x width."""

    table: DataFrame
    books: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def coded(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Coded:
    """Codebooks learned from all vectors in ``rounds`` rounds, and every vector's code under them."""
    if entries > 256:
        raise ValueError("a code is a byte, so a codebook has 256 entries at most")
    table = kept(vectors)
    first = table.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v").alias("n")).first()
    width = first.n if first else 0
    if width % parts:
        raise ValueError(f"{parts} parts do not divide vectors of {width} components")
    table = table.where(F.size("v") == width)
    books = first_books(table, parts, entries, width // parts)
    for k in range(rounds):
        table = _round(table, books, ball=k > 0, last=False)
        books = moved(table, books)
        table = table.where("sums is null").drop("error", "sums")
    return Coded(_round(table, books, ball=rounds > 0, last=True).drop("sums"), books)


def reconstructed(found: Coded) -> DataFrame:
    """``vec_id, v``: each vector as its code gives it back, in the input's scale."""
    books = found.books

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(batch), books.shape[0])
            v = books[np.arange(books.shape[0]), code] / SCALE
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(v.reshape(len(batch), -1)), pa.list_(pa.float64()))], ["vec_id", "v"])

    return found.table.select("vec_id", "code").mapInArrow(run, "vec_id long, v array<double>")


def digests(found: Coded) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every coded vector."""
    sums = found.table.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    both = found.table.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return both.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(found.sha256()).alias("codebooks_sha256"))
