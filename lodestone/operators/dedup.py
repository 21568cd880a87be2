"""MinHash near-duplicates: shingles, banded signatures, star links, connected components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.tables import Tables

#: A Mersenne prime: permutations are a x + b modulo it, and products stay within 62 bits.
PRIME = (1 << 31) - 1


def coefficients(i: int) -> tuple[int, int]:
    """a (not 0) and b of permutation ``i``, by a rule, so the number of hashes is free."""
    return 1 + (i + 1) * 0x9E3779B1 % (PRIME - 1), (i + 1) * 0x85EBCA6B % PRIME


def reduced(x: np.ndarray) -> np.ndarray:
    """``x`` modulo PRIME, for 0 <= x < 2^62."""
    x = (x & PRIME) + (x >> 31)
    x = (x & PRIME) + (x >> 31)
    return np.where(x >= PRIME, x - PRIME, x)


#: Base of the polynomial that numbers a run of words.
BASE = 0x27D4EB2F


def word_numbers(words: pa.Array) -> np.ndarray:
    """A number below PRIME for each word, from the MD5 of each different one."""
    coded = words.dictionary_encode()
    each = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % PRIME for w in coded.dictionary.to_pylist()]
    return np.array(each, np.int64)[coded.indices.to_numpy()]


def shingled(numbers: np.ndarray, sizes: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all runs of ``shingle`` words (a shorter document is one run), and where each document's begin."""
    runs = np.maximum(sizes - shingle + 1, 1)
    starts = np.cumsum(runs) - runs
    within = np.arange(int(runs.sum())) - np.repeat(starts, runs)
    at = np.repeat(np.cumsum(sizes) - sizes, runs) + within
    length = np.repeat(np.minimum(sizes, shingle), runs)
    x = numbers[at]
    for j in range(1, shingle):
        more = j < length
        x = np.where(more, reduced(x * BASE + numbers[np.where(more, at + j, 0)]), x)
    return x, starts


def minima(shingles: np.ndarray, starts: np.ndarray, hashes: int, block: int = 1 << 15) -> np.ndarray:
    """For each document (whose numbers begin at ``starts``; none is empty) the smallest value of every hash.

    A hash is a x + b, its bits above the 31st added to those below: nearly the residue by PRIME. Some
    documents at a time, so that what is worked on stays in the processor's cache.
    """
    out = np.empty((len(starts), hashes), np.int64)
    ends = np.append(starts[1:], len(shingles))
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + block, "right")))
        x = shingles[starts[first] : ends[last - 1]]
        at, v, high = starts[first:last] - starts[first], np.empty_like(x), np.empty_like(x)
        for i in range(hashes):
            a, b = coefficients(i)
            np.multiply(x, a, out=v)
            np.add(v, b, out=v)
            np.right_shift(v, 31, out=high)
            np.bitwise_and(v, PRIME, out=v)
            np.add(v, high, out=v)
            out[first:last, i] = np.minimum.reduceat(v, at)
        first = last
    return out


def signatures(df: DataFrame, key: str, text: str, shingle: int = 5, bands: int = 20, rows: int = 5) -> DataFrame:
    """``key, band, h``: the hash of each band of the MinHash of word shingles; texts without words have none.

    A document's shingles are numbered and reduced within its row, so nothing is shuffled before the bands.
    A word's number is from its MD5, a shingle's a polynomial of its words' numbers.
    """
    words = F.filter(F.split(F.lower(F.col(text)), r"\s+"), lambda w: w != "")
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        # A small table in few files: its rows are dealt out first.
        df = df.select(key, text).repartition(cores)
    base = df.select(key, words.alias("w")).where(F.size("w") > 0)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        for whole in batches:
            # Long texts have many words: some rows at a time.
            for at in range(0, len(whole), 500):
                batch = whole.slice(at, 500)
                w = batch.column(1)
                sizes = w.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                mins = minima(*shingled(word_numbers(w.flatten()), sizes, shingle), bands * rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, mins.size + 1, bands * rows), pa.int32()), pa.array(mins.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], [key, "m"])

    mins = base.mapInArrow(run, f"`{key}` {kind}, m array<bigint>")
    each = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.struct(b.alias("band"), F.xxhash64(F.slice("m", b * rows + 1, rows)).alias("h")))
    return mins.select(key, F.explode(each).alias("b")).select(key, "b.band", "b.h")


def links(df: DataFrame, key: str, text: str, tables: Tables | None = None, **shape: int) -> DataFrame:
    """``a, b``: each document with the smallest of its bucket; a bucket of n gives n - 1 links, never pairs."""
    tables = tables or Tables(df.sparkSession)
    # Both sides of the join below read the written signatures.
    s = tables.written(signatures(df, key, text, **shape))
    stars = s.groupBy("band", "h").agg(F.min(key).alias("a"), F.count("*").alias("n")).where("n > 1")
    return s.join(stars.select("band", "h", "a"), ["band", "h"]).where(F.col("a") != F.col(key)).select("a", F.col(key).alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 60, tables: Tables | None = None) -> DataFrame:
    """``node, component``: smallest node reachable, by neighbours' minima and pointer jumps, written each round."""
    tables = tables or Tables(edges.sparkSession)
    edges = tables.written(edges)
    both = tables.written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component"))
    labels = tables.written(labels)
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node", "left").select("node", F.least("component", "near").alias("component"), F.col("component").alias("old"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        new = tables.written(lower.join(jump, "component", "left").select("node", F.least("component", "next").alias("component"), "old"))
        labels = new.select("node", "component")
        if new.where("component <> old").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def deduplicate(df: DataFrame, key: str, text: str, **shape: int) -> DataFrame:
    """One row of each group of near duplicates: the smallest key."""
    tables = Tables(df.sparkSession)
    gone = components(links(df, key, text, tables, **shape), tables=tables).where("node <> component").select(F.col("node").alias(key))
    return df.join(gone, key, "left_anti")
