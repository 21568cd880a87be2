"""SimHash near-duplicates by pigeonring filtering.

Fingerprints have 64 bits in four ring segments of 16. If two differ in at most three bits, some
segment starts a chain in which every prefix stays within its proportional budget (3/4 of a bit for
each segment): the first segment is equal, the first two differ in at most one bit, the first three
in at most two. The index key is that chain's beginning: the equal segment, and three equal nibbles
of the next one (one differing bit leaves three of its four nibbles alone), 28 bits under 16 choices.
Fingerprints that meet under a key pass the chain test before the full Hamming check.

Equal fingerprints are grouped first, so copies meet no one. Under a key the links found are joined
to a spanning forest there and then: what leaves a key is at most one edge for each fingerprint,
which keeps every connection without listing all pairs. Keys with very many different fingerprints
are dealt again by an equal part of what the key leaves open, so none is compared in one task alone.

Fewer words than a shingle: the whole sequence is the shingle; no words (null or empty text):
fingerprint zero, linked like any other. Repeated rows stay; of documents with a null id, the
smallest other id reachable (or null) is the component. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import batched, texts, written
from lodestone.llm.graph import components

SEED = 42
DISTANCE = 3
SEGMENTS = 4
WIDTH = 16
#: Different fingerprints under one key beyond which the key is refined.
HOT_KEY = 20_000


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id long, fp long``: a bit is 1 if set in over half of the shingles' XXH64, repeats included."""
    shape = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh64_intdigest
        for batch in batches:
            out = []
            for text in batch.column(1):
                words = text.as_py().encode().lower().split()
                if not words:
                    out.append(0)
                    continue
                if len(words) <= shingle:
                    parts = [b" ".join(words)]
                else:
                    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
                h = np.array([digest(p, SEED) for p in parts], "<u8")
                ones = np.zeros(64, np.int64)
                for lo in range(0, len(h), 1 << 16):
                    ones += np.unpackbits(h[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                bits = np.packbits(2 * ones > len(h), bitorder="little")
                out.append(int(bits.view("<i8")[0]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], schema=shape)

    return batched(texts(docs)).mapInArrow(run, "doc_id long, fp long")


def chain_keys(fp) -> list:
    """For each start segment and each nibble left out of the next one: (choice, key column)."""
    out = []
    for i in range(SEGMENTS):
        first = F.shiftrightunsigned(fp, WIDTH * i).bitwiseAND(0xFFFF)
        second = F.shiftrightunsigned(fp, WIDTH * ((i + 1) % SEGMENTS)).bitwiseAND(0xFFFF)
        for n in range(4):
            kept = second.bitwiseAND(0xFFFF & ~(0xF << 4 * n))
            out.append((4 * i + n, first * 65536 + kept))
    return out


def _forest(a: np.ndarray, starts: int) -> list[tuple[int, int]]:
    """Spanning edges of the links among distinct fingerprints ``a`` whose chain starts at ``starts``."""
    segment = lambda k: np.uint64(0xFFFF << WIDTH * ((starts + k) % SEGMENTS))
    second, third = segment(1), segment(1) | segment(2)
    left = np.arange(len(a))
    edges = []
    # Breadth first: the frontier meets only what no tree has reached, so the cost falls as trees grow.
    while len(left):
        root, left = left[0], left[1:]
        frontier = [root]
        while frontier and len(left):
            f = frontier.pop()
            x = a[left] ^ a[f]
            near = np.flatnonzero(np.bitwise_count(x & second) <= 1)
            near = near[np.bitwise_count(x[near] & third) <= 2]
            near = near[np.bitwise_count(x[near]) <= DISTANCE]
            if len(near):
                hit = left[near]
                edges.extend((int(f), int(h)) for h in hit)
                frontier.extend(hit.tolist())
                left = np.delete(left, near)
    return edges


def links(distinct: DataFrame, hot_key: int = HOT_KEY) -> DataFrame:
    """``a long, b long``: edges among distinct fingerprints that connect exactly what links of at
    most three differing bits connect; ``distinct`` has the column fp."""
    pairs = F.array(*(F.struct(F.lit(c).alias("choice"), k.alias("key")) for c, k in chain_keys(F.col("fp"))))
    keyed = distinct.select("fp", F.explode(pairs).alias("k")).select("fp", (F.col("k.choice") * (1 << 32) + F.col("k.key")).alias("key"))
    shape = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fps, keys = np.zeros(0, np.int64), np.zeros(0, np.int64)
        done = False
        it = iter(batches)
        while not done:
            batch = next(it, None)
            if batch is None:
                done, cut = True, len(keys)
            else:
                keys = np.concatenate([keys, batch.column(1).to_numpy()])
                fps = np.concatenate([fps, batch.column(0).to_numpy()])
                cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if not cut:
                continue
            k, f = keys[:cut], fps[:cut]
            edges = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1], [True])))
            out_a, out_b = [], []
            for lo, hi in zip(edges[:-1][np.diff(edges) > 1].tolist(), edges[1:][np.diff(edges) > 1].tolist()):
                own = np.unique(f[lo:hi])
                choice = (int(k[lo]) >> 32) & 15
                for x, y in _forest(own.view(np.uint64), choice // 4):
                    out_a.append(int(own[x]))
                    out_b.append(int(own[y]))
            keys, fps = keys[cut:], fps[cut:]
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], schema=shape)

    def joined(rows: DataFrame) -> DataFrame:
        n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return rows.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")

    return joined(refined(keyed, hot_key))


def refined(keyed: DataFrame, hot_key: int) -> DataFrame:
    """``fp, key`` with hot keys dealt again.

    At most three of the 36 bits that a key leaves open differ, so of four parts of nine bits one is
    equal: a hot key becomes four for each fingerprint, each with nine more bits. The choice stays in
    the key, so its chain is still known.
    """
    hot = keyed.groupBy("key").count().where(F.col("count") > hot_key).select("key")
    hot = written(hot, "simhash-hot")
    if hot.isEmpty():
        return keyed
    start = F.shiftright("key", 34).bitwiseAND(3)
    nibble = F.shiftright("key", 32).bitwiseAND(3)
    ring = F.when(start == 0, F.col("fp"))
    for s in (1, 2, 3):
        ring = ring.when(start == s, F.shiftrightunsigned("fp", 16 * s).bitwiseOR(F.shiftleft("fp", 64 - 16 * s)))
    # Ring order: equal segment, next segment, two more. Open: the left-out nibble, then 32 bits.
    high = F.shiftrightunsigned(ring, 32)
    second = F.shiftrightunsigned(ring, 16).bitwiseAND(0xFFFF)
    out = F.when(nibble == 0, second.bitwiseAND(15))
    for n in (1, 2, 3):
        out = out.when(nibble == n, F.shiftright(second, 4 * n).bitwiseAND(15))
    open_bits = high * 16 + out
    parts = F.array(*(F.shiftrightunsigned(open_bits, 9 * j).bitwiseAND(511) + 512 * j for j in range(4)))
    again = keyed.join(hot, "key", "left_semi").select("fp", F.col("key"), F.explode(parts).alias("part"))
    # 28 + 4 bits of the old key, mixed with the part: distinct under a 63-bit layout.
    dealt = again.select("fp", (F.col("key") + F.shiftleft(F.col("part") + 1, 36)).alias("key"))
    return keyed.join(hot, "key", "left_anti").select("fp", "key").unionByName(dealt)


def near_duplicates(docs: DataFrame, shingle: int = 3, hot_key: int = HOT_KEY) -> DataFrame:
    """``doc_id long, fp long, component_id long``: the smallest doc_id reachable over links."""
    own = written(fingerprints(docs, shingle), "simhash-fp")
    distinct = own.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    found = components(links(distinct.select("fp"), hot_key))
    # Component representatives are fingerprints; each needs its smallest document.
    labelled = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "doc_id", F.coalesce("component", "fp").alias("component"))
    # Both sides of the joins below are written tables, so that a large group can be split.
    labelled = written(labelled, "simhash-components")
    least = written(labelled.groupBy("component").agg(F.min("doc_id").alias("component_id")), "simhash-least")
    by_fp = labelled.join(least, "component").select("fp", "component_id")
    return own.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def hex64(fp):
    """A 64-bit value as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
