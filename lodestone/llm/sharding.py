"""Shards of nearly equal bytes by Karmarkar-Karp differencing.

Equal texts are a group and share a shard. Differencing keeps partial partitions, vectors of one sum
for each shard; it takes the two whose sums spread most, adds the largest sum of one to the smallest
of the other and so on, and goes on until one is left. A result is again a partial partition, so the
work is a tree: groups are dealt by hash into chunks of some thousands, each chunk is differenced in
a task, and the chunks' vectors are differenced in turn until one task's worth is left.

A balanced chunk cannot make up for a group that outweighs a shard. So the groups over 1/64 of a
shard (at most 64 a shard) are differenced first; where their sums differ, as many chunks as are
needed start from their share of the difference, as one more partial partition, and fill it up.

A null text counts as empty: no bytes, size 1. Repeated rows and rows of one doc_id count each; a null
doc_id is a row like any other and comes first in its shard's share. An empty table gives an empty
result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import texts, written

SHARDS = 8
#: Partial partitions that one task differences.
FAN = 4096
#: A group over one part in so many of a shard's bytes is heavy.
HEAVY = 64
#: Rows that are numbered in one sort.
NUMBERED = 20_000


def differenced(items: Sequence[Sequence[int]], k: int) -> tuple[list[list[int]], list[int]]:
    """For each partial partition where its slots go, and the sums of the result, largest first.

    Items that spread alike are taken in their order.
    """
    down = lambda sums: sorted(range(k), key=lambda j: -sums[j])
    n = len(items)
    order = [down(x) for x in items]
    heap = []
    for i, (x, o) in enumerate(zip(items, order)):
        sums = [x[j] for j in o]
        heap.append((sums[-1] - sums[0], i, sums))
    heapq.heapify(heap)
    made: list[tuple[int, int]] = []
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        both = [p + q for p, q in zip(x, reversed(y))]
        o = down(both)
        sums = [both[j] for j in o]
        heapq.heappush(heap, (sums[-1] - sums[0], n + len(made), sums))
        made.append((a, b))
        order.append(o)
    if not n:
        return [], [0] * k
    # Top down: where each node's sorted slots end up.
    place: list[list[int]] = [[]] * (n + len(made))
    place[n + len(made) - 1] = list(range(k))
    for node in range(n + len(made) - 1, n - 1, -1):
        a, b = made[node - n]
        to_a, to_b = [0] * k, [0] * k
        for end, j in zip(place[node], order[node]):
            to_a[j] = to_b[k - 1 - j] = end
        place[a], place[b] = to_a, to_b
    out = []
    for i in range(n):
        to = [0] * k
        for end, j in zip(place[i], order[i]):
            to[j] = end
        out.append(to)
    return out, heap[0][2]


def scalar(size: int, k: int) -> list[int]:
    return [size, *[0] * (k - 1)]


def fillings(sums: Sequence[int], light: int) -> list[int]:
    """How ``light`` bytes, or as many as even out ``sums``, fill its lowest slots to one level."""
    low = sorted(sums)
    left, level, j = light, low[0], 1
    while j < len(low) and left > 0:
        step = min((low[j] - level) * j, left)
        level += step / j
        left -= step
        j += 1
    return [max(0, math.floor(level - x)) for x in sums]


def sized(docs: DataFrame) -> DataFrame:
    """The written ``doc_id, size, text_crc32, key`` of every row; ``key`` is the SHA-256 of its text."""
    rows = texts(docs)
    size = (F.octet_length("text") + 1).cast("long")
    return written(rows.select("doc_id", size.alias("size"), F.crc32("text").alias("text_crc32"), F.unhex(F.sha2("text", 256)).alias("key")), "sized")


def _chunks(light: DataFrame, k: int, lacks: list[int] | None, fill: int, full: bool) -> DataFrame:
    """``key, chunk, slot, bytes`` of the groups differenced in each chunk.

    The first ``fill`` make up for what slots lack: each takes an equal share, or where nothing is left
    over (``full``) all its own bytes.
    """
    shape = pa.schema([("key", pa.binary()), ("chunk", pa.int64()), ("slot", pa.int32()), ("bytes", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        chunk = group.column("chunk")[0].as_py()
        rows = sorted(zip(group.column("bytes").to_pylist(), group.column("key").to_pylist()), key=lambda x: (-x[0], x[1]))
        items = [scalar(n, k) for n, _ in rows]
        carried = lacks is not None and chunk < fill
        if carried:
            own = sum(n for n, _ in rows) if full else sum(lacks) // fill
            share = [x * own // sum(lacks) for x in lacks]
            items.append([max(share) - x for x in share])
        to, _ = differenced(items, k)
        slots = [x[0] for x in to[: len(rows)]]
        if carried:
            named = {end: j for j, end in enumerate(to[-1])}
            slots = [named[s] for s in slots]
        return pa.Table.from_pydict({"key": [x for _, x in rows], "chunk": [chunk] * len(rows), "slot": slots, "bytes": [n for n, _ in rows]}, schema=shape)

    return light.groupBy("chunk").applyInArrow(run, "key binary, chunk long, slot int, bytes long")


def _vectors(rows: list, k: int) -> dict[int, list[int]]:
    """The sums of each item."""
    out: dict[int, list[int]] = {}
    for item, slot, n in rows:
        out.setdefault(item, [0] * k)[slot] += n
    return out


def _upper(items: DataFrame, n: int, k: int, fan: int) -> DataFrame:
    """``item, slot, bytes, up, to``: a further level, of ``n`` items in as many chunks as hold ``fan`` each."""
    shape = pa.schema([("item", pa.int64()), ("slot", pa.int32()), ("bytes", pa.int64()), ("up", pa.int64()), ("to", pa.int32())])

    def run(group: pa.Table) -> pa.Table:
        up = group.column("up")[0].as_py()
        of = _vectors(sorted(zip(*(group.column(c).to_pylist() for c in ("item", "slot", "bytes")))), k)
        to, _ = differenced(list(of.values()), k)
        rows = [(i, j, x[j], up, t[j]) for (i, x), t in zip(of.items(), to) for j in range(k)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), shape)], schema=shape)

    dealt = items.withColumn("up", F.pmod(F.col("item") + 1, F.lit(math.ceil(n / fan))))
    return dealt.groupBy("up").applyInArrow(run, "item long, slot int, bytes long, up long, to int")


def shard_of_groups(groups: DataFrame, k: int = SHARDS, fan: int = FAN) -> DataFrame:
    """``key, shard`` of a written table of groups (``key, bytes``)."""
    spark = groups.sparkSession
    n, total = groups.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    parts = max(1, math.ceil(n / fan))
    heavy, lacks, fill = [], None, 0
    rest = groups.where(F.col("bytes") * HEAVY * k > F.lit(total)) if parts > 1 else None
    if rest is not None:
        # At most HEAVY * k rows, as each has more than that share of the whole.
        heavy = sorted(((r.bytes, bytes(r.key)) for r in rest.collect()), key=lambda x: (-x[0], x[1]))
        groups = groups.where(F.col("bytes") * HEAVY * k <= F.lit(total))
    to, base = differenced([scalar(x, k) for x, _ in heavy], k)
    light = total - sum(base)
    need = sum(base[0] - x for x in base)
    if need and light:
        fill = min(parts, math.ceil(parts * need / light))
        lacks = fillings(base, light)
        fill = fill if any(lacks) else 0
    placed = written(_chunks(groups.select(F.pmod(F.xxhash64("key"), F.lit(parts)).alias("chunk"), "key", "bytes"), k, lacks, fill, need >= light), "placed")
    # The heavy groups and the chunks that fill up their difference are one partial partition, item -1.
    item = F.when(F.col("chunk") < fill, F.lit(-1)).otherwise(F.col("chunk")).cast("long")
    items = placed.groupBy(item.alias("item"), "slot").agg(F.sum("bytes").alias("bytes"))
    if heavy:
        first = spark.createDataFrame([(-1, j, x) for j, x in enumerate(base)], "item long, slot int, bytes long")
        items = items.unionByName(first).groupBy("item", "slot").agg(F.sum("bytes").alias("bytes"))
    left, levels = parts - fill + 1, []
    while left > fan:
        levels.append(written(_upper(items, left, k, fan), "level"))
        left = math.ceil(left / fan)
        items = levels[-1].groupBy(F.col("up").alias("item"), F.col("to").alias("slot")).agg(F.sum("bytes").alias("bytes"))
    of = _vectors(sorted(tuple(r) for r in items.select("item", "slot", "bytes").collect()), k)  # at most fan * k rows
    ends, _ = differenced(list(of.values()), k)
    names = spark.createDataFrame([(i, j, t[j]) for i, t in zip(of, ends) for j in range(k)], "item long, slot int, shard int")
    for level in reversed(levels):
        names = level.join(names.select(F.col("item").alias("up"), F.col("slot").alias("to"), "shard"), ["up", "to"]).select("item", "slot", "shard")
    out = placed.select(item.alias("item"), "slot", "key").join(names, ["item", "slot"]).select("key", "shard")
    if heavy:
        own = next(t for i, t in zip(of, ends) if i == -1) if not levels else None
        slots = spark.createDataFrame([(bytearray(key), -1, t[0]) for (_, key), t in zip(heavy, to)], "key binary, item long, slot int")
        out = out.unionByName(slots.join(names, ["item", "slot"]).select("key", "shard") if own is None else slots.select("key", F.element_at(F.array(*map(F.lit, own)), F.col("slot") + 1).cast("int").alias("shard")))
    return out


def numbered(rows: DataFrame, n: int, k: int, order: Sequence[str]) -> DataFrame:
    """``rows`` (with ``shard``) and a gapless ``slot`` from 0 in each shard, ordered within hashed buckets.

    A shard's buckets are numbered each by itself; their bases are prefix sums of their row counts.
    """
    buckets = max(32, math.ceil(n / (k * NUMBERED)))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    local = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy(*order)).cast("long") - 1
    table = written(dealt.withColumn("local", local), "numbered")
    counts = table.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    base = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")
    bases = counts.select("shard", "bucket", base.alias("base"))
    return table.join(bases, ["shard", "bucket"]).withColumn("slot", F.col("base") + F.col("local")).drop("bucket", "local", "base")


def sharded(docs: DataFrame, k: int = SHARDS, fan: int = FAN) -> DataFrame:
    """One row for each document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    The law is ``bytes``: the shards' sizes are near equal, as far as groups of equal texts allow.
    """
    rows = sized(docs)
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "groups")
    n = rows.count()
    placed = numbered(rows.join(shard_of_groups(groups, k, fan), "key").drop("key"), n, k, ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
