"""Exact duplicates by Patricia-trie owners.

Texts are equal when identical after each run of ASCII white space becomes one space. A first pass
combines each input partition's own copies in a compressed radix trie, so a text that makes a third
of all rows leaves a partition once. The combined texts are dealt by length and content hash to
owner partitions, which insert the full byte strings into tries; a terminal node stores the smallest
doc_id. When a trie outgrows its budget, its largest subtree is spilled to the shared folder and
worked on by itself later.

A null text counts as empty. Of rows that tie (the same doc_id and text) one stays. A null doc_id
stays only if the group has no other; then keep_id is null. An empty table gives an empty result;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import batched, place, scratch, texts, written

#: Bytes of text in one trie: a combiner is flushed, an owner spills a subtree.
COMBINE_BYTES = 64 << 20
OWNER_BYTES = 128 << 20
_NODE_BYTES = 200
_HEAD = struct.Struct("<qq?qq")


def squeezed(data: bytes) -> bytes:
    """Each run of ASCII white space as one space."""
    words = data.split()
    if not words:
        return b" " if data else b""
    out = b" ".join(words)
    if data[:1].isspace():
        out = b" " + out
    return out + b" " if data[-1:].isspace() else out


def common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of ``a`` and ``b[at:]``."""
    lo, hi = 0, min(len(a), len(b) - at)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[at + lo : at + mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class Node:
    """A compressed edge's bytes, the children by first byte, and a terminal's smallest id and members."""

    __slots__ = ("label", "children", "least", "count", "members")

    def __init__(self, label: bytes) -> None:
        self.label, self.children = label, {}
        self.least: int | None = None
        self.count = 0
        self.members: list[int] | None = None


class Spilled:
    """A subtree on disk: texts below one byte, to be inserted into a trie of their own."""

    __slots__ = ("path", "stream", "label")

    def __init__(self, system, path: str, label: bytes) -> None:
        self.path, self.stream, self.label = path, system.open_output_stream(path), label

    def add(self, key: bytes, least: int | None, count: int, members: list[int]) -> None:
        self.stream.write(_HEAD.pack(least or 0, count, least is None, len(key), len(members)) + key + np.array(members, "<i8").tobytes())

    def drained(self, system) -> Iterator[tuple[bytes, int | None, int, list[int]]]:
        """What was added; the file goes with it."""
        self.stream.close()
        with system.open_input_stream(self.path) as f:
            while head := f.read(_HEAD.size):
                least, count, null, size, n = _HEAD.unpack(head)
                key = f.read(size)
                yield key, None if null else least, count, np.frombuffer(f.read(8 * n), "<i8").tolist()
        system.delete_file(self.path)


class Trie:
    """A radix trie over byte strings within ``budget`` bytes; ``folder`` is where subtrees go beyond it."""

    def __init__(self, budget: int, folder: str | None = None) -> None:
        self.root, self.budget, self.folder = Node(b""), budget, folder
        self.size = 0
        self.spills: list[Spilled] = []

    def insert(self, key: bytes, least: int | None, count: int, members: list[int]) -> Node | None:
        """Add ``count`` copies; the terminal node, or None if its subtree is on disk."""
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                self.size += len(key) - at + _NODE_BYTES
                node = child
                break
            if isinstance(child, Spilled):
                child.add(key[at + 1 :], least, count, members)
                return None
            label = child.label
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            n = common(label, key, at)
            middle = Node(label[:n])
            child.label = label[n:]
            middle.children[child.label[0]] = child
            node.children[key[at]] = middle
            self.size += _NODE_BYTES
            node, at = middle, at + n
        if node.members is None:
            node.members, node.least = [], least
        elif least is not None and (node.least is None or least < node.least):
            node.least = least
        node.count += count
        node.members.extend(members)
        self.size += 8 * len(members)
        if self.folder and self.size > self.budget:
            self.spill()
        return node

    @staticmethod
    def walk(top: Node, spilled: bool = False) -> Iterator[tuple[bytes, Node]]:
        """Terminal nodes below ``top`` with the bytes from it, and where ``spilled`` the subtrees on disk."""
        stack = [(b"", top)]
        while stack:
            prefix, node = stack.pop()
            if isinstance(node, Spilled):
                if spilled:
                    yield prefix, node
                continue
            if node.members is not None:
                yield prefix, node
            stack.extend((prefix + c.label, c) for c in node.children.values())

    @staticmethod
    def weight(top: Node) -> int:
        out, stack = 0, [top]
        while stack:
            node = stack.pop()
            if isinstance(node, Node):
                out += len(node.label) + _NODE_BYTES + 8 * len(node.members or ())
                stack.extend(node.children.values())
        return out

    def spill(self) -> None:
        """Move the largest subtree below the first fork to disk, with what is on disk below it."""
        top = self.root
        while len(top.children) == 1 and isinstance(only := next(iter(top.children.values())), Node):
            top = only
        kept = {b: c for b, c in top.children.items() if isinstance(c, Node)}
        if not kept:
            return
        byte, child = max(kept.items(), key=lambda x: self.weight(x[1]))
        system, root = place(self.folder)
        system.create_dir(root, recursive=True)
        out = Spilled(system, f"{root}/{uuid.uuid4().hex}", bytes([byte]))
        for key, node in self.walk(child, spilled=True):
            if isinstance(node, Spilled):
                # Later copies of its texts will come to ``out``, so the earlier ones must be there too.
                self.spills.remove(node)
                for rest, *entry in node.drained(system):
                    out.add((child.label + key)[1:] + rest, *entry)
            else:
                out.add((child.label + key)[1:], node.least, node.count, node.members)
        self.size -= self.weight(child)
        top.children[byte] = out
        self.spills.append(out)

    def groups(self) -> Iterator[Node]:
        """Every terminal node; spilled subtrees one after the other, each in a trie of its own."""
        for _, node in self.walk(self.root):
            yield node
        self.root = Node(b"")
        for s in self.spills:
            system, _ = place(self.folder)
            below = Trie(self.budget, self.folder)
            for entry in s.drained(system):
                below.insert(*entry)
            yield from below.groups()


def combined(docs: DataFrame, budget: int = COMBINE_BYTES) -> DataFrame:
    """The written table of rows and of each partition's different texts.

    ``doc_id, entry, first, text_sha256`` for every row; the first row of an entry has also ``size``,
    ``hash``, ``data`` (the text), ``least`` and ``copies``. ``first`` marks the entry's row with the
    smallest id.
    """
    shape = "doc_id long, entry long, first boolean, text_sha256 string, size long, hash long, data binary, least long, copies long"
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    arrow = pa.schema(list(zip([c.split()[0] for c in shape.split(", ")], kinds)))

    def flush(trie: Trie, ids: list) -> Iterator[pa.RecordBatch]:
        # A member is the row's place in ids.
        out: list[list] = [[] for _ in kinds]
        pending = 0
        for key, node in trie.walk(trie.root):
            sha = hashlib.sha256(key)
            entry = int.from_bytes(os.urandom(8), "little", signed=True)
            content = int.from_bytes(sha.digest()[:8], "little", signed=True)
            first = next(m for m in node.members if ids[m] == node.least)
            for k, m in enumerate(node.members):
                extra = [len(key), content, key, node.least, node.count] if k == 0 else [None] * 5
                for column, x in zip(out, [ids[m], entry, m == first, sha.hexdigest(), *extra]):
                    column.append(x)
            pending += len(key)
            if pending > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], schema=arrow)
                out, pending = [[] for _ in kinds], 0
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, ids = Trie(budget), []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                trie.insert(squeezed(text.as_py().encode()), doc_id, 1, [len(ids)])
                ids.append(doc_id)
                if trie.size > budget:
                    yield from flush(trie, ids)
                    trie, ids = Trie(budget), []
        yield from flush(trie, ids)

    return written(batched(texts(docs)).mapInArrow(run, shape), "exact-rows")


def owners(rows: DataFrame, budget: int = OWNER_BYTES) -> DataFrame:
    """``entry, keep_id, group_size, owner`` of :func:`combined`'s entries; one entry of a group is the owner."""
    spark = rows.sparkSession
    folder = scratch(spark, "exact-spill")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shape = pa.schema([("entry", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("owner", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, least = Trie(budget, folder), {}
        for batch in batches:
            for entry, key, low, copies in zip(*(c.to_pylist() for c in batch.columns)):
                least[entry] = low
                trie.insert(key, low, copies, [entry])
        out: list[list] = [[], [], [], []]
        for node in trie.groups():
            owner = min((e for e in node.members if least[e] == node.least))
            for e in node.members:
                for column, x in zip(out, (e, node.least, node.count, e == owner)):
                    column.append(x)
            if len(out[0]) >= 50_000:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, out[:1])) + [pa.array(out[1], pa.int64()), *map(pa.array, out[2:])], schema=shape)
                out = [[], [], [], []]
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1], pa.int64()), *map(pa.array, out[2:])], schema=shape)

    dealt = rows.where("data is not null").select("entry", "data", "least", "copies", "size", "hash").repartition(n, "size", "hash")
    return dealt.select("entry", "data", "least", "copies").mapInArrow(run, "entry long, keep_id long, group_size long, owner boolean")


def exact_duplicates(docs: DataFrame, combine_bytes: int = COMBINE_BYTES, owner_bytes: int = OWNER_BYTES) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    rows = combined(docs, combine_bytes)
    return (
        rows.select("doc_id", "entry", "first", "text_sha256")
        .join(owners(rows, owner_bytes), "entry")
        .select("doc_id", "keep_id", "group_size", (F.col("first") & F.col("owner")).alias("kept"), "text_sha256")
    )
