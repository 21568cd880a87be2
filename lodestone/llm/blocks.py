"""Documents in blocks with a local dictionary, and the exchange of distinct words.

A block holds some megabytes of whole documents. Its tokens are numbers into the block's own list
of distinct words, so a word crosses the network once for each block and not once for each
occurrence; a word that makes a third of all tokens costs as much as any other. The words are dealt
to targets by their crc32, each block's share as one packed row.

Rows of a blocks table: ``block`` (random 64-bit id, fixed once the table is written), and either
``head`` (where the packed document ids, token counts and token numbers are: a file of the task's in
the shared folder, so they are stored once and cross no shuffle) or ``target`` and ``part`` (the
words for that target). Numbers follow the words' frequency in the block, so they pack well.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.common import batched, narrow, pack, pack_words, place, scratch, unpack, written

SCHEMA = "block long, target int, head string, part binary"
_ARROW = pa.schema([("block", pa.int64()), ("target", pa.int32()), ("head", pa.string()), ("part", pa.binary())])
BLOCK_CHARS = 12 << 20


def read_head(ref: str) -> list[np.ndarray]:
    """``ids, null, counts, codes`` of a block; codes number the words in the order of targets' parts."""
    uri, at, size = ref.rsplit("|", 2)
    system, path = place(uri)
    with system.open_input_file(path) as f:
        f.seek(int(at))
        ids, null, counts, codes, target = unpack(f.read(int(size)))
    order = np.argsort(target, kind="stable")
    number = np.empty(len(order), np.int32)
    number[order] = np.arange(len(order), dtype=np.int32)
    return [ids, null, counts, number[codes]]


class Block:
    """One block while it fills: documents' ids, flags and token numbers, and the dictionary."""

    def __init__(self) -> None:
        self.number: dict[bytes | str, int] = {}
        self.ids: list[int | None] = []
        self.counts: list[int] = []
        self.codes: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, tokens: list) -> None:
        number = self.number
        for w in set(tokens).difference(number):
            number[w] = len(number)
        self.ids.append(doc_id)
        self.counts.append(len(tokens))
        self.codes.append(np.fromiter(map(number.__getitem__, tokens), np.int32, len(tokens)))

    def rows(self, targets: int, weigh: Callable | None, store: Callable[[bytes], str]) -> pa.RecordBatch:
        words = [w if isinstance(w, bytes) else w.encode() for w in self.number]
        codes = np.concatenate(self.codes) if self.codes else np.zeros(0, np.int32)
        by_use = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), np.int32)
        rank[by_use] = np.arange(len(words), dtype=np.int32)
        codes = rank[codes]
        target = np.fromiter((zlib.crc32(words[i]) % targets for i in by_use), np.int64, len(words))
        order = np.argsort(target, kind="stable")
        counts = np.array(self.counts, np.int64)
        null = np.array([i is None for i in self.ids], np.uint8)
        ids = np.array([i or 0 for i in self.ids], np.int64)
        weight = weigh(ids, null, counts, codes, len(words))[order] if weigh else None
        block = int.from_bytes(os.urandom(8), "little", signed=True)
        head = store(pack(ids, null, narrow(counts), narrow(codes), narrow(target)))
        out = {"block": [block], "target": [None], "head": [head], "part": [None]}
        ends = np.searchsorted(target[order], np.arange(targets + 1))
        for t in np.flatnonzero(np.diff(ends)):
            a, b = ends[t], ends[t + 1]
            extra = [narrow(weight[a:b])] if weigh else []
            out["block"].append(block)
            out["target"].append(int(t))
            out["head"].append(None)
            out["part"].append(pack(*pack_words([words[i] for i in by_use[order[a:b]]]), *extra))
        return pa.RecordBatch.from_pydict(out, schema=_ARROW)


def make_blocks(docs: DataFrame, tokens: Callable[[], Callable[[str], list]], targets: int, name: str, weigh: Callable | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The written blocks table of ``docs`` (doc_id, text).

    ``tokens()`` gives, on the executor, the function from a text to its tokens. ``weigh(ids, null,
    counts, codes, n_words)`` may give a number for each word, sent along with it. A block ends with
    the document that brings it to ``block_chars`` characters.
    """
    folder = scratch(docs.sparkSession, f"{name}-heads")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, root = place(folder)
        system.create_dir(root, recursive=True)
        file = f"{task.partitionId()}-{task.taskAttemptId()}"
        split, block = tokens(), Block()
        with system.open_output_stream(f"{root}/{file}") as out:

            def store(data: bytes) -> str:
                at = out.tell()
                out.write(data)
                return f"{folder}/{file}|{at}|{len(data)}"

            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    text = text.as_py()
                    block.add(doc_id, split(text))
                    block.size += len(text)
                    if block.size >= block_chars:
                        yield block.rows(targets, weigh, store)
                        block = Block()
            if block.ids:
                yield block.rows(targets, weigh, store)

    return written(batched(docs.select("doc_id", "text")).mapInArrow(run, SCHEMA), name)
