"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Texts are split into pre-tokens with their positions, each distinct pre-token of the corpus is
encoded once, the ids are joined back and put together by position; decoding joins the table of
token bytes. Positions travel as numbers into a block's dictionary (see ``blocks``), so what is
shuffled is each block's distinct words and their ids, never the occurrences.

Null texts count as empty: no tokens, and the digests of the empty string. Repeated rows each give
their own row; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.blocks import make_blocks, read_head
from lodestone.llm.common import gather, n_targets, narrow, pack, texts, unpack, unpack_words, written

VOCABULARY = "byte_bpe_50k.tiktoken"
BACK = "block long, target int, ids binary"
_BACK = pa.schema([("block", pa.int64()), ("target", pa.int32()), ("ids", pa.binary())])


def default_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def token_bytes(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table, its key being the position: (start, length, bytes) for each id."""
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        table[i] = token
    lengths = np.array([len(t) for t in table], np.int64)
    return np.cumsum(lengths) - lengths, lengths, np.frombuffer(b"".join(table), np.uint8)


@functools.lru_cache(2)
def _encoder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


def encoded_words(parts: DataFrame, path: str, pattern: str) -> DataFrame:
    """Each target's distinct words encoded once; a packed row of ids for each block's share."""

    def run(group: pa.Table) -> pa.Table:
        shares = [unpack_words(*unpack(p)) for p in group.column("part").to_pylist()]
        number: dict[bytes, int] = {}
        for share in shares:
            for w in share:
                number.setdefault(w, len(number))
        ids = _encoder(path, pattern).encode_ordinary_batch([w.decode() for w in number], num_threads=1)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(lengths.sum()))
        starts = np.cumsum(lengths) - lengths
        out = []
        for share in shares:
            at = np.fromiter(map(number.__getitem__, share), np.int64, len(share))
            out.append(pack(narrow(lengths[at]), narrow(gather(starts[at], lengths[at], flat))))
        return pa.Table.from_pydict({"block": group.column("block"), "target": group.column("target"), "ids": out}, schema=_BACK)

    return parts.groupBy("target").applyInArrow(run, BACK)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``block, ids, n_docs...``: packed rows of whole documents' ids; :func:`documents` unfolds them.

    A row is ``block long, doc binary``, the packed (doc ids, null flags, token counts, token ids).
    """
    path, pattern = path or default_path(), pattern or default_pattern()
    spark = docs.sparkSession

    def split():
        import regex

        return regex.compile(pattern).findall

    blocks = make_blocks(texts(docs), split, n_targets(spark), "bpe-blocks")
    back = encoded_words(blocks.where("target is not null").select("block", "target", "part"), path, pattern)
    both = blocks.where("head is not null").select("block", "head", F.lit(None).cast("int").alias("target"), F.lit(None).cast("binary").alias("ids")).unionByName(
        back.select("block", F.lit(None).cast("string").alias("head"), "target", "ids")
    )
    shape = pa.schema([("block", pa.int64()), ("doc", pa.binary())])

    def run(group: pa.Table) -> pa.Table:
        rows = group.select(["head", "target", "ids"]).to_pylist()
        ids, null, counts, codes = read_head(next(r["head"] for r in rows if r["head"] is not None))
        shares = [unpack(r["ids"]) for r in sorted((r for r in rows if r["ids"] is not None), key=lambda r: r["target"])]
        empty = np.zeros(0, np.int64)
        lengths = np.concatenate([empty, *(s[0] for s in shares)]).astype(np.int64)
        flat = np.concatenate([np.zeros(0, np.uint32), *(s[1] for s in shares)]).astype(np.uint32)
        starts = np.cumsum(lengths) - lengths
        per_word = lengths[codes]
        before = np.concatenate(([0], np.cumsum(per_word)))
        ends = np.cumsum(counts.astype(np.int64))
        tokens = before[ends] - before[ends - counts]
        out = [pack(ids, null, narrow(tokens), narrow(gather(starts[codes], per_word, flat)))]
        return pa.Table.from_pydict({"block": [rows and group.column("block")[0].as_py()], "doc": out}, schema=shape)

    return both.groupBy("block").applyInArrow(run, "block long, doc binary")


def documents(encoded: DataFrame) -> DataFrame:
    """``doc_id long, ids array<int>`` of :func:`encode`'s rows."""
    shape = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                ids, null, counts, flat = unpack(data)
                ends = np.concatenate(([0], np.cumsum(counts.astype(np.int64))))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=null.astype(bool)), lists], schema=shape)

    return encoded.select("doc").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id long, data binary``: the bytes of :func:`documents`' ids, by a join with the token-byte table."""
    path = path or default_path()
    shape = pa.schema([("doc_id", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, lengths, data = token_bytes(read_ranks(path))
        for batch in batches:
            out = []
            for ids in batch.column(1):
                at = np.asarray(ids.values if ids.is_valid else [], np.int64)
                out.append(gather(starts[at], lengths[at], data).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], schema=shape)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def digests(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of :func:`encode`'s rows; decodes the ids a document at a time."""
    path = path or default_path()
    shape = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, lengths, data = token_bytes(read_ranks(path))
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                ids, null, counts, flat = unpack(packed)
                counts, flat = counts.astype(np.int64), flat.astype("<u4")
                out: list[list] = [[], []]
                for end, n in zip(np.cumsum(counts).tolist(), counts.tolist()):
                    own = flat[end - n : end]
                    at = own.astype(np.int64)
                    out[0].append(hashlib.sha256(own.tobytes()).hexdigest())
                    out[1].append(hashlib.sha256(gather(starts[at], lengths[at], data).tobytes()).hexdigest())
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=null.astype(bool)), pa.array(counts), *map(pa.array, out)], schema=shape)

    return encoded.select("doc").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_once(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """:func:`encode`, written, for callers that read the ids more than once."""
    return written(encode(docs, path, pattern), "bpe-ids")
