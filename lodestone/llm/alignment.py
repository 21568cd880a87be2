"""Cross-tokenizer alignment by interval coalescing.

Both vocabularies cut the bytes of space+text into tokens. All tokens of both sides are sorted by
start, the running maximum of their ends is taken, and a group breaks where a start reaches it: there
both sides end. Within a group the overlapping pairs are expanded; those that end together are links.

No token of either side goes on from a character into a space after it (the files are checked: A's words
begin with their space, no piece of B has a space inside), so a text falls into pieces that begin with
a space and are encoded by themselves. A block of documents encodes and aligns each of its different
pieces once. A block's different id pairs are dealt to targets by the B id, where their corpus counts and the highest count of each B id
are summed, and the counts come back to the block as one packed row for each target: what is shuffled
follows the different pairs of a block, not the tokens.

A null or empty text, and one whose joined tokens of either side differ from space+text (it holds
U+2581, say), has no tokens: zeros and the empty string. Repeated rows each give their own row and
count each; a null doc_id stays null; an empty table gives an empty result; columns other than doc_id
and text are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import batched, n_targets, narrow, pack, texts, unpack, written

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
BLOCK_CHARS = 8 << 20
#: Pieces that are encoded at a time.
_BATCH = 20_000
#: A space between a character and a later one: the next piece begins there.
_CUT = re.compile(r"(?<=\S) (?=\s*\S)")
_SPACE = "▁"
_BLOCKS = pa.schema([("block", pa.int64()), ("target", pa.int32()), ("data", pa.binary())])


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(A_FILE), public_tokenizers.path(B_FILE)


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in set(plain))
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Coder:
    """Both tokenizers and their tables of token bytes."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        back = byte_of()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(back[c] for c in token) if set(token) <= back.keys() else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(_SPACE in p.lstrip(_SPACE) for p in pieces):
            raise ValueError(f"{path_b}: a piece goes on after a space, so texts can't be cut at spaces")
        rules = json.loads(self.a.to_str())
        if rules["normalizer"] or (rules["pre_tokenizer"] or {}).get("type") != "ByteLevel" or not rules["pre_tokenizer"]["use_regex"] or rules["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path_a}: not plain byte-level words, so texts can't be cut at spaces")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.size_a = np.fromiter(map(len, self.bytes_a), np.int64, len(self.bytes_a))
        self.size_b = np.fromiter(map(len, self.bytes_b), np.int64, len(self.bytes_b))

    def encode(self, rests: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides for each piece, given without its leading space; none on either side if the bytes differ."""
        ids_a: list[list[int]] = []
        ids_b: list[list[int]] = []
        for at in range(0, len(rests), _BATCH):
            some = rests[at : at + _BATCH]
            ids_a += [e.ids for e in self.a.encode_batch_fast([f" {r}" for r in some], add_special_tokens=False)]
            ids_b += self.b.encode(some, num_threads=1)
        of_a, of_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        for k, rest in enumerate(rests):
            whole = b" " + rest.encode()
            if b"".join(map(of_a, ids_a[k])) != whole or b"".join(map(of_b, ids_b[k])) != whole:
                ids_a[k], ids_b[k] = [], []
        return ids_a, ids_b


@functools.lru_cache(1)
def coder(path_a: str, path_b: str) -> Coder:
    return Coder(path_a, path_b)


def coalesced(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each A token and of each B token, in order of place.

    Tokens of a side are in order and do not overlap.
    """
    start, end = np.concatenate((start_a, start_b)), np.concatenate((end_a, end_b))
    side = np.repeat((0, 1), (len(start_a), len(start_b)))
    order = np.lexsort((side, start))
    reached = np.maximum.accumulate(end[order]) if len(order) else end
    group = np.zeros(len(order), np.int64)
    group[1:] = np.cumsum(start[order][1:] >= reached[:-1])
    out = np.empty(len(order), np.int64)
    out[order] = group
    return out[: len(start_a)], out[len(start_a) :]


def overlaps(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of all overlapping (A token, B token) pairs; tokens of a side are in order and do not overlap."""
    low = np.searchsorted(end_b, start_a, "right")
    count = np.searchsorted(start_b, end_a, "left") - low
    i = np.repeat(np.arange(len(start_a)), count)
    within = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
    return i, np.repeat(low, count) + within


def spans(ids: list[list[int]], sizes: np.ndarray, bases: np.ndarray) -> tuple[np.ndarray, ...]:
    """``piece, id, start, end`` of all tokens; a piece's bytes begin at its base."""
    n = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum()))
    piece = np.repeat(np.arange(len(ids)), n)
    ends = np.cumsum(sizes[flat])
    before = np.concatenate(([0], ends))[np.cumsum(n) - n]
    end = ends - np.repeat(before, n) + bases[piece]
    return piece, flat, end - sizes[flat], end


def fresh(group: np.ndarray) -> np.ndarray:
    """1 where another group begins."""
    out = np.ones(len(group), np.uint8)
    out[1:] = group[1:] != group[:-1]
    return out


class Block:
    """Documents as numbers of pieces, and the different pieces."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.ids: list[int | None] = []
        self.codes: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, text: str) -> None:
        rests = _CUT.split(text) if text else []
        number = self.number
        self.codes.append(np.fromiter((number.setdefault(r, len(number)) for r in rests), np.int64, len(rests)))
        self.ids.append(doc_id)
        self.size += len(text)

    def rows(self, code: Coder, targets: int) -> pa.RecordBatch:
        """The block's packed documents and pieces (no target), and for each target its id pairs with their counts."""
        pieces = list(self.number)
        # Numbers in order of use pack well.
        by_use = np.argsort(-np.bincount(np.concatenate([np.zeros(0, np.int64), *self.codes]), minlength=len(pieces)), kind="stable")
        rank = np.empty(len(pieces), np.int64)
        rank[by_use] = np.arange(len(pieces))
        pieces = [pieces[i] for i in by_use.tolist()]
        ids_a, ids_b = code.encode(pieces)
        ok = np.fromiter(map(bool, ids_a), bool, len(pieces))
        codes = [c if ok[c].all() else c[:0] for c in (rank[c] for c in self.codes)]
        counts = np.fromiter(map(len, codes), np.int64, len(codes))
        flat = np.concatenate([np.zeros(0, np.int64), *codes])
        size = np.fromiter((len(p.encode()) + 1 for p in pieces), np.int64, len(pieces))
        bases = np.cumsum(size) - size
        piece_a, a, start_a, end_a = spans(ids_a, code.size_a, bases)
        piece_b, b, start_b, end_b = spans(ids_b, code.size_b, bases)
        group_a, group_b = coalesced(start_a, end_a, start_b, end_b)
        i, j = overlaps(start_a, end_a, start_b, end_b)
        together = end_a[i] == end_b[j]
        n_over = np.bincount(piece_a[i], minlength=len(pieces))
        i, j = i[together], j[together]
        pairs, pair = np.unique((a[i] << 32) | b[j], return_inverse=True)
        linked = piece_a[i]
        used = np.bincount(flat, minlength=len(pieces))
        weight = np.bincount(pair, used[linked], len(pairs)).astype(np.int64)
        target = (pairs & 0xFFFFFFFF) % targets
        order = np.argsort(target, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        null = np.array([x is None for x in self.ids], np.uint8)
        per = lambda x: narrow(np.bincount(x, minlength=len(pieces)))
        head = pack(
            np.array([x or 0 for x in self.ids], np.int64), null, narrow(counts), narrow(flat),
            per(piece_a), per(piece_b), per(linked), narrow(n_over), narrow(a), narrow(b), fresh(group_a), fresh(group_b), narrow(place[pair]),
        )
        block = int.from_bytes(os.urandom(8), "little", signed=True)
        out = [(block, None, head)]
        cuts = np.searchsorted(target[order], np.arange(targets + 1))
        for t in np.flatnonzero(np.diff(cuts)).tolist():
            own = order[cuts[t] : cuts[t + 1]]
            out.append((block, t, pack(pairs[own], narrow(weight[own]))))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _BLOCKS)], schema=_BLOCKS)


class Aligned:
    """A block's packed row, unpacked."""

    def __init__(self, data: bytes) -> None:
        self.ids, null, counts, codes, *rest = unpack(data)
        self.n_a, self.n_b, self.n_links, self.n_over, self.a, self.b, self.fresh_a, self.fresh_b, self.pair = (x.astype(np.int64) for x in rest)
        self.null, self.counts, self.codes = null.astype(bool), counts.astype(np.int64), codes.astype(np.int64)
        self.ends = np.cumsum(self.counts)
        # Groups never cross pieces, so a piece's groups are those of its A tokens.
        self.n_groups = self.by_piece(self.fresh_a, np.cumsum(self.n_a) - self.n_a, self.n_a)

    @staticmethod
    def by_piece(x: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Sums of a token's or link's numbers over each piece."""
        upto = np.concatenate(([0], np.cumsum(x, dtype=np.int64)))
        return upto[at + n] - upto[at]

    def by_document(self, per_piece: np.ndarray) -> np.ndarray:
        upto = np.concatenate(([0], np.cumsum(per_piece[self.codes], dtype=np.int64)))
        return upto[self.ends] - upto[self.ends - self.counts]

    def cuts(self) -> Iterator[tuple[int, int, int, int]]:
        """Where the A tokens and the B tokens of all pieces' groups begin and end, in order."""
        cut_a = np.append(np.flatnonzero(self.fresh_a), len(self.a)).tolist()
        cut_b = np.append(np.flatnonzero(self.fresh_b), len(self.b)).tolist()
        return zip(cut_a, cut_a[1:], cut_b, cut_b[1:])

    def said(self) -> list[bytes]:
        """Each piece's groups as text: ``a1,a2|b1;a3|b2``."""
        a, b = list(map(str, self.a.tolist())), list(map(str, self.b.tolist()))
        one = [f"{a[i]}|{b[k]}" if j - i == m - k == 1 else f"{','.join(a[i:j])}|{','.join(b[k:m])}" for i, j, k, m in self.cuts()]
        at = self.first_groups()
        return [";".join(one[i:j]).encode() for i, j in zip(at, at[1:])]

    def first_groups(self) -> list[int]:
        """Where each piece's groups begin among all, and where the last ends."""
        return np.concatenate(([0], np.cumsum(self.n_groups))).tolist()

    def codes_of(self, k: int) -> np.ndarray:
        return self.codes[self.ends[k] - self.counts[k] : self.ends[k]]


def align(docs: DataFrame, paths: tuple[str, str] | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The written table of aligned blocks: ``block, target, data``.

    Rows without a target hold documents and pieces, the others id pairs and their counts in the block.
    """
    path_a, path_b = paths or default_paths()
    targets = n_targets(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, block = coder(path_a, path_b), Block()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                block.add(doc_id, text.as_py())
                if block.size >= block_chars:
                    yield block.rows(code, targets)
                    block = Block()
        if block.ids:
            yield block.rows(code, targets)

    return written(batched(texts(docs)).mapInArrow(run, "block long, target int, data binary"), "aligned")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``block, target, data``: for each block's share of pairs, the packed corpus counts and whether they are the B id's highest."""

    def run(group: pa.Table) -> pa.Table:
        shares = [unpack(x) for x in group.column("data").to_pylist()]
        pairs, place = np.unique(np.concatenate([s[0] for s in shares]), return_inverse=True)
        total = np.zeros(len(pairs), np.int64)
        np.add.at(total, place, np.concatenate([s[1].astype(np.int64) for s in shares]))
        _, b = np.unique(pairs & 0xFFFFFFFF, return_inverse=True)
        most = np.zeros(int(b.max()) + 1, np.int64)
        np.maximum.at(most, b, total)
        best = total == most[b]
        cuts = np.cumsum([len(s[0]) for s in shares])[:-1]
        out = [pack(narrow(total[p]), best[p].astype(np.uint8)) for p in np.split(place, cuts)]
        return pa.Table.from_arrays([group.column("block"), group.column("target"), pa.array(out, pa.binary())], schema=_BLOCKS)

    return blocks.where("target is not null").groupBy("target").applyInArrow(run, "block long, target int, data binary")


def link_table(blocks: DataFrame) -> DataFrame:
    """``a int, b int, n long``: how many links of all documents hold each id pair linked."""
    shape = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                pairs, n = unpack(data)
                yield pa.RecordBatch.from_arrays([pa.array((pairs >> 32).astype(np.int32)), pa.array((pairs & 0xFFFFFFFF).astype(np.int32)), pa.array(n.astype(np.int64))], schema=shape)

    parts = blocks.where("target is not null").select("data").mapInArrow(run, "a int, b int, n long")
    return parts.groupBy("a", "b").agg(F.sum("n").alias("n")).where("n > 0")


def groups(blocks: DataFrame) -> DataFrame:
    """``doc_id, groups``: each document's groups in order, with the A ids and the B ids of each."""
    side = pa.list_(pa.int32())
    shape = pa.schema([("doc_id", pa.int64()), ("groups", pa.list_(pa.struct([("a", side), ("b", side)])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                x = Aligned(data)
                every, at = list(x.cuts()), x.first_groups()
                for k, doc_id in enumerate(x.ids.tolist()):
                    own = [{"a": x.a[i:j].tolist(), "b": x.b[m:n].tolist()} for p in x.codes_of(k) for i, j, m, n in every[at[p] : at[p + 1]]]
                    yield pa.RecordBatch.from_pylist([{"doc_id": None if x.null[k] else doc_id, "groups": own}], schema=shape)

    return blocks.where("target is null").select("data").mapInArrow(run, "doc_id long, groups array<struct<a: array<int>, b: array<int>>>")


def digests(blocks: DataFrame) -> DataFrame:
    """A row for each document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_overlaps``."""
    numbers = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    shape = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in numbers), ("groups_sha256", pa.string()), ("n_overlaps", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        rows = group.select(["target", "data"]).to_pylist()
        x = Aligned(next(r["data"] for r in rows if r["target"] is None))
        shares = [unpack(r["data"]) for r in sorted((r for r in rows if r["target"] is not None), key=lambda r: r["target"])]
        empty = np.zeros(0, np.int64)
        count, best = (np.concatenate([empty, *(s[k] for s in shares)]).astype(np.int64) for k in (0, 1))
        at = np.cumsum(x.n_links) - x.n_links
        per = [x.n_a, x.n_b, x.n_groups, x.n_links, x.by_piece(best[x.pair], at, x.n_links), x.by_piece(count[x.pair], at, x.n_links)]
        said = x.said()
        shas = []
        for k, n in enumerate(x.counts.tolist()):
            shas.append(hashlib.sha256(b";".join(map(said.__getitem__, x.codes_of(k).tolist()))).hexdigest() if n else "")
        out = [pa.array(x.ids, mask=x.null), *(pa.array(x.by_document(p)) for p in per), pa.array(shas), pa.array(x.by_document(x.n_over))]
        return pa.Table.from_arrays(out, schema=shape)

    heads = blocks.where("target is null").select("block", "target", "data")
    return heads.unionByName(pair_counts(blocks)).groupBy("block").applyInArrow(run, ", ".join(f"{f.name} {'string' if f.name == 'groups_sha256' else 'long'}" for f in shape))
