"""Katz backoff language model: Good-Turing discounts, exactly normalised backoff weights.

Tokens are white-space-free words after lower-casing A-Z, then one end token a document; the end
token is also the history of a document's first token. With h the last words of a history, at most
``order`` - 1 of them and none before the document, and h' the same without its first word:

    P(w)      = d1(c(w)) c(w) / N,   the mass left over is P(unknown)
    P(w | h)  = dn(c(hw)) c(hw) / c(h)   if c(hw) > 0, else alpha(h) P(w | h');   P(w | h') if c(h) = 0
    alpha(h)  = (1 - sum of seen P(w | h)) / (1 - sum of P(w | h') of the same words)

so every history's probabilities sum to one over the vocabulary and one unknown word. A token is
evaluated from its own count upwards, order by order. Counts up to ``K`` are discounted by Good-Turing
with Katz's correction, for each order; where count-of-counts allow no discount in (0, 1), r - 0.5 over
r takes its place, and a history (or the unigrams) that would keep no mass for backoff gets one more in
its denominator.

The tables are kept in parts by hash. Documents stand in blocks with local dictionaries (see
``blocks``), and a block sends each target part its own distinct words as one packed row; the part adds
up the counts, numbers the words and answers each block in the order it asked. So it goes on order by
order: an n-gram is its history's id and its last word's, and its part is its history's, and by its word
too where the history is frequent, so no history fills a part. Sums of a history that stands in one part
are taken there; those of the frequent ones are added up over the parts. What is gathered grows with the
corpus: nothing is pruned, sampled or capped, and the driver sees only totals and counts of counts up to
K + 1.

A null text counts as empty (its end token alone). Without training documents every word is
unknown. Repeated rows count as they stand; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.blocks import make_blocks, read_head
from lodestone.llm.common import discard, n_targets, narrow, pack, texts, tidy, unpack, unpack_words, written

K = 5
ORDER = 3
#: The end token; no word holds a space.
END = b" "
#: Occurrences of a history beyond which its n-grams are spread over more parts.
SPREAD = 1 << 20
#: Characters of input for each part of the tables.
PART_CHARS = 32 << 20
_ROW = pa.schema([("block", pa.int64()), ("target", pa.int32()), ("data", pa.binary())])
ROW = "block long, target int, data binary"


def split() -> object:
    """The function from a text to its tokens."""

    def tokens(text: str) -> list[bytes]:
        words = text.encode().lower().split()
        words.append(END)
        return words

    return tokens


def held_out(ids: np.ndarray, null: np.ndarray, mod: int) -> np.ndarray:
    """Whether crc32 of the id as text is 0 modulo ``mod``; a null id is the empty text."""
    import zlib

    return np.array([zlib.crc32(b"" if n else str(i).encode()) % mod == 0 for i, n in zip(ids.tolist(), null.tolist())], bool)


def discounts(counts: list[int], k: int = K) -> np.ndarray:
    """d[r] for r = 0..k from the counts of counts n[1..k+1] (``counts[0]`` is unused)."""
    d = np.ones(k + 1)
    n = [float(c) for c in counts]
    common = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    for r in range(1, k + 1):
        star = (r + 1) * n[r + 1] / (r * n[r]) if n[r] else 1.0
        x = (star - common) / (1 - common) if common < 1 else 1.0
        d[r] = x if 0 < x < 1 else (r - 0.5) / r
    return d


@dataclass
class Totals:
    """What the driver knows of the model; ``d[n]`` are the discounts of order n."""

    tokens: int
    types: int
    unigram_denominator: float
    unknown: float
    d: dict[int, np.ndarray]

    def discounted(self, n: int, c: np.ndarray) -> np.ndarray:
        """Counts of order ``n`` after the discount."""
        return np.append(self.d[n], 1.0)[np.minimum(c, K + 1).astype(np.int64)] * c

    def p1(self, c: np.ndarray) -> np.ndarray:
        """P(w) by its training count; 0 is the unknown word."""
        return np.where(c > 0, self.discounted(1, c) / self.unigram_denominator, self.unknown)


def _answers(group: pa.Table, data: list[bytes]) -> pa.Table:
    return pa.Table.from_arrays([group.column("block").combine_chunks(), group.column("target").combine_chunks().cast(pa.int32()), pa.array(data, pa.binary())], schema=_ROW)


def count_words(parts: DataFrame) -> DataFrame:
    """For each block's share: packed (number of the word in the part, its count); row ``block`` null
    has the part's table: packed (lengths, bytes, counts) in order of numbers."""

    def run(group: pa.Table) -> pa.Table:
        number: dict[bytes, int] = {}
        shares = []
        for data in group.column("part").to_pylist():
            lengths, blob, weight = unpack(data)
            words = unpack_words(lengths, blob)
            shares.append((np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)), weight))
        total = np.zeros(len(number), np.int64)
        for at, weight in shares:
            total[at] += weight.astype(np.int64)
        out = _answers(group, [pack(narrow(at), narrow(total[at])) for at, _ in shares])
        words = list(number)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        own = [pack(narrow(lengths), np.frombuffer(b"".join(words), np.uint8), narrow(total))]
        mine = pa.Table.from_arrays([pa.array([None], pa.int64()), group.column("target").combine_chunks()[:1].cast(pa.int32()), pa.array(own, pa.binary())], schema=_ROW)
        return pa.concat_tables([out, mine])

    return parts.groupBy("target").applyInArrow(run, ROW)


def _histogram(df: DataFrame, at: int) -> list[int]:
    """Summed (types, tokens, n_1 .. n_K+1) of the part tables whose counts are the array ``at``."""
    names = ["types", "tokens", *(f"n{r}" for r in range(1, K + 2))]
    shape = pa.schema([(n, pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                c = unpack(data)[at].astype(np.int64)
                c = c[c > 0]
                n = np.bincount(np.minimum(c, K + 2), minlength=K + 3)
                yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in (len(c), c.sum(), *n[1 : K + 2])], schema=shape)

    row = df.select("data").mapInArrow(run, ", ".join(f"{n} long" for n in names)).agg(*(F.coalesce(F.sum(n), F.lit(0)) for n in names)).first()
    return list(row)


def _block(group: pa.Table, kinds: int) -> tuple[list[np.ndarray], list[list[tuple[int, bytes]]], int]:
    """A block's head, and for each kind of answer its (target, data) in order of targets."""
    head, answers = None, [[] for _ in range(kinds)]
    for kind, target, data in zip(*(group.column(c).to_pylist() for c in ("kind", "target", "data"))):
        if kind == 0:
            head = read_head(data.decode())
        else:
            answers[kind - 1].append((target, data))
    return head, [sorted(a) for a in answers], group.column("block")[0].as_py()


def _tagged(df: DataFrame, kind: int) -> DataFrame:
    target = F.col("target") if "target" in df.columns else F.lit(-1).alias("target")
    return df.select("block", F.lit(kind).alias("kind"), target, "data")


def _words(answers: list[tuple[int, bytes]], targets: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and counts of a block's words, in the block's numbering; an id is number * targets + part."""
    ids, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for target, data in answers:
        at, c = unpack(data)
        ids.append(at.astype(np.int64) * targets + target)
        counts.append(c.astype(np.int64))
    return np.concatenate(ids), np.concatenate(counts)


@dataclass
class Tokens:
    """A block's tokens: documents, local words, and each token's place in its document."""

    doc_ids: np.ndarray
    null: np.ndarray
    held: np.ndarray
    sizes: np.ndarray
    first: np.ndarray
    codes: np.ndarray
    place: np.ndarray


def _tokens(head: list[np.ndarray], mod: int) -> Tokens:
    doc_ids, null, sizes, codes = head
    sizes, codes = sizes.astype(np.int64), codes.astype(np.int64)
    first = np.cumsum(sizes) - sizes
    return Tokens(doc_ids, null.astype(bool), held_out(doc_ids, null, mod), sizes, first, codes, np.arange(len(codes)) - np.repeat(first, sizes))


@dataclass
class Grams:
    """A block's different n-grams of one order, by part, history and word; and which one each token ends (-1: none).

    ``ids`` (not of the last order), ``counts``, ``denominators`` and ``alphas`` (of those not seen) are known once the parts have answered.
    """

    at: np.ndarray
    ids: np.ndarray
    counts: np.ndarray
    denominators: np.ndarray
    alphas: np.ndarray | None = None


def _asked(t: Tokens, n: int, words: Grams, lower: Grams, targets: int, spread: int):
    """The n-grams of a block whose history was seen in training: ``at, part, history, word, weight,
    history's count, count and denominator of the n-gram without its first word``."""
    if n == 2:
        before = np.empty_like(t.codes)
        before[1:] = t.codes[:-1]
        # The end token's place in this block; every document has one.
        before[t.first] = t.codes[t.first + t.sizes - 1]
    else:
        before = np.full(len(t.codes), -1)
        before[1:] = lower.at[:-1]
        before[t.place < n - 2] = -1
    asks = np.flatnonzero(before >= 0)
    asks = asks[lower.counts[before[asks]] > 0]
    past, own = before[asks], t.codes[asks]
    part = (lower.ids % targets)[past]
    wide = np.flatnonzero((lower.counts >= spread)[past])
    if len(wide):
        h = past[wide]
        part[wide] = (part[wide] + words.ids[own[wide]] % (1 + lower.counts[h] // spread) * 40503) % targets
    # One number for each n-gram, in order of part, history's id and word's id.
    key = part * len(lower.ids) + _rank(lower.ids)[past]
    if targets * len(lower.ids) * len(words.ids) >= 1 << 63:
        key = np.unique(key, return_inverse=True)[1]
    key = key * len(words.ids) + _rank(words.ids)[own]
    order = np.argsort(key)
    key = key[order]
    new = np.flatnonzero(np.diff(key, prepend=-1))
    inverse = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(key))))
    at = np.full(len(t.codes), -1)
    at[asks[order]] = inverse
    weight = np.bincount(inverse, weights=np.repeat(~t.held, t.sizes)[asks[order]], minlength=len(new)).astype(np.int64)
    one = order[new]
    past, own, tail = past[one], own[one], lower.at[asks[one]]
    return at, part[one], lower.ids[past], words.ids[own], weight, lower.counts[past], lower.counts[tail], lower.denominators[tail]


def _rank(ids: np.ndarray) -> np.ndarray:
    """Each id's place among the ids (all different) in order."""
    rank = np.empty(len(ids), np.int64)
    rank[np.argsort(ids)] = np.arange(len(ids))
    return rank


def _packed(h: np.ndarray, w: np.ndarray, c: np.ndarray, often: np.ndarray, lower: np.ndarray, under: np.ndarray) -> bytes:
    """n-grams in order; what only depends on the history (its count, and the denominator one order lower) once for each."""
    starts = np.flatnonzero(np.diff(h, prepend=-1))
    runs = np.diff(np.append(starts, len(h)))
    return pack(narrow(np.diff(h[starts], prepend=0)), narrow(runs), narrow(w), narrow(c), narrow(often[starts]), narrow(lower), narrow(under[starts]))


def _unpacked(data: bytes) -> tuple[np.ndarray, ...]:
    """Of each n-gram: the place of its history, word, count, count without the first word; of each
    history: its id, count, and the denominator one order lower."""
    step, runs, w, c, often, lower, under = unpack(data)
    return np.repeat(np.arange(len(runs)), runs), w.astype(np.int64), c.astype(np.int64), lower.astype(np.int64), np.cumsum(step, dtype=np.int64), often.astype(np.int64), under.astype(np.int64)


def _answered(at: np.ndarray, rows: list[tuple[int, bytes]], targets: int) -> Grams:
    """The block's n-grams with what the parts know of them."""
    ids, counts, denominators, alphas = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for target, data in rows:
        step, c, d, a = unpack(data)
        ids.append(np.cumsum(step, dtype=np.int64) * targets + target)
        counts.append(c.astype(np.int64))
        denominators.append(d.astype(np.int64))
        alphas.append(a)
    c = np.concatenate(counts)
    alpha, weights = np.ones(len(c)), np.concatenate(alphas)
    if len(weights):
        alpha[c == 0] = weights
    return Grams(at, np.concatenate(ids), c, np.concatenate(denominators), alpha)


def _known(head: list[np.ndarray], answers: list[list[tuple[int, bytes]]], mod: int, targets: int, spread: int) -> tuple[Tokens, list[Grams]]:
    """A block's tokens and its words and n-grams of each order that ``answers`` has, order 1 first."""
    t = _tokens(head, mod)
    ids, counts = _words(answers[0], targets)
    levels = [Grams(t.codes, ids, counts, np.zeros(len(ids), np.int64))]
    for n, rows in enumerate(answers[1:], 2):
        levels.append(_answered(_asked(t, n, levels[0], levels[-1], targets, spread)[0], rows, targets))
    return t, levels


_TABLE = pa.schema([("target", pa.int32()), ("data", pa.binary()), ("shares", pa.binary()), ("spread", pa.bool_()), *((f"n{r}", pa.int64()) for r in range(1, K + 2))])


def _one_key(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One number for each (h, w) in their order, whatever their sizes."""
    bits = int(w.max(initial=0)).bit_length()
    if int(h.max(initial=0)).bit_length() + bits > 63:
        h, w = np.unique(h, return_inverse=True)[1], np.unique(w, return_inverse=True)[1]
        bits = int(w.max(initial=0)).bit_length()
    return h << bits | w


def count_grams(requests: DataFrame, spread: int) -> DataFrame:
    """A row for each part: its n-grams (see :func:`_packed`), what each block asked for, whether a
    history stands in more parts, and the counts of counts."""

    def run(group: pa.Table) -> pa.Table:
        shares = [_unpacked(d) for d in group.column("data").to_pylist()]
        ends = np.cumsum([0, *(len(x[0]) for x in shares)])
        h, often, under = (np.concatenate([x[i][x[0]] for x in shares]) for i in (4, 5, 6))
        w = np.concatenate([x[1] for x in shares])
        _, one, inverse = np.unique(_one_key(h, w), return_index=True, return_inverse=True)
        c = np.bincount(inverse, weights=np.concatenate([x[2] for x in shares]), minlength=len(one)).astype(np.int64)
        data = _packed(h[one], w[one], c, often[one], np.concatenate([x[3] for x in shares])[one], under[one])
        # A block's share is in the table's order, so it goes by steps.
        steps = np.concatenate([np.diff(inverse[a:b], prepend=0) for a, b in zip(ends, ends[1:])])
        asked = pack(group.column("block").to_numpy(), narrow(np.diff(ends)), narrow(steps))
        n = np.bincount(np.minimum(c, K + 2), minlength=K + 3)
        row = [group.column("target")[0].as_py(), data, asked, bool((often >= spread).any()), *n[1 : K + 2].tolist()]
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(row, _TABLE)], schema=_TABLE)

    return requests.groupBy("target").applyInArrow(run, "target int, data binary, shares binary, spread boolean, " + ", ".join(f"n{r} long" for r in range(1, K + 2)))


def _sums(data: bytes, n: int, totals: Totals):
    """Of a part's table: each n-gram's count and its history's place; of each history its id, count,
    what the discounts cut from its n-grams, and the probability of the same words one order lower."""
    at, _, c, lower, h, often, under = _unpacked(data)
    p = totals.p1(lower) if n == 2 else totals.discounted(n - 1, lower) / np.maximum(under, 1)[at]
    add = lambda x: np.bincount(at, weights=x, minlength=len(h))
    return c, at, h, often, add(c - totals.discounted(n, c)), add(np.where(c > 0, p, 0.0))


def answers(table: DataFrame, n: int, totals: Totals, targets: int, spread: int) -> Callable[[bool, bool], DataFrame]:
    """A function (steps, weights) of what to send to each block and part, in the order asked, packed: steps of the
    numbers if wanted, counts, histories' denominators, and, if wanted, backoff weights of the n-grams not seen."""
    shape = pa.schema([("h", pa.int64()), ("target", pa.int32()), ("cut", pa.float64()), ("lower", pa.float64())])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for target, data in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                _, _, h, often, cut, lower = _sums(data, n, totals)
                wide = often >= spread
                yield pa.RecordBatch.from_arrays([pa.array(h[wide]), pa.array(np.full(int(wide.sum()), target, np.int32)), pa.array(cut[wide]), pa.array(lower[wide])], schema=shape)

    # Histories in several parts: their sums over all of them, back to each.
    some = written(table.where("spread").select("target", "data").mapInArrow(partial, "h long, target int, cut double, lower double"), "katz-spread")
    whole = some.groupBy("h").agg(F.sum("cut").alias("cut"), F.sum("lower").alias("lower"))
    back = some.select("h", "target").join(whole, "h").groupBy("target").agg(F.collect_list(F.struct("h", "cut", "lower")).alias("wide"))
    rows = table.select("target", "data", "shares").join(written(back, "katz-spread-sums"), "target", "left")

    def run(batches: Iterator[pa.RecordBatch], numbers: bool, weights: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                target, data, shares, wide = (batch.column(k)[i].as_py() for k in range(4))
                c, at, h, often, cut, lower = _sums(data, n, totals)
                for x in wide or ():
                    k = int(np.searchsorted(h, x["h"]))
                    cut[k], lower[k] = x["cut"], x["lower"]
                # No mass left for backoff: one more in the denominator.
                denominator = np.where(cut > 1e-9, often, often + 1)
                alpha = np.where(cut > 1e-9, cut, 1.0) / np.maximum(denominator, 1) / np.maximum(1 - lower, 1e-12)
                blocks, sizes, steps = unpack(shares)
                ends = np.cumsum(sizes, dtype=np.int64)
                out = []
                for a, b in zip((ends - sizes).tolist(), ends.tolist()):
                    own = np.cumsum(steps[a:b], dtype=np.int64)
                    past, seen = at[own], c[own]
                    out.append(pack(steps[a:b] if numbers else steps[:0], narrow(seen), narrow(denominator[past]), alpha[past[seen == 0]] if weights else alpha[:0]))
                yield pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(np.full(len(out), target, np.int32)), pa.array(out, pa.binary())], schema=_ROW)

    return lambda numbers, weights: rows.mapInArrow(lambda batches: run(batches, numbers, weights), ROW)


@dataclass
class Model:
    """Tables in parts, each written to the shared folder: of words, and of the n-grams of each order from 2."""

    totals: Totals
    words: DataFrame
    grams: dict[int, DataFrame]
    scores: DataFrame | None = None


def n_parts(docs: DataFrame) -> int:
    """Parts of the tables: by the characters of the input, so that a part stays the same size."""
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return max(n_targets(docs.sparkSession), size // PART_CHARS)


def fit_and_score(docs: DataFrame, mod: int = 10, order: int = ORDER, spread: int = SPREAD) -> Model:
    """Learn from documents whose crc32(doc_id as text) modulo ``mod`` is not 0; score all.

    ``scores``: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.
    """
    targets = n_parts(docs)

    def weigh(ids, null, counts, codes, n_words):
        train = ~held_out(ids, null, mod)
        return np.bincount(codes, weights=np.repeat(train, counts), minlength=n_words).astype(np.int64)

    blocks = make_blocks(texts(docs), split, targets, "katz-blocks", weigh)
    heads = written(blocks.where("head is not null").select("block", F.col("head").cast("binary").alias("data")), "katz-refs")
    counted = written(count_words(blocks.where("target is not null").select("block", "target", "part")), "katz-words")
    # Its words are in the parts' tables now, its references in ``heads``.
    discard(blocks)
    words = counted.where("block is null")
    types, tokens, *n1 = _histogram(words, 2)
    d1 = discounts([0, *n1])
    kept = tokens - float((np.arange(1, K + 1) * np.array(n1[:K]) * (1 - d1[1:])).sum())
    denominator = float(tokens) if kept < tokens and tokens else float(tokens + 1)
    totals = Totals(tokens, types, denominator, max(1 - kept / denominator, 0.0) if tokens else 1.0, {1: d1})

    # What blocks need to ask for the next order, and to score.
    asking = known = _tagged(heads, 0).unionByName(_tagged(counted.where("block is not null"), 1))
    tables = {}
    for n in range(2, order + 1):

        def ask(group: pa.Table) -> pa.Table:
            head, found, block = _block(group, n - 1)
            t, levels = _known(head, found, mod, targets, spread)
            _, part, h, *rest = _asked(t, n, levels[0], levels[-1], targets, spread)
            ends = np.searchsorted(part, np.arange(targets + 1))
            used = np.flatnonzero(np.diff(ends))
            rows = [_packed(h[a:b], *(x[a:b] for x in rest)) for a, b in zip(ends[used], ends[used + 1])]
            return pa.Table.from_arrays([pa.array([block] * len(used), pa.int64()), pa.array(used, pa.int32()), pa.array(rows, pa.binary())], schema=_ROW)

        table = written(count_grams(asking.groupBy("block").applyInArrow(ask, ROW), spread), f"katz-grams-{n}")
        tables[n] = table
        of = table.agg(*(F.coalesce(F.sum(f"n{r}"), F.lit(0)) for r in range(1, K + 2))).first()
        totals.d[n] = discounts([0, *of])
        answered = answers(table, n, totals, targets, spread)
        known = known.unionByName(_tagged(answered(n < order, True), n))
        asking = asking.unionByName(_tagged(answered(True, False), n))
        tidy(docs.sparkSession)

    shape = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def score(group: pa.Table) -> pa.Table:
        head, found, _ = _block(group, order)
        t, (own, *levels) = _known(head, found, mod, targets, spread)
        c1 = own.counts[t.codes]
        p = totals.p1(c1)
        for n, level in enumerate(levels, 2):
            asked = np.flatnonzero(level.at >= 0)
            at = level.at[asked]
            c = level.counts[at]
            p[asked] = np.where(c > 0, totals.discounted(n, c) / np.maximum(level.denominators[at], 1), level.alphas[at] * p[asked])
        base = np.log10((c1 + 0.1) / (totals.tokens + 0.1 * (totals.types + 1)))
        add = lambda x: np.add.reduceat(x, t.first) if len(t.first) else np.zeros(0)
        n_known = add((c1 > 0).astype(np.int64)).astype(np.int64)
        return pa.Table.from_arrays([pa.array(t.doc_ids, mask=t.null), pa.array(t.held), pa.array(t.sizes), pa.array(n_known), pa.array(np.full(len(t.sizes), totals.tokens)), pa.array(add(base)), pa.array(add(np.log10(p)))], schema=shape)

    scores = known.groupBy("block").applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return Model(totals, words, tables, scores)
