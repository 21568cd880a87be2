"""Toxic documents by a bidirectional gated recurrent network with attention pooling.

A document is read in overlapping windows of ``WINDOW`` words, ``STRIDE`` apart, all of it. A word
enters as its own (hashed) embedding beside the mean embedding of its character trigrams, so unseen
forms of a known stem are recognised. Forward and backward gated units run over a window, attention
pools their states, a logistic layer scores the window, and a document's score is its highest.

Trained in numpy on the driver from document labels: each step scores all windows of some documents
and learns on the highest of each. The sample is bounded (``MAX_DOCS``, half of them toxic at most,
none longer than ``MAX_CHARS``); scoring has no bounds. Embeddings start from how much oftener a word
or trigram occurs in the sample's toxic documents. Texts are the only input of a score.

A null or empty text is one window without words. Without labels, or with one class, the score is
the share of label 1 in the sample (0 if there is none). Repeated rows are scored alike; a null
doc_id keeps its row and is never learned from. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import batched, crc_split, texts

WINDOW = 32
STRIDE = 24
MAX_DOCS = 3_000
MAX_CHARS = 20_000
WORDS = 1 << 15
TRIGRAMS = 1 << 14
EMBED = 8
HIDDEN = 12
GATE = 12
#: Gradient steps, whatever the number of rows.
STEPS = 500
SEED = 23
_TRIM = ".,;:!?\"'()[]*#%&$|"


class Bag:
    """Texts as numbers into their distinct words, and the words' table rows."""

    def __init__(self, column: pa.Array) -> None:
        split = pc.ascii_split_whitespace(pc.utf8_lower(column))
        coded = pc.utf8_trim(split.flatten(), _TRIM).dictionary_encode()
        self.codes = coded.indices.to_numpy().astype(np.int32)
        self.sizes = split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        words = coded.dictionary.cast(pa.binary()).to_pylist()
        n = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"\x01" + b"".join(w + b"\x01" for w in words) + b"\x01\x01", np.uint8).astype(np.int64)
        tri = (data[:-2] * 961 + data[1:-1] * 31 * 7919 + data[2:] * 104729) % 2147483647
        # A word of n bytes has the n trigrams from the mark before it on; the last ends with the mark after it.
        at = np.cumsum(n + 1) - n - 1
        self.tri_sizes = n
        self.tri = (tri[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())] % TRIGRAMS).astype(np.int32)
        weight = np.add.reduceat(np.append(tri[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())] * (1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)), 0), np.minimum(np.cumsum(n) - n, n.sum())) if len(n) else n
        self.word = np.where(n > 0, weight % 1000003 % WORDS, 0).astype(np.int32)

    def __len__(self) -> int:
        return len(self.word)

    def windows(self, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes (windows x WINDOW, ``len(self)`` where there is no word), the number of each document's
        windows, and the first window of each."""
        starts, sizes = np.cumsum(self.sizes) - self.sizes, self.sizes
        if at is not None:
            starts, sizes = starts[at], sizes[at]
        many = 1 + -(-np.maximum(sizes - WINDOW, 0) // STRIDE)
        first = np.cumsum(many) - many
        k = np.arange(many.sum()) - np.repeat(first, many)
        place = np.repeat(starts, many)[:, None] + k[:, None] * STRIDE + np.arange(WINDOW)
        inside = place < np.repeat(starts + sizes, many)[:, None]
        codes = np.append(self.codes, np.int32(0))[np.minimum(place, len(self.codes))]
        return np.where(inside, codes, len(self)), many, first


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


class Model:
    """The network's weights (about 1.5 MB, whatever the corpus)."""

    def __init__(self, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        h = HIDDEN
        self.p = {"Ew": (0.05 * rng.standard_normal((WORDS, EMBED))).astype(np.float32), "Ec": (0.05 * rng.standard_normal((TRIGRAMS, EMBED))).astype(np.float32)}
        self.p |= {"W": init(2 * EMBED, 6 * h), "b": np.zeros(6 * h, np.float32), "U0": init(h, 3 * h), "U1": init(h, 3 * h), "A": init(2 * h, GATE), "v": init(GATE, 1), "c": init(2 * h, 1), "d": np.full(1, -1.0, np.float32)}
        self.constant: float | None = None

    def embedded(self, bag: Bag) -> np.ndarray:
        """Input rows of the bag's words, and a row of zeros."""
        x = np.zeros((len(bag) + 1, 2 * EMBED), np.float32)
        x[:-1, :EMBED] = self.p["Ew"][bag.word]
        full = bag.tri_sizes > 0
        if full.any():
            begin = (np.cumsum(bag.tri_sizes) - bag.tri_sizes)[full]
            x[:-1, EMBED:][full] = np.add.reduceat(self.p["Ec"][bag.tri], begin) / bag.tri_sizes[full][:, None]
        return x

    def _run(self, px: np.ndarray, idx: np.ndarray, mask: np.ndarray, back: int, keep: list | None) -> np.ndarray:
        """States (WINDOW, windows, HIDDEN) of one direction; ``px`` has the input parts of each word."""
        h, u = np.zeros((len(idx), HIDDEN), np.float32), self.p[f"U{back}"]
        out = np.empty((WINDOW, len(idx), HIDDEN), np.float32)
        n = HIDDEN
        for t in range(WINDOW)[:: -1 if back else 1]:
            x, m, hu = px[idx[:, t]], mask[:, t, None], h @ u
            zr = _sigmoid(x[:, : 2 * n] + hu[:, : 2 * n])
            z, r = zr[:, :n], zr[:, n:]
            new = np.tanh(x[:, 2 * n :] + r * hu[:, 2 * n :])
            if keep is not None:
                keep.append((t, h, z, r, new, hu[:, 2 * n :], m))
            h = h + m * ((1 - z) * (new - h))
            out[t] = h
        return out

    def forward(self, x: np.ndarray, idx: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows ``idx`` over input rows ``x``."""
        p, mask = self.p, (idx < len(x) - 1).astype(np.float32)
        px = x @ p["W"] + p["b"]
        traces: list[list] = [[], []]
        sides = [self._run(np.ascontiguousarray(px[:, d * 3 * HIDDEN : (d + 1) * 3 * HIDDEN]), idx, mask, d, traces[d] if keep is not None else None) for d in (0, 1)]
        s = np.concatenate(sides, axis=2)
        g = np.tanh(s @ p["A"])
        e = (g @ p["v"])[:, :, 0] + np.where(mask.T > 0, 0, -1e4).astype(np.float32)
        e = np.exp(e - e.max(0))
        a = e / e.sum(0)
        pooled = np.einsum("tb,tbh->bh", a, s)
        if keep is not None:
            keep |= {"s": s, "g": g, "a": a, "pooled": pooled, "traces": traces, "mask": mask}
        return (pooled @ p["c"] + p["d"])[:, 0]

    def gradients(self, bag: Bag, x: np.ndarray, idx: np.ndarray, y: np.ndarray, weight: np.ndarray, hidden: np.ndarray | None = None) -> dict[str, np.ndarray]:
        p, f = self.p, {}
        logit = self.forward(x, idx, f)
        ds = ((_sigmoid(logit) - y) * weight / len(y)).astype(np.float32)[:, None]
        s, g, a = f["s"], f["g"], f["a"]
        dp = ds @ p["c"].T
        da = np.einsum("bh,tbh->tb", dp, s)
        de = a * (da - (a * da).sum(0))
        dg = de[:, :, None] * p["v"][:, 0] * (1 - g * g)
        dstate = a[:, :, None] * dp[None] + dg @ p["A"].T
        out = {"c": f["pooled"].T @ ds, "d": ds.sum(0), "v": np.einsum("tbg,tb->g", g, de)[:, None], "A": np.einsum("tbh,tbg->hg", s, dg)}
        dx = np.zeros((WINDOW, len(idx), 6 * HIDDEN), np.float32)
        for d in (0, 1):
            u, du = p[f"U{d}"], np.zeros_like(p[f"U{d}"])
            later = np.zeros((len(idx), HIDDEN), np.float32)
            for t, h, z, r, new, hn, m in reversed(f["traces"][d]):
                dh = later + dstate[t, :, d * HIDDEN : (d + 1) * HIDDEN]
                dnew = m * dh
                dn = dnew * (1 - z) * (1 - new * new)
                dz = dnew * (h - new) * z * (1 - z)
                dr = dn * hn * r * (1 - r)
                dhu = np.concatenate([dz, dr, dn * r], axis=1)
                du += h.T @ dhu
                later = dh - dnew * (1 - z) + dhu @ u.T
                dx[t, :, d * 3 * HIDDEN : (d + 1) * 3 * HIDDEN] = np.concatenate([dz, dr, dn], axis=1)
            out[f"U{d}"] = du
        flat, at = dx.reshape(-1, 6 * HIDDEN), idx.T.reshape(-1)
        out["b"], out["W"] = flat.sum(0), x[at].T @ flat
        din = np.zeros_like(x)
        np.add.at(din, at, flat @ p["W"].T)
        if hidden is not None:
            din[hidden, :EMBED] = 0
        used = np.unique(at[at < len(bag)])
        ew, ec = np.zeros_like(p["Ew"]), np.zeros_like(p["Ec"])
        np.add.at(ew, bag.word[used], din[used, :EMBED])
        n = bag.tri_sizes[used]
        begin = (np.cumsum(bag.tri_sizes) - bag.tri_sizes)[used]
        rows = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        np.add.at(ec, bag.tri[rows], np.repeat(din[used, EMBED:] / np.maximum(n, 1)[:, None], n, axis=0))
        out["Ew"], out["Ec"] = ew, ec
        return out

    def score(self, column: pa.Array, at_once: int = 4096) -> np.ndarray:
        """The highest window score of each text."""
        if self.constant is not None:
            return np.full(len(column), self.constant)
        bag = Bag(column)
        x = self.embedded(bag)
        idx, _, first = bag.windows()
        logits = np.concatenate([self.forward(x, idx[lo : lo + at_once]) for lo in range(0, len(idx), at_once)])
        return _sigmoid(np.maximum.reduceat(logits, first).astype(np.float64))


def train(column: pa.Array, y: np.ndarray, steps: int = STEPS, batch: int = 48, rate: float = 4e-3, seed: int = SEED) -> Model:
    """Adam on the highest window of each document."""
    model, y = Model(seed), np.asarray(y, np.float32)
    if not len(y) or y.min() == y.max():
        model.constant = float(y.mean()) if len(y) else 0.0
        return model
    bag = Bag(column)
    # How much oftener a word or trigram is in toxic documents, each document counting once.
    doc = np.repeat(np.arange(len(y)), bag.sizes)
    pairs = np.unique(doc * (len(bag) + 1) + bag.codes)
    d, w = pairs // (len(bag) + 1), pairs % (len(bag) + 1)
    toxic, rows = y.sum(), len(y)

    def odds(hits: np.ndarray, own: np.ndarray) -> np.ndarray:
        return np.clip(np.log((hits + 0.5) / (toxic + 1)) - np.log((own - hits + 0.5) / (rows - toxic + 1)), -3, 3) * np.minimum(own / 5, 1)

    code = bag.word[w]
    model.p["Ew"][:, 0] = 0.5 * odds(np.bincount(code, weights=y[d], minlength=WORDS), np.bincount(code, minlength=WORDS))
    owner = np.repeat(np.arange(len(bag)), bag.tri_sizes)
    share = np.bincount(w, weights=y[d], minlength=len(bag))
    whole = np.bincount(w, minlength=len(bag))
    model.p["Ec"][:, 0] = 0.5 * odds(np.bincount(bag.tri, weights=share[owner], minlength=TRIGRAMS), np.bincount(bag.tri, weights=whole[owner], minlength=TRIGRAMS))
    weight = np.ones(rows, np.float32)
    rng, step = np.random.default_rng(seed), 0
    m = {k: np.zeros_like(x) for k, x in model.p.items()}
    v = {k: np.zeros_like(x) for k, x in model.p.items()}
    while step < steps:
        order = rng.permutation(rows)
        for lo in range(0, rows, batch):
            if step == steps:
                break
            pick = order[lo : lo + batch]
            if step % 8 == 0:
                # Half of the words show their trigrams only, so the network learns stems, not a word list.
                x, hidden = model.embedded(bag), np.flatnonzero(rng.random(len(bag)) < 0.5)
                x[hidden, :EMBED] = 0
            idx, many, first = bag.windows(pick)
            logits = model.forward(x, idx)
            top = np.array([f + int(np.argmax(logits[f : f + n])) for f, n in zip(first.tolist(), many.tolist())])
            grads = model.gradients(bag, x, idx[top], y[pick], weight[pick], hidden)
            step += 1
            for k, w in model.p.items():
                g = grads[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                w -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
    return model


def sample(docs: DataFrame, labels: DataFrame, mod: int, max_docs: int) -> DataFrame:
    """At most ``max_docs`` labelled documents that are not held out, half of them toxic at most; the same at every run.

    They are chosen among the documents of at most MAX_CHARS characters.
    """
    y = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    fit = texts(docs).where(F.length("text") <= MAX_CHARS)
    known = y.where(~crc_split(mod)).join(fit.select("doc_id"), "doc_id", "left_semi")
    by = [F.xxhash64(F.col("doc_id"), F.lit(SEED)), F.col("doc_id")]
    toxic = known.where("y = 1").orderBy(*by).limit(max_docs // 2)
    picked = toxic.unionByName(known.where("y = 0").orderBy(*by).limit(max_docs - toxic.count()))
    return fit.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "y")


def fit(docs: DataFrame, labels: DataFrame, mod: int = 5, max_docs: int = MAX_DOCS) -> Model:
    """Learn ``labels.toxic`` from documents whose crc32(doc_id as text) modulo ``mod`` is not 0."""
    rows = sample(docs, labels, mod, max_docs).toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return train(rows.column("text").combine_chunks(), rows.column("y").to_numpy())


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id long, score double`` of every whole text."""
    shape = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(batch.column(1)))], schema=shape)

    return batched(texts(docs)).mapInArrow(run, "doc_id long, score double")


def classified(docs: DataFrame, labels: DataFrame, mod: int = 5, threshold: float = 0.5, max_docs: int = MAX_DOCS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    found = scores(docs, fit(docs, labels, mod, max_docs))
    return found.select("doc_id", crc_split(mod).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
