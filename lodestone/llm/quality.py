"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages (all of it, none left out). Each passage is encoded by its hashed words
and by shares of what its bytes and words look like, then by one tanh layer; gated attention learned from document
labels alone weighs the passages, and a logistic layer scores the weighted representation:

    h_k = tanh(W x_k + b)      a = softmax(v (tanh(V h) * sigmoid(U h)))      score = sigmoid(c sum a_k h_k + d)

Trained in numpy on the driver over a bounded sample of labelled documents (``MAX_DOCS``, whole
documents; scoring has no such bound). Texts are the only input
of a score.

A null or empty text is one empty passage. Without labels (or with one class) the score is the
share of label 1 in the sample, 0.5 if there is none. Repeated rows are scored alike; a null doc_id
keeps its row and is never learned from. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import batched, crc_split, texts

MAX_DOCS = 4_000
PASSAGE_BYTES = 512
HIDDEN = 24
GATE = 12
EPOCHS = 30
SEED = 17

_CLASS = np.zeros(256, np.uint8)
for _lo, _hi, _kind in ((0, 31, 0), (32, 32, 1), (48, 57, 2), (65, 90, 3), (97, 122, 4), (128, 255, 5)):
    _CLASS[_lo : _hi + 1] = _kind
for _kind, _chars in ((6, b".,;:"), (7, b"!?"), (8, b"#$%&*@^~"), (9, b"|<>{}[]\\/_=+"), (10, b"\"'()-`")):
    _CLASS[list(_chars)] = _kind
_CLASS[9:14] = 1
KINDS = 11
#: Bins into which a passage's words are hashed.
LEXICAL = 64
N_FEATURES = KINDS * KINDS + KINDS + LEXICAL + 7


def features(data: bytes) -> np.ndarray:
    """One row a passage: shares of byte classes and of neighbouring classes, how words repeat, and shares of hashed words."""
    a = np.frombuffer(data, np.uint8)
    n = max(1, -(-len(a) // PASSAGE_BYTES))
    x = np.zeros((n, N_FEATURES), np.float32)
    if not len(a):
        return x
    kind = _CLASS[a].astype(np.int64)
    at = np.arange(len(a)) // PASSAGE_BYTES
    size = np.bincount(at, minlength=n).astype(np.float32)[:, None]
    x[:, :KINDS] = np.bincount(at * KINDS + kind, minlength=n * KINDS).reshape(n, KINDS) / size
    pair = kind[:-1] * KINDS + kind[1:]
    x[:, KINDS : KINDS + KINDS * KINDS] = np.bincount(at[1:] * KINDS * KINDS + pair, minlength=n * KINDS * KINDS).reshape(n, -1) / size
    # Words by their ends, length and sum of squares; a word belongs to the passage in which it starts.
    gap = kind == 1
    starts = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
    if len(starts):
        ends = np.flatnonzero(~gap & np.concatenate((gap[1:], [True]))) + 1
        b = a.astype(np.int64)
        sums = np.cumsum(b * b)
        word = (sums[ends - 1] - sums[starts]) * 131071 + (ends - starts) * 65537 + b[starts] * 257 + b[ends - 1]
        own = at[starts]
        words = np.bincount(own, minlength=n).astype(np.float32)
        safe = np.maximum(words, 1)
        same = np.concatenate(([False], word[1:] == word[:-1]))
        order = np.lexsort((word, own))
        w, o = word[order], own[order]
        new = np.concatenate(([True], (w[1:] != w[:-1]) | (o[1:] != o[:-1])))
        length = (ends - starts).astype(np.float64)
        k = KINDS + KINDS * KINDS
        x[:, k] = np.bincount(own, weights=same, minlength=n) / safe
        x[:, k + 1] = np.bincount(o, weights=new, minlength=n) / safe
        x[:, k + 2] = np.minimum(np.bincount(own, weights=length, minlength=n) / safe / 10, 5)
        x[:, k + 3] = np.bincount(own, weights=(kind[ends - 1] == 8), minlength=n) / safe
        x[:, k + 4] = np.bincount(own, weights=(kind[ends - 1] == 7), minlength=n) / safe
        x[:, k + 5] = np.bincount(own, weights=(kind[starts] == 9) & (ends - starts == 1), minlength=n) / safe
        bins = ((word * 40503) >> 7) % LEXICAL
        x[:, k + 6 : k + 6 + LEXICAL] = np.bincount(own * LEXICAL + bins, minlength=n * LEXICAL).reshape(n, LEXICAL) / safe[:, None]
    x[:, -1] = min(1.0, len(a) / 5000)
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Model:
    """The network's weights; small enough to travel with a task."""

    def __init__(self, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"W": init(N_FEATURES, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": init(HIDDEN, GATE), "U": init(HIDDEN, GATE), "v": init(GATE, 1), "c": init(HIDDEN, 1), "d": np.zeros(1, np.float32)}
        self.mean, self.scale = np.zeros(N_FEATURES, np.float32), np.ones(N_FEATURES, np.float32)
        self.constant: float | None = None

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """``x``: passages of bags that begin at ``starts``."""
        p = self.p
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = ((t * g) @ p["v"])[:, 0]
        bag = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "bag": bag, "s": _sigmoid(z @ p["c"] + p["d"])[:, 0]}

    def score(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(starts), self.constant)
        return self.forward(x, starts)["s"].astype(np.float64)

    def gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, starts)
        bag, a, h, t, g = f["bag"], f["a"], f["h"], f["t"], f["g"]
        ds = ((f["s"] - y) * weight)[:, None] / len(y)
        dz = ds @ p["c"].T
        da = (dz[bag] * h).sum(1)
        de = (a * (da - np.add.reduceat(a * da, starts)[bag]))[:, None]
        dtg = de @ p["v"].T
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh = a[:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T
        du = dh * (1 - h * h)
        return {"W": f["x"].T @ du, "b": du.sum(0), "V": h.T @ dt, "U": h.T @ dg, "v": (t * g).T @ de, "c": f["z"].T @ ds, "d": ds.sum(0)}


def train(bags: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 3e-3, seed: int = SEED) -> Model:
    """Adam over bags; classes weigh alike."""
    model = Model(seed)
    y = np.asarray(y, np.float32)
    if not len(y) or y.min() == y.max():
        model.constant = float(y.mean()) if len(y) else 0.5
        return model
    whole = np.concatenate(bags)
    model.mean, model.scale = whole.mean(0), whole.std(0) + 1e-3
    share = y.mean()
    # Rejecting a good document costs more than passing a poor one: half the correction for balance.
    weight = np.where(y == 1, 1.0, np.sqrt(share / (1 - share))).astype(np.float32)
    rng, step = np.random.default_rng(seed), 0
    m = {k: np.zeros_like(w) for k, w in model.p.items()}
    v = {k: np.zeros_like(w) for k, w in model.p.items()}
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), batch):
            pick = order[lo : lo + batch]
            x = np.concatenate([bags[i] for i in pick])
            starts = np.cumsum([0, *(len(bags[i]) for i in pick[:-1])])
            grads = model.gradients(x, starts, y[pick], weight[pick])
            step += 1
            for k, w in model.p.items():
                g = grads[k] + 1e-4 * w
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, max_docs: int) -> DataFrame:
    """At most ``max_docs`` labelled documents (doc_id, text, y) that are not held out, the same at every run."""
    y = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("y"))
    picked = y.where(~crc_split(mod)).orderBy(F.xxhash64(F.col("doc_id"), F.lit(SEED)), "doc_id").limit(max_docs)
    return texts(docs).join(F.broadcast(picked), "doc_id").select("doc_id", "text", "y")


def fit(docs: DataFrame, labels: DataFrame, mod: int = 5, max_docs: int = MAX_DOCS) -> Model:
    """Learn ``labels.quality`` from documents whose crc32(doc_id as text) modulo ``mod`` is not 0."""
    shape = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("x", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1):
                out.append(features(text.as_py().encode()).astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int32()), pa.array(out, pa.binary())], schema=shape)

    rows = batched(sample(docs, labels, "quality", mod, max_docs)).mapInArrow(run, "doc_id long, y int, x binary").toArrow().sort_by("doc_id").to_pylist()
    bags = [np.frombuffer(r["x"], np.float16).reshape(-1, N_FEATURES).astype(np.float32) for r in rows]
    return train(bags, np.array([r["y"] for r in rows]))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id long, score double`` of every whole text."""
    shape = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[np.ndarray] = []
            xs: list[np.ndarray] = []
            for i, text in enumerate(batch.column(1)):
                xs.append(features(text.as_py().encode()))
                if sum(map(len, xs)) > 4096 or i + 1 == batch.num_rows:
                    out.append(model.score(np.concatenate(xs), np.cumsum([0, *map(len, xs[:-1])])))
                    xs = []
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out))], schema=shape)

    return batched(texts(docs)).mapInArrow(run, "doc_id long, score double")


def classified(docs: DataFrame, labels: DataFrame, mod: int = 5, threshold: float = 0.3, max_docs: int = MAX_DOCS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    found = scores(docs, fit(docs, labels, mod, max_docs))
    return found.select("doc_id", crc_split(mod).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
