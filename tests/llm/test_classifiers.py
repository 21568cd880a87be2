import zlib

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import quality, toxicity


def numeric(f, array, at, h):
    old = array[at]
    array[at] = old + h
    up = f()
    array[at] = old - h
    down = f()
    array[at] = old
    return (up - down) / (2 * h)


def loss(s, y, w):
    return float(-np.mean(w * (y * np.log(s) + (1 - y) * np.log(1 - s))))


def test_quality_gradients():
    rng = np.random.default_rng(0)
    m = quality.Model()
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x = rng.random((9, quality.N_FEATURES))
    starts, y, w = np.array([0, 4, 6]), np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 1.0])
    grads = m.gradients(x, starts, y, w)
    for k, p in m.p.items():
        for at in [tuple(rng.integers(0, n) for n in p.shape) for _ in range(3)]:
            assert grads[k][at] == pytest.approx(numeric(lambda: loss(m.forward(x, starts)["s"], y, w), p, at, 1e-6), rel=1e-4, abs=1e-8)


def test_toxicity_gradients():
    rng = np.random.default_rng(0)
    m = toxicity.Model()
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    bag = toxicity.Bag(pa.array(["one two three. one", "", "four five " * 20]))
    idx, many, first = bag.windows()
    assert many.tolist() == [1, 1, 2] and idx.shape == (4, toxicity.WINDOW)
    y, w = np.array([1.0, 0.0, 1.0, 0.0]), np.array([1.0, 2.0, 1.0, 1.0])
    f = lambda: loss(1 / (1 + np.exp(-m.forward(m.embedded(bag).astype(np.float64), idx))), y, w)
    grads = m.gradients(bag, m.embedded(bag).astype(np.float64), idx, y, w)
    for k in ("W", "b", "U0", "U1", "A", "v", "c", "d"):
        p = m.p[k]
        for at in [tuple(rng.integers(0, n) for n in p.shape) for _ in range(3)]:
            assert grads[k][at] == pytest.approx(numeric(f, p, at, 1e-4), rel=2e-2, abs=1e-5)


def test_every_word_is_in_a_window():
    for n in (0, 1, 31, 32, 33, 56, 57, 200):
        bag = toxicity.Bag(pa.array([" ".join(f"w{i}" for i in range(n)), "tail"]))
        idx, many, first = bag.windows()
        own = idx[: many[0]]
        assert set(own[own < len(bag)].tolist()) == set(bag.codes[: bag.sizes[0]].tolist())


@pytest.mark.parametrize(("module", "label", "threshold"), [(quality, "quality", 0.3), (toxicity, "toxic", 0.5)])
def test_held_out_accuracy(spark, module, label, threshold):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    known = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    truth = {r.doc_id: r[label] for r in labels.collect()}
    rows = module.classified(known, labels).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == known.count() and len(held) > 500
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in rows)
    right = sum(r.predicted == truth[r.doc_id] for r in held) / len(held)
    assert right > 0.97


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_odd_inputs(spark, odd_docs, no_docs, module, label):
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    assert {r.score for r in module.classified(odd_docs, none).collect()} == {0.5 if module is quality else 0.0}
    one = spark.createDataFrame([(100, 1), (101, 1), (None, 0), (102, None)], f"doc_id long, {label} int")
    assert {r.score for r in module.classified(odd_docs, one).collect()} == {1.0}
    two = spark.createDataFrame([(100 + i, i % 2) for i in range(40)] + [(1, 1), (2, 0)], f"doc_id long, {label} int")
    rows = module.classified(odd_docs, two).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert module.classified(no_docs, two).collect() == []
