"""Heads trained by summed gradients, tree losses, character n-grams, pooled vectors."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from lodestone.operators import models, networks


@pytest.mark.parametrize("kind", networks.KINDS)
@pytest.mark.parametrize("hidden", [(), (4,), (5, 3)])
def test_gradient(kind, hidden):
    rng = np.random.default_rng(3)
    widths = [3, *hidden, 1 if kind == "number" else 3]
    flat = rng.normal(size=sum(a * b + b for a, b in zip(widths, widths[1:])))
    x, w = rng.normal(size=(7, 3)), rng.uniform(0.5, 2, 7)
    y = rng.normal(size=(7, 1)) if kind == "number" else np.eye(3)[rng.integers(0, 3, 7)] if kind == "classes" else rng.integers(0, 2, (7, 3)).astype(float)
    at = lambda f: networks.loss_and_gradient(kind, networks._shaped(f, widths), x, y, w)
    _, g = at(flat)
    for i in range(len(flat)):
        step = np.zeros_like(flat)
        step[i] = 1e-5
        assert g[i] == pytest.approx((at(flat + step)[0] - at(flat - step)[0]) / 2e-5, rel=1e-3, abs=1e-6)


@pytest.fixture(scope="module")
def xor(spark):
    rows = spark.range(400).select("id", (F.rand(1) * 2 - 1).alias("a"), (F.rand(2) * 2 - 1).alias("b"))
    return rows.select("id", F.array("a", "b").alias("x"), F.when(F.col("a") * F.col("b") > 0, "same").otherwise("other").alias("y"), (F.col("a") * F.col("b")).alias("z"))


def right(df, head):
    got = networks.evaluate_head(df, head, "x", "y")
    return got.where("label = prediction").count() / got.count()


def test_layers_learn_what_a_line_cannot(spark, xor, tmp_path):
    train = xor.union(spark.createDataFrame([(-1, None, "same", 0.0), (-2, [1.0, 1.0], None, 0.0)], "id long, x array<double>, y string, z double"))
    line = networks.train_head(train, "x", "y", "id", hidden=(), rate=0.05, batches=2, passes=4)
    head = networks.train_head(train, "x", "y", "id", hidden=(16,), rate=0.1, batches=4, passes=14)
    assert right(xor, line) < 0.75 and right(xor, head) > 0.93
    assert head.names == ["other", "same"]
    head.save(spark, f"{tmp_path}/h")
    back = networks.Head.load(spark, f"{tmp_path}/h")
    p = xor.select(back.column("x").alias("p"), head.column("x").alias("q")).collect()
    assert all(r.p == r.q and sum(r.p) == pytest.approx(1) for r in p)
    assert spark.createDataFrame([(None,)], "x array<double>").select(back.column("x").alias("p")).first().p is None


def test_training_stops_and_keeps_the_best(xor):
    noise = xor.withColumn("y", F.when(F.rand(7) > 0.5, "a").otherwise("b"))
    head = networks.train_head(noise, "x", "y", "id", hidden=(8,), rate=0.1, batches=2, passes=60, patience=3, held=0.3)
    assert len(head.history) < 60 and min(head.history) == min(head.history[:-3])


def test_numbers_and_several_labels(spark, xor):
    number = networks.train_head(xor, "x", "z", "id", kind="number", hidden=(16,), rate=0.03, batches=4, passes=15)
    got = networks.evaluate_head(xor, number, "x", "z").collect()
    assert np.corrcoef([r.label for r in got], [r.prediction for r in got])[0, 1] > 0.9
    tags = xor.withColumn("t", F.filter(F.array(F.when(F.col("x")[0] > 0, "right"), F.when(F.col("x")[1] > 0, "up")), lambda t: t.isNotNull()))
    head = networks.train_head(tags, "x", "t", "id", kind="labels", hidden=(8,), rate=0.1, batches=4, passes=10)
    assert head.names == ["right", "up"]
    got = networks.evaluate_head(tags, head, "x", "t").collect()
    assert sum(sorted(r.label) == sorted(r.prediction) for r in got) / len(got) > 0.93


def test_bad_calls(xor):
    with pytest.raises(ValueError, match="kind"):
        networks.train_head(xor, "x", "y", "id", kind="other")
    with pytest.raises(ValueError, match="learn"):
        networks.train_head(xor.where("id < 0"), "x", "y", "id")


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text("abcdef", min_size=1, max_size=3), st.integers(1, 50), min_size=2, max_size=9))
def test_huffman(counts):
    codes = models.huffman(counts)
    assert sum(2.0 ** -len(c) for c in codes.values()) == 1
    assert not any(a != b and codes[b].startswith(codes[a]) for a in codes for b in codes)
    assert all(len(codes[a]) >= len(codes[b]) for a in codes for b in codes if counts[a] < counts[b])


@pytest.fixture(scope="module")
def topics(spark):
    words = {"sea": "wave ship tide", "sky": "cloud wind bird", "soil": "root worm stone", "fire": "flame smoke ash"}
    rows = [(f"{w.split()[i % 3]} the {w.split()[(i + 1) % 3]} and {i}", name) for k, (name, w) in enumerate(words.items()) for i in range(30 - 5 * k)]
    return spark.createDataFrame(rows, "text string, label string")


@pytest.mark.parametrize("loss", ["softmax", "ova", "hs"])
def test_losses(spark, topics, loss, tmp_path):
    model = models.train_ngrams(topics, n=2, buckets=256, epochs=8, loss=loss)
    per = models.evaluate(topics, model).collect()
    assert len(per) == 4 and all(r.f1 > 0.95 and r.auc > 0.99 for r in per)
    if loss != "ova":
        assert all(sum(r.prediction.values()) == pytest.approx(1, abs=1e-9) for r in models.infer(topics, model).collect())
    models.save(model, f"{tmp_path}/m")
    back = PipelineModel.load(f"{tmp_path}/m/model")
    assert {r.prediction["sea"] for r in models.infer(topics, back).collect()} == {r.prediction["sea"] for r in models.infer(topics, model).collect()}


def test_tree_of_one_class_is_refused(spark, topics):
    with pytest.raises(ValueError):
        models.train_ngrams(topics.where("label = 'sea'"), loss="hs")
    with pytest.raises(ValueError):
        models.train_ngrams(topics, loss="other")


def test_characters_know_new_words(spark, topics):
    new = spark.createDataFrame([("waves shipping", "sea"), ("clouds winds", "sky")], topics.schema)
    model = models.train_ngrams(topics, n=1, buckets=1024, epochs=8, characters=(3, 4))
    assert [max(r.prediction, key=r.prediction.get) for r in models.infer(new, model).collect()] == ["sea", "sky"]
    grams = models._characters(3, 4).transform(spark.createDataFrame([(["ab", "xyz"],)], "_w array<string>")).first()._c
    assert grams == ["<ab", "ab>", "<ab>", "<xy", "xyz", "yz>", "<xyz", "xyz>"]


def test_rare_words_count_nothing(spark, topics):
    model = models.train_ngrams(topics, n=1, buckets=4096, epochs=5, min_count=5)
    seen = model.transform(spark.createDataFrame([("wave 7", "sea"), ("zebra", "sea")], topics.schema)).select("_hw").collect()
    assert [r._hw.numNonzeros() for r in seen] == [1, 0]


def test_pooled_vectors_are_summed_before_the_shuffle(spark):
    tokens = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "b"), (3, "none")], "doc long, token string")
    vectors = spark.createDataFrame([("a", [1.0, 2.0, 0.0]), ("b", [4.0, -1.0, 8.0])], "token string, vector array<double>")
    out = models.pooled_embeddings(tokens, vectors, "doc")
    assert {r.doc: r.pooled for r in out.collect()} == {1: [2.0, 1.0, pytest.approx(8 / 3)], 2: [4.0, -1.0, 8.0]}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "partial_sum" in plan
    small, step = models.quantized(vectors)
    assert {r.token: [x * step for x in r.vector] for r in small.collect()}["b"] == [pytest.approx(x, abs=step / 2) for x in (4.0, -1.0, 8.0)]
    counts = spark.createDataFrame([("a", 2), ("b", 2)], "token string, n long")
    assert len(models.distil(vectors, counts, dimensions="auto").first().vector) == 3
