import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators import annotate, calibration, compare, dedup, metrics, models, rows, sampling, stats
from lodestone.sources import jsonl
from lodestone.streaming import files


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.range(1000).select(F.col("id"), (F.col("id") % 10).alias("label"), F.when(F.col("id") % 10 < 7, "pos").otherwise("neg").alias("score"))


def test_balance(spark, numbers):
    kept = sampling.balance(numbers, "score", "id")
    counts = dict(kept.groupBy("score").count().collect())
    assert counts["neg"] == 300 and abs(counts["pos"] - 300) < 60
    exact = dict(sampling.balance(numbers, "score", "id", exact=True).groupBy("score").count().collect())
    assert exact == {"neg": 300, "pos": 300}
    assert sampling.balance(numbers.limit(0), "score", "id").count() == 0


def test_sampling_is_deterministic_and_checks_its_rate(numbers):
    pick = lambda seed: sorted(r.id for r in sampling.sample_rate(numbers.repartition(5), 0.5, "id", seed).collect())
    assert pick(42) == pick(42) != pick(123)
    assert 440 < len(pick(42)) < 560
    for bad in (0, -1, 1.5):
        with pytest.raises(ValueError):
            sampling.sample_rate(numbers, bad, "id")


def test_sample_bytes(numbers):
    df = numbers.withColumn("file", F.col("id") % 50)
    size = F.lit(10)
    assert sampling.sample_bytes(df, 20_000, "id", size, "file").count() == 1000
    assert 450 <= sampling.sample_bytes(df, 5_000, "id", size, "file").count() <= 550
    few = sampling.sample_bytes(df, 100, "id", size, "file")
    assert few.select("file").distinct().count() <= 1 and few.columns == df.columns


@pytest.mark.parametrize(("test", "valid", "files"), [(0.1, 0.2, 10), (50, 0, 7), (0, 0, 3), (1, 1, 5)])
def test_reshard(numbers, test, valid, files):
    out = sampling.reshard(numbers, "id", files, test, valid)
    sizes = dict(out.groupBy("split").count().collect())
    assert sizes.get("test", 0) == sampling.allotted(1000, test) and sizes.get("valid", 0) == sampling.allotted(1000, valid)
    per = [r["count"] for r in out.where("split = 'train'").groupBy("shard").count().collect()]
    assert max(per) - min(per) <= 1 and out.select("shard").distinct().count() == files
    assert sorted(r.position for r in out.select("position").collect()) == list(range(1000))


def test_reshard_refuses_what_cannot_be(numbers):
    with pytest.raises(ValueError):
        sampling.reshard(numbers, "id", 4, 900, 200)
    with pytest.raises(ValueError):
        sampling.reshard(numbers, "id", 2, 0.1, 0.1)


def test_positional_statistics_against_lists(spark):
    rng = random.Random(4)
    values = [rng.randint(0, 30) for _ in range(137)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v long")
    s, n = sorted(values), len(values)
    row = stats.value_statistics(df, "v").first()
    assert [row[f"p{p}"] for p in stats.PERCENTS] == [s[min(int(n * p / 100), n - 1)] for p in stats.PERCENTS]
    assert stats.bin_edges(df, "v", 5) == [s[0], *(s[int(i * n / 5)] for i in range(1, 5)), s[-1]]
    with pytest.raises(ValueError):
        stats.bin_edges(df, "v", 500)
    edges = stats.quantile_boundaries(df, "v", 10)
    assert edges == sorted({s[i * n // 10] for i in range(10)}) + [s[-1] + 1]
    assert sum(r.n for r in stats.quantile_buckets(df, "v").collect()) == n


def test_bins_with_one_value_and_outside(spark):
    edges = [0, 2, 2, 5]
    df = spark.createDataFrame([(v,) for v in (-1, 0, 1, 2, 3, 5, 9)], "v int")
    assert [r.b for r in df.select(stats.bin_of(F.col("v"), edges).alias("b")).collect()] == [2, 0, 0, 1, 2, 2, 2]


def test_constant_values(spark):
    df = spark.createDataFrame([(3.0, 1)] * 4, "v double, w int")
    assert [r.n for r in stats.equal_width(df, "v").orderBy("bucket").collect()] == [4] + [0] * 9
    assert {r.value for r in stats.weighted_percentiles(df, "v", "w", (0, 50, 100)).collect()} == {3.0}
    pairs = df.select(F.lit("k").alias("key_hash"), F.lit(1).alias("l1"), F.lit(1).alias("l2"))
    row = compare.agreement(pairs, ordinal=True).first()
    assert (row.rate, row.kappa, row.pearson) == (1.0, 1.0, 0.0)


def test_multilabel_lines_drop_rows_without_labels(spark):
    df = spark.createDataFrame([("a b", {"x": 1, "y": 0, "a c": 2}), ("c", {"x": 0}), ("d", {})], "text string, labels map<string,int>")
    assert [r.value for r in rows.render_multilabel(df).collect()] == ["__label__a_c __label__x a b"]
    with pytest.raises(TypeError):
        rows.render_multilabel(df.withColumn("labels", F.lit(1)))


def test_strict_reader_refuses_nulls(spark):
    df = spark.createDataFrame([("a", "x"), (None, "y")], "text string, score string")
    with pytest.raises(Exception, match="null text or label"):
        rows.labelled_text(df).collect()
    assert rows.labelled_text(df.where("text is not null"), max_length=1).collect()[0] == ("a", "x")


def test_tied_auc_and_perfect_order(spark):
    df = spark.createDataFrame([(0.1, 0), (0.5, 1), (0.5, 0), (0.9, 1)], "s double, r int")
    assert metrics.auc(df, "s", F.col("r") == 1).first()[0] == pytest.approx(0.875)
    assert metrics.auc(df.where("r = 1"), "s", F.col("r") == 1).first()[0] is None
    assert metrics.reliability(df.withColumn("s", F.col("s") * 3 - 1), "s", F.col("r")).count() == 3


def test_calibration_fits(spark):
    rng = random.Random(1)
    data = [(x := rng.random(), y := rng.random(), 0.3 * x - 0.2 * y + 0.4) for _ in range(300)]
    df = spark.createDataFrame(data, "x double, y double, t double")
    fit = calibration.ridge(df, ["x", "y"], "t", alpha=1e-9)
    assert fit.weights == pytest.approx([0.3, -0.2], abs=1e-6) and fit.bias == pytest.approx(0.4, abs=1e-6)
    assert fit.by_weight()[0][0] == "x"
    assert fit.expression() == '. | (."x" * 0.300000) + (."y" * -0.200000) + 0.400000'
    curved = df.withColumn("t", 1 / (1 + F.exp(-(2 * F.col("x") - F.col("y") + 0.5))))
    log = calibration.log_linear(curved, ["x", "y"], "t")
    assert log.weights == pytest.approx([2, -1], abs=1e-2) and log.bias == pytest.approx(0.5, abs=1e-2)
    from lodestone.functions.jq import compile_expression

    got = curved.select(compile_expression(log.expression(), curved).alias("a"), log.column().alias("b")).collect()
    assert all(r.a == pytest.approx(r.b, abs=1e-5) for r in got)
    assert calibration.ridge(df.limit(0), ["x"], "t").bias == 0.0


def test_minhash_keeps_one_of_each_group(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(500)]
    base = [rng.choice(words) for _ in range(200)]
    near = base.copy()
    near[100] = "other"
    docs = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base)), (4, " ".join(rng.choice(words) for _ in range(200))), (5, ""), (6, None), (7, "two words")]
    df = spark.createDataFrame(docs, "id long, text string")
    assert sorted(r.id for r in dedup.deduplicate(df, "id", "text").collect()) == [1, 4, 5, 6, 7]
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 60)], "a long, b long")
    assert {r.node: r.component for r in dedup.components(edges).collect()} == {**dict.fromkeys(range(21), 0), 50: 50, 60: 50}


def test_annotation_with_cache_limit_and_rejects(spark):
    prompt = annotate.rubric("test code")
    df = spark.createDataFrame([(i, "x" * (i * 700)) for i in range(5)], "id long, text string")
    asked = []

    def broken(prompts, schema):
        return ["not json" if "x" * 700 not in p else json.dumps({"justification": "j", "score": 2}) for p in prompts]

    run = annotate.annotate(df, prompt, "text", broken)
    assert sorted(r.id for r in run.rows.collect()) == [1, 2, 3, 4] and [r.id for r in run.rejected.collect()] == [0]
    assert annotate.annotate(df, prompt, "text", limit=2).rows.count() == 2
    done = annotate.annotate(df, prompt, "text").rows
    again = annotate.annotate(done, prompt, "text", broken)
    assert again.rows.count() == 5
    cache = df.select(F.sha2(prompt.render(F.col("text")), 256).alias("prompt_hash"), F.lit('{"justification": "c", "score": 4}').alias("response"))
    assert {r.s for r in annotate.annotate(df, prompt, "text", broken, cache=cache).rows.select(F.col(f"{prompt.name}.score").alias("s")).collect()} == {4}
    assert annotate.json_schema(prompt.schema) == {"type": "object", "properties": {"justification": {"type": "string"}, "score": {"type": "integer"}}, "required": ["justification", "score"], "additionalProperties": False}
    assert asked == []


def test_conversations(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "<think>a\nb</think> yo"), (1, 2, "user", "<|im_end|>"), (2, 0, "user", "alone")], "c long, t long, role string, text string")
    assert annotate.conversation_prefix(turns, "c", "t", "role", "assistant").count() == 2
    out = {r.c: r.value for r in annotate.render_conversations(turns, "c", "t", "role", "text").collect()}
    assert out[1] == "CONVERSATION:\nROLE: user\nCONTENT: hi\n\nROLE: assistant\nCONTENT: yo\n\nROLE: user\nCONTENT: <| im_end |>"


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.range(250).select("id", F.concat(F.lit("té "), "id").alias("text"))
    for zstd in (True, False):
        folder = f"file://{tmp_path}/z{zstd}"
        names = jsonl.write_jsonl(df.coalesce(1), folder, 100, zstd)
        assert len(names) == 3
        back = jsonl.read_jsonl(spark, folder, "id long, text string")
        assert sorted((r.id, r.text) for r in back.collect()) == sorted((r.id, r.text) for r in df.collect())
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd" / "a.jsonl").write_text('{"id": 1}\nbroken\n')
    (tmp_path / "odd" / "a.v2.jsonl").write_text('{"id": 9}\n')
    assert [r.id for r in jsonl.read_jsonl(spark, f"file://{tmp_path}/odd", "id long", tolerant=True).collect()] == [1]
    with pytest.raises(FileNotFoundError):
        jsonl.read_dataset(spark, [f"file://{tmp_path}"], "id long")


def test_split_folders_and_yaml(spark, tmp_path):
    df = sampling.split(spark.range(60).select(F.col("id"), F.lit("x").alias("text")), "id", test=0.3)
    out = jsonl.write_by_split(df, f"file://{tmp_path}/d")
    assert set(out) == {"train", "test"}
    assert jsonl.read_dataset(spark, [f"file://{tmp_path}/d"], "id long, text string").count() == 60
    assert jsonl.to_yaml({"a": {"b": 0.123456, "c": [1, 2]}, "d": "x"}) == 'a:\n  b: 0.1235\n  c:\n    - 1\n    - 2\nd: "x"\n'


def test_models(spark, tmp_path):
    rng = random.Random(3)
    data = [(i, " ".join(rng.choice(["good", "fine", "nice"] if i % 2 else ["bad", "poor", "sad"]) for _ in range(6)), "p" if i % 2 else "n") for i in range(80)]
    df = spark.createDataFrame(data, "id long, text string, label string")
    for loss in ("softmax", "ova"):
        model = models.train_ngrams(df, n=2, buckets=256, epochs=5, loss=loss, balanced=loss == "softmax")
        assert {r.f1 for r in models.evaluate(df, model).collect()} == {1.0}
    model = models.train_ngrams(df, n=1, buckets=64, epochs=3)
    models.save(model, f"{tmp_path}/m", {"n": 1})
    assert (tmp_path / "m" / "model").exists()
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0])], "token string, vector array<double>")
    counts = spark.createDataFrame([("a", 3)], "token string, n long")
    assert {r.token: r.vector[1] for r in models.distil(vectors, counts).collect()}["b"] == pytest.approx(2.0)
    assert len(models.distil(vectors, counts, dimensions=1).first().vector) == 1
    numbers = spark.createDataFrame([([float(i), 1.0], 2.0 * i) for i in range(20)], "features array<double>, y double")
    head = models.train_vectors(numbers, "features", "y", regression=True)
    assert head.transform(numbers).select(F.avg(F.abs(F.col("_k") - F.col("y")))).first()[0] < 0.1


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"text": " a  b "}\n')
    query = files.to_parquet(files.normalize_stream(spark, f"file://{tmp_path}/in", "text string"), f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    query.awaitTermination(60)
    assert [r.text for r in spark.read.parquet(f"file://{tmp_path}/out").collect()] == ["a b"]
    assert T.StringType() == spark.read.parquet(f"file://{tmp_path}/out").schema["text"].dataType


def test_last_write_wins(spark):
    """Repeated keys on either side, keys on one side only, null keys and null values."""
    one = spark.createDataFrame([(1, 10, 0), (1, 11, 1), (2, 20, 2), (3, None, 3), (4, 40, 4), (None, 1, 5)], "k int, v int, at int")
    two = spark.createDataFrame([(1, 10, 0), (2, 21, 1), (2, 20, 2), (3, 30, 3), (5, 50, 4)], "k int, v int, at int")
    got = {(r.key, r.value1, r.value2, r.row1["at"], r.row2["at"]) for r in compare.keyed_diff(one, two, "k", "v", "at").collect()}
    assert got == {("1", 11, 10, 1, 0), ("3", None, 30, 3, 3)}
    assert tuple(compare.diff_statistics(one, two, "k", "v", "at").first())[:4] == (1, 1, 3, 2)
    sides = [compare.last_by_key(df, F.col("k"), F.col("v"), F.col("at")) for df in (one, two)]
    assert tuple(compare.coverage(*sides).first()) == (1, 1, 3)
    assert {(r.l1, r.l2) for r in compare.paired(*sides).collect()} == {(11, 10), (20, 20), (None, 30)}


def test_cut_text_is_a_parameter(spark):
    df = spark.createDataFrame([("a  b" * 1000, "X Y")], "text string, label string")
    assert len(rows.normalize_rows(df, "whitespace", "text", "label", 10).first().text) < 10
    assert len(rows.normalize_rows(df, "whitespace", "text", "label").first().text) == 3000


def test_minhash_against_plain(spark):
    import hashlib

    import numpy as np

    texts = ["a b c d e f g", "one", "x y z", "p q r s t", " ".join(f"w{i % 37}" for i in range(5000)), "a b c d e f h", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    number = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dedup.PRIME

    def plain(text):
        words = [number(w) for w in text.split()]
        runs = [words[i : i + 5] for i in range(max(len(words) - 4, 1))]
        values = []
        for r in runs:
            x = r[0]
            for y in r[1:]:
                x = (x * dedup.BASE + y) % dedup.PRIME
            values.append(x)
        out = []
        for i in range(12):
            a, b = dedup.coefficients(i)
            out.append(min(((a * x + b) & dedup.PRIME) + ((a * x + b) >> 31) for x in values))
        return out

    sizes = np.array([len(t.split()) for t in texts if t])
    numbers = np.array([number(w) for t in texts for w in t.split()])
    for block in (1, 1 << 15):
        assert dedup.minima(*dedup.shingled(numbers, sizes, 5), 12, block).tolist() == [plain(t) for t in texts if t]
    bands = dedup.signatures(df, "id", "text", bands=4, rows=3).collect()
    assert len(bands) == 6 * 4 and len({(r.id, r.band) for r in bands}) == 24
