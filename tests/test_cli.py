import json

import pytest

from lodestone import cli
from lodestone.sources import jsonl


@pytest.fixture()
def dataset(tmp_path):
    for split, n in (("train", 60), ("test", 20)):
        (tmp_path / "d" / split).mkdir(parents=True)
        lines = [json.dumps({"id": i, "text": f"{'good' if i % 3 else 'bad'} words {i}\n end", "score": "pos" if i % 3 else "neg", "value": i, "prediction": (i % 3) / 2, "part": {"a": i % 3, "b": 1}}) for i in range(n)]
        (tmp_path / "d" / split / "data.jsonl").write_text("\n".join(lines) + "\n")
    return f"file://{tmp_path}"


def call(spark, text):
    return cli.run(spark, cli.parser().parse_args(text.split()))


def rows(spark, folder):
    return cli.inferred(spark, folder).collect()


def test_data_commands(spark, dataset):
    d = f"{dataset}/d"
    call(spark, f"transform-dataset --input {d} --output {dataset}/t --label-transform {{n:.value}}")
    assert {tuple(sorted(r.asDict())) for r in rows(spark, f"{dataset}/t")} == {("file", "n", "split", "text")}
    call(spark, f"normalize-dataset --input {d} --output {dataset}/n --normalizer whitespace --label-field score")
    assert all("\n" not in r.text for r in rows(spark, f"{dataset}/n"))
    call(spark, f"balance-dataset --input {d} --output {dataset}/b --exact")
    assert sorted((r.split, r.score) for r in rows(spark, f"{dataset}/b")).count(("train", "pos")) == 20
    call(spark, f"convert-to-lines --input {d} --output {dataset}/l")
    assert spark.read.text(f"{dataset}/l").where("value like '\\_\\_label\\_\\_%'").count() == 80
    call(spark, f"convert-to-lines --input {d} --output {dataset}/lb --label-field value --bins 2")
    assert spark.read.text(f"{dataset}/lb").where("value like '%bin0%'").count() == 50
    call(spark, f"reshard-dataset --input {d} --output {dataset}/r --files 4 --test 0.25")
    assert cli.inferred(spark, f"{dataset}/r").groupBy("split").count().orderBy("split").collect()[0][1] == 20
    call(spark, f"sample-dataset --input {d} --output {dataset}/s --rate 0.5")
    assert 20 < jsonl.read_lines(spark, f"{dataset}/s").count() < 60
    with pytest.raises(ValueError):
        call(spark, f"sample-dataset --input {d} --output {dataset}/s")
    assert call(spark, f"count-tokens --input {d}") == {"tokens": 320, "rows": 80, "files": 2, "bytes": sum(len(r.text) for r in rows(spark, d))}


def test_analysis_commands(spark, dataset):
    d = f"{dataset}/d"
    assert call(spark, f"annotation-agreement --input {d},{d}")[0]["rate"] == 1.0
    assert [r["n"] for r in call(spark, f"label-distribution --input {d}")] == [27, 53]
    assert call(spark, f"label-distribution --input {d} --value --label-field value")["n"] == 80
    out = call(spark, f"eval-calibration --input {d} --label-field score")
    assert out["auc"]["macro"] == 1.0
    fit = call(spark, f"train-calibration --input {d} --prediction-expression .part")
    assert set(fit["weights"]) == {"a", "b"}
    assert call(spark, f"compare --input {d},{d} --value score")["different"] == 0
    assert call(spark, f"percentiles --input {d} --expression .value")[50.0] == 19.5
    assert call(spark, "list-prompts")


def test_model_commands(spark, dataset):
    d = f"{dataset}/d"
    call(spark, f"train-ngrams --input {d} --output {dataset}/m --ngrams 1 --buckets 64 --epochs 5")
    assert call(spark, f"eval-ngrams --input {d} --model {dataset}/m")["overall"]["macro_f1"] == 1.0
    call(spark, f"infer-ngrams --input {d} --output {dataset}/i --model {dataset}/m --name c")
    assert set(rows(spark, f"{dataset}/i")[0].metadata.c.asDict()) == {"neg", "pos"}
    call(spark, f"annotate-dataset --input {d} --output {dataset}/a --prompt prose --limit-rows 7")
    assert len(rows(spark, f"{dataset}/a")) == 7


def names(spark, folder):
    return sorted(f.removeprefix("file:").lstrip("/").removeprefix(folder.removeprefix("file:").lstrip("/")).lstrip("/") for f in jsonl.list_files(spark, folder))


def test_outputs_keep_or_give_names(spark, dataset):
    d = f"{dataset}/d"
    for command in ("transform-dataset", "normalize-dataset --normalizer whitespace", "sample-dataset --rate 0.9", "annotate-dataset --prompt prose"):
        out = f"{dataset}/{command.split()[0]}"
        call(spark, f"{command} --input {d} --output {out}")
        assert names(spark, out) == ["test/data.jsonl", "train/data.jsonl"]
    assert [r.id for r in jsonl.read_jsonl(spark, f"{dataset}/normalize-dataset/train", "id long").collect()] == list(range(60))
    call(spark, f"reshard-dataset --input {d} --output {dataset}/rs --files 4 --test 0.25")
    assert names(spark, f"{dataset}/rs") == ["test/shard_3.jsonl.zst", *(f"train/shard_{k}.jsonl.zst" for k in range(3))]
    spark.range(250).selectExpr("id", "'t' as text").write.parquet(f"{dataset}/p")
    call(spark, f"import-dataset --input {dataset}/p --output {dataset}/im --key id --test-split 0.2 --rows-per-file 100")
    got = names(spark, f"{dataset}/im")
    assert "train/shard_0.jsonl.zst" in got and "train/shard_100.jsonl.zst" in got and "test/shard_0.jsonl.zst" in got


def test_equal_rows_are_told_apart(spark, tmp_path):
    for k in range(2):
        (tmp_path / "e" / "train").mkdir(parents=True, exist_ok=True)
        (tmp_path / "e" / "train" / f"f{k}.jsonl").write_text('{"text": "same", "score": "a"}\n' * 200 + '{"text": "other", "score": "b"}\n' * 50)
    folder = f"file://{tmp_path}/e"
    marked = cli.keyed(cli.inferred(spark, folder)).collect()
    assert len({r._id for r in marked}) == len(marked) == 500
    again = cli.keyed(cli.inferred(spark, folder).repartition(5)).collect()
    assert {r._id for r in again} == {r._id for r in marked}
    call(spark, f"balance-dataset --input {folder} --output {tmp_path}/b --exact".replace(f"{tmp_path}/b", f"file://{tmp_path}/b"))
    scores = [r.score for r in rows(spark, f"file://{tmp_path}/b")]
    assert scores.count("a") == scores.count("b") == 100
    call(spark, f"sample-dataset --input {folder} --output file://{tmp_path}/s --rate 0.5")
    assert 60 < sum('"same"' in r.value for r in jsonl.read_lines(spark, f"file://{tmp_path}/s").collect()) < 340


def test_sample_by_file_budget(spark, tmp_path):
    (tmp_path / "q" / "train").mkdir(parents=True)
    for k, n in enumerate((900, 90, 9)):
        (tmp_path / "q" / "train" / f"f{k}.jsonl").write_text("".join(json.dumps({"i": i, "k": k, "pad": "x" * 80}) + "\n" for i in range(n)))
    call(spark, f"sample-dataset --input file://{tmp_path}/q --output file://{tmp_path}/o --target-size 20000 --by-file")
    for k in range(3):
        source, kept = (tmp_path / d / "train" / f"f{k}.jsonl" for d in ("q", "o"))
        whole = sum((tmp_path / "q" / "train" / f"f{j}.jsonl").stat().st_size for j in range(3))
        budget = 20_000 * source.stat().st_size / whole
        line = source.stat().st_size / (900, 90, 9)[k]
        assert budget - 1 <= kept.stat().st_size <= budget + line + 3


def test_heads_over_token_vectors(spark, dataset):
    words = [("good", [1.0, 0.0]), ("bad", [0.0, 1.0]), ("words", [0.3, 0.3]), ("end", [0.1, 0.2])]
    spark.createDataFrame(words, "token string, vector array<double>").write.parquet(f"{dataset}/v")
    said = call(spark, f"train-head --input {dataset}/d --output {dataset}/h --vectors {dataset}/v --hidden 4 --learning-rate 0.1 --batches 2 --epochs 12")
    assert said["passes"] <= 12
    out = call(spark, f"eval-head --input {dataset}/d --model {dataset}/h --vectors {dataset}/v")
    assert out["overall"]["macro_f1"] == 1.0 and out["classes"]["pos"]["auc"] == 1.0
    call(spark, f"train-ngrams --input {dataset}/d --output {dataset}/hs --ngrams 1 --buckets 64 --epochs 5 --loss hs --max-characters 3")
    assert call(spark, f"eval-ngrams --input {dataset}/d --model {dataset}/hs")["classes"]["neg"]["auc"] == 1.0
