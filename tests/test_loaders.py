"""Typed loaders, disagreement files, reports and their display."""

import json
import logging

import pytest
from pyspark.sql import functions as F

from lodestone import cli, display
from lodestone.operators import annotate
from lodestone.sources import jsonl, loaders, sinks


def put(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))
    return f"file://{path.parent}"


def call(spark, text):
    return cli.run(spark, cli.parser().parse_args(text.split()))


def test_predictions_and_labels(spark, tmp_path):
    one = put(tmp_path / "a" / "x.jsonl", [{"p": 0.5, "y": "low"}, {"p": 1, "y": "mid"}])
    two = put(tmp_path / "b" / "x.jsonl", [{"p": 0.25, "y": "high"}, {"p": 0, "y": "low"}])
    got = loaders.predictions_and_labels(spark, [one, two], ".p", ".y").collect()
    assert sorted((r.prediction, r.label, r["rank"]) for r in got) == [(0.0, "low", 1), (0.25, "high", 0), (0.5, "low", 1), (1.0, "mid", 2)]
    bad = put(tmp_path / "c" / "x.jsonl", [{"p": None, "y": "low"}, {"p": 1, "y": "low"}])
    with pytest.raises(Exception, match="gives null"):
        loaders.predictions_and_labels(spark, [bad], ".p", ".y").collect()


def test_labels_and_keys(spark, tmp_path):
    folder = put(tmp_path / "a" / "x.jsonl", [{"k": 7, "v": "3"}, {"k": 8, "v": "4"}])
    read = lambda kind, key=".k": sorted((r.label, r.key) for r in loaders.labels_and_keys(spark, folder, ".v", key, kind).collect())
    assert read("ordinal") == [(3, "7"), (4, "8")] and read("value") == [(3.0, "7"), (4.0, "8")] and read("text") == [("3", "7"), ("4", "8")]
    assert [r.key for r in loaders.labels_and_keys(spark, folder, ".v").collect()] == [None, None]
    with pytest.raises(ValueError):
        read("other")
    odd = put(tmp_path / "b" / "x.jsonl", [{"k": 1, "v": "x"}])
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cannot be cast"):
        loaders.labels_and_keys(spark, odd, ".v", ".k", "ordinal").collect()


def test_keyed_values_count_what_they_skip(spark, tmp_path):
    folder = put(tmp_path / "a" / "x.jsonl", [{"text": "one", "v": 1}, "broken {", {"v": 2}, {"text": None, "v": 3}, "[1]", {"text": "one", "v": 4}])
    got = loaders.keyed_values(spark, folder, "text", ".v")
    assert sorted((r.key or "", r.value) for r in got.rows.collect()) == [("", 3), ("one", 1), ("one", 4)]
    s = got.skipped.first()
    assert (s.unreadable, s.without_key) == (2, 1)
    assert {json.loads(r.row)["v"] for r in got.rows.collect()} == {1, 3, 4}


def test_rendered_splits_and_vocabulary(spark, tmp_path):
    data = put(tmp_path / "d" / "train" / "x.jsonl", [{"text": f"t {i}", "score": i % 2} for i in range(10)]).rsplit("/", 1)[0]
    put(tmp_path / "d" / "test" / "x.jsonl", [{"text": "q", "score": 1}])
    for flag in ("", " --single-file"):
        out = f"file://{tmp_path}/lines{len(flag)}"
        call(spark, f"convert-to-lines --input {data} --output {out}{flag} --bins 2")
        got = loaders.rendered_splits(spark, [out]).collect()
        assert sorted((r.split, r.label) for r in got) == [("test", "__label__bin1")] + [("train", "__label__bin0")] * 5 + [("train", "__label__bin1")] * 5
        report = (tmp_path / f"lines{len(flag)}" / "report.yaml").read_text()
        assert "train: 10" in report and "num_bins: 2" in report
    assert (tmp_path / "lines14" / "train.txt").exists()
    with pytest.raises(FileNotFoundError):
        loaders.rendered_splits(spark, [data + "/none"])
    (tmp_path / "v.txt").write_text(" a \nb\n\nb\n")
    assert sorted(r.token for r in loaders.vocabulary(spark, f"file://{tmp_path}/v.txt").collect()) == ["a", "b"]


def test_disagreement_file(spark, tmp_path):
    one = put(tmp_path / "a" / "x.jsonl", [{"text": "s", "v": 1, "n": "first"}, {"text": "t", "v": 1}, {"text": "only", "v": 5}])
    two = put(tmp_path / "b" / "x.jsonl", [{"text": "s", "v": 2, "m": 0}, {"text": "t", "v": 1}])
    out = f"file://{tmp_path}/out"
    said = call(spark, f"compare --input {one},{two} --value v --output {out}")
    assert said["different"] == 1 and said["common"] == 2
    rows = [json.loads(r.value) for r in jsonl.read_lines(spark, out).collect()]
    assert rows == [{"text": "s", "value_file1": 1, "value_file2": 2, "file1_name": "a", "file2_name": "b", "row_file1": {"n": "first", "text": "s", "v": 1}, "row_file2": {"m": 0, "text": "s", "v": 2}}]


def test_results_are_written(spark, tmp_path):
    folder = put(tmp_path / "a" / "x.jsonl", [{"score": i} for i in range(10)])
    call(spark, f"label-distribution --input {folder} --value --results file://{tmp_path}/r")
    files = [p for p in (tmp_path / "r").iterdir() if not p.name.startswith(".")]
    assert len(files) == 1 and files[0].name.startswith("results_") and "median: 4.5" in files[0].read_text()
    with pytest.raises(FileNotFoundError):
        call(spark, f"label-distribution --input {folder}/none")


def test_token_totals(spark, tmp_path):
    import public_tokenizers

    folder = put(tmp_path / "a" / "x.jsonl", [{"text": "Hello world"}, {"text": "one two three"}])
    said = call(spark, f"count-tokens --input {folder} --totals --tokenizer {public_tokenizers.path('word_bpe_49k.json')}")
    size = (tmp_path / "a" / "x.jsonl").stat().st_size
    assert said["tokens"] == 5 and said["file_bytes"] == size and said["tokens_per_file"] == 5 and said["tokens_per_byte"] == pytest.approx(5 / size)


def test_distil_command(spark, tmp_path):
    spark.createDataFrame([("a", [1.0, 2.0], 5), ("b", [3.0, -4.0], 5), ("c", [9.0, 9.0], 1)], "token string, vector array<double>, n long").write.parquet(f"{tmp_path}/v")
    (tmp_path / "words.txt").write_text("a\nb\n")
    call(spark, f"distil --input file://{tmp_path}/v --output file://{tmp_path}/o --vocabulary file://{tmp_path}/words.txt --dimensions auto --quantize")
    out = spark.read.parquet(f"{tmp_path}/o").collect()
    assert sorted(r.token for r in out) == ["a", "b"] and max(abs(x) for r in out for x in r.vector) == 127
    assert (tmp_path / "o-step.yaml").read_text().startswith("step: ")


def test_prompt_for_a_subset(spark):
    assert call(spark, "list-prompts") == sorted(annotate.PROMPTS) and "story_characters" in annotate.PROMPTS
    df = spark.createDataFrame([(1, "write_fiction", "Ann met Bob"), (2, "cooking", "soup"), (3, None, "x")], "id long, topic string, text string")
    answer = lambda prompts, schema: [json.dumps({"names": " bob, ann ,"})] * len(prompts)
    rows = annotate.annotate(df, annotate.CHARACTERS, "text", answer).rows.collect()
    assert [(r.id, r.story_characters.names) for r in rows] == [(1, ["ann", "bob"])]
    with pytest.raises(ValueError, match="topic"):
        annotate.annotate(df.drop("topic"), annotate.CHARACTERS, "text", answer)


def test_display(tmp_path):
    assert display.table([{"label": "a", "f1": 0.5, "n": 1200}, {"label": "bb", "f1": None, "n": 3}]) == "label      f1      n\n-----  ------  -----\na      0.5000  1,200\nbb          -      3"
    assert display.panel("AUC", {"macro": 0.25, "n": 3}) == "AUC\n---\nmacro  0.2500\nn      3"
    assert display.histogram({"x": 4, "yy": 2}, 4) == "x  #### 4\nyy ## 2"
    plot = display.reliability_plot([{"bin": 1, "n": 10, "mean_truth": 0.5, "mean_predicted": 0.7}], 10)
    assert plot == "  1 #####  |   0.500 (10)"
    log = display.logger(str(tmp_path / "logs"))
    log.info("said %d", 5)
    assert "said 5" in next((tmp_path / "logs").iterdir()).read_text() and log.level == logging.INFO
    display.logger()
    assert cli.parser().parse_args(["version"]).command == "version"
