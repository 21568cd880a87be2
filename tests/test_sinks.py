"""Sinks: names, orders, collisions, and attempts that fail."""

import gzip
import json
import os
import subprocess
import sys
import textwrap
from pathlib import Path

import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from lodestone.operators import sampling
from lodestone.sources import jsonl, sinks


def read(path):
    data = Path(path).read_bytes()
    data = zstandard.ZstdDecompressor().stream_reader(data).readall() if str(path).endswith(".zst") else gzip.decompress(data) if str(path).endswith(".gz") else data
    return [json.loads(x) for x in data.decode().splitlines()]


def files(folder):
    return sorted(str(p.relative_to(folder)) for p in Path(folder).rglob("*") if p.is_file() and not p.name.startswith("."))


def test_file_for_file(spark, tmp_path):
    source = tmp_path / "in"
    rows = {"train/a.jsonl": 300, "train/deep/b.jsonl.gz": 40, "test/c.jsonl.zst": 25, "odd.json": 1}
    for name, n in rows.items():
        (source / name).parent.mkdir(parents=True, exist_ok=True)
        data = "".join(json.dumps({"f": name, "i": i}) + "\n" for i in range(n)).encode()
        (source / name).write_bytes(gzip.compress(data) if name.endswith("gz") else zstandard.compress(data) if name.endswith("zst") else data)
    lines = jsonl.read_lines(spark, f"file://{source}")
    done = sinks.write_like(lines.repartition(7), [f"file://{source}"], f"file://{tmp_path}/out", order=["at"], value="value")
    assert files(tmp_path / "out") == sorted(rows)
    assert {w.name: w.n_rows for w in done} == rows
    for name, n in rows.items():
        assert read(tmp_path / "out" / name) == [{"f": name, "i": i} for i in range(n)]
    # Again over what is there, with fewer rows.
    sinks.write_like(lines.where("get_json_object(value, '$.i') % 2 = 0"), [f"file://{source}"], f"file://{tmp_path}/out", order=["at"], value="value")
    assert [r["i"] for r in read(tmp_path / "out/train/a.jsonl")] == list(range(0, 300, 2))


def test_inputs_of_one_relative_path_are_refused(spark, tmp_path):
    for top in ("x", "y"):
        (tmp_path / top / "train").mkdir(parents=True)
        (tmp_path / top / "train" / "a.jsonl").write_text('{"k": 1}\n')
    folders = [f"file://{tmp_path}/{t}" for t in ("x", "y")]
    lines = jsonl.read_lines(spark, folders[0]).unionByName(jsonl.read_lines(spark, folders[1]))
    with pytest.raises(ValueError, match="train/a.jsonl"):
        sinks.write_like(lines, folders, f"file://{tmp_path}/out", order=["at"], value="value")
    assert not (tmp_path / "out").exists()


def batch(*rows):
    return pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows]), pa.array([v for _, v in rows])], ["name", "value"])


def test_only_the_attempts_of_the_manifest_count(spark, tmp_path):
    """Two attempts of a task both finish, a third ends half-way: one of them is named, once."""
    job, out = f"file://{tmp_path}/out/_writing-x", f"file://{tmp_path}/out"
    rows = [("a.jsonl.zst", '{"k": 1}'), ("a.jsonl.zst", '{"k": 2}'), ("b.jsonl", '{"k": 3}')]
    first = list(sinks.attempt_writer(job, "0-1")(iter([batch(*rows)])))[0].to_pylist()
    list(sinks.attempt_writer(job, "0-2")(iter([batch(*rows[:1]), batch(*rows[1:])])))

    def fails():
        yield batch(*rows[:1])
        raise OSError("lost")

    with pytest.raises(OSError):
        list(sinks.attempt_writer(job, "0-3")(fails()))
    done = sinks.commit(spark, job, out, [tuple(r.values()) for r in first])
    assert [(w.name, w.n_rows) for w in done] == [("a.jsonl.zst", 2), ("b.jsonl", 1)]
    assert files(tmp_path / "out") == ["a.jsonl.zst", "b.jsonl"] and not (tmp_path / "out" / "_writing-x").exists()
    assert read(tmp_path / "out/a.jsonl.zst") == [{"k": 1}, {"k": 2}]


def test_two_tasks_of_one_name_are_refused(spark, tmp_path):
    job = f"file://{tmp_path}/out/_writing-y"
    made = [list(sinks.attempt_writer(job, f"{k}-0")(iter([batch(("a.jsonl", "{}"))])))[0].to_pylist()[0] for k in range(2)]
    with pytest.raises(ValueError, match="a.jsonl"):
        sinks.commit(spark, job, f"file://{tmp_path}/out", [tuple(r.values()) for r in made])


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    df = spark.range(1000).select(F.lit("a.jsonl").alias("name"), F.expr("if(id = 900, raise_error('no'), cast(id as string))").alias("value"))
    with pytest.raises(Exception, match="no"):
        sinks.write_named(df, f"file://{tmp_path}/out")
    assert files(tmp_path / "out") == [] and list((tmp_path / "out").glob("_writing*")) == []


def test_tasks_that_are_tried_again_leave_no_extra_row(tmp_path):
    """In a session of its own that tries tasks again: each task's first attempt fails after it has written."""
    code = """
        import sys
        from pyspark.sql import SparkSession, functions as F
        from lodestone.sources import jsonl, sinks
        spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3").getOrCreate()
        spark.sparkContext.setLogLevel("OFF")
        def once(batches):
            from pyspark import TaskContext
            for k, b in enumerate(batches):
                yield b
                if TaskContext.get().attemptNumber() == 0 and k == 1:
                    raise OSError("lost")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
        rows = spark.range(0, 2000, 1, 3).selectExpr("cast(id as string) value").mapInArrow(once, "value string")
        sinks.write_dealt(rows, sys.argv[1] + "/dealt", 150)
        jsonl.write_jsonl(spark.range(0, 900, 1, 2).mapInArrow(once, "id long"), sys.argv[1] + "/rows", 400)
    """
    script = tmp_path / "job.py"
    script.write_text(textwrap.dedent(code))
    root = Path(__file__).resolve().parents[1]
    subprocess.run([sys.executable, str(script), f"file://{tmp_path}"], check=True, timeout=240, env=os.environ | {"PYTHONPATH": str(root)}, capture_output=True)
    got = sorted(x for f in files(tmp_path / "dealt") for x in read(tmp_path / "dealt" / f))
    assert got == list(range(2000))
    assert sorted(x["id"] for f in files(tmp_path / "rows") for x in read(tmp_path / "rows" / f)) == list(range(900))
    assert all(len(read(tmp_path / "dealt" / f)) <= 150 for f in files(tmp_path / "dealt"))


def test_shards_are_named_by_their_first_row(spark, tmp_path):
    df = spark.range(1050).select("id", F.concat(F.lit("t"), "id").alias("text"))
    for parts in (1, 9):
        out = tmp_path / f"s{parts}"
        sinks.write_shards(sampling.positions(df.repartition(parts), "id", 7), f"file://{out}", "position", 250)
        assert files(out) == sorted(f"shard_{k}.jsonl.zst" for k in (0, 250, 500, 750, 1000))
        assert [len(read(out / f"shard_{k}.jsonl.zst")) for k in (0, 250, 1000)] == [250, 250, 50]
    assert read(tmp_path / "s1/shard_250.jsonl.zst") == read(tmp_path / "s9/shard_250.jsonl.zst")


def test_numbered_shards_run_on_across_splits(spark, tmp_path):
    df = spark.range(100).withColumn("key", F.col("id").cast("string"))
    out = sampling.reshard(df, "key", 12, test=0.2)
    sinks.write_numbered(out, f"file://{tmp_path}/r", "split", "shard", 12, "position")
    names = files(tmp_path / "r")
    assert names == [*(f"test/shard_{k:02d}.jsonl.zst" for k in (10, 11)), *(f"train/shard_{k:02d}.jsonl.zst" for k in range(10))]
    assert sorted(r["id"] for n in names for r in read(tmp_path / "r" / n)) == list(range(100))
    sinks.write_numbered(sampling.reshard(df, "key", 3), f"file://{tmp_path}/one", "split", "shard", 3, "position")
    assert files(tmp_path / "one") == [f"shard_{k}.jsonl.zst" for k in range(3)]
