"""JSON lines datasets: scans by file suffix, split folders, and sinks that keep the folder structure."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Suffixes that a dataset's files may have, compared with all suffixes of a name.
SUFFIXES = tuple(f".{kind}{code}" for kind in ("jsonl", "json") for code in ("", ".gz", ".gzip", ".zst", ".zstd"))


def list_files(spark: SparkSession, folder: str, recursive: bool = True) -> list[str]:
    """Files below ``folder`` whose joined suffixes are known, in order; names alone, from Hadoop's listing."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(folder)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found, files = [], system.listFiles(place, recursive)
    while files.hasNext():
        path = files.next().getPath()
        name = path.getName()
        at = name.find(".", 1)
        if at > 0 and name[at:] in SUFFIXES:
            found.append(path.toString())
    return sorted(found)


def read_lines(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """``value, file, at``: raw lines, not parsed; ``at`` orders the lines of a file."""
    files = list_files(spark, folder, recursive)
    packed = [f for f in files if f.endswith((".zst", ".zstd"))]
    plain = [f for f in files if f not in set(packed)]
    out = _zstd_lines(spark, packed)
    if plain:
        out = out.unionByName(spark.read.text(plain).select("value", F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("at")))
    return out


def _zstd_lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """Lines of zstd files, streamed by the executors; such files cannot be split, so each is one task's."""

    def run(batches: Iterator) -> Iterator:
        import io
        import re

        import pyarrow as pa
        import zstandard
        from pyarrow import fs

        for batch in batches:
            for file in batch.column(0).to_pylist():
                system, path = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", file))
                with system.open_input_stream(path, compression=None) as f, zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True) as raw:
                    lines, row = io.TextIOWrapper(raw, encoding="utf-8", newline="\n"), 0
                    while chunk := lines.readlines(4 << 20):
                        values = [x.removesuffix("\n").removesuffix("\r") for x in chunk]
                        at = pa.StructArray.from_arrays([pa.array([0] * len(values), pa.int64()), pa.array(range(row, row + len(values)), pa.int64())], ["block", "row"])
                        row += len(values)
                        yield pa.RecordBatch.from_arrays([pa.array(values), pa.array([file] * len(values)), at], ["value", "file", "at"])

    names = spark.createDataFrame([(f,) for f in files], "file string")
    return names.repartition(max(1, min(len(files), 10_000)), "file").mapInArrow(run, "value string, file string, at struct<block: long, row: long>")


def read_jsonl(spark: SparkSession, folder: str, schema: T.StructType | str, tolerant: bool = False) -> DataFrame:
    """Rows with the fields of ``schema`` and ``file``; lines that cannot be read are skipped if ``tolerant``, else an error."""
    lines = read_lines(spark, folder)
    parsed = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE" if tolerant else "FAILFAST"}).alias("r"), "file", F.try_parse_json("value").isNotNull().alias("ok"))
    return parsed.where("ok" if tolerant else "true").select("r.*", "file")


def read_dataset(spark: SparkSession, folders: list[str], schema: T.StructType | str, required: tuple[str, ...] = ("train", "test"), optional: tuple[str, ...] = ("valid",)) -> DataFrame:
    """Split folders of several datasets as one table with ``split``; a required split that is missing is an error."""
    out = None
    for folder in folders:
        for split in (*required, *optional):
            place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{split}")
            if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
                if split in required:
                    raise FileNotFoundError(f"{folder}/{split}")
                continue
            rows = read_jsonl(spark, f"{folder}/{split}", schema).withColumn("split", F.lit(split))
            out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise FileNotFoundError("no split folder")
    return out


def write_jsonl(df: DataFrame, folder: str, max_rows: int = 100_000, zstd: bool = True) -> list[str]:
    """``shard_*.jsonl.zst`` (or .gz) of at most ``max_rows``; the names of all. Safe under retries (see ``sinks``)."""
    if not zstd:
        df.write.mode("append").option("maxRecordsPerFile", max_rows).option("compression", "gzip").json(folder)
        return list_files(df.sparkSession, folder)

    from lodestone.sources import sinks

    return [f"{folder}/{w.name}" for w in sinks.write_dealt(df.select(sinks.json_line(df).alias("value")), folder, max_rows)]


def write_by_split(df: DataFrame, folder: str, max_rows: int = 100_000) -> dict[str, list[str]]:
    """A folder for each split that has rows."""
    out = {}
    for split in [r.split for r in df.select("split").distinct().collect()]:
        out[split] = write_jsonl(df.where(F.col("split") == split).drop("split"), f"{folder}/{split}", max_rows)
    return out


def write_lines(df: DataFrame, folder: str, value: str = "value") -> None:
    """Rendered lines as text, a folder for each split."""
    df.select("split", value).write.mode("overwrite").partitionBy("split").text(folder)


def to_yaml(value: object, digits: int = 4, indent: int = 0) -> str:
    """Nested results as YAML, floats rounded."""
    pad = " " * indent
    if isinstance(value, dict):
        return "".join(f"{pad}{k}:\n{to_yaml(v, digits, indent + 2)}" if isinstance(v, (dict, list)) else f"{pad}{k}: {to_yaml(v, digits).strip()}\n" for k, v in value.items())
    if isinstance(value, list):
        return "".join(f"{pad}- {to_yaml(v, digits).strip()}\n" for v in value)
    if isinstance(value, float):
        return f"{pad}{round(value, digits)}\n"
    return f"{pad}{json.dumps(value, ensure_ascii=False)}\n"


def results(per_class: DataFrame, overall: DataFrame) -> dict:
    """A report's frames (a row a class; one row) as nested values."""
    return {"overall": overall.first().asDict(), "classes": {str(r["label"]): {k: v for k, v in r.asDict().items() if k != "label"} for r in per_class.orderBy("label").collect()}}
