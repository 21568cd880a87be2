"""Sinks of JSON lines files whose names mean something, safe under retries and speculation.

A task attempt writes to files of its own in a hidden job folder and reports those it closed. Spark
keeps the report of one attempt for each task, so the reports together are a manifest in which every
row occurs once; the driver gives the files of the manifest their final names and removes the rest.
Nothing appears under a final name before all tasks are done.

Rows name the file they go to. A file is written by one task, in the order asked for, and streamed;
its compression follows its suffix (none, .gz, .gzip, .zst, .zstd).
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.jsonl import list_files

MANIFEST = "temp string, name string, n_rows long, n_bytes long"
_ZST = (".zst", ".zstd")


@dataclass(frozen=True)
class Written:
    """A file under its final name (relative to the sink's folder)."""

    name: str
    n_rows: int
    n_bytes: int


def _open(system, path: str, name: str):
    """A stream of bytes into ``path``, compressed as ``name`` says."""
    import gzip

    import zstandard

    raw = system.open_output_stream(path, compression=None)
    if name.endswith(_ZST):
        return zstandard.ZstdCompressor().stream_writer(raw, closefd=True)
    if name.endswith((".gz", ".gzip")):
        return _Both(gzip.GzipFile(fileobj=raw, mode="wb", mtime=0), raw)
    return raw


class _Both:
    """A compressing stream that closes the one below."""

    def __init__(self, top, below) -> None:
        self.top, self.below = top, below

    def write(self, data: bytes) -> None:
        self.top.write(data)

    def close(self) -> None:
        self.top.close()
        self.below.close()


def attempt_writer(job: str, attempt: str):
    """The function of one task attempt: from batches of (name, value), sorted by name, to its manifest."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(job)
        system.create_dir(root, recursive=True)
        done: list[tuple] = []
        sink = name = temp = None
        rows = size = 0

        def close() -> None:
            if sink is not None:
                sink.close()
                done.append((temp, name, rows, size))

        for batch in batches:
            for its, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if its != name:
                    close()
                    name, temp, rows, size = its, f"{attempt}-{len(done)}", 0, 0
                    sink = _open(system, f"{root}/{temp}", name)
                data = line.encode() + b"\n"
                sink.write(data)
                rows, size = rows + 1, size + len(data)
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done) if done else [()] * 4, (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["temp", "name", "n_rows", "n_bytes"])

    return run


def _task(job: str):
    def run(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        c = TaskContext.get()
        yield from attempt_writer(job, f"{c.partitionId()}-{c.taskAttemptId()}")(batches)

    return run


def _system(spark: SparkSession, uri: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def commit(spark: SparkSession, job: str, folder: str, manifest: Sequence[tuple]) -> list[Written]:
    """Give the manifest's files their names; an older file of the name is replaced, what no manifest names goes."""
    twice = [n for n, k in Counter(row[1] for row in manifest).items() if k > 1]
    system, place = _system(spark, job)
    if twice:
        system.delete(place, True)
        raise ValueError(f"several tasks wrote {sorted(twice)[:3]}")
    out = []
    for temp, name, rows, size in sorted(manifest, key=lambda r: r[1]):
        _, final = _system(spark, f"{folder}/{name}")
        system.mkdirs(final.getParent())
        if system.exists(final):
            system.delete(final, False)
        if not system.rename(_system(spark, f"{job}/{temp}")[1], final):
            raise OSError(f"{name} could not be named; its rows are in {job}/{temp}")
        out.append(Written(name, rows, size))
    system.delete(place, True)
    return out


def write_named(rows: DataFrame, folder: str, name: str = "name", value: str = "value", order: Sequence[str | Column] = ()) -> list[Written]:
    """Write each row's ``value`` as a line of the file that its ``name`` gives (relative to ``folder``)."""
    spark = rows.sparkSession
    job = f"{folder.rstrip('/')}/_writing-{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, F.col(name)).sortWithinPartitions(name, *order)
    lines = dealt.select(F.col(name).alias("name"), F.col(value).alias("value"))
    try:
        manifest = [tuple(r) for r in lines.mapInArrow(_task(job), MANIFEST).collect()]  # a row a file
    except BaseException:
        system, place = _system(spark, job)
        system.delete(place, True)
        raise
    return commit(spark, job, folder, manifest)


def write_dealt(lines: DataFrame, folder: str, max_rows: int = 100_000, suffix: str = ".jsonl.zst") -> list[Written]:
    """``shard_<uuid>`` files of at most ``max_rows`` of the lines of ``value`` as they lie: no shuffle."""
    spark = lines.sparkSession
    job = f"{folder.rstrip('/')}/_writing-{uuid.uuid4().hex}"
    write = _task(job)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def named() -> Iterator:
            name, left = "", 0
            for batch in batches:
                at = 0
                while at < len(batch):
                    if not left:
                        name, left = f"shard_{uuid.uuid4().hex}{suffix}", max_rows
                    part = batch.slice(at, left)
                    at, left = at + len(part), left - len(part)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), part.column(0)], ["name", "value"])

        yield from write(named())

    return commit(spark, job, folder, [tuple(r) for r in lines.select("value").mapInArrow(run, MANIFEST).collect()])


def json_line(df: DataFrame, *drop: str) -> Column:
    """All columns but ``drop`` as one line of JSON, nulls included."""
    return F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns if c not in drop)), {"ignoreNullFields": "false"})


def file_sizes(spark: SparkSession, folder: str) -> dict[str, int]:
    """Bytes of each data file of ``folder`` as it is stored."""
    system, _ = _system(spark, folder)
    return {file: system.getFileStatus(_system(spark, file)[1]).getLen() for file in list_files(spark, folder)}


def relative_names(spark: SparkSession, folders: Sequence[str]) -> dict[str, str]:
    """The path of each data file of ``folders`` below its folder; two files of one path are an error."""
    out: dict[str, str] = {}
    for folder in folders:
        _, place = _system(spark, folder)
        system, _ = _system(spark, folder)
        root = system.makeQualified(place).toString().rstrip("/")
        for file in list_files(spark, folder):
            out[file] = file.removeprefix(root).lstrip("/")
    twice = sorted(n for n, k in Counter(out.values()).items() if k > 1)
    if twice:
        raise ValueError(f"several inputs have the relative path {twice[0]}: their outputs would overwrite each other")
    return out


def relative_name(folders: Sequence[str], file: str = "file") -> Column:
    """The part of ``file`` below whichever of ``folders`` holds it."""
    out = F.col(file)
    for folder in folders:
        root = folder.rstrip("/").split(":", 1)[-1].lstrip("/")
        # Schemes are written with one slash or three.
        at = F.locate(f"/{root}/", out)
        out = F.when(at > 0, F.substring(out, at + len(root) + 2, 1 << 30)).otherwise(out)
    return out


def write_like(df: DataFrame, folders: Sequence[str], out: str, file: str = "file", order: Sequence[str] = (), value: str | None = None) -> list[Written]:
    """A file for each input file: rows that came from ``file`` go to the same path below ``out``.

    ``value`` names a column of lines as they are; without it all other columns are written as JSON.
    Files none of whose rows are left are not written.
    """
    relative_names(df.sparkSession, folders)
    line = F.col(value) if value else json_line(df, file, *order)
    return write_named(df.select(relative_name(folders, file).alias("name"), line.alias("value"), *order), out, order=order)


def write_shards(df: DataFrame, folder: str, position: str, rows: int = 100_000, suffix: str = ".jsonl.zst") -> list[Written]:
    """Shards of exactly ``rows`` rows (the last may have fewer) by the gapless ``position``, named by their first one."""
    first = (F.col(position) - F.pmod(F.col(position), F.lit(rows))).cast("long")
    named = df.select(F.concat(F.lit("shard_"), first, F.lit(suffix)).alias("name"), json_line(df, position).alias("value"), F.col(position).alias("_at"))
    return write_named(named, folder, order=["_at"])


def write_numbered(df: DataFrame, folder: str, split: str, shard: str, shards: int, order: str, value: str | None = None) -> list[Written]:
    """``<split>/shard_<k>.jsonl.zst``, k zero-padded and running on across splits; without several splits no split folder."""
    digits = len(str(shards))
    splits = df.select(split).distinct().count()
    name = F.concat(F.concat(F.col(split), F.lit("/")) if splits > 1 else F.lit(""), F.lit("shard_"), F.lpad(F.col(shard).cast("string"), digits, "0"), F.lit(".jsonl.zst"))
    line = F.col(value) if value else json_line(df, split, shard, order)
    return write_named(df.select(name.alias("name"), line.alias("value"), F.col(order).alias("_at")), folder, order=["_at"])


def write_text(spark: SparkSession, path: str, text: str) -> str:
    """A small text of the driver's as a file, in any store that Hadoop reaches."""
    system, place = _system(spark, path)
    out = system.create(place, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return path


def write_results(spark: SparkSession, folder: str, text: str) -> str:
    """``results_<first six digits of the text's SHA-256>.yaml``."""
    import hashlib

    return write_text(spark, f"{folder.rstrip('/')}/results_{hashlib.sha256(text.encode()).hexdigest()[:6]}.yaml", text)


def write_disagreements(diff: DataFrame, folder: str, names: tuple[str, str], max_rows: int = 100_000) -> list[Written]:
    """Rows of ``compare.keyed_diff`` as JSON lines: text, both values, both names, both whole rows."""
    out = diff.select(
        F.col("key").alias("text"),
        F.col("value1").alias("value_file1"),
        F.col("value2").alias("value_file2"),
        F.lit(names[0]).alias("file1_name"),
        F.lit(names[1]).alias("file2_name"),
        F.col("row1").alias("row_file1"),
        F.col("row2").alias("row_file2"),
    )
    return write_dealt(out.select(json_line(out).alias("value")), folder, max_rows)
