"""What the operators share: reading tables, written tables in the shared folder, packed arrays.

Intermediate results that are read more than once are written as Parquet below
``spark.checkpoint.dir`` (a folder that the driver and all executors share), so a lost executor
only costs the tasks it ran. They stay until :func:`release` or the end of the driver.
"""

from __future__ import annotations

import atexit
import gc
import json
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_shipped: set[str] = set()
_made: list[str] = []
_own: list[str] = []


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="lodestone-ship-")) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, or a local one where none is set (tests on one machine)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        folder = spark._jvm.org.apache.hadoop.fs.Path(base)
        whole = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString()
        return re.sub("^file:/+", "file:///", whole).rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="lodestone-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return f"file://{_own[0]}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new place below the shared folder."""
    path = f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
    if not _made and spark.sparkContext.master.startswith("local"):
        atexit.register(_sweep)
    _made.append(path)
    return path


def _sweep() -> None:
    """On one machine, what is left when the driver ends goes with it."""
    for path in _made:
        if path.startswith("file:///"):
            shutil.rmtree(path.removeprefix("file://"), True)


def release(spark: SparkSession) -> None:
    """Delete what this session wrote to the shared folder; frames that read it end with that."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _made:
        place = jvm.org.apache.hadoop.fs.Path(_made.pop())
        place.getFileSystem(conf).delete(place, True)


#: Whether Spark drops the shuffle files of an execution when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, and each row is made once.

    Its shuffle files go as soon as it is written, as nothing reads them again.
    """
    path = scratch(df.sparkSession, name)
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path, partitionBy=partition_by)
    finally:
        conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table of :func:`written` that nothing will read again."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        place = jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(conf).delete(place, True)


def tidy(spark: SparkSession) -> None:
    """Let the driver drop the shuffle files of plans that are over: Spark does so when it collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of an input table."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of ``uri``, as executors reach it."""
    return fs.FileSystem.from_uri(uri)


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text (null: empty) of ``docs``, whatever else it has."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def batched(df: DataFrame, limit: str = "4m") -> DataFrame:
    """Bound the bytes of the Arrow batches that Python stages get: texts can be very long."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", limit)
    return df


def n_targets(spark: SparkSession) -> int:
    """Parts into which a key space is hashed; follows the session's shuffle width."""
    return 2 * max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))


def crc_split(mod: int):
    """Whether a document is held out: crc32 of its id as text, modulo ``mod``, is 0 (null id: as empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % mod == 0


def let(value: str, name: str, body: str) -> str:
    """SQL of ``body`` with ``name`` standing for ``value``, which is evaluated once.

    A column would do if the optimiser did not copy a column's expression into a lambda that names it
    once, where it is evaluated for each element.
    """
    return f"transform(array({value}), {name} -> {body})[0]"


def narrow(a: np.ndarray) -> np.ndarray:
    """Non-negative integers in the smallest type that holds them."""
    a = np.asarray(a)
    top = int(a.max()) if a.size else 0
    return a.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))


def pack(*arrays: np.ndarray) -> bytes:
    """Flat arrays as one compressed string of bytes, byte planes apart (small numbers leave zeros together)."""
    arrays = [np.ascontiguousarray(a) for a in arrays]
    head = json.dumps([[a.dtype.str, a.size] for a in arrays]).encode()
    planes = (np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(b"".join([len(head).to_bytes(4, "little"), head, *planes]))


def unpack(data: bytes) -> list[np.ndarray]:
    """The arrays given to :func:`pack`."""
    body = zstandard.ZstdDecompressor().decompress(data)
    at = 4 + int.from_bytes(body[:4], "little")
    out = []
    for kind, size in json.loads(body[4:at]):
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(body, np.uint8, count=size * width, offset=at).reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(-1))
        at += size * width
    return out


def pack_words(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as (lengths, blob)."""
    return narrow(np.fromiter(map(len, words), np.int64, len(words))), np.frombuffer(b"".join(words), np.uint8)


def unpack_words(lengths: np.ndarray, blob: np.ndarray) -> list[bytes]:
    data, ends = blob.tobytes(), np.cumsum(lengths.astype(np.int64)).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def gather(starts: np.ndarray, lengths: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The runs data[start : start + length], one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    index = np.ones(total, np.int32 if len(data) < 1 << 31 else np.int64)
    full = lengths > 0
    s, n = starts[full], lengths[full]
    if total:
        at = np.concatenate(([0], np.cumsum(n)[:-1]))
        index[at] = s - np.concatenate(([0], s[:-1] + n[:-1] - 1))
        np.cumsum(index, out=index)
    return data[index[:total]]


def arrow_schema(spark_schema: T.StructType):
    """The Arrow form of a Spark schema."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark_schema)
