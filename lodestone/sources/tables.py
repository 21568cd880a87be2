"""Intermediate tables in the folder that a cluster's driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local folder that goes with the driver only where none is set on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="lodestone-tables-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return f"file://{_own[0]}"


class Tables:
    """Tables that one piece of work writes and reads again; :meth:`drop` deletes them when it is over."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder = spark, f"{shared_folder(spark)}/lodestone/{uuid.uuid4().hex}"
        self.n = 0

    def written(self, df: DataFrame) -> DataFrame:
        """``df`` as a table: made once, its lineage cut, and whole if an executor is lost."""
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
