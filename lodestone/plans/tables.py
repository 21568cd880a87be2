"""Input tables and the derived ones that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have labels."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")


#: The second annotator of the agreement queries: a rule over length, on a three-step scale.
GRADE = "CASE WHEN n_chars < 600 THEN 0 WHEN n_chars < 2000 THEN 1 ELSE 2 END"
OTHER = "CASE WHEN length(source) > 4 THEN 2 WHEN n_chars % 3 = 0 THEN 0 ELSE 1 END"
#: A score in [0, 1] with ties, for ranking and calibration metrics.
SCORE = "(n_chars % 1000) / 1000.0"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.expr("(n_chars % 1000) / cast(1000 as double)").alias("score"), F.expr(GRADE).alias("grade"))


SCORED = f"(SELECT doc_id, lang, (n_chars % 1000) / 1000.0::DOUBLE AS score, {GRADE} AS grade FROM documents)"


def unit(seed: int, key: str) -> str:
    """DuckDB's form of the engine's hash number."""
    return f"(('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
