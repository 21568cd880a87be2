"""Typed loaders of dataset folders: inferred rows, rendered lines, predictions, annotations, vocabularies."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import jq
from lodestone.functions.text import py_str
from lodestone.operators import rows
from lodestone.operators.stats import dense_ranks
from lodestone.sources import jsonl

#: What a label can be: a whole number, a number, or text.
LABEL_TYPES = {"ordinal": "int", "value": "double", "text": "string"}


def inferred(spark: SparkSession, folder: str, placed: bool = False) -> DataFrame:
    """All lines of ``folder`` with the fields they have, and ``split`` and ``file``; ``_at``, a line's place, if ``placed``."""
    lines = jsonl.read_lines(spark, folder)
    strings = getattr(lines.select("value")._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    schema = DataFrame(spark._jsparkSession.read().json(strings), spark).schema
    split = F.regexp_extract("file", r"/(train|test|valid)/[^/]*$", 1)
    at = [F.col("at").alias("_at")] if placed else []
    return lines.select(F.from_json("value", schema).alias("r"), "file", split.alias("split"), *at).select("r.*", "file", "split", *(["_at"] if placed else []))


def union(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def required(value: Column, name: str) -> Column:
    """``value``, or an error where it is null."""
    return F.when(value.isNull(), F.raise_error(F.lit(f"{name} gives null for a row"))).otherwise(value)


def predictions_and_labels(spark: SparkSession, folders: Sequence[str], prediction: str, label: str) -> DataFrame:
    """``prediction double, label, rank``: both by expression, null is an error; ``rank`` numbers the distinct labels in order."""
    parts = []
    for folder in folders:
        df = inferred(spark, folder)
        score = jq.compile_expression(prediction, df).cast("double")
        parts.append(df.select(required(score, prediction).alias("prediction"), required(jq.compile_expression(label, df), label).alias("label")))
    return dense_ranks(union(parts), "label").select("prediction", "label", "rank")


def labels_and_keys(spark: SparkSession, folder: str, label: str, key: str | None = None, kind: str = "text") -> DataFrame:
    """``label, key, file``: a label that cannot be of its ``kind`` (ordinal, value, text) is an error; keys as Python writes them."""
    if kind not in LABEL_TYPES:
        raise ValueError(f"a label's kind is one of {', '.join(LABEL_TYPES)}")
    df = inferred(spark, folder)
    value = jq.compile_expression(label, df)
    typed = py_str(value, df.select(value.alias("x")).schema["x"].dataType.simpleString()) if kind == "text" else value.cast(LABEL_TYPES[kind])
    if key is None:
        named = F.lit(None).cast("string")
    else:
        given = jq.compile_expression(key, df)
        named = required(py_str(given, df.select(given.alias("x")).schema["x"].dataType.simpleString()), key)
    return df.select(required(typed, label).alias("label"), named.alias("key"), "file")


@dataclass
class Keyed:
    """``rows``: key, value, row (as JSON), file, at. ``skipped``: file, unreadable, without_key."""

    rows: DataFrame
    skipped: DataFrame


def keyed_values(spark: SparkSession, folder: str, key: str, value: str) -> Keyed:
    """Rows by the text of field ``key`` with ``value`` (an expression); lines that cannot be read or lack the field are counted."""
    lines = jsonl.read_lines(spark, folder)
    parsed = F.try_parse_json("value")
    read = lines.withColumns({"_ok": parsed.isNotNull() & F.startswith(F.ltrim(F.col("value")), F.lit("{"))})
    has = F.array_contains(F.json_object_keys("value"), key)
    marked = read.withColumn("_has", F.when(F.col("_ok"), F.coalesce(has, F.lit(False))).otherwise(False))
    skipped = marked.groupBy("file").agg(F.count_if(~F.col("_ok")).alias("unreadable"), F.count_if(F.col("_ok") & ~F.col("_has")).alias("without_key"))
    df = inferred(spark, folder, placed=True)
    good = marked.where("_has").select("value", "file", "at")
    schema = df.drop("file", "split", "_at").schema
    typed = good.select(F.from_json("value", schema).alias("r"), F.col("value").alias("_row"), F.col("file").alias("_file"), F.col("at").alias("_place")).select("r.*", "_row", "_file", "_place")
    out = typed.select(F.col(f"`{key}`").cast("string").alias("key"), jq.compile_expression(value, typed).alias("value"), F.col("_row").alias("row"), F.col("_file").alias("file"), F.col("_place").alias("at"))
    return Keyed(out, skipped)


def rendered_splits(spark: SparkSession, folders: Sequence[str], needed: Sequence[str] = ("train", "test"), optional: Sequence[str] = ("valid",)) -> DataFrame:
    """``label, text, split`` of the rendered lines of several folders: ``<split>.txt``, or folders ``split=<split>``."""
    parts = []
    for folder in folders:
        for split in (*needed, *optional):
            for name in (f"{folder}/{split}.txt", f"{folder}/split={split}"):
                place = spark._jvm.org.apache.hadoop.fs.Path(name)
                if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
                    parts.append(rows.parse_lines(spark.read.text(name)).select("label", "text", F.lit(split).alias("split")))
                    break
            else:
                if split in needed:
                    raise FileNotFoundError(f"{folder}: no {split} lines")
    return union(parts)


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """``token``: the lines of a text file, trimmed; repeated and empty ones once and not at all."""
    return spark.read.text(path).select(F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("token")).where("token <> ''").distinct()
