"""Row reshaping, line rendering for linear classifiers, densifying of maps, write-back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import jq
from lodestone.functions import text as X

LABEL = "__label__"


def transform_rows(df: DataFrame, text: str = "{text: .text}", label: str = "{score: .score}") -> DataFrame:
    """The union of two object constructors; the second wins."""
    columns = jq.compile_object(text, df) | jq.compile_object(label, df)
    return df.select(*(c.alias(k) for k, c in columns.items()))


def normalize_rows(df: DataFrame, normalizer: str = "plsfix", text: str = "text", label: str | None = None, max_length: int | None = None) -> DataFrame:
    """Text and label normalised in place, other fields kept; texts are cut before they are normalised."""
    df = df.withColumn(text, X.get_normalizer(normalizer)(X.truncate(F.col(text).cast("string"), max_length)))
    return df.withColumn(label, X.normalize_label(F.col(label).cast("string"))) if label else df


def labelled_text(df: DataFrame, text: str = ".text", label: str = ".score", normalizer: str | None = None, max_length: int | None = None) -> DataFrame:
    """``text, label`` strings by expression; a null is an error under ANSI rules, as in a strict reader."""
    body = X.truncate(jq.compile_expression(text, df).cast("string"), max_length)
    body = X.get_normalizer(normalizer)(body) if normalizer else body
    rows = df.select(body.alias("text"), jq.compile_expression(label, df).cast("string").alias("label"))
    return rows.where(F.expr("assert_true(text is not null and label is not null, 'null text or label') is null"))


def truthy(c: Column, kind: T.DataType) -> Column:
    """Python's truth of a value: zero, empty and null are false."""
    if isinstance(kind, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    if isinstance(kind, T.NumericType):
        return F.coalesce(c != 0, F.lit(False))
    return F.coalesce(F.length(c) > 0, F.lit(False)) if isinstance(kind, T.StringType) else F.coalesce(F.size(c) > 0, F.lit(False))


def render_lines(df: DataFrame, text: str = "text", label: str = "label", normalizer: str = "whitespace", max_length: int | None = None) -> DataFrame:
    """``value``: one line a row, the marked label and then the text."""
    body = X.get_normalizer(normalizer)(X.unwrap_labels(X.truncate(F.col(text), max_length)))
    return df.withColumn("value", F.concat_ws(" ", F.concat(F.lit(LABEL), X.normalize_label(F.col(label).cast("string"))), body))


def render_multilabel(df: DataFrame, text: str = "text", labels: str = "labels", normalizer: str = "whitespace") -> DataFrame:
    """Lines with a marked label for each true key of a map, sorted; rows without one are dropped."""
    kind = df.schema[labels].dataType
    if not isinstance(kind, T.MapType):
        raise TypeError(f"{labels} must be a map")
    keys = F.array_sort(F.map_keys(F.map_filter(labels, lambda _, v: truthy(v, kind.valueType))))
    marked = F.transform(keys, lambda k: F.concat(F.lit(LABEL), X.normalize_label(k)))
    body = X.get_normalizer(normalizer)(X.unwrap_labels(F.col(text)))
    return df.withColumn("value", F.when(F.size(marked) > 0, F.concat_ws(" ", F.array_join(marked, " "), body))).where("value is not null")


def parse_lines(df: DataFrame, value: str = "value") -> DataFrame:
    """``label, text`` of rendered lines: split at the first space; further labels stay in the text."""
    first = F.split_part(F.col(value), F.lit(" "), F.lit(1))
    return df.withColumns({"label": first, "text": F.expr(f"substring({value}, length(split_part({value}, ' ', 1)) + 2)")})


def dictionary_keys(df: DataFrame, column: str) -> DataFrame:
    """``key``: the distinct keys of a map column."""
    return df.select(F.explode(F.map_keys(column)).alias("key")).distinct()


def densify(df: DataFrame, column: str, keys: list[str], out: str = "features") -> DataFrame:
    """A map as an array in the order of ``keys``; missing is 0."""
    values = [F.coalesce(F.try_element_at(F.col(column), F.lit(k)).cast("double"), F.lit(0.0)) for k in keys]
    return df.withColumn(out, F.array(*values))


def write_back(df: DataFrame, name: str, value: Column, column: str = "metadata") -> DataFrame:
    """``column.name = value``; the struct is made where it is missing."""
    if column in df.columns:
        return df.withColumn(column, F.coalesce(F.col(column), F.struct(*(F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema[column].dataType))).withField(name, value))
    return df.withColumn(column, F.struct(value.alias(name)))


def concatenate(*frames: DataFrame) -> DataFrame:
    """Bag union by name; columns that a frame lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def signature(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """``rows, signature``: a fingerprint that does not depend on the order of rows."""
    h = F.conv(F.substring(F.md5(F.concat_ws("\t", text, label)), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("signature"))
