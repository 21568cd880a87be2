"""Prompt rendering, and annotation of rows by a pluggable annotator with a response cache."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import text as X
from lodestone.operators.answers import AnswerStore, Limits, call_all

SEPARATOR = "\n\n\n"
ROLES = ("system", "user", "assistant")
PROMPTS: dict[str, "Prompt"] = {}


@dataclass(frozen=True)
class Prompt:
    """What to ask, how the content is shown, what comes back, and which rows it is for."""

    name: str
    instructions: str
    schema: T.StructType
    preamble: str | None = None
    subset: Callable[[DataFrame], Column] | None = None
    max_length: int | None = None
    postprocess: Callable[[Column], Column] | None = None

    def register(self) -> "Prompt":
        if PROMPTS.get(self.name, self) != self:
            raise ValueError(f"prompt {self.name!r} is registered already")
        PROMPTS[self.name] = self
        return self

    def render(self, content: Column) -> Column:
        """Preamble, text block and instructions, three line feeds apart."""
        body = F.trim(X.squeeze_newlines(X.truncate(content, self.max_length)))
        parts = [F.lit(self.preamble)] if self.preamble else []
        return F.concat_ws(SEPARATOR, *parts, F.concat(F.lit("TEXT:\n"), body), F.lit(f"INSTRUCTIONS:\n{self.instructions}"))


def rubric(language: str, low: int = 1, high: int = 5) -> Prompt:
    """An educational-value prompt for code of one language."""
    schema = T.StructType([T.StructField("justification", T.StringType(), False), T.StructField("score", T.IntegerType(), False)])
    words = f"Judge how much a student of {language} can learn from the text. Say why in one sentence, then give a whole number from {low} (nothing) to {high} (a model lesson)."
    return Prompt(f"teaching_value_{language.lower().replace(' ', '_')}", words, schema)


#: The prompt that is there from the start.
PROSE = rubric("prose").register()


#: Topics with characters: fixed values.
TOPICS = ("write_fiction", "games_and_role_play")


def _of_topics(df: DataFrame) -> Column:
    if "topic" not in df.columns:
        raise ValueError("the prompt needs a field topic")
    return F.coalesce(F.col("topic").isin(*TOPICS), F.lit(False))


def _listed(answer: Column) -> Column:
    """The answer's names in place of its comma-separated text."""
    return answer.withField("names", X.character_list(answer["names"]))


#: Who appears in a story or a game, of conversations that are one.
CHARACTERS = Prompt(
    "story_characters",
    "Which characters with names of their own does the last message of the user mention? Answer with their names alone, in lower case, commas between them, or with nothing.",
    T.StructType([T.StructField("names", T.StringType(), False)]),
    subset=_of_topics,
    postprocess=_listed,
).register()


def json_schema(schema: T.DataType) -> dict:
    """A strict JSON schema: every property is required and no other is allowed."""
    if isinstance(schema, T.StructType):
        return {"type": "object", "properties": {f.name: json_schema(f.dataType) for f in schema}, "required": schema.names, "additionalProperties": False}
    if isinstance(schema, T.ArrayType):
        return {"type": "array", "items": json_schema(schema.elementType)}
    if isinstance(schema, T.BooleanType):
        return {"type": "boolean"}
    if isinstance(schema, T.IntegralType):
        return {"type": "integer"}
    return {"type": "number" if isinstance(schema, T.NumericType) else "string"}


def conversation_prefix(turns: DataFrame, key: str, turn: str, role: str, until: str, last: bool = True) -> DataFrame:
    """Turns of a long table up to the last (or first) turn of role ``until``; conversations without it go."""
    w = Window.partitionBy(key)
    at = F.when(F.col(role) == until, F.col(turn))
    end = (F.max(at) if last else F.min(at)).over(w)
    return turns.withColumn("_end", end).where(F.col(turn) <= F.col("_end")).drop("_end")


def render_conversations(turns: DataFrame, key: str, turn: str, role: str, text: str, max_length: int | None = None) -> DataFrame:
    """``key, value``: the turns of each conversation as ROLE / CONTENT blocks under one header."""
    clean = X.sanitize_special_tokens(F.when(F.col(role) == "assistant", X.remove_think(F.col(text))).otherwise(F.col(text)))
    block = F.concat(F.lit("ROLE: "), F.col(role), F.lit("\nCONTENT: "), F.trim(clean))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), block.alias("b")))), lambda x: x["b"]), "\n\n")
    out = turns.groupBy(key).agg(joined.alias("value"))
    return out.withColumn("value", F.concat(F.lit("CONVERSATION:\n"), X.truncate(F.col("value"), max_length)))


Annotator = Callable[[list[str], dict], list[str]]


def length_annotator(prompts: list[str], schema: dict) -> list[str]:
    """The offline default: a score from 1 to 5 by length, as a model would answer in JSON."""
    out = []
    for p in prompts:
        n = len(p.split("TEXT:\n", 1)[-1].split(f"{SEPARATOR}INSTRUCTIONS:", 1)[0])
        out.append(json.dumps({"justification": f"{n} characters", "score": 1 + min(4, n // 1000)}))
    return out


@dataclass
class Run:
    """Rows with the new field, and rows whose answers could not be read."""

    rows: DataFrame
    rejected: DataFrame = field(repr=False)


def annotate(
    df: DataFrame,
    prompt: Prompt,
    content: str,
    annotator: Annotator = length_annotator,
    limit: int | None = None,
    reprocess: bool = False,
    cache: DataFrame | None = None,
    batch: int = 2000,
    store: AnswerStore | None = None,
    invalidate: bool = False,
    limits: Limits | None = None,
    run: str | None = None,
) -> Run:
    """Add field ``prompt.name``. Rows that have it pass through unless ``reprocess``; ``limit`` bounds new rows.

    ``cache`` (prompt_hash, response; of repeated hashes the largest response) and then ``store`` are asked
    before the annotator, and one answer serves equal prompts. With a store the new answers are written
    to it (under ``run``) before anything is returned, so none is asked for twice; ``invalidate`` asks for
    all again and lets the new answers win. With ``limits`` each prompt is a call of its own within
    them, and a call that fails leaves a rejected row with its ``_error``.
    """
    done = df.schema.fieldNames().count(prompt.name) > 0 and not reprocess
    passed = df.where(F.col(prompt.name).isNotNull()) if done else None
    todo = (df.where(F.col(prompt.name).isNull()) if done else df).drop(prompt.name)
    if prompt.subset:
        todo = todo.where(prompt.subset(todo))
    if limit is not None:
        todo = todo.limit(limit)
    asked = todo.withColumn("_prompt", prompt.render(F.col(content))).withColumn("_hash", F.sha2("_prompt", 256))
    schema = json_schema(prompt.schema)

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lo in range(0, len(f), batch):
                part = f.iloc[lo : lo + batch]
                yield pd.DataFrame({"_hash": part["_hash"], "_response": annotator(part["_prompt"].tolist(), schema), "_error": None})

    wanted = asked.select("_hash", "_prompt").dropDuplicates(["_hash"])
    known = None
    if cache is not None:
        known = cache.where("prompt_hash is not null").groupBy("prompt_hash").agg(F.max("response").alias("response"))
    if store is not None and not invalidate:
        stored = store.read()
        known = stored if known is None else known.unionByName(stored.join(known, "prompt_hash", "left_anti"))
    new = wanted
    if known is not None:
        known = known.select(F.col("prompt_hash").alias("_hash"), F.col("response").alias("_response"), F.lit(None).cast("string").alias("_error")).join(wanted.select("_hash"), "_hash", "left_semi")
        new = wanted.join(known, "_hash", "left_anti")
    if limits is not None:
        answers = call_all(new, lambda text: annotator([text], schema)[0], limits)
    else:
        answers = new.mapInPandas(call, "_hash string, _response string, _error string")
    if store is not None:
        answers = _stored(answers, store, run)
    if known is not None:
        answers = answers.unionByName(known)
    parsed = F.from_json("_response", prompt.schema)
    scored = asked.join(answers, "_hash", "left").withColumn(prompt.name, parsed)
    good = F.col(prompt.name).isNotNull() & F.col(f"{prompt.name}.{prompt.schema.names[-1]}").isNotNull()
    rows = scored.where(good).drop("_prompt", "_hash", "_response", "_error")
    if prompt.postprocess:
        rows = rows.withColumn(prompt.name, prompt.postprocess(F.col(prompt.name)))
    if passed is not None:
        rows = rows.unionByName(passed, allowMissingColumns=True)
    return Run(rows, scored.where(~F.coalesce(good, F.lit(False))).select(*todo.columns, "_response", "_error"))


def _stored(answers: DataFrame, store: AnswerStore, run: str | None) -> DataFrame:
    """The answers after they were asked for once: responses go to the store, errors beside it."""
    spark = store.spark
    place = f"{store.path}/asked-{uuid.uuid4().hex}"
    answers.write.parquet(place)
    told = spark.read.schema("_hash string, _response string, _error string").parquet(place)
    if not told.where("_response is not null").isEmpty():
        store.append(told.select(F.col("_hash").alias("prompt_hash"), F.col("_response").alias("response")), run)
    return told
