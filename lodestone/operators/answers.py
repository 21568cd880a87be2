"""Answers of annotators: a store with last write wins, and calls within shared limits.

The store is a folder of Parquet. Each run appends under its own number, so a run that is repeated
replaces what it wrote before; of several answers to one prompt the latest run's counts. Compaction
writes one base of the answers that count and then drops what it covers; readers take the newest
whole base and the runs after it, so a compaction that stops half-way changes nothing.
"""

from __future__ import annotations

import re
import threading
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "prompt_hash string, response string"


class AnswerStore:
    """``prompt_hash, response`` of all runs below ``path``, which all executors reach."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _folders(self, kind: str) -> dict[tuple[int, str], str]:
        """(number, run id) and path of each whole folder of a kind (``run`` or ``base``)."""
        jvm = self.spark._jvm
        top = jvm.org.apache.hadoop.fs.Path(self.path)
        system = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out: dict[tuple[int, str], str] = {}
        if not system.exists(top):
            return out
        for status in system.listStatus(top):
            name = status.getPath().getName()
            found = re.fullmatch(rf"{kind}-(\d+)-(\w+)", name)
            if found and system.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")):
                out[int(found[1]), found[2]] = f"{self.path}/{name}"
        return out

    def append(self, answers: DataFrame, run: str | None = None) -> str:
        """Add the answers of a run; one that bears the name of an earlier run takes its place. The run's name."""
        run = run or uuid.uuid4().hex
        if not re.fullmatch(r"\w+", run):
            raise ValueError("a run's name has letters, digits and _ only")
        known = {**self._folders("run"), **self._folders("base")}
        number = next((n for (n, name) in self._folders("run") if name == run), max((n for n, _ in known), default=0) + 1)
        answers.select("prompt_hash", "response").where("prompt_hash is not null and response is not null").write.mode("overwrite").parquet(f"{self.path}/run-{number:08d}-{run}")
        return run

    def read(self) -> DataFrame:
        """The answers that count: one row for each prompt hash."""
        bases, out = self._folders("base"), None
        last = max(bases, default=(0, ""))
        parts = [(last, bases[last])] if bases else []
        parts += sorted((k, p) for k, p in self._folders("run").items() if k[0] > last[0])
        for (number, run), path in parts:
            rows = self.spark.read.schema(SCHEMA).parquet(path).withColumn("_order", F.struct(F.lit(number).alias("n"), F.lit(run).alias("run")))
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            return self.spark.createDataFrame([], SCHEMA)
        return out.groupBy("prompt_hash").agg(F.max_by("response", F.struct("_order", "response")).alias("response"))

    def compact(self) -> None:
        """One base in place of all runs and bases so far."""
        runs, bases = self._folders("run"), self._folders("base")
        if not runs:
            return
        number = max(n for n, _ in {**runs, **bases})
        new = f"{self.path}/base-{number:08d}-{uuid.uuid4().hex}"
        self.read().write.parquet(new)
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in [*runs.values(), *bases.values()]:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


@dataclass(frozen=True)
class Limits:
    """What all tasks of an annotation may do together.

    ``tokens(prompt)`` counts what a call will use. A call that raises is tried ``retries`` times more,
    after ``backoff`` seconds, twice that, and so on.
    """

    requests_per_minute: int = 10_000
    tokens_per_minute: int = 100_000_000
    concurrent: int = 1_000
    new_tokens: int = 16_384
    retries: int = 3
    backoff: float = 1.0
    tokens: Callable[[str], int] = len
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep

    def shared(self, tasks: int) -> "Limits":
        """One task's share where ``tasks`` share these limits."""
        part = lambda n: max(1, n // tasks)
        return Limits(part(self.requests_per_minute), part(self.tokens_per_minute), part(self.concurrent), self.new_tokens, self.retries, self.backoff, self.tokens, self.clock, self.sleep)

    def tasks(self, most: int) -> int:
        """How many tasks can share these limits with at least one call each."""
        return max(1, min(most, self.requests_per_minute, self.concurrent))


class Limiter:
    """Lets calls go so that the requests and tokens of any 60 seconds stay within a task's limits."""

    def __init__(self, limits: Limits, late: bool = False) -> None:
        self.limits, self.lock = limits, threading.Lock()
        self.calls: deque[tuple[float, int]] = deque()
        self.used = 0
        if late:  # what an earlier attempt of the task did in this minute is not known
            limits.sleep(60)

    def acquire(self, tokens: int) -> None:
        """Wait until one more call of ``tokens`` is allowed."""
        limits = self.limits
        if tokens > limits.tokens_per_minute:
            raise ValueError(f"a call of {tokens} tokens is over a task's {limits.tokens_per_minute} a minute")
        while True:
            with self.lock:
                now = limits.clock()
                while self.calls and self.calls[0][0] <= now - 60:
                    self.used -= self.calls.popleft()[1]
                if len(self.calls) < limits.requests_per_minute and self.used + tokens <= limits.tokens_per_minute:
                    self.calls.append((now, tokens))
                    self.used += tokens
                    return
                pause = self.calls[0][0] + 60 - now
            limits.sleep(max(pause, 1e-3))


def answered(items: Iterator[tuple[str, str]], ask: Callable[[str], str], limits: Limits, limiter: Limiter) -> Iterator[tuple[str, str | None, str | None]]:
    """(hash, response, error) of each (hash, prompt), as calls end; at most ``concurrent`` are under way or held.

    Every prompt has a row: after the last try the error in place of a response.
    """

    def one(prompt: str) -> str:
        for k in range(limits.retries + 1):
            try:
                limiter.acquire(limits.tokens(prompt) + limits.new_tokens)
                return ask(prompt)
            except Exception:
                if k == limits.retries:
                    raise
                limits.sleep(limits.backoff * 2**k)
        raise AssertionError

    with ThreadPoolExecutor(limits.concurrent) as pool:
        under_way: dict = {}
        for key, prompt in items:
            under_way[pool.submit(one, prompt)] = key
            if len(under_way) >= limits.concurrent:
                yield from _ended(under_way)
        while under_way:
            yield from _ended(under_way)


def _ended(under_way: dict) -> Iterator[tuple[str, str | None, str | None]]:
    done, _ = wait(under_way, return_when=FIRST_COMPLETED)
    for f in done:
        key = under_way.pop(f)
        error = f.exception()
        yield (key, f.result(), None) if error is None else (key, None, f"{type(error).__name__}: {error}")


def call_all(prompts: DataFrame, ask: Callable[[str], str], limits: Limits) -> DataFrame:
    """``_hash, _response, _error`` of each row of ``_hash, _prompt``, asked within ``limits``.

    The prompts are dealt to as many tasks as can share the limits; each keeps its share of every
    minute and of the calls under way, so the limits hold however many run at once. A task that is
    run again waits a minute first. Speculative execution would call twice and should be off.
    """
    tasks = limits.tasks(prompts.sparkSession.sparkContext.defaultParallelism)
    share = limits.shared(tasks)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        limiter = Limiter(share, late=TaskContext.get().attemptNumber() > 0)
        items = ((h, p) for b in batches for h, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for row in answered(items, ask, share, limiter):
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in row], ["_hash", "_response", "_error"])

    return prompts.select("_hash", "_prompt").repartition(tasks, "_hash").mapInArrow(run, "_hash string, _response string, _error string")
