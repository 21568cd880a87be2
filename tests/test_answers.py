"""The answer store, and calls within limits."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from lodestone.operators import annotate
from lodestone.operators.answers import AnswerStore, Limiter, Limits, answered

PROMPT = annotate.rubric("store tests")


def rows(spark, n=30):
    return spark.range(n).select("id", F.concat(F.lit("text "), F.col("id") % 20).alias("text"))


def counted(folder):
    """An annotator that leaves a file for each prompt it is asked."""

    def ask(prompts, schema):
        import uuid
        from pathlib import Path

        for _ in prompts:
            (Path(folder) / uuid.uuid4().hex).touch()
        return annotate.length_annotator(prompts, schema)

    return ask


def calls(folder):
    n = len(list(folder.iterdir()))
    for p in folder.iterdir():
        p.unlink()
    return n


@pytest.mark.parametrize("limits", [None, Limits(concurrent=16)])
def test_second_run_asks_nothing(spark, tmp_path, limits):
    seen = tmp_path / "seen"
    seen.mkdir()
    store = AnswerStore(spark, f"file://{tmp_path}/store")
    ask = lambda **k: annotate.annotate(rows(spark), PROMPT, "text", counted(str(seen)), store=store, limits=limits, **k)
    first = ask()
    assert first.rows.count() == 30 and first.rejected.count() == 0
    assert calls(seen) == 20  # equal prompts are one
    assert ask().rows.count() == 30 and calls(seen) == 0
    assert ask(invalidate=True).rows.count() == 30 and calls(seen) == 20
    more = annotate.annotate(rows(spark, 400).withColumn("text", F.concat(F.lit("text "), F.col("id") % 25)), PROMPT, "text", counted(str(seen)), store=store, limits=limits)
    assert more.rows.count() == 400 and calls(seen) == 5


def test_last_write_wins_and_runs_are_idempotent(spark, tmp_path):
    store = AnswerStore(spark, f"file://{tmp_path}/s")
    of = lambda *x: spark.createDataFrame(x, "prompt_hash string, response string")
    now = lambda: dict(tuple(r) for r in store.read().collect())
    assert now() == {}
    store.compact()
    store.append(of(("a", "1"), ("b", "1"), (None, "x"), ("n", None)), "first")
    store.append(of(("b", "2"), ("c", "2")), "second")
    assert now() == {"a": "1", "b": "2", "c": "2"}
    store.append(of(("a", "9"), ("b", "9")), "first")  # again: it takes its old place
    assert now() == {"a": "9", "b": "2", "c": "2"}
    store.compact()
    assert now() == {"a": "9", "b": "2", "c": "2"} and len(list((tmp_path / "s").iterdir())) == 1
    store.append(of(("c", "3"), ("c", "3")), "third")
    assert now() == {"a": "9", "b": "2", "c": "3"} and store.read().count() == 3
    with pytest.raises(ValueError):
        store.append(of(("a", "1")), "a/b")


def test_a_compaction_that_stopped_changes_nothing(spark, tmp_path):
    store = AnswerStore(spark, f"file://{tmp_path}/s")
    store.append(spark.createDataFrame([("a", "1")], "prompt_hash string, response string"), "one")
    (tmp_path / "s" / "base-00000001-dead").mkdir()
    (tmp_path / "s" / "base-00000001-dead" / "part-0.parquet").write_bytes(b"half")
    assert [tuple(r) for r in store.read().collect()] == [("a", "1")]


def test_repeated_hashes_in_a_cache_are_harmless(spark):
    hashed = rows(spark).select(F.sha2(PROMPT.render(F.col("text")), 256).alias("prompt_hash")).distinct()
    answer = json.dumps({"justification": "known", "score": 5})
    cache = hashed.withColumn("response", F.lit(answer)).union(hashed.withColumn("response", F.lit(answer)))
    cache = cache.union(spark.createDataFrame([("other", "{}"), (None, "{}")], "prompt_hash string, response string"))
    out = annotate.annotate(rows(spark), PROMPT, "text", cache=cache)
    got = out.rows.select("id", F.col(PROMPT.name).score.alias("s")).collect()
    assert len(got) == 30 and {r.s for r in got} == {5} and out.rejected.count() == 0


class Clock:
    """Time that passes when someone sleeps."""

    def __init__(self):
        self.now, self.lock = 0.0, threading.Lock()

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        with self.lock:
            self.now += seconds


def within(times, limit, tokens=None):
    """Whether any 60 seconds hold at most ``limit`` calls (or tokens)."""
    return all(sum((tokens or [1] * len(times))[j] for j, u in enumerate(times) if t <= u < t + 60) <= limit for t in times)


@pytest.mark.parametrize("requests, most", [(10, 10**9), (10**6, 500), (7, 300)])
def test_any_minute_is_within_the_limits(requests, most):
    clock = Clock()
    limiter = Limiter(Limits(requests_per_minute=requests, tokens_per_minute=most, clock=clock, sleep=clock.sleep))
    times, used = [], []
    for k in range(100):
        tokens = 20 + k * 7 % 80
        limiter.acquire(tokens)
        times.append(clock.now)
        used.append(tokens)
        clock.sleep(0.7)
    assert within(times, requests) and within(times, most, used)
    assert clock.now < 60 * (2 + max(100 / requests, sum(used) / (most - 100)))
    with pytest.raises(ValueError):
        limiter.acquire(most + 1)


def test_a_task_that_is_run_again_waits_a_minute():
    clock = Clock()
    Limiter(Limits(clock=clock, sleep=clock.sleep), late=True)
    assert clock.now == 60


def test_failures_are_rows_and_calls_under_way_are_bounded():
    clock, lock, now, most, tries = Clock(), threading.Lock(), [0], [0], {}
    limits = Limits(concurrent=5, retries=2, backoff=1.0, new_tokens=1, clock=clock, sleep=clock.sleep)

    def ask(prompt):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
            tries[prompt] = tries.get(prompt, 0) + 1
        try:
            if prompt.startswith("bad") or prompt.startswith("slow") and tries[prompt] < 3:
                raise OSError("no answer")
            return prompt.upper()
        finally:
            with lock:
                now[0] -= 1

    items = [(f"h{k}", f"{('good', 'bad', 'slow')[k % 3]} {k}") for k in range(60)]
    got = {h: (r, e) for h, r, e in answered(iter(items), ask, limits, Limiter(limits))}
    assert len(got) == 60 and most[0] <= 5
    assert got["h0"] == ("GOOD 0", None) and got["h2"] == ("SLOW 2", None) and got["h1"] == (None, "OSError: no answer")
    assert {tries[p] for _, p in items} == {1, 3}


def test_limits_are_shared_among_tasks():
    limits = Limits(requests_per_minute=100, tokens_per_minute=10_000, concurrent=20)
    n = limits.tasks(8)
    share = limits.shared(n)
    assert (n, share.requests_per_minute * n <= 100, share.tokens_per_minute * n <= 10_000, share.concurrent * n <= 20) == (8, True, True, True)
    assert Limits(requests_per_minute=3).tasks(8) == 3


def test_an_annotator_that_fails_loses_no_row(spark):
    def ask(prompts, schema):
        if "text 7" in prompts[0]:
            raise OSError("down")
        return annotate.length_annotator(prompts, schema)

    out = annotate.annotate(rows(spark), PROMPT, "text", ask, limits=Limits(retries=1, backoff=0.0))
    assert out.rows.count() == 28
    assert sorted((r.id, r._error) for r in out.rejected.collect()) == [(7, "OSError: down"), (27, "OSError: down")]
