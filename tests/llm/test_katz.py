import functools
import math
import os
import zlib
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import katz
from lodestone.llm.blocks import make_blocks


def brute(rows, mod=10, order=3):
    """The same model over plain dictionaries, evaluated recursively; the end token stands before the first word."""
    def tokens(t):
        return (" ", *(w.decode() for w in katz.split()(t or "")))

    held = {i: zlib.crc32(b"" if i is None else str(i).encode()) % mod == 0 for i, _ in rows}
    c1, follow = Counter(), [{} for _ in range(order + 1)]
    for i, t in rows:
        if not held[i]:
            w = tokens(t)
            c1.update(w[1:])
            for n in range(2, order + 1):
                for k in range(len(w) - n + 1):
                    follow[n].setdefault(w[k : k + n - 1], Counter())[w[k + n - 1]] += 1
    n, v = sum(c1.values()), len(c1)
    hist = lambda c: [0] + [sum(x == r for x in c) for r in range(1, katz.K + 2)]
    d = [None, katz.discounts(hist(c1.values())), *(katz.discounts(hist([c for f in follow[m].values() for c in f.values()])) for m in range(2, order + 1))]
    cut = lambda m, c: (d[m][c] if c <= katz.K else 1.0) * c
    kept = sum(cut(1, c) for c in c1.values())
    den1 = n if kept < n - 1e-9 else n + 1
    unknown = 1 - kept / den1 if n else 1.0

    @functools.cache
    def history(h):
        f = follow[len(h) + 1].get(h)
        if not f:
            return None
        total, mass = sum(f.values()), sum(cut(len(h) + 1, c) for c in f.values())
        den = total if total - mass > 1e-9 else total + 1
        return f, den, (1 - mass / den) / (1 - sum(p(w, h[1:]) for w in f))

    def p(w, h):
        if not h:
            return cut(1, c1[w]) / den1 if c1[w] else unknown
        found = history(h)
        if not found:
            return p(w, h[1:])
        f, den, alpha = found
        return cut(len(h) + 1, f[w]) / den if f[w] else alpha * p(w, h[1:])

    out = []
    for i, t in rows:
        w = tokens(t)
        base = sum(math.log10((c1[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w[1:])
        score = sum(math.log10(p(w[k], w[max(0, k - order + 1) : k])) for k in range(1, len(w)))
        out.append((i, held[i], len(w) - 1, sum(c1[x] > 0 for x in w[1:]), n, base, score))
    return out, p, c1, [h for f in follow for h in f]


def close(got, want):
    got, want = sorted(map(tuple, got), key=str), sorted(want, key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_scores_against_dictionaries(odd_docs, order):
    """Every order; sums over the vocabulary are one after short, long, seen and unseen histories."""
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    want, p, c1, histories = brute(rows, order=order)
    for h in [(), ("never seen",), *histories[:10], *histories[-10:], *histories[:: len(histories) // 20 + 1]]:
        assert sum(p(w, h) for w in c1) + p("never seen", h) == pytest.approx(1, abs=1e-8)
    assert any(w[1] for w in want)
    close(katz.fit_and_score(odd_docs, order=order).scores.collect(), want)


def test_histories_over_several_parts(odd_docs):
    """The same scores where frequent histories are spread."""
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    model = katz.fit_and_score(odd_docs, spread=8)
    assert model.grams[2].where("spread").count() > 1 and model.grams[3].where("spread").count() > 1
    close(model.scores.collect(), brute(rows)[0])


def test_keys_of_any_size():
    h, w = np.array([5, 1, 1, 2**61]), np.array([2**40, 7, 6, 2**60])
    assert np.argsort(katz._one_key(h, w)).tolist() == [2, 1, 0, 3]
    assert len(set(katz._one_key(h, w).tolist())) == 4


def test_model_on_the_small_tables_beats_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = katz.fit_and_score(docs).scores.collect()
    close(got, brute(rows)[0])
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_empty_and_only_held_out(spark, no_docs):
    assert katz.fit_and_score(no_docs).scores.collect() == []
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    docs = spark.createDataFrame([(i, "some words") for i in ids], "doc_id long, text string")
    rows = katz.fit_and_score(docs).scores.collect()
    assert all(r.held_out and r.n_known == 0 and r.train_tokens == 0 and r.score == 0.0 for r in rows)


def test_blocks_words_are_gone_once_counted(odd_docs, monkeypatch):
    """The blocks' words do not stand beside the tables of n-grams."""
    made = []
    monkeypatch.setattr(katz, "make_blocks", lambda *a: made.append(make_blocks(*a)) or made[0])
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    close(katz.fit_and_score(odd_docs).scores.collect(), brute(rows)[0])
    folder = made[0].inputFiles()[0].rsplit("/", 1)[0]
    assert not os.path.exists(folder.removeprefix("file://"))


def test_ngrams_of_a_block_stand_in_order_of_part_history_and_word():
    rng = np.random.default_rng(3)
    codes = np.append(rng.integers(0, 20, 499), 20)
    t = katz.Tokens(np.zeros(1, np.int64), np.zeros(1, bool), np.zeros(1, bool), np.array([500]), np.array([0]), codes, np.arange(500))
    ids = rng.permutation(1000)[:21]
    words = katz.Grams(codes, ids, np.bincount(codes, minlength=21) * 3, np.zeros(21, np.int64))
    want = Counter((int(ids[a]) % 7 if words.counts[a] < 40 else int(ids[a] % 7 + ids[b] % (1 + words.counts[a] // 40) * 40503) % 7, int(ids[a]), int(ids[b])) for a, b in zip([codes[-1], *codes[:-1]], codes))
    for big in (False, True):
        targets = 7 if not big else 7 * 2**60
        at, part, h, w, weight, *_ = katz._asked(t, 2, words, words, targets, 40 if not big else 10**9)
        got = list(zip(part.tolist(), h.tolist(), w.tolist()))
        assert got == sorted(got) and len(set(got)) == len(want) and weight.sum() == 500
        assert big or dict(zip(got, weight.tolist())) == want
        assert [got[k][1:] for k in at] == [(ids[a], ids[b]) for a, b in zip([codes[-1], *codes[:-1]], codes)]
