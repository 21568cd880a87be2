import collections
import hashlib
import random
import re

import pytest

from lodestone.llm import exact_dedup as E


def brute(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for t, ids in groups.items():
        least = min((i for i in ids if i is not None), default=None)
        stay = [True] * ids.count(least)
        stay = [k == 0 for k in range(len(stay))]
        for i in ids:
            kept = stay.pop(0) if i == least else False
            out.append((i, least, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("budget", [E.COMBINE_BYTES, 2000])
def test_against_brute_force(odd_docs, budget):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    got = [tuple(r) for r in E.exact_duplicates(odd_docs.repartition(3), budget, budget).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_empty_table(no_docs):
    assert E.exact_duplicates(no_docs).collect() == []


def test_trie_spills_subtrees_and_keeps_every_group(tmp_path):
    rng = random.Random(3)
    keys = [b"shared prefix " + bytes(rng.choices(b"ab", k=rng.randint(0, 60))) for _ in range(600)] + [b"", b"shared", b"other"] * 3
    want = collections.Counter(keys)
    for budget in (10**9, 4000):
        trie = E.Trie(budget, f"file://{tmp_path}/{budget}")
        for i, k in enumerate(keys):
            trie.insert(k, i, 1, [i])
        spilled = bool(trie.spills)
        got = {}
        for node in trie.groups():
            same = {keys[m] for m in node.members}
            assert len(same) == 1 and node.least == min(node.members)
            got[same.pop()] = node.count
        assert got == dict(want)
        assert spilled == (budget == 4000)


def test_copies_after_two_spills_at_different_depths_join_the_earlier_ones(tmp_path):
    trie = E.Trie(4000, f"file://{tmp_path}")
    keys = []

    def put(key):
        trie.insert(key, len(keys), 1, [len(keys)])
        keys.append(key)

    deep = [b"PPPa" + bytes([k]) * 50 for k in range(10)]
    for key in [*deep, *(b"PPPb" + bytes([k]) * 50 for k in range(8))]:
        put(key)
    assert [s.label for s in trie.spills] == [b"a"]
    put(b"Q" * 50)
    for k in range(20):
        put(b"PPPc" + bytes([k]) * 50)
    assert isinstance(trie.root.children[ord("P")], E.Spilled)
    for key in deep:
        put(key)
    got = [({keys[m] for m in n.members}, n.least, n.count) for n in trie.groups()]
    want = collections.Counter(keys)
    assert sorted(got, key=str) == sorted((({k}, keys.index(k), n) for k, n in want.items()), key=str)
    assert not list(tmp_path.iterdir())


def test_squeezed():
    for t in [b"", b" ", b"\n\t", b"a", b" a", b"a\n", b" a  b\x0b\x0cc ", "  x y\x1c".encode()]:
        assert E.squeezed(t) == re.sub(rb"[\x20\x09-\x0D]+", b" ", t)
