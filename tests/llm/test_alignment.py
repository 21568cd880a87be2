import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestone.llm import alignment


def test_coalescing_and_overlaps():
    ends_a, ends_b = np.array([2, 5, 6, 9]), np.array([1, 3, 6, 7, 9])
    start_a, start_b = np.concatenate(([0], ends_a[:-1])), np.concatenate(([0], ends_b[:-1]))
    ga, gb = alignment.coalesced(start_a, ends_a, start_b, ends_b)
    assert ga.tolist() == [0, 0, 0, 1] and gb.tolist() == [0, 0, 0, 1, 1]
    i, j = alignment.overlaps(start_a, ends_a, start_b, ends_b)
    want = [(a, b) for a in range(4) for b in range(5) if start_a[a] < ends_b[b] and start_b[b] < ends_a[a]]
    assert list(zip(i.tolist(), j.tolist())) == want
    assert alignment.coalesced(*[np.zeros(0, np.int64)] * 4)[0].size == 0


def plain(code, rows):
    """Whole texts through the libraries, cut and linked by sets of ends."""
    found, counts = [], Counter()
    for doc_id, text in rows:
        a, b = (code.a.encode(" " + text, add_special_tokens=False).ids, code.b.encode(text)) if text else ([], [])
        ta, tb = [code.bytes_a[i] for i in a], [code.bytes_b[i] for i in b]
        if not text or b"".join(ta) != (" " + text).encode() or b"".join(tb) != (" " + text).encode():
            found.append((doc_id, [], [], [], ""))
            continue
        ea, eb = np.cumsum([len(t) for t in ta]).tolist(), np.cumsum([len(t) for t in tb]).tolist()
        shared = sorted(set(ea) & set(eb))
        links = [(a[ea.index(e)], b[eb.index(e)]) for e in shared]
        said, low = [], 0
        for e in shared:
            said.append(",".join(str(x) for x, end in zip(a, ea) if low < end <= e) + "|" + ",".join(str(x) for x, end in zip(b, eb) if low < end <= e))
            low = e
        counts.update(links)
        found.append((doc_id, a, b, links, hashlib.sha256(";".join(said).encode()).hexdigest()))
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for doc_id, a, b, links, sha in found:
        groups = len(links)
        out.append((doc_id, len(a), len(b), groups, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), sha))
    return sorted(out, key=str), counts


ODD = [
    "  two  spaces  inside and at the end  ", "tabs\tand\nlines \n\n  mixed \r\n x", "   ", " ", "\n", "a▁b is not equal", "<|endoftext|> <s> </s> <unk> <0x41>",
    "ﬁ ¨ é 日本語のテキスト 🙂🙂 　wide　space \xa0 nbsp \x85   end", "x = {\r\n  y;\r\n}", "don't we'll 1234567 ____ !!!??", "\x1c\x1d a \x1f b", "a \x0b b \x0c c", "é ​ zero ﻿ mark", "same text", "same text",
]


def test_against_whole_texts(spark, odd_docs):
    base = [(r.doc_id, (r.text or "")[:3000]) for r in odd_docs.select("doc_id", "text").collect()]
    rows = base + [(1000 + k, t) for k, t in enumerate(ODD)]
    docs = spark.createDataFrame([(i, t, "t", 1) for i, t in rows], "doc_id long, text string, target string, block int")
    blocks = alignment.align(docs, block_chars=900)
    want, counts = plain(alignment.coder(*alignment.default_paths()), rows)
    got = sorted((tuple(r)[:8] for r in alignment.digests(blocks).collect()), key=str)
    assert got == want
    assert {(r.a, r.b): r.n for r in alignment.link_table(blocks).collect()} == counts
    lists = {r.doc_id: r.groups for r in alignment.groups(blocks).where("doc_id >= 1000").collect()}
    text = ";".join(",".join(map(str, g.a)) + "|" + ",".join(map(str, g.b)) for g in lists[1000])
    assert hashlib.sha256(text.encode()).hexdigest() == next(w[7] for w in want if w[0] == 1000)
    assert lists[1005] == []


def test_test_table_against_whole_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text or "") for r in docs.collect() if len(r.text or "") < 6000]
    kept = docs.where("length(coalesce(text, '')) < 6000")
    want, _ = plain(alignment.coder(*alignment.default_paths()), rows)
    assert sorted((tuple(r)[:8] for r in alignment.digests(alignment.align(kept)).collect()), key=str) == want


def test_empty_table(no_docs):
    blocks = alignment.align(no_docs)
    assert alignment.digests(blocks).collect() == [] and alignment.link_table(blocks).collect() == []


def test_vocabularies_that_cross_spaces_are_refused(monkeypatch):
    class Piece:
        def get_piece_size(self):
            return 1

        def id_to_piece(self, i):
            return "a▁b"

    import sentencepiece

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", lambda model_file: Piece())
    with pytest.raises(ValueError, match="space"):
        alignment.Coder(*alignment.default_paths())
