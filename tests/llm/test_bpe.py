import hashlib

import numpy as np
import tiktoken

from lodestone.llm import bpe

WHOLE = None


def whole():
    global WHOLE
    WHOLE = WHOLE or tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=bpe.read_ranks(bpe.default_path()), special_tokens={})
    return WHOLE


def test_same_ids_as_the_library_and_exact_round_trip(odd_docs):
    encoded = bpe.encode_once(odd_docs)
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(encoded).collect()))
    want = []
    for r in odd_docs.select("doc_id", "text").collect():
        ids = np.array(whole().encode_ordinary(r.text or ""), "<u4")
        want.append((r.doc_id is not None, r.doc_id or 0, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want)
    texts = {r.doc_id: r.data.decode() for r in bpe.decode(bpe.documents(encoded)).collect()}
    assert texts == {r.doc_id: r.text or "" for r in odd_docs.select("doc_id", "text").collect()}


def test_small_blocks_and_empty_table(spark, odd_docs, no_docs):
    assert bpe.digests(bpe.encode(no_docs)).collect() == []
    from lodestone.llm.blocks import make_blocks
    from lodestone.llm.common import texts

    blocks = make_blocks(texts(odd_docs), lambda: str.split, 7, "tiny", block_chars=200)
    assert blocks.where("head is not null").count() > 10
