import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from lodestone.llm import token_files


def test_files_against_the_library(spark, odd_docs):
    coder = Tokenizer.from_file(token_files.default_path())
    shards = token_files.write_ids(odd_docs)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read_documents(shards).collect())
    want, start, flat = [], 0, []
    for r in sorted(odd_docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")):
        ids = np.array([*coder.encode(r.text or "", add_special_tokens=False).ids, token_files.END_ID], "<u4")
        want.append((start, r.doc_id, len(ids), zlib.crc32(ids.tobytes())))
        flat.append(ids)
        start += len(ids)
    assert got == want
    files = token_files.TokenFiles(shards)
    assert len(files) == len(flat)
    assert all(np.array_equal(files[i], x) for i, x in enumerate(flat))
    assert np.array_equal(files.tokens(100, start - 5), np.concatenate(flat)[100 : start - 5])


def test_empty_table(no_docs):
    shards = token_files.write_ids(no_docs)
    assert token_files.read_documents(shards).collect() == []
    assert len(token_files.TokenFiles(shards)) == 0


def test_words_alone_encode_as_whole_texts(spark):
    coder = Tokenizer.from_file(token_files.default_path())
    encode = lambda t: token_files.word_encoder(token_files.default_path(), "<u2", 1).encode(pa.array([t]))[0].tolist()
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        assert encode(r.text) == [*coder.encode(r.text, add_special_tokens=False).ids, 1]
    for text in ["a\u0085b", "a b 　c", "x\x1cy \x1f z", "e ́", "İSTANBUL ΑΣ ΟΔΟΣ", "don'T <|endoftext|>x <|startoftext|>", "᠎ a", "a​b", "", "  A,b. C., x! 'S it's THE.  ", "<|ENDOFTEXT|> a", "Éa. ß. ǅx, a1. 1.", "été, naïve. ñandú straße! пример 日本語. ﬁn ǆ ʼn ı İ ς ªº ª. ſ", "e\u0301a, a\u0300.", "a.. b.,", "l'été. s'il"]:
        assert encode(text) == [*coder.encode(text, add_special_tokens=False).ids, 1], text
