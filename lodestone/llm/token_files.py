"""Token ids as flat unsigned integer files with 64-bit document offsets, memory-mapped on reading.

The documents are dealt to partitions by ranges of doc_id and sorted in each. A partition writes
one file of ids (little-endian, the narrowest unsigned type that holds the vocabulary) and reports
how many it wrote; prefix sums of the reports are the partitions' bases, from which the 64-bit
offsets file of each partition is written. Names carry the attempt, and the table of reports is
committed by Spark, so what a lost or repeated task has written is never read.

A null text counts as empty and has the end id alone. Repeated doc_ids keep all their rows, in the
order of their texts; a null doc_id comes first. An empty table has no shards. Other columns are
ignored.
"""

from __future__ import annotations

import bisect
import functools
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import batched, gather, place, scratch, texts, written

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: Words whose ids a Python worker keeps; it starts anew when they are more.
CACHE_WORDS = 1_000_000
#: Words given to the library at once: what it returns is large beside its ids.
AT_ONCE = 4_000
_STOPS = tuple(b".,;:!?")


def default_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def mapped(uri: str, dtype: str) -> np.ndarray:
    """A file as an array: memory-mapped where the file system is mounted, else read."""
    system, path = place(uri)
    if system.get_file_info(path).size == 0:
        return np.zeros(0, dtype)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r")
    with system.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


class WordEncoder:
    """Ids of texts by their words, each word encoded once while it is remembered.

    The vocabulary's rules never join characters across white space (they squeeze it, lower-case and
    split on it), and split letters from what is neither letter, digit nor space. So a text's ids are
    those of its words, and a word's those of its letters and of one stop after them; letters alone go to
    the library's merges without its normalising and splitting. Upper case A-Z makes no difference but in the names of special tokens.
    """

    def __init__(self, path: str, dtype: str, end_id: int) -> None:
        from tokenizers import Tokenizer

        self.coder, self.dtype, self.end_id = Tokenizer.from_file(path), dtype, end_id
        self.known: dict[bytes, bytes] = {}
        size = max(self.coder.get_vocab_size(with_added_tokens=True), end_id + 1)
        self.as_bytes = [x.tobytes() for x in np.arange(size).astype(dtype)]
        # The byte-level alphabet: visible Latin-1 characters stand for themselves, the rest follow 255.
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = [b for b in range(256) if b not in shown]
        self.alphabet = {b: 256 + i for i, b in enumerate(rest)}

    def _letters(self, word: bytes) -> bytes | None:
        """Ids of a word that is letters alone, already normal and in lower case; None for others."""
        if word.isalpha():  # ASCII only, for bytes
            if not word.islower():
                return None
            text = word.decode()
        else:
            text = word.decode()
            if not text.isalpha() or text != text.lower() or not unicodedata.is_normalized("NFC", text):
                return None
            text = word.decode("latin-1").translate(self.alphabet)
        return b"".join([self.as_bytes[t.id] for t in self.coder.model.tokenize(text)])

    def words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of ``words``."""
        known = self.known
        if len(known) + len(words) > CACHE_WORDS:
            known.clear()
        rest, letters = [], self._letters
        for w in words:
            if w in known:
                continue
            if w[-1:] and w[-1] in _STOPS:
                stem, stop = w[:-1], w[-1:]
                ids = letters(stem)
                if ids:  # a stop after a letter is a piece of its own
                    if stop not in known:
                        known[stop] = b"".join([self.as_bytes[t.id] for t in self.coder.model.tokenize(stop.decode())])
                    known[stem] = ids
                    known[w] = ids + known[stop]
                    continue
            ids = letters(w)
            if ids:
                known[w] = ids
            else:
                rest.append(w)
        for lo in range(0, len(rest), AT_ONCE):
            part = rest[lo : lo + AT_ONCE]
            for w, e in zip(part, self.coder.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)):
                known[w] = b"".join([self.as_bytes[i] for i in e.ids])
        return [known[w] for w in words]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of ``column``, the end id after each, and how many each has."""
        special = pc.match_substring(column, "<|")
        words = pc.ascii_split_whitespace(pc.if_else(special, column, pc.ascii_lower(column)))
        flat = words.flatten().cast(pa.binary()).dictionary_encode()
        ids = self.words(flat.dictionary.to_pylist())
        width = np.dtype(self.dtype).itemsize
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // width
        data = np.frombuffer(b"".join([*ids, np.array([self.end_id], self.dtype).tobytes()]), self.dtype)
        lengths = np.append(lengths, 1)
        starts = np.cumsum(lengths) - lengths
        sizes = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        codes = np.insert(flat.indices.to_numpy().astype(np.int64), np.cumsum(sizes), len(ids))
        per_word = lengths[codes]
        counts = np.add.reduceat(per_word, np.cumsum(sizes + 1) - sizes - 1) if len(sizes) else np.zeros(0, np.int64)
        return gather(starts[codes], per_word, data), counts


@functools.lru_cache(2)
def word_encoder(path: str, dtype: str, end_id: int) -> WordEncoder:
    """The process's encoder, kept from task to task."""
    return WordEncoder(path, dtype, end_id)


def write_ids(docs: DataFrame, path: str | None = None, end_id: int = END_ID, vocabulary_size: int | None = None, partitions: int | None = None) -> DataFrame:
    """Write the files of ``docs`` (doc_id, text); returns the written table of shards.

    ``shard int, ids_uri string, offsets_uri string, dtype string, n_docs long, base long,
    n_tokens long, doc_ids_uri string``: shards in ascending doc_id order; ``base`` is the number of
    ids before the shard. Offsets files hold n_docs + 1 values, ``base`` included.
    """
    path = path or default_path()
    if vocabulary_size is None:
        from tokenizers import Tokenizer

        vocabulary_size = max(Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True), end_id + 1)
    dtype = "<u2" if vocabulary_size <= 1 << 16 else "<u4"
    spark = docs.sparkSession
    folder = scratch(spark, "token-files")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    shape = "shard int, name string, n_docs long, n_tokens long"
    arrow = pa.schema([("shard", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        coder = word_encoder(path, dtype, end_id)
        name, system, root = f"{task.partitionId():08d}-{task.taskAttemptId()}", *place(folder)
        system.create_dir(root, recursive=True)
        docs, tokens = 0, 0
        with system.open_output_stream(f"{root}/{name}.ids") as ids, system.open_output_stream(f"{root}/{name}.lengths") as lengths, system.open_output_stream(f"{root}/{name}.docs") as keys:
            for batch in batches:
                coded, counts = coder.encode(batch.column(1))
                ids.write(coded.tobytes())
                lengths.write(counts.astype("<u8").tobytes())
                key = batch.column(0)
                keys.write(np.array([key.fill_null(-(2**63)).to_numpy(zero_copy_only=False)], "<i8").tobytes())
                docs, tokens = docs + len(counts), tokens + int(counts.sum())
        yield pa.RecordBatch.from_pylist([{"shard": task.partitionId(), "name": name, "n_docs": docs, "n_tokens": tokens}], schema=arrow)

    dealt = batched(texts(docs), "16m").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    reports = written(dealt.mapInArrow(write, shape), "token-shards").where("n_docs > 0")
    # One row for each partition, not for each document.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = reports.select(F.dense_rank().over(Window.orderBy("shard")).cast("int").alias("shard"), "name", "n_docs", "n_tokens", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    out = f"{shape}, base long"
    whole = pa.schema([*arrow, ("base", pa.int64())])

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = place(folder)
        for batch in batches:
            for row in batch.to_pylist():
                ends = row["base"] + np.cumsum(mapped(f"{folder}/{row['name']}.lengths", "<u8").astype(np.int64))
                # The same bytes whichever attempt writes them.
                with system.open_output_stream(f"{root}/{row['name']}.offsets") as f:
                    f.write(np.concatenate(([row["base"]], ends)).astype("<u8").tobytes())
            yield batch.select(whole.names).cast(whole)

    # The window leaves one partition; the shards are dealt out again for the writing.
    done = written(based.repartition(n, "shard").mapInArrow(offsets, out), "token-bases")
    uri = lambda kind: F.concat(F.lit(f"{folder}/"), F.col("name"), F.lit(f".{kind}"))
    return done.select("shard", uri("ids").alias("ids_uri"), uri("offsets").alias("offsets_uri"), uri("docs").alias("doc_ids_uri"), F.lit(dtype).alias("dtype"), "n_docs", "base", "n_tokens")


def read_documents(shards: DataFrame) -> DataFrame:
    """``doc_id, start long, n_tokens long, ids_crc32 long`` of each document, from the mapped files.

    ``ids_crc32`` is of the ids as little-endian unsigned 32-bit integers.
    """
    shape = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, at = mapped(row["ids_uri"], row["dtype"]), mapped(row["offsets_uri"], "<u8")
                keys = mapped(row["doc_ids_uri"], "<i8")
                local = (at - at[0]).astype(np.int64)
                for lo in range(0, len(keys), 10_000):
                    hi = min(lo + 10_000, len(keys))
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(local[lo:hi].tolist(), local[lo + 1 : hi + 1].tolist())]
                    own = np.asarray(keys[lo:hi])
                    yield pa.RecordBatch.from_arrays([pa.array(own, mask=own == -(2**63)), pa.array(at[lo:hi].astype(np.int64)), pa.array(np.diff(at[lo : hi + 1].astype(np.int64))), pa.array(crc, pa.int64())], schema=shape)

    n = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shards.repartition(n, "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


class TokenFiles:
    """Random access to written shards: document ``i`` in ascending doc_id order, or any run of ids.

    Keeps the shards' names and bases only, one row a partition, and maps a file when it is asked for.
    """

    def __init__(self, shards: DataFrame) -> None:
        self.shards = [r.asDict() for r in shards.orderBy("shard").collect()]
        self.bases = [s["base"] for s in self.shards]
        self.firsts = np.cumsum([0, *(s["n_docs"] for s in self.shards)]).tolist()

    def __len__(self) -> int:
        return self.firsts[-1]

    def __getitem__(self, i: int) -> np.ndarray:
        if not 0 <= i < len(self):
            raise IndexError(i)
        k = bisect.bisect_right(self.firsts, i) - 1
        s, j = self.shards[k], i - self.firsts[k]
        at = mapped(s["offsets_uri"], "<u8")[j : j + 2].astype(np.int64) - s["base"]
        return mapped(s["ids_uri"], s["dtype"])[at[0] : at[1]]

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the whole corpus, across shards."""
        out, k = [], max(0, bisect.bisect_right(self.bases, start) - 1)
        while k < len(self.shards) and self.bases[k] < stop:
            s = self.shards[k]
            out.append(mapped(s["ids_uri"], s["dtype"])[max(0, start - s["base"]) : stop - s["base"]])
            k += 1
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


