"""The thin queries opN_<name> over whole tables, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import alignment, bpe, decontamination, exact_dedup, katz, line_dedup, pii, quality, sharding, simhash, token_files, toxicity, vector_codes
from lodestone.llm.common import table


def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that each contaminated document holds."""
    return decontamination.contaminated(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op2_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: by pattern, and by learned context."""
    return pii.personal_data(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents in flat files with 64-bit offsets, read back from the mapped files."""
    return token_files.read_documents(token_files.write_ids(table(spark, sf_dir, "documents", "doc_id", "text")))


def op4_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability under the Katz model of the documents that are not held out."""
    return katz.fit_and_score(table(spark, sf_dir, "documents", "doc_id", "text"), mod=10).scores


def op5_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line occurrence that fuzzy line deduplication removes, with the occurrence that stays."""
    gone = line_dedup.removed(line_dedup.keyed(table(spark, sf_dir, "documents", "doc_id", "text")), grams=True)
    return gone.select(F.col("_row.id").alias("doc_id"), F.col("pos").alias("line"), F.col("keeper._row.id").alias("kept_doc_id"), F.col("keeper.pos").alias("kept_line"), F.col("size").alias("group_size"))


def op6_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SimHash of three-word shingles and its component over links of at most three bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), shingle=3)
    return found.select("doc_id", simhash.hex64(F.col("fp")).alias("fingerprint"), "component_id")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the smallest document of equal text."""
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by a shuffle of distinct words, and decoded again."""
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents", "doc_id", "text")))


def op9_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality by attention over its passages."""
    return quality.classified(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))


def op10_toxicity_bigru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, the highest of its overlapping windows."""
    return toxicity.classified(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's aligned groups of two tokenizers, and its links under corpus-wide counts."""
    return alignment.digests(alignment.align(table(spark, sf_dir, "documents", "doc_id", "text")))


def op12_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in eight shards of nearly equal bytes, equal texts together."""
    return sharding.sharded(table(spark, sf_dir, "documents", "doc_id", "text"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding's code of 16 parts under codebooks learned from all."""
    return vector_codes.digests(vector_codes.coded(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_template_decontamination": op1_template_decontamination,
    "op2_contextual_pii": op2_contextual_pii,
    "op3_token_files": op3_token_files,
    "op4_katz_backoff": op4_katz_backoff,
    "op5_fuzzy_lines": op5_fuzzy_lines,
    "op6_simhash_pigeonring": op6_simhash_pigeonring,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_quality_mil": op9_quality_mil,
    "op10_toxicity_bigru": op10_toxicity_bigru,
    "op11_token_alignment": op11_token_alignment,
    "op12_byte_shards": op12_byte_shards,
    "op13_vector_codes": op13_vector_codes,
}

#: White space runs become one space by the same rule in every dialect of regular expressions.
_NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"

SQL: dict[str, str] = {
    "op7_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_NORM} AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
        FROM d WINDOW g AS (PARTITION BY t)""",
}
