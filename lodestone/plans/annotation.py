"""Queries over prompts, conversations, and annotation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import annotate
from lodestone.plans.registry import query
from lodestone.plans.tables import table

PROMPT = annotate.PROSE
_BODY = "regexp_replace(regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g'), '^ +| +$', '', 'g')"


@query(f"SELECT doc_id, 'TEXT:' || chr(10) || {_BODY} || chr(10) || chr(10) || chr(10) || 'INSTRUCTIONS:' || chr(10) || '{PROMPT.instructions}' AS prompt FROM documents")
def prompt_text(spark, d):
    return table(spark, d, "documents").select("doc_id", PROMPT.render(F.col("text")).alias("prompt"))


@query("""WITH e AS (SELECT conv_id, max(turn) AS last FROM conversations WHERE role = 'assistant' GROUP BY 1) SELECT conv_id, turn, role FROM conversations JOIN e USING (conv_id) WHERE turn <= last""")
def conversation_prefix(spark, d):
    return annotate.conversation_prefix(table(spark, d, "conversations"), "conv_id", "turn", "role", "assistant").select("conv_id", "turn", "role")


@query("""SELECT conv_id, 'CONVERSATION:' || chr(10) || string_agg('ROLE: ' || role || chr(10) || 'CONTENT: ' || trim(text, ' '), chr(10) || chr(10) ORDER BY turn) AS value FROM conversations GROUP BY 1""")
def render_conversations(spark, d):
    return annotate.render_conversations(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")


@query("SELECT doc_id, 1 + least(4, length(regexp_replace(regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g'), '^ +| +$', '', 'g')) // 1000)::INTEGER AS score FROM documents")
def annotate_documents(spark, d):
    """Scores of the offline annotator, parsed from its JSON answers."""
    done = annotate.annotate(table(spark, d, "documents"), PROMPT, "text")
    return done.rows.select("doc_id", F.col(f"{PROMPT.name}.score").alias("score"))


@query("""SELECT doc_id, 'a < | endoftext | > b ' || lang AS cleaned, 'keep ' || source AS spoken, lang AS unquoted, ['a', 'b c', lang] AS names FROM documents""".replace("'a < | endoftext | > b '", "'a <| endoftext |> b '"))
def text_clean_up(spark, d):
    """Reserved tokens, thinking blocks, quotes, and name lists."""
    df = table(spark, d, "documents")
    return df.select(
        "doc_id",
        X.sanitize_special_tokens(F.concat(F.lit("a <|endoftext|> b "), "lang")).alias("cleaned"),
        X.remove_think(F.concat(F.lit("<think>x\ny</think>keep "), "source", F.lit("<think>"))).alias("spoken"),
        X.strip_quotes(F.concat(F.lit(' "'), "lang", F.lit('" '))).alias("unquoted"),
        X.character_list(F.concat(F.lit("b c ,a, "), "lang")).alias("names"),
    )


@query("SELECT doc_id, sha256(doc_id::VARCHAR) AS id_hash, CASE WHEN n_chars > 1000 THEN 'True' ELSE 'False' END AS long, translate(text, chr(10) || chr(13), '  ') AS line FROM documents")
def python_strings(spark, d):
    df = table(spark, d, "documents")
    return df.select("doc_id", F.sha2(X.py_str(F.col("doc_id"), "bigint"), 256).alias("id_hash"), X.py_str(F.col("n_chars") > 1000, "boolean").alias("long"), X.newlines_to_spaces(F.col("text")).alias("line"))


@query("""WITH h AS (SELECT doc_id, text, substr(text, 1, 920) AS h FROM documents), k AS (SELECT *, CASE WHEN contains(h, chr(10)) THEN substr(h, 1, length(h) - length(list_last(string_split(h, chr(10)))) - 1) ELSE h END AS k FROM h)
    SELECT doc_id, CASE WHEN length(text) <= 1000 THEN text ELSE k || chr(10) || '[truncated: ' || (length(text) - length(k)) || ' characters, ' || (len(string_split(text, chr(10))) - len(string_split(k, chr(10)))) || ' lines]' END AS text FROM k""")
def truncate_with_marker(spark, d):
    return table(spark, d, "documents").select("doc_id", X.truncate_at_line(F.col("text"), 1000).alias("text"))
