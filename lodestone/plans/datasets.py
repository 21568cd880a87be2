"""Queries over dataset preparation: reshaping, rendering, sampling, splitting, normalising."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import dedup, rows, sampling, stats
from lodestone.plans.registry import query
from lodestone.plans.tables import labelled, table, unit

_WS = r"trim(regexp_replace({}, '[\s\x{{0085}}\p{{Z}}\x0B\x1C-\x1F]+', ' ', 'g'))"
_L = "(SELECT * FROM documents JOIN labels USING (doc_id))"


def ws(c: str) -> str:
    return _WS.format(c)


_SPLIT = f"CASE WHEN {unit(42, 'doc_id')} < 0.1 THEN 'valid' WHEN {unit(42, 'doc_id')} < 0.2 THEN 'test' ELSE 'train' END"


@query(f"""WITH c AS (SELECT {_SPLIT} AS split, quality, count(*) AS n FROM {_L} GROUP BY ALL)
    SELECT split, quality, n, min(n) OVER (PARTITION BY split) AS target, min(n) OVER (PARTITION BY split) / n AS ratio FROM c""")
def label_balance_report(spark, d):
    """Label counts of each split, the balance target and the share to keep."""
    return sampling.label_counts(sampling.split(labelled(spark, d), "doc_id", 42, 0.1, 0.1), "quality", ["split"])


@query("SELECT text, doc_id AS id, CASE WHEN n_chars >= 1500 THEN 'long' ELSE 'short' END AS score, lang || '-' || source AS tag FROM documents")
def transform_rows(spark, d):
    """Two object constructors in the expression language."""
    return rows.transform_rows(table(spark, d, "documents"), "{text: .text, id: .doc_id}", r'{score: (if .n_chars >= 1500 then "long" else "short" end), tag: "\(.lang)-\(.source)"}')


@query("""SELECT doc_id, CASE WHEN quality IS NULL OR quality < 1 THEN 'low' WHEN toxic > 0 THEN 'mixed' ELSE 'high' END AS tier,
    greatest(coalesce(quality, 0), coalesce(toxic, 0))::DOUBLE AS top, length(text)::BIGINT AS size, coalesce(quality, -1) AS q,
    coalesce(quality, 0) + n_chars * 2.0::DOUBLE AS mix FROM documents LEFT JOIN labels USING (doc_id)""")
def expression_language(spark, d):
    """Conditions with nulls, alternatives, arrays, pipes and arithmetic."""
    from lodestone.functions.jq import compile_expression as c

    df = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return df.select("doc_id", c('if .quality < 1 then "low" elif .toxic > 0 then "mixed" else "high" end', df).alias("tier"), c("[.quality // 0, .toxic // 0] | max", df).alias("top"), c(".text | length", df).alias("size"), c(".quality // -1", df).cast("int").alias("q"), c(".quality + .n_chars * 2.0", df).alias("mix"))


@query(f"SELECT doc_id, {ws('text')} AS text, trim(lower(regexp_replace(regexp_replace(source || ' A', '^__label__', ''), '\\s+', '_', 'g'))) AS source FROM documents")
def normalize_rows(spark, d):
    """Text and label normalised in place."""
    df = table(spark, d, "documents").select("doc_id", "text", F.concat("source", F.lit(" A")).alias("source"))
    return rows.normalize_rows(df, "whitespace", "text", "source")


@query(f"""SELECT doc_id, '__label__' || trim(lower(lang)) || ' ' || {ws("regexp_replace(text || ' __label__odd word', '__label__(\\S+)', '\\1', 'g')")} AS value FROM documents""")
def classifier_lines(spark, d):
    """One rendered line a row, with a label marker inside the text unwrapped."""
    df = table(spark, d, "documents").withColumn("text", F.concat("text", F.lit(" __label__odd word")))
    return rows.render_lines(df, "text", "lang").select("doc_id", "value")


@query(f"""SELECT doc_id, CASE WHEN quality > 0 THEN '__label__quality ' ELSE '' END || CASE WHEN toxic > 0 THEN '__label__toxic ' ELSE '' END || {ws('text')} AS value
    FROM {_L} WHERE quality > 0 OR toxic > 0""")
def classifier_lines_multilabel(spark, d):
    df = labelled(spark, d).withColumn("labels", F.create_map(F.lit("toxic"), "toxic", F.lit("quality"), "quality"))
    return rows.render_multilabel(df).select("doc_id", "value")


@query(f"""WITH v AS (SELECT doc_id, '__label__' || lang || ' ' || {ws('text')} AS v FROM documents)
    SELECT doc_id, split_part(v, ' ', 1) AS label, substr(v, length(split_part(v, ' ', 1)) + 2) AS text FROM v""")
def parse_classifier_lines(spark, d):
    return rows.parse_lines(rows.render_lines(table(spark, d, "documents"), "text", "lang").select("doc_id", "value")).select("doc_id", "label", "text")


_EDGE = "(SELECT list_sort(list(n_chars)) AS v, count(*) AS n, min(n_chars) AS lo, max(n_chars) AS hi FROM documents)"


@query(f"""WITH e AS (SELECT v[1] AS e0, v[1 + n // 4] AS e1, v[1 + 2 * n // 4] AS e2, v[1 + 3 * n // 4] AS e3, hi FROM {_EDGE})
    SELECT doc_id, CASE WHEN n_chars >= e0 AND n_chars < e1 THEN 0 WHEN n_chars >= e1 AND n_chars < e2 THEN 1 WHEN n_chars >= e2 AND n_chars < e3 THEN 2 ELSE 3 END AS bin FROM documents, e""")
def equal_count_bins(spark, d):
    """Numeric labels in four bins of equal counts."""
    df = table(spark, d, "documents")
    return df.select("doc_id", stats.bin_of(F.col("n_chars"), stats.bin_edges(df, "n_chars", 4)).alias("bin"))


@query(f"""WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1), t AS (SELECT quality, (min(n) OVER () / n) AS ratio FROM c)
    SELECT doc_id, quality FROM labels JOIN t USING (quality) WHERE {unit(42, 'doc_id')} < ratio""")
def balance(spark, d):
    return sampling.balance(table(spark, d, "labels"), "quality", "doc_id").select("doc_id", "quality")


@query(f"""WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {unit(42, 'doc_id')}, doc_id) AS r FROM labels)
    SELECT doc_id, quality FROM r WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality))""")
def balance_exact(spark, d):
    return sampling.balance(table(spark, d, "labels"), "quality", "doc_id", exact=True).select("doc_id", "quality")


@query(f"SELECT doc_id, lang FROM documents WHERE {unit(42, 'doc_id')} < 0.25")
def sample_by_rate(spark, d):
    return sampling.sample_rate(table(spark, d, "documents"), 0.25, "doc_id").select("doc_id", "lang")


@query(f"""WITH t AS (SELECT sum(strlen(text)) AS s FROM documents) SELECT doc_id FROM documents, t WHERE {unit(42, 'doc_id')} < (s // 2) / s""")
def sample_by_bytes(spark, d):
    """About half of the bytes, each source giving its share."""
    df = table(spark, d, "documents")
    total = df.agg(F.sum(F.octet_length("text"))).first()[0]
    return sampling.sample_bytes(df, total // 2, "doc_id", F.octet_length("text"), "source").select("doc_id")


@query(f"""WITH f AS (SELECT source AS file, sum(n_chars) AS size FROM documents GROUP BY 1),
    o AS (SELECT *, coalesce(sum(size) OVER (ORDER BY {unit(42, 'file')}, file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f)
    SELECT file, size::BIGINT AS size FROM o WHERE before < (SELECT sum(size) / 3 FROM f)""")
def choose_whole_files(spark, d):
    """Whole files in hash order up to a third of all bytes."""
    files = table(spark, d, "documents").groupBy(F.col("source").alias("file")).agg(F.sum("n_chars").alias("size"))
    return sampling.choose_files(files, files.agg(F.sum("size")).first()[0] / 3)


@query(f"SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {unit(7, 'doc_id')}, doc_id) AS r FROM documents) WHERE r <= 20")
def file_quota_sample(spark, d):
    return sampling.file_quota(table(spark, d, "documents"), 20, "doc_id", "source", 7).select("doc_id", "source")


def _quotas(total: int) -> str:
    """DuckDB's form of the allotment by largest remainders over the sources' bytes."""
    return f"""f AS (SELECT source, sum(strlen(text) + 1)::HUGEINT AS size FROM documents GROUP BY 1), a AS (SELECT sum(size)::HUGEINT AS whole FROM f),
    e AS (SELECT source, size, {total} * size // whole AS least, {total} * size % whole AS rest FROM f, a),
    q AS (SELECT source, size, least + CASE WHEN row_number() OVER (ORDER BY rest DESC, source) <= {total} - sum(least) OVER () THEN 1 ELSE 0 END AS quota FROM e)"""


def _sources(spark, d):
    df = table(spark, d, "documents")
    return df, df.groupBy(F.col("source").alias("file")).agg(F.sum(F.octet_length("text") + 1).alias("size"))


@query(f"WITH {_quotas(1000)} SELECT source AS file, size::BIGINT AS size, quota::BIGINT AS quota FROM q")
def file_allotment(spark, d):
    """A thousand rows shared out among the sources in proportion to their bytes."""
    return sampling.allotment(_sources(spark, d)[1], 1000)


@query(f"""WITH {_quotas(150)}, r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {unit(42, 'doc_id')}, doc_id) - 1 AS r FROM documents)
    SELECT doc_id, source FROM r JOIN q USING (source) WHERE r < quota""")
def proportional_rows(spark, d):
    """150 rows, each source's number in proportion to its bytes."""
    df, files = _sources(spark, d)
    return sampling.proportional_rows(df, files, 150, "doc_id", "source").select("doc_id", "source")


@query(f"""WITH {_quotas(200_000)}, r AS (SELECT doc_id, source, strlen(text) + 1 AS own, sum(strlen(text) + 1) OVER (PARTITION BY source ORDER BY {unit(42, 'doc_id')}) AS upto FROM documents)
    SELECT doc_id, source, own::BIGINT AS bytes FROM r JOIN q USING (source) WHERE size <= quota OR upto - own < quota""")
def byte_budget_sample(spark, d):
    """200,000 bytes, each source's budget in proportion to its bytes and filled in hash order."""
    df, files = _sources(spark, d)
    kept = sampling.byte_budget(df, files, 200_000, "doc_id", F.octet_length("text") + 1, "source")
    return kept.select("doc_id", "source", (F.octet_length("text") + 1).cast("long").alias("bytes"))


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {unit(333, 'doc_id')}, doc_id) - 1 AS position FROM documents")
def shuffle_positions(spark, d):
    return sampling.positions(table(spark, d, "documents"), "doc_id", 333).select("doc_id", "position")


_N, _T, _V = "(SELECT count(*) FROM documents)", "(SELECT round_even(count(*) * 0.1, 0)::BIGINT FROM documents)", "(SELECT round_even(count(*) * 0.2, 0)::BIGINT FROM documents)"


@query(f"""WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY {unit(42, 'doc_id')}, doc_id) - 1 AS p FROM documents), s AS (SELECT {_N} AS n, {_T} AS t, {_V} AS v),
    q AS (SELECT *, n - t - v AS tr FROM p, s)
    SELECT doc_id, CASE WHEN p < tr THEN 'train' WHEN p < tr + v THEN 'valid' ELSE 'test' END AS split,
        CASE WHEN p < tr THEN p * 7 // tr WHEN p < tr + v THEN 7 + (p - tr) * 2 // v ELSE 9 END AS shard FROM q""")
def reshard(spark, d):
    """Ten shards: a tenth for testing, a fifth for validation."""
    return sampling.reshard(table(spark, d, "documents"), "doc_id", 10, 0.1, 0.2).select("doc_id", "split", "shard")


@query(f"SELECT doc_id, {_SPLIT} AS split FROM documents")
def hash_split(spark, d):
    return sampling.split(table(spark, d, "documents"), "doc_id", 42, 0.1, 0.1).select("doc_id", "split")


@query("SELECT 'a' AS origin, doc_id, lang, NULL::VARCHAR AS role FROM documents UNION ALL SELECT 'b', conv_id, NULL, role FROM conversations")
def concatenate(spark, d):
    a = table(spark, d, "documents").select(F.lit("a").alias("origin"), "doc_id", "lang")
    return rows.concatenate(a, table(spark, d, "conversations").select(F.lit("b").alias("origin"), F.col("conv_id").alias("doc_id"), "role"))


@query("SELECT count(*) AS rows, sum(('0x' || substr(md5(text || chr(9) || lang), 1, 12))::BIGINT)::HUGEINT::VARCHAR AS signature FROM documents")
def dataset_signature(spark, d):
    return rows.signature(table(spark, d, "documents"), "text", "lang")


@query("SELECT doc_id, quality::DOUBLE AS f0, toxic::DOUBLE AS f1 FROM labels")
def densify(spark, d):
    df = table(spark, d, "labels").withColumn("m", F.map_filter(F.create_map(F.lit("quality"), "quality", F.lit("toxic"), "toxic"), lambda k, v: v > 0))
    keys = sorted(r.key for r in rows.dictionary_keys(df, "m").collect())
    return rows.densify(df, "m", keys).select("doc_id", F.col("features")[0].alias("f0"), F.col("features")[1].alias("f1"))


@query("SELECT doc_id, lang, 0.5::DOUBLE AS clf, source AS old FROM documents")
def metadata_write_back(spark, d):
    df = table(spark, d, "documents").withColumn("metadata", F.struct(F.col("source").alias("old")))
    return rows.write_back(df, "clf", F.lit(0.5)).select("doc_id", "lang", "metadata.clf", "metadata.old")


@query("SELECT sum(len(string_split_regex(trim(text), '\\s+')))::BIGINT AS tokens, count(*) AS rows, sum(strlen(text))::BIGINT AS bytes FROM documents")
def count_tokens(spark, d):
    return table(spark, d, "documents").agg(F.sum(F.size(F.split(F.trim("text"), r"\s+"))).cast("long").alias("tokens"), F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes"))


@query("""SELECT quality, n, round(w / sum(w) OVER (), 9) AS weight FROM (SELECT quality, count(*) AS n, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS w FROM labels GROUP BY 1)""")
def class_weights(spark, d):
    return sampling.class_weights(table(spark, d, "labels"), "quality").withColumn("weight", F.round("weight", 9))


@query("SELECT doc_id, strip_accents(nfc_normalize(text)) AS text FROM documents")
def strip_diacritics(spark, d):
    return table(spark, d, "documents").select("doc_id", X.strip_diacritics(F.col("text")).alias("text"))


@query()
def potion_normalizer(spark, d):
    return table(spark, d, "documents").select("doc_id", X.get_normalizer("potion")(F.col("text")).alias("text"))


@query(f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents),
    n AS (SELECT doc_id, list_transform(w, lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT % {dedup.PRIME}) AS n FROM w WHERE len(w) > 0),
    s AS (SELECT DISTINCT doc_id, list_reduce(n[i + 1 : i + 5], lambda x, y: (x * {dedup.BASE} + y) % {dedup.PRIME}) AS x FROM (SELECT doc_id, n, unnest(range(greatest(len(n) - 5, 0) + 1)) AS i FROM n)),
    p AS (SELECT i, 1 + (i + 1) * {0x9E3779B1} % {dedup.PRIME - 1} AS a, (i + 1) * {0x85EBCA6B} % {dedup.PRIME} AS b FROM (SELECT unnest(range(100)) AS i)),
    m AS (SELECT doc_id, i, min(((a * x + b) & {dedup.PRIME}) + ((a * x + b) >> 31)) AS m FROM s, p GROUP BY 1, 2),
    g AS (SELECT doc_id, i // 5 AS band, string_agg(m::VARCHAR, ',' ORDER BY i) AS h FROM m GROUP BY 1, 2),
    l AS (SELECT DISTINCT g.doc_id AS b, f.a FROM g JOIN (SELECT band, h, min(doc_id) AS a FROM g GROUP BY 1, 2) f USING (band, h) WHERE f.a <> g.doc_id),
    e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
    r AS (SELECT DISTINCT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a)
    SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT node FROM r GROUP BY node HAVING min(seen) < node)""")
def minhash_deduplicate(spark, d):
    """Documents that are left after MinHash near-duplicate removal (five-word shingles, 20 bands of 5)."""
    return dedup.deduplicate(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "lang")


_CODE = "'def f():' || chr(10) || repeat(' ', 4) || 'if x:' || chr(10) || repeat(' ', 8 + (doc_id % 3)::INT) || 'return ' || lang || chr(10) || chr(10) || 'end'"


@query(f"""WITH c AS (SELECT doc_id, {_CODE} AS t, CASE doc_id % 3 WHEN 0 THEN 4 WHEN 1 THEN 1 ELSE 2 END AS n FROM documents)
    SELECT doc_id, n AS indent, contains(t, chr(10) || '  ') AS spaced, 'def f():' || chr(10) || repeat(chr(9), 4 // n) || 'if x:' || chr(10) || repeat(chr(9), (8 + (doc_id % 3)::INT) // n)
        || substr(t, 9 + 4 + 5 + 1 + 8 + (doc_id % 3)::INT + 1) AS tabbed FROM c""")
def indentation(spark, d):
    """Indent width by greatest common divisor, and spaces to tabs."""
    t = F.concat(F.lit("def f():\n    if x:\n"), F.repeat(F.lit(" "), (8 + F.col("doc_id") % 3).cast("int")), F.lit("return "), "lang", F.lit("\n\nend"))
    df = table(spark, d, "documents").select("doc_id", t.alias("t"))
    return df.select("doc_id", X.indentation(F.col("t")).alias("indent"), X.has_space_indentation(F.col("t")).alias("spaced"), X.spaces_to_tabs(F.col("t")).alias("tabbed"))
