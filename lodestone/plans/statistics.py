"""Queries over distributions, percentiles, agreement and diffs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import compare, stats
from lodestone.plans.registry import query
from lodestone.plans.tables import GRADE, OTHER, labelled, table


def pairs(spark, d):
    return table(spark, d, "documents").select(F.sha2(F.col("doc_id").cast("string"), 256).alias("key_hash"), F.expr(GRADE).alias("l1"), F.expr(OTHER).alias("l2"))


_P = f"(SELECT sha256(doc_id::VARCHAR) AS key_hash, {GRADE} AS l1, {OTHER} AS l2 FROM documents)"


def sides(spark, d):
    a = compare.last_by_key(table(spark, d, "documents"), F.col("doc_id"), F.expr(GRADE), F.col("doc_id"))
    b = compare.last_by_key(table(spark, d, "labels"), F.col("doc_id"), F.col("quality"), F.col("doc_id"))
    return a, b


_A = f"(SELECT doc_id AS k, {GRADE} AS v FROM documents)"
_B = "(SELECT doc_id AS k, quality AS v FROM labels)"


@query(f"SELECT sha256(a.k::VARCHAR) AS key_hash, a.v AS l1, b.v AS l2 FROM {_A} a JOIN {_B} b USING (k)")
def annotation_join(spark, d):
    return compare.paired(*sides(spark, d))


@query(f"SELECT count_if(b.k IS NULL)::BIGINT AS only_1, count_if(a.k IS NULL)::BIGINT AS only_2, count_if(a.k IS NOT NULL AND b.k IS NOT NULL)::BIGINT AS common FROM {_A} a FULL JOIN {_B} b USING (k)")
def annotation_coverage(spark, d):
    return compare.coverage(*sides(spark, d))


@query(f"""WITH p AS {_P}, t AS (SELECT count(*) AS n, count_if(l1 = l2) AS a, avg(abs(l1 - l2)) AS mae, sqrt(avg((l1 - l2) * (l1 - l2))) AS rmse, corr(l1, l2) AS r, avg((l1 - l2) * (l1 - l2)) AS o FROM p),
    e AS (SELECT avg((x.l1 - y.l2) * (x.l1 - y.l2)) AS e FROM p x, p y)
    SELECT n, a::BIGINT AS agreements, a / n AS rate, round(1 - o / e, 9) AS kappa, CASE WHEN 1 - o / e < 0 THEN 'poor' WHEN 1 - o / e < 0.2 THEN 'slight' WHEN 1 - o / e < 0.4 THEN 'fair' ELSE 'moderate' END AS interpretation,
        round(mae, 9) AS mae, round(rmse, 9) AS rmse, round(r, 9) AS pearson FROM t, e""")
def annotation_agreement(spark, d):
    """Rate, quadratic kappa, errors and correlation of two annotators."""
    out = compare.agreement(pairs(spark, d), ordinal=True)
    return out.withColumns({c: F.round(c, 9) for c in ("kappa", "mae", "rmse", "pearson")})


@query(f"""WITH p AS {_P}, o AS (SELECT count(*) AS n, count_if(l1 = l2) AS a FROM p), e AS (SELECT count_if(x.l1 = y.l2) / count(*) AS pe FROM p x, p y)
    SELECT n, a::BIGINT AS agreements, round((a / n - pe) / (1 - pe), 9) AS kappa FROM o, e""")
def cohen_kappa(spark, d):
    return compare.agreement(pairs(spark, d)).select("n", "agreements", F.round("kappa", 9).alias("kappa"))


@query(f'SELECT l1, count_if(l2 = 0)::BIGINT AS "0", count_if(l2 = 1)::BIGINT AS "1", count_if(l2 = 2)::BIGINT AS "2" FROM {_P} GROUP BY 1')
def confusion_matrix(spark, d):
    return compare.confusion(pairs(spark, d), [0, 1, 2])


@query(f"SELECT l2 - l1 AS difference, count(*) AS n FROM {_P} GROUP BY 1")
def difference_histogram(spark, d):
    return compare.differences(pairs(spark, d))


@query(f"SELECT label, count_if(s = 1)::BIGINT AS n1, count_if(s = 2)::BIGINT AS n2 FROM (SELECT l1 AS label, 1 AS s FROM {_P} UNION ALL SELECT l2, 2 FROM {_P}) GROUP BY 1")
def side_by_side(spark, d):
    return compare.side_by_side(pairs(spark, d))


@query(f"SELECT key_hash, l1, l2 FROM {_P} WHERE l1 <> l2 ORDER BY key_hash LIMIT 10")
def first_disagreements(spark, d):
    return compare.first_disagreements(pairs(spark, d))


_DA, _DB = "(SELECT *, doc_id AS k, n_chars // 10 AS v FROM documents)", "(SELECT documents.*, doc_id AS k, n_chars // 10 + toxic AS v FROM documents JOIN labels USING (doc_id))"


def _versions(spark, d):
    """All documents with a value, and those with labels, where some values are other ones."""
    a = table(spark, d, "documents").withColumn("k", F.col("doc_id"))
    b = labelled(spark, d).withColumn("k", F.col("doc_id"))
    return a.withColumn("v", F.expr("n_chars div 10")), b.withColumn("v", F.expr("n_chars div 10 + toxic"))


@query(f"""WITH a AS (SELECT k, max(doc_id) AS i, arg_max(v, doc_id) AS v FROM {_DA} GROUP BY 1), b AS (SELECT k, max(doc_id) AS i, arg_max(v, doc_id) AS v FROM {_DB} GROUP BY 1)
    SELECT a.k::VARCHAR AS key, a.v AS value1, b.v AS value2, a.i AS id1, b.i AS id2 FROM a JOIN b USING (k) WHERE a.v IS DISTINCT FROM b.v""")
def keyed_diff(spark, d):
    """Rows of two versions that differ, last write wins."""
    out = compare.keyed_diff(*_versions(spark, d), "k", "v", "doc_id")
    return out.select("key", "value1", "value2", F.col("row1.doc_id").alias("id1"), F.col("row2.doc_id").alias("id2"))


@query(f"""WITH a AS (SELECT k, arg_max(v, doc_id) AS v FROM {_DA} GROUP BY 1), b AS (SELECT k, arg_max(v, doc_id) AS v FROM {_DB} GROUP BY 1),
    s AS (SELECT count_if(b.k IS NULL)::BIGINT AS only_1, count_if(a.k IS NULL)::BIGINT AS only_2, count_if(a.k = b.k)::BIGINT AS common, count_if(a.k = b.k AND a.v <> b.v)::BIGINT AS different FROM a FULL JOIN b ON a.k = b.k)
    SELECT *, different / common AS rate FROM s""")
def diff_statistics(spark, d):
    return compare.diff_statistics(*_versions(spark, d), "k", "v", "doc_id")


@query(f"""WITH c AS (SELECT {GRADE} AS label, count(*) AS n FROM documents GROUP BY 1)
    SELECT label, n, round(100.0 * n / sum(n) OVER (), 9) AS percent, round(100.0 * sum(n) OVER (ORDER BY label) / sum(n) OVER (), 9) AS cumulative FROM c""")
def label_distribution(spark, d):
    out = stats.distribution(table(spark, d, "documents").withColumn("g", F.expr(GRADE)), "g")
    return out.withColumns({c: F.round(c, 9) for c in ("percent", "cumulative")})


@query("""WITH c AS (SELECT source AS label, count(*) AS n FROM documents GROUP BY 1)
    SELECT label, n, round(100.0 * n / sum(n) OVER (), 9) AS percent, round(100.0 * sum(n) OVER (ORDER BY n DESC, label ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 9) AS cumulative FROM c""")
def text_label_distribution(spark, d):
    out = stats.distribution(table(spark, d, "documents"), "source", ordinal=False)
    return out.withColumns({c: F.round(c, 9) for c in ("percent", "cumulative")})


def _positional(column: str, source: str, percents) -> str:
    picks = ", ".join(f"v[1 + least(n * {p} // 100, n - 1)] AS p{p}" for p in percents)
    return f"SELECT n, round(mean, 6) AS mean, round(std, 6) AS std, lo AS min, hi AS max, med AS median, {picks} FROM (SELECT list_sort(list({column})) AS v, count(*) AS n, avg({column}) AS mean, stddev_samp({column}) AS std, min({column}) AS lo, max({column}) AS hi, median({column}) AS med FROM {source})"


@query(_positional("value", "events", stats.PERCENTS))
def value_statistics(spark, d):
    out = stats.value_statistics(table(spark, d, "events"), "value")
    return out.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("SELECT count(value) AS n, count(DISTINCT value) AS different, min(value) AS min, max(value) AS max FROM events")
def value_extent(spark, d):
    return stats.extent(table(spark, d, "events"), "value")


@query(_positional("length(url)", "pages", (1, 5, 10, 25, 50, 75, 90, 95, 99)))
def key_length_statistics(spark, d):
    out = stats.value_statistics(table(spark, d, "pages").select(F.length("url").cast("long").alias("n")), "n", (1, 5, 10, 25, 50, 75, 90, 95, 99))
    return out.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("""WITH e AS (SELECT min(value) AS lo, (max(value) - min(value)) / 10 AS w FROM events), p AS (SELECT least(floor((value - lo) / w)::BIGINT, 9) AS bucket, count(*) AS n FROM events, e GROUP BY 1)
    SELECT b.bucket, round(lo + b.bucket * w, 6) AS low, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(range(10)) AS bucket) b CROSS JOIN e LEFT JOIN p ON p.bucket = b.bucket""")
def equal_width_buckets(spark, d):
    return stats.equal_width(table(spark, d, "events"), "value").withColumn("low", F.round("low", 6))


@query("""WITH s AS (SELECT list_sort(list(n_chars)) AS v, count(*) AS n, max(n_chars) AS hi FROM documents),
    e AS (SELECT DISTINCT v[1 + i * n // 10] AS lo FROM s, (SELECT unnest(range(10)) AS i) UNION SELECT hi + 1 FROM s),
    b AS (SELECT lo, lead(lo) OVER (ORDER BY lo) AS high FROM e)
    SELECT b.lo::INTEGER AS low, b.high::INTEGER AS high, count(*) AS n FROM b JOIN documents d ON d.n_chars >= b.lo AND d.n_chars < b.high GROUP BY 1, 2""")
def quantile_buckets(spark, d):
    return stats.quantile_buckets(table(spark, d, "documents"), "n_chars")


_PS = (5, 25, 50, 75, 95)


@query("SELECT p AS percent, round(v, 6) AS value FROM (SELECT unnest([5.0, 25.0, 50.0, 75.0, 95.0]::DOUBLE[]) AS p, unnest(quantile_cont(value, [0.05, 0.25, 0.5, 0.75, 0.95])) AS v FROM events)")
def percentiles(spark, d):
    return stats.percentiles(table(spark, d, "events"), "value", _PS).withColumn("value", F.round("value", 6))


@query("""WITH g AS (SELECT value AS v, sum(1 + event_id % 5)::DOUBLE AS w FROM events GROUP BY 1),
    m AS (SELECT v, 100.0::DOUBLE * (sum(w) OVER (ORDER BY v) - w / 2) / sum(w) OVER () AS mid FROM g),
    n AS (SELECT v, mid, lead(mid) OVER (ORDER BY v) AS mid2, lead(v) OVER (ORDER BY v) AS v2, row_number() OVER (ORDER BY v) AS r FROM m), p AS (SELECT unnest([5.0, 25.0, 50.0, 75.0, 95.0]::DOUBLE[]) AS percent)
    SELECT percent, round(CASE WHEN percent >= mid AND mid2 IS NOT NULL THEN v + (v2 - v) * (percent - mid) / (mid2 - mid) ELSE v END, 6) AS value
    FROM n JOIN p ON (mid <= percent AND percent < coalesce(mid2, 1e9)) OR (r = 1 AND percent < mid)""")
def weighted_percentiles(spark, d):
    df = table(spark, d, "events").withColumn("w", 1 + F.col("event_id") % 5)
    return stats.weighted_percentiles(df, "value", "w", _PS).withColumn("value", F.round("value", 6))


@query("""SELECT round(mean, 6) AS mean, round(sqrt(greatest(vv - mean * mean, 0)), 6) AS std FROM (SELECT sum(value * (1 + event_id % 5)) / sum(1 + event_id % 5) AS mean, sum(value * value * (1 + event_id % 5)) / sum(1 + event_id % 5) AS vv FROM events)""")
def weighted_moments(spark, d):
    out = stats.weighted_moments(table(spark, d, "events").withColumn("w", 1 + F.col("event_id") % 5), "value", "w")
    return out.select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("SELECT doc_id, lang, dense_rank() OVER (ORDER BY lang) - 1 AS rank FROM documents")
def dense_label_ranks(spark, d):
    return stats.dense_ranks(table(spark, d, "documents").select("doc_id", "lang"), "lang").select("doc_id", "lang", F.col("rank").cast("long").alias("rank"))
