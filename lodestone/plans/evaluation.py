"""Queries over classification, ranking, regression and calibration metrics, and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import calibration, metrics, models, sampling
from lodestone.plans.registry import query
from lodestone.plans.tables import GRADE, OTHER, SCORED, scored, table

_TP = f"(SELECT {GRADE} AS t, {OTHER} AS p FROM documents)"


def _judged(spark, d):
    return table(spark, d, "documents").select(F.expr(GRADE).alias("t"), F.expr(OTHER).alias("p"))


_REPORT = f"""SELECT label, round(coalesce(tp / nullif(said, 0), 0), 9) AS precision, round(tp / support, 9) AS recall, round(coalesce(2.0 * tp / (said + support), 0), 9) AS f1, support
    FROM (SELECT l AS label, (SELECT count(*) FROM {_TP} WHERE t = l AND p = l) AS tp, (SELECT count(*) FROM {_TP} WHERE p = l) AS said, (SELECT count(*) FROM {_TP} WHERE t = l) AS support FROM (SELECT DISTINCT t AS l FROM {_TP}))"""


@query(_REPORT)
def classification_report(spark, d):
    out = metrics.report(_judged(spark, d), "t", "p")
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query(f"SELECT round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1, sum(support)::BIGINT AS support FROM ({_REPORT})")
def macro_report(spark, d):
    out = metrics.macro(metrics.report(_judged(spark, d), "t", "p"))
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c != "support"})


_AUC = "(SELECT sum(CASE WHEN x.score > y.score THEN 1.0 WHEN x.score = y.score THEN 0.5 ELSE 0 END) / count(*) FROM s x, s y WHERE {pos} AND {neg})"


@query(f"WITH s AS {SCORED} SELECT round({_AUC.format(pos='x.grade = 2', neg='y.grade <> 2')}, 9) AS auc")
def binary_auc(spark, d):
    return metrics.auc(scored(spark, d), "score", F.col("grade") == 2).select(F.round("auc", 9).alias("auc"))


@query(f"""WITH s AS {SCORED}, a AS (SELECT {_AUC.format(pos='x.grade >= 1', neg='y.grade < 1')} AS a1, {_AUC.format(pos='x.grade >= 2', neg='y.grade < 2')} AS a2, {_AUC.format(pos='x.grade = 1', neg='y.grade = 0')} AS b1,
    {_AUC.format(pos='x.grade = 2', neg='y.grade = 1')} AS b2, (SELECT count(*) FROM s WHERE grade >= 1) AS n1, (SELECT count(*) FROM s WHERE grade >= 2) AS n2)
    SELECT round((a1 + a2) / 2, 9) AS macro, round((a1 * n1 + a2 * n2) / (n1 + n2), 9) AS weighted, round((b1 + b2) / 2, 9) AS ordinal FROM a""")
def auc_with_ties(spark, d):
    return metrics.auc_with_ties(scored(spark, d), "score", "grade").select(*(F.round(c, 9).alias(c) for c in ("macro", "weighted", "ordinal")))


@query(f"""WITH s AS {SCORED}, r AS (SELECT score, grade, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS ra, rank() OVER (ORDER BY grade) + (count(*) OVER (PARTITION BY grade) - 1) / 2.0 AS rb FROM s),
    k AS (SELECT sum(sign(x.score - y.score) * sign(x.grade - y.grade)) AS net, sum((x.score <> y.score)::INT) AS na, sum((x.grade <> y.grade)::INT) AS nb FROM s x, s y)
    SELECT (SELECT count(*) FROM s) AS n, round((SELECT corr(score, grade) FROM s), 9) AS pearson, round((SELECT corr(ra, rb) FROM r), 9) AS spearman, round(net / sqrt(na::DOUBLE * nb::DOUBLE), 9) AS kendall FROM k""")
def rank_correlations(spark, d):
    out = metrics.rank_correlations(scored(spark, d), "score", "grade")
    return out.select("n", *(F.round(c, 9).alias(c) for c in ("pearson", "spearman", "kendall")))


_OTHER = "SELECT n_chars + (doc_id % 97) / 97.0 AS a, length(text) / (1.0 + doc_id % 13) AS b FROM documents"


@query(f"""WITH s AS ({_OTHER}), r AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM s),
    k AS (SELECT sum(sign(x.a - y.a) * sign(x.b - y.b)) AS net, sum((x.a <> y.a)::INT) AS na, sum((x.b <> y.b)::INT) AS nb FROM s x, s y)
    SELECT (SELECT count(*) FROM s) AS n, round((SELECT corr(a, b) FROM r), 9) AS pearson, round((SELECT corr(ra, rb) FROM r), 9) AS spearman, round(net / sqrt(na::DOUBLE * nb::DOUBLE), 9) AS kendall FROM k""")
def rank_correlations_of_numbers(spark, d):
    """Correlations of two columns that hardly repeat a value."""
    df = table(spark, d, "documents").select(F.expr("n_chars + (doc_id % 97) / 97D").alias("a"), F.expr("length(text) / (1D + doc_id % 13)").alias("b"))
    out = metrics.rank_correlations(df, "a", "b")
    return out.select("n", *(F.round(c, 9).alias(c) for c in ("pearson", "spearman", "kendall")))


#: Probabilities of four classes, the last of which no document has; class 1 lacks some.
_CLASSES = {"0": "(n_chars % 11) / 11", "1": "CASE WHEN doc_id % 4 > 0 THEN (n_chars % 7) / 7 END", "2": "(length(source) * n_chars % 29) / 29", "3": "(doc_id % 5) / 5"}
_GIVEN = " UNION ALL ".join(f"SELECT {GRADE} = {c} AS hit, '{c}' AS label, coalesce(({p})::DOUBLE, 0) AS s FROM documents" for c, p in _CLASSES.items())
_OVR = f"""WITH g AS ({_GIVEN}), r AS (SELECT *, rank() OVER (PARTITION BY label ORDER BY s) + (count(*) OVER (PARTITION BY label, s) - 1) / 2.0 AS r FROM g),
    t AS (SELECT label, count_if(hit)::BIGINT AS positives, count_if(NOT hit) AS q, sum(CASE WHEN hit THEN r END) AS sr FROM r GROUP BY 1)
    SELECT label, round((sr - positives * (positives + 1) / 2.0) / nullif(positives * q, 0), 9) AS auc, positives FROM t"""


def _probabilities(spark, d):
    pairs = ", ".join(f"'{c}', cast({p} as double)" for c, p in _CLASSES.items())
    df = table(spark, d, "documents").select(F.expr(GRADE).alias("grade"), F.expr(f"map({pairs})").alias("p"))
    return df.select("grade", F.map_filter("p", lambda k, v: v.isNotNull()).alias("p"))


@query(_OVR)
def one_vs_rest_auc(spark, d):
    """The AUC of each class's probability against the other classes."""
    return metrics.one_vs_rest(_probabilities(spark, d), "p", "grade").withColumn("auc", F.round("auc", 9))


@query(f"SELECT round(avg(auc), 9) AS macro_auc FROM ({_OVR}) WHERE label <> '3'")
def macro_auc(spark, d):
    df = _probabilities(spark, d).withColumn("p", F.map_filter("p", lambda k, v: k != "3"))
    return metrics.macro_auc(metrics.one_vs_rest(df, "p", "grade")).withColumn("macro_auc", F.round("macro_auc", 9))


@query(f"""SELECT round(mse, 9) AS mse, round(sqrt(mse), 9) AS rmse, round(mae, 9) AS mae, round(1 - mse / v, 9) AS r2 FROM (SELECT avg((score - grade / 2.0) ** 2) AS mse, avg(abs(score - grade / 2.0)) AS mae, var_pop(grade / 2.0) AS v FROM {SCORED})""")
def regression_metrics(spark, d):
    return metrics.regression(scored(spark, d), "score", F.col("grade") / 2.0).select(*(F.round(c, 9).alias(c) for c in ("mse", "rmse", "mae", "r2")))


_BINS = f"SELECT len(list_filter([i / 10.0::DOUBLE FOR i IN range(1, 10)], lambda e: score >= e))::INTEGER AS bin, count(*) AS n, avg(score) AS mean_predicted, avg(grade / 2.0) AS mean_truth FROM {SCORED} GROUP BY 1"


@query(f"SELECT bin, n, round(mean_predicted, 9) AS mean_predicted, round(mean_truth, 9) AS mean_truth FROM ({_BINS})")
def reliability_bins(spark, d):
    out = metrics.reliability(scored(spark, d), "score", F.col("grade") / 2.0)
    return out.withColumns({c: F.round(c, 9) for c in ("mean_predicted", "mean_truth")})


@query(f"SELECT round(sum(abs(mean_predicted - mean_truth) * n) / sum(n), 9) AS ece, round(max(abs(mean_predicted - mean_truth)), 9) AS mce FROM ({_BINS})")
def calibration_error(spark, d):
    return metrics.calibration_error(metrics.reliability(scored(spark, d), "score", F.col("grade") / 2.0)).select(F.round("ece", 9).alias("ece"), F.round("mce", 9).alias("mce"))


@query(f"SELECT grade, count(*) AS n, round(avg(score), 9) AS mean, round(stddev_pop(score), 9) AS std, min(score) AS min, max(score) AS max, round(median(score), 9) AS median FROM {SCORED} GROUP BY 1")
def per_class_metrics(spark, d):
    out = metrics.per_class(scored(spark, d), "score", "grade")
    return out.withColumns({c: F.round(c, 9) for c in ("mean", "std", "median")})


@query(f"SELECT min(score) AS min, max(score) AS max, count_if(score < 0 OR score > 1)::BIGINT AS outside FROM {SCORED}")
def prediction_range(spark, d):
    return metrics.prediction_range(scored(spark, d), "score")


@query(f"""WITH s AS (SELECT score AS x, grade / 2.0 AS y FROM {SCORED}), m AS (SELECT count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * y) AS sxy, sum(x * x) AS sxx FROM s),
    f AS (SELECT (sxy - sx * sy / n) / (sxx - sx * sx / n + 0.01) AS w, sx / n AS mx, sy / n AS my FROM m) SELECT round(w, 6) AS weight, round(my - w * mx, 6) AS bias FROM f""")
def ridge_calibration(spark, d):
    fit = calibration.ridge(scored(spark, d).withColumn("y", F.col("grade") / 2.0), ["score"], "y")
    return spark.createDataFrame([(round(fit.weights[0], 6), round(fit.bias, 6))], "weight double, bias double")


@query()
def log_linear_calibration(spark, d):
    """Rows with their calibrated score."""
    df = scored(spark, d).withColumn("y", F.col("grade") / 2.0)
    return df.select("doc_id", F.round(calibration.log_linear(df, ["score"], "y").column(), 6).alias("calibrated"))


@query()
def ngram_classifier(spark, d):
    """Trained on a hash split, its probabilities over the other rows."""
    df = sampling.split(table(spark, d, "documents").select("doc_id", "text", F.col("lang").alias("label")), "doc_id", test=0.2)
    model = models.train_ngrams(df.where("split = 'train'"), n=2, buckets=1 << 12, epochs=10)
    return models.infer(df.where("split = 'test'"), model).select("doc_id", "label", models.top_k("prediction", 1)[0]["key"].alias("predicted"))


@query()
def vector_classifier(spark, d):
    """A linear head over stored embeddings."""
    df = sampling.split(table(spark, d, "embeddings"), "vec_id", test=0.2)
    model = models.train_vectors(df.where("split = 'train'"), "embedding", "label", epochs=20)
    return model.transform(df.where("split = 'test'")).select("vec_id", "label", F.col("_k").cast("int").alias("predicted"))


_TOK = "(SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS token FROM documents) WHERE token <> '' GROUP BY ALL)"
_VEC = "(SELECT token, ord(token[1]) / 128.0 AS a, ord(right(token, 1)) / 128.0 AS b FROM (SELECT DISTINCT token FROM t))"


@query(f"WITH t AS {_TOK}, v AS {_VEC} SELECT doc_id, round(sum(a * n) / sum(n), 9) AS a, round(sum(b * n) / sum(n), 9) AS b FROM t JOIN v USING (token) GROUP BY 1")
def pooled_embeddings(spark, d):
    """Mean of token vectors, a join on the token."""
    t = table(spark, d, "documents").select("doc_id", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("token")).where("token <> ''")
    v = t.select("token").distinct().select("token", F.array(F.ascii("token") / 128.0, F.ascii(F.substring("token", -1, 1)) / 128.0).alias("vector"))
    return models.pooled_embeddings(t, v, "doc_id").select("doc_id", F.round(F.col("pooled")[0], 9).alias("a"), F.round(F.col("pooled")[1], 9).alias("b"))


@query("SELECT vec_id, list_reverse_sort(embedding)[1:3] AS top FROM (SELECT vec_id, embedding::DOUBLE[] AS embedding FROM embeddings)")
def top_k_values(spark, d):
    """The largest entries of a probability map."""
    df = table(spark, d, "embeddings").select("vec_id", F.map_from_arrays(F.transform(F.sequence(F.lit(1), F.size("embedding")), lambda i: i.cast("string")), F.col("embedding").cast("array<double>")).alias("prediction"))
    return df.select("vec_id", F.transform(models.top_k("prediction", 3), lambda e: e["value"]).alias("top"))
