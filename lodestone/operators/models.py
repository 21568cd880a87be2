"""Text classifiers on Spark ML: hashed n-grams, and pooled static embeddings; inference and evaluation."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, OneVsRest
from pyspark.ml.feature import ElementwiseProduct, HashingTF, NGram, RegexTokenizer, SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from lodestone.operators import metrics
from lodestone.operators.sampling import class_weights


def huffman(counts: dict[str, int]) -> dict[str, str]:
    """Each class's path of 0s and 1s in the tree of least mean length; ties by count, then by order of making."""
    heap = [(n, i, (name,)) for i, (name, n) in enumerate(sorted(counts.items()))]
    codes = dict.fromkeys(counts, "")
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for bit, (_, _, names) in zip("01", (a, b)):
            for name in names:
                codes[name] = bit + codes[name]
        heapq.heappush(heap, (a[0] + b[0], len(counts) + b[1], a[2] + b[2]))
    return codes


def _characters(low: int, high: int) -> SQLTransformer:
    """``_c``: the runs of ``low`` to ``high`` characters of each word between < and >."""
    run = f"transform(filter(sequence(1, length(w) + 2), i -> i + n - 1 <= length(w) + 2), i -> substring(concat('<', w, '>'), i, n))"
    every = f"flatten(transform(_w, w -> flatten(transform(sequence({low}, {high}), n -> {run}))))"
    return SQLTransformer(statement=f"select *, filter({every}, g -> g not in ('<', '>')) as _c from __THIS__")


def _frequent(df: DataFrame, column: str, out: str, low: int) -> ElementwiseProduct:
    """Zeroes the buckets whose words occur fewer than ``low`` times in all of ``df``."""
    total = df.select(Summarizer.sum(F.col(column)).alias("s")).first().s.toArray()
    return ElementwiseProduct(scalingVec=Vectors.dense((total >= low).astype(float)), inputCol=column, outputCol=out)


def train_ngrams(
    df: DataFrame,
    text: str = "text",
    label: str = "label",
    n: int = 3,
    buckets: int = 1 << 16,
    epochs: int = 20,
    loss: str = "softmax",
    balanced: bool = False,
    min_count: int = 1,
    characters: tuple[int, int] | None = None,
) -> PipelineModel:
    """Words and word n-grams up to ``n`` in hashed buckets under a loss: softmax, ova (one against all) or hs.

    ``hs`` is a Huffman tree of the classes with a two-way model at each inner node, learned from the
    rows that pass it. Buckets of words that occur fewer than ``min_count`` times in all count
    nothing. ``characters`` adds the words' character n-grams of these lengths. Gradients are summed over
    partitions.
    """
    if loss not in ("softmax", "ova", "hs"):
        raise ValueError(f"unknown loss {loss!r}")
    stages: list = [StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc"), RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"\s+")]
    for k in range(1, n + 1):
        stages += [NGram(n=k, inputCol="_w", outputCol=f"_g{k}"), HashingTF(inputCol=f"_g{k}", outputCol=f"_h{k}", numFeatures=buckets)]
    inputs = [f"_h{k}" for k in range(1, n + 1)]
    if characters:
        stages += [_characters(*characters), HashingTF(inputCol="_c", outputCol="_hc", numFeatures=buckets)]
        inputs.append("_hc")
    if min_count > 1:
        stages.append(_frequent(Pipeline(stages=stages[:4]).fit(df).transform(df), "_h1", "_hw", min_count))
        inputs[0] = "_hw"
    stages.append(VectorAssembler(inputCols=inputs, outputCol="_x"))
    weight = {}
    if balanced:
        df = df.join(class_weights(df, label).select(label, F.col("weight").alias("_weight")), label)
        weight = {"weightCol": "_weight"}
    if loss == "hs":
        return _train_tree(df, stages, label, epochs, weight)
    base = LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=epochs, regParam=1e-4, probabilityCol="_p", predictionCol="_k", **weight)
    # A model of this kind that is read back knows the default name of its margins only.
    stages.append(OneVsRest(classifier=base, featuresCol="_x", labelCol="_y", predictionCol="_k") if loss == "ova" else base.setRawPredictionCol("_r"))
    return Pipeline(stages=stages).fit(df)


def _train_tree(df: DataFrame, stages: list, label: str, epochs: int, weight: dict) -> PipelineModel:
    """The pipeline with a model for each inner node, their probabilities as ``_nodes`` and the classes' paths as ``_codes``."""
    front = Pipeline(stages=stages).fit(df)
    counts = {str(r[label]): r["count"] for r in df.where(F.col(label).isNotNull()).groupBy(label).count().collect()}
    if len(counts) < 2:
        raise ValueError("hs needs two classes")
    codes = huffman(counts)
    rows = front.transform(df).select(F.col(label).cast("string").alias("_c0"), "_x", *weight.values()).persist(StorageLevel.MEMORY_AND_DISK)
    paths = F.create_map(*(F.lit(x) for pair in codes.items() for x in pair))

    def node(prefix: str):
        here = rows.withColumn("_code", paths[F.col("_c0")]).where(F.startswith("_code", F.lit(prefix)))
        bit = here.withColumn("_bit", F.substring("_code", len(prefix) + 1, 1).cast("double"))
        name = f"_n{prefix}"
        one = LogisticRegression(featuresCol="_x", labelCol="_bit", maxIter=epochs, regParam=1e-4, family="binomial", probabilityCol=name, predictionCol=f"{name}k", rawPredictionCol=f"{name}r", **weight)
        return one.fit(bit)

    prefixes = _inner(codes.values())
    try:
        with ThreadPoolExecutor(4) as pool:
            nodes = list(pool.map(node, prefixes))
    finally:
        rows.unpersist()
    said = ", ".join(f"'{codes[name]}'" for name in front.stages[0].labels)
    tail = [VectorAssembler(inputCols=[f"_n{p}" for p in prefixes], outputCol="_nodes"), SQLTransformer(statement=f"select *, array({said}) as _codes from __THIS__")]
    return PipelineModel(stages=[*front.stages, *nodes, *tail])


def _inner(codes: Iterable[str]) -> list[str]:
    """The inner nodes of a tree, by their paths in order."""
    return sorted({c[:i] for c in codes for i in range(len(c))})


def _tree_probabilities(model: PipelineModel) -> Column:
    """An array with the product of the turns' probabilities on each class's path."""
    codes = re.findall(r"'([01]+)'", model.stages[-1].getStatement())
    place = {p: i for i, p in enumerate(_inner(codes))}
    p = vector_to_array("_nodes")

    def turns(code: str) -> Column:
        out = F.lit(1.0)
        for i, bit in enumerate(code):
            out = out * F.element_at(p, 2 * place[code[:i]] + int(bit) + 1)
        return out

    return F.array(*map(turns, codes))


def class_names(model: PipelineModel) -> list[str]:
    return list(model.stages[0].labels)


def infer(df: DataFrame, model: PipelineModel, label: str = "label", out: str = "prediction") -> DataFrame:
    """``df`` with map ``out``: each class's probability by name."""
    names = class_names(model)
    rows = df if label in df.columns else df.withColumn(label, F.lit(names[0]))
    for s in model.stages:
        if isinstance(s, StringIndexerModel):
            s.setHandleInvalid("keep")
    scored = model.transform(rows)
    if "_nodes" in scored.columns:
        p = _tree_probabilities(model)
    else:
        p = vector_to_array("_p") if "_p" in scored.columns else F.transform(vector_to_array("rawPrediction"), lambda z: 1 / (1 + F.exp(-z)))
    return scored.withColumn(out, F.map_from_arrays(F.array(*(F.lit(x) for x in names)), F.slice(p, 1, len(names)))).select(*df.columns, out)


def top_k(probabilities: str, k: int = -1) -> Column:
    """Entries of a probability map from the largest down; ties by name; all if k is -1."""
    entries = F.array_sort(F.map_entries(probabilities), lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).when(a["key"] < b["key"], -1).otherwise(1))
    return entries if k < 0 else F.slice(entries, 1, k)


def evaluate(df: DataFrame, model: PipelineModel, label: str = "label") -> DataFrame:
    """The classification report of ``model`` on labelled rows, with each class's AUC against the others."""
    best = F.element_at(top_k("prediction", 1), 1)["key"]
    scored = infer(df, model, label).withColumn("_best", best)
    ranked = metrics.one_vs_rest(scored, "prediction", label).select(F.col("label").alias("_l"), "auc")
    per = metrics.report(scored, label, "_best")
    return per.join(ranked, F.col("label").cast("string") == F.col("_l"), "left").drop("_l")


def vector_sums(rows: DataFrame, key: str, vector: str, weight: str, width: int) -> DataFrame:
    """``key, sums, weight``: for each key the sum of ``vector`` times ``weight``, added up before the shuffle.

    The dimensions are columns of one aggregation, so a key crosses as one row of numbers from each task.
    """
    each = [F.sum(F.col(vector)[i].cast("double") * F.col(weight)).alias(f"_s{i}") for i in range(width)]
    out = rows.groupBy(key).agg(*each, F.sum(weight).alias("weight"))
    return out.select(key, F.array(*(f"_s{i}" for i in range(width))).alias("sums"), "weight")


def pooled_embeddings(tokens: DataFrame, vectors: DataFrame, key: str, token: str = "token", vector: str = "vector", width: int | None = None) -> DataFrame:
    """``key, pooled``: the mean of the vectors of each document's tokens, a join on the token."""
    each = tokens.groupBy(key, token).agg(F.count("*").alias("n")).join(vectors.select(token, vector), token)
    if width is None:
        first = vectors.select(F.size(vector)).first()
        width = first[0] if first else 0
    sums = vector_sums(each, key, vector, "n", width)
    return sums.select(key, F.transform("sums", lambda x: x / F.col("weight")).alias("pooled"))


def quantized(vectors: DataFrame, vector: str = "vector") -> tuple[DataFrame, float]:
    """The vectors as signed bytes, and the step that gives them back: the largest component is 127 steps."""
    top = vectors.agg(F.max(F.array_max(F.transform(vector, F.abs)))).first()[0] or 1.0
    step = float(top) / 127
    return vectors.withColumn(vector, F.transform(vector, lambda x: F.round(x / step).cast("tinyint"))), step


def distil(vectors: DataFrame, counts: DataFrame, token: str = "token", vector: str = "vector", sif: float = 1e-4, dimensions: int | str | None = None) -> DataFrame:
    """Static vectors from a token-vector table: weight a / (a + p(token)), principal components if asked (``auto``: as many as there are)."""
    total = counts.agg(F.sum("n")).first()[0] or 1
    weighed = vectors.join(counts, token, "left").withColumn("w", sif / (sif + F.coalesce("n", F.lit(0)) / total))
    out = weighed.select(token, F.transform(vector, lambda x: x * F.col("w")).alias(vector))
    if dimensions:
        from pyspark.ml.feature import PCA
        from pyspark.ml.functions import array_to_vector

        if dimensions == "auto":
            dimensions = out.select(F.size(vector)).first()[0]
        rows = out.withColumn("_v", array_to_vector(vector))
        out = PCA(k=dimensions, inputCol="_v", outputCol="_p").fit(rows).transform(rows).select(token, vector_to_array("_p").alias(vector))
    return out


def train_vectors(df: DataFrame, features: str, label: str, regression: bool = False, epochs: int = 50) -> PipelineModel:
    """A linear head over array features: classes, or a number."""
    width = df.select(F.size(features)).first()[0]
    fields = ", ".join(f"{features}[{i}] as _f{i}" for i in range(width))
    stages: list = [SQLTransformer(statement=f"select *, {fields} from __THIS__"), VectorAssembler(inputCols=[f"_f{i}" for i in range(width)], outputCol="_x")]
    if regression:
        stages.append(LinearRegression(featuresCol="_x", labelCol=label, predictionCol="_k", maxIter=epochs, regParam=1e-3))
    else:
        stages = [StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc"), *stages]
        stages.append(LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=epochs, regParam=1e-3, probabilityCol="_p", predictionCol="_k", rawPredictionCol="_r"))
    return Pipeline(stages=stages).fit(df)


def save(model: PipelineModel, path: str, parameters: dict | None = None) -> None:
    """A model folder and the parameters it was trained with."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(parameters or {}, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/parameters")

