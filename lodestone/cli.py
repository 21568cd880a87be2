"""Commands over dataset folders: ``python -m lodestone.cli COMMAND --help``.

A dataset folder has train/, test/ and perhaps valid/ with JSON lines. Each command reads with Spark,
applies one operator of this package, and writes with Spark.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import lodestone
from lodestone import display
from lodestone.functions import jq
from lodestone.functions import text as X
from lodestone.operators import annotate, calibration, compare, metrics, models, networks, rows, sampling, stats
from lodestone.operators.answers import AnswerStore, Limits
from lodestone.sources import jsonl, loaders, sinks
from lodestone.sources.loaders import inferred


def number(text: str) -> float | int:
    """A share if written with a point, else rows; ``1.0`` is the number 1, that is one row."""
    value = float(text)
    return int(value) if value == int(value) else value


def dimensions(text: str) -> int | float | str:
    """``auto`` or a number."""
    return "auto" if text.lower() == "auto" else number(text)


def checked(spark: SparkSession, path: str, folder: bool | None = None) -> str:
    """``path``, if it is there, and a folder or a file where that matters; in any store that Hadoop reaches."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(place):
        raise FileNotFoundError(path)
    if folder is not None and system.getFileStatus(place).isDirectory() != folder:
        raise NotADirectoryError(path) if folder else IsADirectoryError(path)
    return path


def expression(df: DataFrame, field: str | None, text: str | None, default: str):
    return jq.compile_expression(jq.field_or_expression(field, text, default), df)


def strict(df: DataFrame, a: argparse.Namespace) -> DataFrame:
    """``text, label`` with file and split."""
    return df.select("file", "split", expression(df, a.text_field, a.text_expression, ".text").cast("string").alias("text"), expression(df, a.label_field, a.label_expression, ".score").alias("label"))


def put_like(df: DataFrame, a: argparse.Namespace) -> None:
    """Each input file's rows under the same path below the output."""
    sinks.write_like(df.drop("split"), [a.input], a.output, order=["_at"])


def put(df: DataFrame, out: str) -> None:
    df = df.drop("file")
    if "split" in df.columns and not df.where("split <> ''").isEmpty():
        jsonl.write_by_split(df.where("split <> ''"), out)
    else:
        jsonl.write_jsonl(df.drop("split"), out)


def keyed(df: DataFrame) -> DataFrame:
    """``_id``: a row's fingerprint and its place among equal rows, for hash sampling.

    Equal rows are counted a file at a time, and a file's places start at a prefix sum, so no task
    gets more than one file's equal rows.
    """
    content = F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns if c not in ("file", "split", "_at"))))
    marked = df.withColumn("_h", F.sha2(F.coalesce(content, F.lit("")), 256))
    local = marked.withColumn("_k", F.row_number().over(Window.partitionBy("_h", "file").orderBy(F.lit(0))))
    counts = marked.groupBy("_h", "file").agg(F.count("*").alias("_n"))
    base = counts.select("_h", "file", (F.sum("_n").over(Window.partitionBy("_h").orderBy("file")) - F.col("_n")).alias("_base"))
    return local.join(base, ["_h", "file"]).withColumn("_id", F.concat_ws("-", "_h", F.col("_base") + F.col("_k"))).select(*df.columns, "_id")


def run(spark: SparkSession, a: argparse.Namespace) -> object:
    """Do the command; what it returns is printed, and written as YAML where ``--results`` names a folder."""
    if getattr(a, "input", None):
        for place in a.input.split(","):
            checked(spark, place)
    for option, folder in (("model", True), ("vocabulary", False)):
        if getattr(a, option, None):
            checked(spark, getattr(a, option), folder)
    out = _run(spark, a)
    if out is not None and getattr(a, "results", None):
        sinks.write_results(spark, a.results, jsonl.to_yaml(out))
    return out


def _run(spark: SparkSession, a: argparse.Namespace) -> object:
    c = a.command
    if c == "version":
        return lodestone.__version__
    if c == "distil":
        vectors = spark.read.parquet(a.input)
        if a.vocabulary:
            vectors = vectors.join(loaders.vocabulary(spark, a.vocabulary), "token", "left_semi")
        counts = vectors.select("token", "n") if "n" in vectors.columns else vectors.select("token", F.lit(1).alias("n"))
        out = models.distil(vectors.select("token", "vector"), counts, sif=a.sif, dimensions=a.dimensions)
        if a.quantize:
            out, step = models.quantized(out)
            sinks.write_text(spark, f"{a.output}-step.yaml", jsonl.to_yaml({"step": step}, digits=12))
        out.write.mode("overwrite").parquet(a.output)
        return None
    if c == "import-dataset":
        df = spark.read.format(a.format).load(a.input)
        df = keyed(df.withColumn("file", F.input_file_name())).drop("file") if not a.key else df.withColumn("_id", F.col(a.key))
        df = sampling.split(df, "_id", a.seed, a.test_split)
        for split in ("train", "test"):
            part = sampling.positions(df.where(F.col("split") == split), "_id", a.seed).drop("_id", "split")
            sinks.write_shards(part, f"{a.output}/{split}", "position", a.rows_per_file)
    elif c == "transform-dataset":
        df = inferred(spark, a.input, placed=True)
        objects = jq.compile_object(a.text_transform, df) | jq.compile_object(a.label_transform, df)
        put_like(df.select(*(v.alias(k) for k, v in objects.items()), "file", "_at"), a)
    elif c == "normalize-dataset":
        put_like(rows.normalize_rows(inferred(spark, a.input, placed=True), a.normalizer, a.text_field or "text", a.label_field), a)
    elif c == "convert-to-lines":
        df = strict(inferred(spark, a.input), a)
        if a.bins:
            edges = stats.bin_edges(df.where("split = 'train'").withColumn("v", F.col("label").cast("double")), "v", a.bins)
            df = df.withColumn("label", F.concat(F.lit("bin"), stats.bin_of(F.col("label").cast("double"), edges).cast("string")))
        lines = rows.render_lines(df, "text", "label", a.normalizer, a.max_length)
        if a.single_file:
            sinks.write_named(lines.where("split <> ''").withColumn("name", F.concat("split", F.lit(".txt"))), a.output)
        else:
            jsonl.write_lines(lines, a.output)
        counts = {r.split: r["count"] for r in df.groupBy("split").count().orderBy("split").collect()}
        said = {"input_dir": a.input, "output_dir": a.output, "text_expression": a.text_expression or f".{a.text_field or 'text'}", "label_expression": a.label_expression or f".{a.label_field or 'score'}", "normalization": a.normalizer, "max_length": a.max_length, "num_rows": counts}
        if a.bins:
            said["auto_bins"] = {"num_bins": a.bins, "bin_edges": edges, "bin_labels": [f"bin{i}" for i in range(a.bins)]}
        sinks.write_text(spark, f"{a.output}/report.yaml", jsonl.to_yaml(said))
    elif c == "balance-dataset":
        df = keyed(inferred(spark, a.input).withColumn("_label", F.lit(None)))
        df = df.withColumn("_label", expression(df, a.label_field, a.label_expression, ".score").cast("string"))
        put(sampling.balance(df, "_label", "_id", a.seed, ["split"], a.exact).drop("_label", "_id"), a.output)
    elif c == "sample-dataset":
        if (a.rate is None) == (a.target_size is None):
            raise ValueError("give either a rate or a target size")
        lines = keyed(jsonl.read_lines(spark, a.input).withColumn("_at", F.col("at")).drop("at"))
        size = F.octet_length("value") + 1
        if a.rate:
            kept = sampling.sample_rate(lines, a.rate, "_id", a.seed)
        elif a.by_file:
            sizes = lines.groupBy("file").agg(F.sum(size).alias("size"))
            kept = sampling.byte_budget(lines, sizes, X.byte_size(a.target_size), "_id", size, "file", a.seed)
        else:
            kept = sampling.sample_bytes(lines, X.byte_size(a.target_size), "_id", size, "file", a.seed)
        sinks.write_like(kept.drop("_id"), [a.input], a.output, order=["_at"], value="value")
    elif c == "count-tokens":
        df = inferred(spark, a.input)
        body = expression(df, a.text_field, a.text_expression, ".text").cast("string")
        counted = X.token_counts(a.tokenizer)(body) if a.tokenizer else F.size(F.filter(F.split(body, r"(?U)\s+"), lambda w: w != ""))
        said = df.agg(F.coalesce(F.sum(counted), F.lit(0)).alias("tokens"), F.count("*").alias("rows"), F.count_distinct("file").alias("files"), F.coalesce(F.sum(F.octet_length(body)), F.lit(0)).alias("bytes")).first().asDict()
        if a.totals:
            stored = sum(sinks.file_sizes(spark, a.input).values())
            said |= {"file_bytes": stored, "tokens_per_file": said["tokens"] / max(1, said["files"]), "tokens_per_byte": said["tokens"] / max(1, stored)}
        return said
    elif c == "reshard-dataset":
        df = keyed(inferred(spark, a.input)).drop("split")
        out = sampling.reshard(df, "_id", a.files, a.test, a.valid, a.seed).drop("_id", "file")
        sinks.write_numbered(out, a.output, "split", "shard", a.files, "position")
    elif c == "train-ngrams":
        df = strict(inferred(spark, a.input), a).where("split = 'train'").withColumn("label", F.col("label").cast("string"))
        models.save(models.train_ngrams(df, n=a.ngrams, buckets=a.buckets, epochs=a.epochs, loss=a.loss, balanced=a.balanced, min_count=a.min_count, characters=(a.min_characters, a.max_characters) if a.max_characters else None), a.output, vars(a))
    elif c in ("infer-ngrams", "eval-ngrams"):
        from pyspark.ml import PipelineModel

        model, df = PipelineModel.load(f"{a.model}/model"), inferred(spark, a.input, placed=c == "infer-ngrams")
        if c == "eval-ngrams":
            df = strict(df, a).where("split = 'test'").withColumn("label", F.col("label").cast("string"))
            per = models.evaluate(df, model)
            return jsonl.results(per, metrics.macro(per))
        body = expression(df, a.text_field, a.text_expression, ".text").cast("string")
        scored = models.infer(df.withColumn("_text", body).withColumnRenamed("text", "_old").withColumnRenamed("_text", "text"), model, "_label", "_p")
        put_like(rows.write_back(scored.drop("text").withColumnRenamed("_old", "text"), a.name, F.col("_p")).drop("_p"), a)
    elif c in ("train-head", "eval-head"):
        df = keyed(strict(inferred(spark, a.input), a)).where(F.col("split") == ("train" if c == "train-head" else "test"))
        words = df.select("_id", F.explode(F.split(F.lower("text"), r"\s+")).alias("token")).where("token <> ''")
        pooled = models.pooled_embeddings(words, spark.read.parquet(a.vectors), "_id").join(df.select("_id", "label"), "_id")
        if c == "train-head":
            hidden = tuple(int(n) for n in a.hidden.split(",") if n)
            head = networks.train_head(pooled, "pooled", "label", "_id", a.kind, hidden, a.learning_rate, a.batches, a.epochs, a.patience, held=a.held, balanced=a.balanced, seed=a.seed)
            head.save(spark, a.output)
            return {"passes": len(head.history), "loss": min(head.history)}
        head = networks.Head.load(spark, a.model)
        scored = networks.evaluate_head(pooled, head, "pooled", "label")
        if head.kind == "number":
            return metrics.regression(scored, "prediction", F.col("label").cast("double")).first().asDict()
        per = metrics.report(scored, "label", "prediction").join(metrics.one_vs_rest(scored, "probabilities", "label").select("label", "auc"), "label", "left")
        return jsonl.results(per, metrics.macro(per))
    elif c == "annotate-dataset":
        prompt = annotate.PROMPTS.get(a.prompt) or annotate.rubric(a.prompt)
        limits = Limits(a.max_requests_per_minute, a.max_tokens_per_minute, a.max_concurrent_requests, a.max_new_tokens)
        store = AnswerStore(spark, a.store) if a.store else None
        done = annotate.annotate(inferred(spark, a.input, placed=True), prompt, a.text_field or "text", limit=a.limit_rows, reprocess=a.reprocess_all_rows, store=store, invalidate=a.invalidate, limits=limits if a.one_call_each else None)
        put_like(done.rows, a)
    elif c == "list-prompts":
        return sorted(annotate.PROMPTS)
    elif c == "annotation-agreement":
        sets = []
        for folder in a.input.split(","):
            df = inferred(spark, folder)
            label = expression(df, a.label_field, a.label_expression, ".score").cast("int" if a.ordinal else "string")
            sets.append(compare.last_by_key(df, expression(df, None, a.key_expression, ".id").cast("string"), label, F.struct("file", F.monotonically_increasing_id())))
        return [r.asDict() for r in compare.chain(sets, a.ordinal).collect()]
    elif c == "label-distribution":
        df = inferred(spark, a.input)
        label = expression(df, a.label_field, a.label_expression, ".score")
        if a.value:
            return stats.value_statistics(df.select(label.cast("double").alias("v")), "v").first().asDict()
        return [r.asDict() for r in stats.distribution(df.select(label.alias("v")), "v").orderBy("label").collect()]
    elif c in ("eval-calibration", "train-calibration"):
        df = inferred(spark, a.input)
        ranked = stats.dense_ranks(df.withColumn("_y", expression(df, a.label_field, a.label_expression, ".score")), "_y")
        top = ranked.agg(F.max("rank")).first()[0] or 1
        truth = F.col("rank") / top
        if c == "eval-calibration":
            ranked = ranked.withColumn("_s", expression(df, None, a.prediction_expression, ".prediction").cast("double"))
            bins = metrics.reliability(ranked, "_s", truth, a.bins)
            out = {"auc": metrics.auc_with_ties(ranked, "_s", "rank"), "correlation": metrics.rank_correlations(ranked, "_s", "rank"), "regression": metrics.regression(ranked, "_s", truth), "calibration": metrics.calibration_error(bins)}
            each = {k: v.first().asDict() for k, v in out.items()}
            return {**each, "bins": [r.asDict() for r in bins.orderBy("bin").collect()]} if a.show else each
        ranked = ranked.withColumn("_m", expression(df, None, a.prediction_expression, ".prediction"))
        kind = ranked.schema["_m"].dataType.simpleString()
        if kind.startswith("struct"):
            ranked = ranked.withColumn("_m", F.from_json(F.to_json("_m"), "map<string,double>"))
        names = sorted(r.key for r in rows.dictionary_keys(ranked, "_m").collect())
        wide = ranked.select(*(F.coalesce(F.try_element_at("_m", F.lit(n)), F.lit(0.0)).alias(n) for n in names), truth.alias("_t"))
        fit = (calibration.ridge if a.model_type == "linear" else calibration.log_linear)(wide, names, "_t")
        score = metrics.regression(wide.withColumn("_s", calibration.clipped(fit)), "_s", F.col("_t"))
        return {"weights": dict(zip(fit.names, fit.weights)), "bias": fit.bias, "expression": fit.expression(), "metrics": score.first().asDict()}
    elif c == "compare":
        folders = a.input.split(",")
        one, two = (inferred(spark, f, placed=True).withColumn("_order", F.struct("file", "_at")) for f in folders)
        if a.output:
            bare = lambda df: df.withColumn("_o", F.col("_order")).drop("file", "split", "_at", "_order")
            diff = compare.keyed_diff(bare(one), bare(two), a.text_field or "text", a.value, "_o")
            sinks.write_disagreements(diff.withColumns({r: F.col(r).dropFields("_o") for r in ("row1", "row2")}), a.output, tuple(f.rstrip("/").rsplit("/", 1)[-1] for f in folders))
        return compare.diff_statistics(one, two, a.text_field or "text", a.value, "_order").first().asDict()
    elif c == "percentiles":
        df = inferred(spark, a.input)
        value = df.select(expression(df, None, a.expression, ".score").try_cast("double").alias("v"), (expression(df, None, a.weight, ".weight").try_cast("double") if a.weight else F.lit(1.0)).alias("w"))
        ps = list(range(5, 100, 5))
        out = stats.weighted_percentiles(value, "v", "w", ps) if a.weight else stats.percentiles(value, "v", ps)
        return {r.percent: r.value for r in out.orderBy("percent").collect()}
    return None


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestone")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *options: tuple, output: bool = True, source: bool = True) -> None:
        s = sub.add_parser(name)
        if source:
            s.add_argument("--input", required=True)
        if output:
            s.add_argument("--output", required=True)
        for field in ("text", "label"):
            s.add_argument(f"--{field}-field")
            s.add_argument(f"--{field}-expression")
        s.add_argument("--seed", type=int, default=42)
        s.add_argument("--results")
        s.add_argument("--show", action="store_true")
        for flag, extra in options:
            s.add_argument(flag, **extra)

    add("import-dataset", ("--format", {"default": "parquet"}), ("--key", {}), ("--test-split", {"type": float, "default": 0.1}), ("--rows-per-file", {"type": int, "default": 100_000}))
    add("transform-dataset", ("--text-transform", {"default": "{text: .text}"}), ("--label-transform", {"default": "{score: .score}"}))
    add("normalize-dataset", ("--normalizer", {"default": "plsfix"}))
    add("convert-to-lines", ("--normalizer", {"default": "whitespace"}), ("--max-length", {"type": int}), ("--bins", {"type": int}), ("--single-file", {"action": "store_true"}))
    add("balance-dataset", ("--exact", {"action": "store_true"}))
    add("sample-dataset", ("--rate", {"type": float}), ("--target-size", {}), ("--by-file", {"action": "store_true"}))
    add("count-tokens", ("--tokenizer", {}), ("--totals", {"action": "store_true"}), output=False)
    add("reshard-dataset", ("--files", {"type": int, "required": True}), ("--test", {"type": number, "default": 0}), ("--valid", {"type": number, "default": 0}))
    add("train-ngrams", ("--ngrams", {"type": int, "default": 3}), ("--buckets", {"type": int, "default": 1 << 16}), ("--epochs", {"type": int, "default": 20}), ("--loss", {"choices": ["softmax", "hs", "ova"], "default": "softmax"}), ("--balanced", {"action": "store_true"}), ("--min-count", {"type": int, "default": 1}), ("--min-characters", {"type": int, "default": 1}), ("--max-characters", {"type": int, "default": 0}))
    add("infer-ngrams", ("--model", {"required": True}), ("--name", {"default": "classifier"}))
    add("eval-ngrams", ("--model", {"required": True}), output=False)
    add("train-head", ("--vectors", {"required": True}), ("--kind", {"choices": ["classes", "number"], "default": "classes"}), ("--hidden", {"default": "512"}), ("--learning-rate", {"type": float, "default": 1e-3}), ("--batches", {"type": int, "default": 16}), ("--epochs", {"type": int, "default": 100}), ("--patience", {"type": int, "default": 5}), ("--held", {"type": float, "default": 0.1}), ("--balanced", {"action": "store_true"}))
    add("eval-head", ("--model", {"required": True}), ("--vectors", {"required": True}), output=False)
    share = [(f"--max-{name}", {"type": int, "default": n}) for name, n in (("requests-per-minute", 10_000), ("tokens-per-minute", 100_000_000), ("concurrent-requests", 1_000), ("new-tokens", 16_384))]
    flags = [(f"--{name}", {"action": "store_true"}) for name in ("invalidate", "reprocess-all-rows", "one-call-each")]
    add("annotate-dataset", ("--prompt", {"required": True}), ("--limit-rows", {"type": int}), ("--store", {}), *flags, *share)
    add("list-prompts", output=False, source=False)
    add("annotation-agreement", ("--key-expression", {"default": ".id"}), ("--ordinal", {"action": "store_true"}), output=False)
    add("label-distribution", ("--value", {"action": "store_true"}), output=False)
    add("eval-calibration", ("--prediction-expression", {"default": ".prediction"}), ("--bins", {"type": int, "default": 10}), output=False)
    add("train-calibration", ("--prediction-expression", {"default": ".prediction"}), ("--model-type", {"choices": ["linear", "log-linear"], "default": "linear"}), output=False)
    add("compare", ("--value", {"required": True}), ("--output", {}), output=False)
    add("distil", ("--vocabulary", {}), ("--dimensions", {"type": dimensions}), ("--sif", {"type": float, "default": 1e-4}), ("--quantize", {"action": "store_true"}))
    add("version", output=False, source=False)
    add("percentiles", ("--expression", {"default": ".score"}), ("--weight", {}), output=False)
    return p


def shown(out: object) -> str:
    """Results for a terminal: reports as tables, all else as JSON."""
    if isinstance(out, dict) and "classes" in out and "overall" in out:
        return display.panel("Overall", out["overall"]) + "\n\n" + display.table([{"label": k, **v} for k, v in out["classes"].items()])
    if isinstance(out, dict) and "bins" in out:
        rest = "\n\n".join(display.panel(k.capitalize(), v) for k, v in out.items() if isinstance(v, dict))
        return rest + "\n\nReliability\n" + display.reliability_plot(out["bins"])
    return json.dumps(out, indent=2, default=str)


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName(f"lodestone {a.command}").getOrCreate()
    if (out := run(spark, a)) is not None:
        sys.stdout.write((shown(out) if a.show else json.dumps(out, indent=2, default=str)) + "\n")


if __name__ == "__main__":
    main()
