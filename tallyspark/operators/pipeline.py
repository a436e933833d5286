"""Whole runs: samples to model answers to scores, with resume; and many runs to one table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rows import build_request, model_of_path, task_of_path
from ..functions.text import run_steps
from ..plans.config import Task
from ..plans.planner import fingerprint, plan_inline
from ..schemas import PREDICTION
from ..sources.readers import read
from ..sources.sinks import append_new, exists, write_small
from .enrich import predict
from .metrics import dataset_metric, score_means, score_sample
from .rescore import collect_vocabulary
from .runs import last_by, merged, pending, results_table, sample_k, winners


def run_task(examples: DataFrame, task: Task, call: Callable[[list[dict]], list[dict]], path: str, template: str = "{{text}}", system: str = "", size: int = 8, scorer: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
    """Score the examples (sample_id, ordinal, text, target) that the table at path doesn't have yet, append them, and
    give the whole table. A sample whose request or answer fails is a row with an error. scorer(processed, raw, target)
    gives a map of scores (a Column, or that of a pandas UDF) in place of the usual ones."""
    spark = examples.sparkSession
    vocab = task.labels or collect_vocabulary(examples.where("target IS NOT NULL"))
    parsers, cleaners = plan_inline(vocab, task.task_type, task.labels or None)
    todo = examples
    if exists(spark, path):
        todo = pending(examples, spark.read.parquet(path))
    made = todo.withColumn("_r", build_request(system, template, {"text": F.col("text")}))
    answers = predict(made.where("_r.error IS NULL").select("sample_id", F.to_json(F.struct("_r.messages", "_r.audio_inputs")).alias("request")), call, size)
    df = made.join(answers, "sample_id", "left").withColumn("error", F.coalesce("_r.error", "error"))
    raw = F.coalesce("prediction", F.lit(""))
    df = df.withColumn("_post", run_steps(raw, parsers, cleaners))
    scores = scorer(F.col("_post.text"), raw, F.col("target")) if scorer else score_sample(F.col("_post.text"), raw, F.when(F.col("target").isNull(), "none").otherwise("text"), F.col("target"), F.split("target", ","), F.lit(task.task_type))
    times = ("predictions", "finish_reason", "prompt_tokens", "completion_tokens", "latency_sec", "server_info", "batch", "roundtrip_sec")
    out = df.select("sample_id", "ordinal", F.lit(task.id).alias("task_id"), "prediction", *times, F.col("_post.text").alias("processed"), "target", F.when(F.col("error").isNull(), scores).alias("scores"), F.lit(fingerprint(parsers, cleaners)).alias("postprocess"), "error")
    append_new(out, path)
    return spark.read.parquet(path)


def upload(spark: SparkSession, folder: str, uri: str, names: list[str]) -> list[str]:
    """Copy the named artifacts of a local folder to a Hadoop file system; gives those that were there."""
    jvm, conf, done = spark._jvm, spark._jsc.hadoopConfiguration(), []
    for name in names:
        source = jvm.org.apache.hadoop.fs.Path(f"file://{folder.rstrip('/')}/{name}")
        if source.getFileSystem(conf).exists(source):
            target = jvm.org.apache.hadoop.fs.Path(f"{uri.rstrip('/')}/{name}")
            target.getFileSystem(conf).copyFromLocalFile(False, True, source, target)
            done.append(name)
    return done


def summarize(scored: DataFrame, task: Task) -> dict:
    """Counts and means of one task, and its corpus metric."""
    n = scored.agg(F.count("*").alias("n"), F.count("error").alias("e")).first()
    means = {r["metric"]: r["mean"] for r in score_means(scored, "scores").collect()}
    corpus = dataset_metric(scored.where("error IS NULL AND target IS NOT NULL").select("sample_id", "ordinal", "processed", "target"), task.task_type, "processed", "target", "ordinal")
    if corpus is not None:
        means[corpus.columns[0]] = corpus.first()[0]
    return {"task_id": task.id, "n_samples": n.n, "n_errors": n.e, "mean": means}


def consolidate(spark: SparkSession, root: str, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(inventory, rows): every run under root with its model, task, rows and repeated ids, and whether it is the winner of
    its model and task; the rows of the winners. expected has (task, expected)."""
    rows = read(spark, "run_files", root, schema=PREDICTION).withColumn("model", model_of_path(F.col("path"))).withColumn("task", task_of_path(F.col("path")))
    per = rows.groupBy("model", "task", "path").agg(F.count_if(~F.col("malformed")).alias("n"), F.count_if("malformed").alias("malformed"), F.count_distinct("row.sample_id").alias("ids"), F.max("mtime").alias("mtime"))
    per = per.join(F.broadcast(expected), "task", "left").na.fill(0, ["expected"])
    best = winners(per.where("n = ids"), ["model", "task"], "expected", "n", "mtime", "path")
    inventory = per.join(best.select("path", F.lit(True).alias("winner")), "path", "left").na.fill(False, ["winner"])
    return inventory, rows.join(best.select("path"), "path", "left_semi").where("NOT malformed").select("model", "task", "row.*")


def table(scored: DataFrame, tasks: list[str], metric: str) -> DataFrame:
    """Model by task, the mean of one metric, and how many tasks each model has."""
    m = scored.groupBy("model", "task").agg(F.avg(F.try_element_at("scores", F.lit(metric))).alias("v"))
    return results_table(m, "model", "task", "v", tasks)


def validate(spark: SparkSession, root: str, sidecars: list[str]) -> DataFrame:
    """(folder, problem): malformed lines, rows without predictions, and run folders that lack a sidecar file."""
    rows = read(spark, "run_files", root, schema=PREDICTION).withColumn("folder", F.regexp_replace("path", "/[^/]+$", ""))
    bad = F.when(F.col("malformed"), "malformed line").when(F.col("row.predictions").isNull() & F.col("row.error").isNull(), "row without predictions")
    found = rows.withColumn("problem", bad).where("problem IS NOT NULL").select("folder", "problem").distinct()
    for name in sidecars:
        files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).format("binaryFile").load(root)
        have = files.select(F.regexp_replace(F.regexp_replace(F.substring_index("path", root.rstrip("/") + "/", -1), "^/+", ""), "/[^/]+$", "").alias("folder"))
        found = found.unionByName(rows.select("folder").distinct().join(have, "folder", "left_anti").withColumn("problem", F.lit(f"missing {name}")))
    return found


def pairs(examples: DataFrame, scored: DataFrame, model: str, run_id: str) -> DataFrame:
    """Prompt and answer side by side, one record for each sample."""
    s = last_by(scored.select("sample_id", F.col("ordinal").alias("_o"), "prediction", "processed", "error"), "sample_id", "_o").drop("_o")
    out = examples.join(s, "sample_id")
    subset = F.col("subset") if "subset" in examples.columns else F.lit("all")
    return out.select(F.lit("pairs_v1").alias("schema_version"), F.lit(run_id).alias("run_id"), F.lit(model).alias("model_tag"), subset.alias("subset"), "sample_id", F.col("target").alias("ground_truth"), F.col("text").alias("prompt"), F.array("prediction").alias("raw_predictions"), F.col("processed").alias("processed_prediction"), "error")


def select_examples(examples: DataFrame, k: int, strategy: str = "first", seed: int = 0) -> DataFrame:
    """k examples: the first ones by ordinal, or a sample that depends on the seed and the ids alone."""
    if strategy == "first":
        return examples.orderBy("ordinal").limit(k)
    if strategy == "sample":
        return sample_k(examples, k, "sample_id", seed)
    raise ValueError(f"unknown strategy {strategy!r}")


def write_pairs(records: DataFrame, folder: str, run_id: str, resume: bool = False) -> DataFrame:
    """Append the records that folder doesn't have, and write a manifest (counts by subset, ids' digests) beside them;
    gives (subset, n, digest). Without resume the folder must be new."""
    spark, path = records.sparkSession, f"{folder}/pairs"
    if exists(spark, path) and not resume:
        raise ValueError(f"{folder} has pairs already")
    append_new(records, path)
    whole = spark.read.parquet(path)
    chosen_ids = whole.select("subset", "sample_id").distinct()
    chosen_ids.write.mode("overwrite").partitionBy("subset").parquet(f"{folder}/sample_ids")
    # an order-free digest, so no subset's ids meet in one task
    digest = F.hex(F.bit_xor(F.xxhash64("sample_id"))).alias("digest")
    manifest = chosen_ids.groupBy("subset").agg(F.count("*").alias("n"), digest)
    if folder.startswith("/"):
        write_small(f"{folder}/manifest.json", {"schema_version": "pairs_manifest_v1", "run_id": run_id, "subsets": {r["subset"]: {"n": r["n"], "digest": r["digest"]} for r in manifest.collect()}})  # a row for each subset
    return manifest


__all__ = ["consolidate", "merged", "pairs", "run_task", "select_examples", "summarize", "table", "upload", "validate", "write_pairs"]
