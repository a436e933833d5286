"""What a run leaves: three append-only tables, summaries of tasks, suites and runs, the model's identity, judge outputs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import append_new, write_small

#: the tables of a run and their columns beside sample_id, ordinal and task_id
TABLES = {
    "predictions": ("predictions", "finish_reason", "prompt_tokens", "completion_tokens", "latency_sec", "server_info", "batch", "roundtrip_sec", "error"),
    "processed_predictions": ("predictions", "processed", "postprocess", "error"),
    "scored_predictions": ("predictions", "processed", "target", "scores", "postprocess", "error"),
}


def append_run(rows: DataFrame, folder: str) -> dict[str, DataFrame]:
    """Append the samples of rows that each table of TABLES doesn't have yet; gives the tables as they are then. rows are
    read three times, so they should come from a written table."""
    spark = rows.sparkSession
    for name, columns in TABLES.items():
        append_new(rows.select("sample_id", "ordinal", "task_id", *columns), f"{folder}/{name}")
    return {name: spark.read.parquet(f"{folder}/{name}") for name in TABLES}


def as_json_lines(table: DataFrame, path: str) -> None:
    """A table as JSON lines with sorted keys, nulls kept."""
    from ..sources.sinks import canonical_json

    table.select(canonical_json(**{c: F.col(c) for c in table.columns}).alias("value")).write.mode("overwrite").text(path)


def latency(answers: DataFrame) -> DataFrame:
    """One row: mean_roundtrip_sec over the calls, n_batches, and mean_latency_sec over the samples that report one. A call
    is one value of batch; its rows all have its time."""
    calls = answers.where("batch IS NOT NULL").groupBy("batch").agg(F.max("roundtrip_sec").alias("s"), F.sum("latency_sec").alias("l"), F.count("latency_sec").alias("n"))
    return calls.agg(F.avg("s").alias("mean_roundtrip_sec"), F.count("*").alias("n_batches"), F.try_divide(F.sum("l"), F.sum("n")).alias("mean_latency_sec"))


def throughput(rows: int, n_bytes: int, seconds: float) -> dict[str, float]:
    """Rows and megabytes (10**6 bytes) a second; 0 for no time."""
    per = lambda n: n / seconds if seconds > 0 else 0.0
    return {"rows": rows, "seconds": seconds, "rows_per_sec": per(rows), "mb_per_sec": per(n_bytes / 1e6)}


def task_summary(scored: DataFrame, by: str = "task_id") -> DataFrame:
    """A row for each task: n_samples, n_errors, mean (map of the mean of each metric over the rows that have it)."""
    task = F.coalesce(F.col(by), F.lit("default")).alias("task")
    n = scored.groupBy(task).agg(F.count("*").alias("n_samples"), F.count("error").alias("n_errors"))
    m = scored.select(task, F.explode("scores").alias("metric", "value")).groupBy("task", "metric").agg(F.avg("value").alias("v"))
    m = m.groupBy("task").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "v")))).alias("mean"))  # as many as there are metrics
    return n.join(m, "task", "left").withColumn("mean", F.coalesce("mean", F.create_map().cast("map<string,double>")))


def suite_summary(scored: DataFrame, suite_id: str, run_id: str, folder: str = "") -> DataFrame:
    """One row (value): the suite's summary as JSON, its tasks in order of their names."""
    listed = F.collect_list(F.struct(F.col("task").alias("eval_task_id"), F.struct("mean", "n_errors", "n_samples").alias("summary")))
    by_name = lambda a, b: F.when(a["eval_task_id"] < b["eval_task_id"], -1).when(a["eval_task_id"] > b["eval_task_id"], 1).otherwise(0)
    items = task_summary(scored).agg(F.array_sort(listed, by_name).alias("eval_tasks"))
    return items.select(F.to_json(F.struct("eval_tasks", F.lit(folder).alias("output_dir"), F.lit(run_id).alias("run_id"), F.lit("suite_summary_v1").alias("schema_version"), F.lit(suite_id).alias("suite_id"))).alias("value"))


def run_summary(items: list[dict], run_id: str, config: str = "", folder: str = "", limit: int | None = None) -> dict:
    """The aggregate of a run's models and tasks, as it is written."""
    return {"schema_version": "run_summary_aggregate_v1", "source_config": config, "run_id": run_id, "output_dir": folder, "limit": limit, "items": items}


def write_run(folder: str, summary: dict, answers: DataFrame, ordinal: str = "ordinal", judged: DataFrame | None = None) -> None:
    """summary.json with the calls' times, model_identity.json, and judge_outputs where there are any; folder is local."""
    from .enrich import first_server_info
    from .judges import judge_outputs

    times = latency(answers).first()
    if times["n_batches"]:
        summary = {**summary, "latency": {"mean_roundtrip_sec": times["mean_roundtrip_sec"], "n_batches": times["n_batches"]}}
    info = first_server_info(answers, ordinal).first()["server_info"]
    identity = json.loads(info) if info else {}
    write_small(f"{folder}/summary.json", {**summary, "model_identity": identity})
    write_small(f"{folder}/model_identity.json", identity)
    if judged is not None:
        judge_outputs(judged).write.mode("overwrite").text(f"{folder}/judge_outputs")


__all__ = ["append_run", "as_json_lines", "latency", "run_summary", "suite_summary", "task_summary", "throughput", "write_run"]
