"""Sinks: canonical JSON, append after an anti-join, and small driver-side files written whole or not at all."""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_LOCAL: dict[str, str] = {}


def _work_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # one process, as in tests
        root = _LOCAL.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="tallyspark-")
        _LOCAL[spark.sparkContext.applicationId] = root
    return f"{root.rstrip('/')}/tallyspark/{spark.sparkContext.applicationId}"


def work_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share."""
    return f"{_work_root(spark)}/{uuid.uuid4().hex}"


def clear_work(spark: SparkSession) -> None:
    """Remove all folders that work_dir gave this application, once their results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_work_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def canonical_json(**fields: Column) -> Column:
    """One JSON object: keys sorted, nulls kept, no blanks."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def append_new(df: DataFrame, path: str, key: str = "sample_id", fmt: str = "parquet") -> None:
    """Append the rows whose key the table doesn't have yet, one of each key. A null key is none: such rows are told apart
    by all that they hold."""
    spark = df.sparkSession
    own = F.when(F.col(key).isNotNull(), F.to_json(F.struct(F.col(key).alias("k")))).otherwise(F.concat(F.lit("null "), F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256)))
    df = df.withColumn("_key", own)
    if exists(spark, path):
        df = df.join(spark.read.format(fmt).load(path).select(*df.drop("_key").columns).select(own.alias("_key")), "_key", "left_anti")
    df.dropDuplicates(["_key"]).drop("_key").write.mode("append").format(fmt).save(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or a folder that isn't empty, in whatever file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and (fs.getFileStatus(p).isFile() or any(not f.getPath().getName().startswith(("_", ".")) for f in fs.listStatus(p)))


def write_small(path: str, value: dict) -> None:
    """A driver-side JSON file, replaced in one step."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    fd, name = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        f.write(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False))
        f.flush()
        os.fsync(f.fileno())
    os.replace(name, path)


def write_checkpoint(path: str, run_id: str, completed: list[str], n_predictions: int, n_errors: int, failures: list[dict]) -> dict:
    """Merge with the file that is there: ids are united, the error count never falls."""
    old = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            old = json.load(f)
    new = {
        "schema_version": "checkpoint_v1",
        "run_id": run_id,
        "completed_sample_ids": sorted({*old.get("completed_sample_ids", []), *completed}),
        "n_predictions_written": old.get("n_predictions_written", 0) + n_predictions,
        "n_errors": max(old.get("n_errors", 0), n_errors),
        "failures": [*old.get("failures", []), *failures],
    }
    write_small(path, new)
    return new


def markdown(table: DataFrame, key: str, columns: list[str]) -> str:
    """A small table as Markdown; bars in cells are escaped."""
    cell = lambda v: "-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [" | ".join([key, *columns]), " | ".join(["---"] * (len(columns) + 1))]
    lines += [" | ".join(cell(r[c]) for c in (key, *columns)) for r in table.orderBy(key).collect()]
    return "\n".join(f"| {x} |" for x in lines)


def publish(df: DataFrame, path: str) -> None:
    """A dataset by tier and subset."""
    df.write.mode("overwrite").partitionBy("tier", "subset").parquet(path)


def sync_labels(path: str, task: str, labels: list[str]) -> bool:
    """Set a task's label vocabulary in a registry file; False if it was so already."""
    import yaml

    with open(path, encoding="utf-8") as f:
        doc = yaml.safe_load(f) or {}
    entry = doc[task] if isinstance(doc.get(task), dict) else doc
    if entry.get("labels") == labels:
        return False
    entry["labels"] = labels
    fd, name = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        yaml.safe_dump(doc, f, sort_keys=False, allow_unicode=True)
    os.replace(name, path)
    return True
