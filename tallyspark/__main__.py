"""python -m tallyspark list|describe|score-from-file|run|pairs ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import enrich, pipeline, rescore
from .plans.config import Task
from .sources import readers, sinks


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tallyspark")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("list", "describe"):
        p = sub.add_parser(name)
        p.add_argument("registry")
        p.add_argument("kind")
        if name == "describe":
            p.add_argument("id")
    for name in ("score-from-file", "run"):
        p = sub.add_parser(name)
        p.add_argument("input", help="Parquet: predictions or samples")
        p.add_argument("output")
        p.add_argument("--task-type", default="classification")
        p.add_argument("--labels", nargs="*", default=[])
        if name == "run":
            p.add_argument("--url", help="model endpoint; a deterministic stub without it")
        else:
            p.add_argument("--targets", required=True)
    p = sub.add_parser("pairs")
    p.add_argument("examples", help="Parquet: sample_id, ordinal, subset, text, target")
    p.add_argument("scored", help="Parquet: what run or score-from-file wrote")
    p.add_argument("output")
    p.add_argument("--model", required=True)
    p.add_argument("--run-id", default="pairs")
    p.add_argument("--k", type=int, help="so many examples; all without it")
    p.add_argument("--strategy", choices=["first", "sample"], default="first")
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--resume", action="store_true")
    args = parser.parse_args(argv)
    if args.command in ("list", "describe"):
        docs = readers.registry(args.registry)[args.kind]
        print("\n".join(sorted(docs)) if args.command == "list" else json.dumps(docs[args.id], sort_keys=True, indent=2))
        return 0
    spark = SparkSession.builder.getOrCreate()
    if args.command == "pairs":
        examples = spark.read.parquet(args.examples)
        examples = pipeline.select_examples(examples, args.k, args.strategy, args.seed) if args.k else examples
        records = pipeline.pairs(examples, spark.read.parquet(args.scored), args.model, args.run_id)
        pipeline.write_pairs(records, args.output, args.run_id, args.resume)
        return 0
    task = Task(args.command, args.task_type, ["accuracy"], args.labels)
    if args.command == "run":
        if args.url:
            enrich.preflight(args.url)
        call = enrich.http_model(args.url) if args.url else enrich.stub_model
        scored = pipeline.run_task(spark.read.parquet(args.input), task, call, f"{args.output}/scored")
    else:
        targets = spark.read.parquet(args.targets)
        vocab = args.labels or rescore.collect_vocabulary(targets)
        scored = rescore.rescore(spark.read.parquet(args.input), targets, vocab, args.task_type)
        scored.write.mode("overwrite").parquet(f"{args.output}/scored")
        scored = spark.read.parquet(f"{args.output}/scored").withColumn("error", F.col("error"))
    sinks.write_small(f"{args.output}/summary.json", pipeline.summarize(scored, task))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
