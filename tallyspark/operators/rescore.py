"""From stored predictions to scores: join, clean, align, score, aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import run_steps
from ..plans.planner import plan_offline
from .metrics import score_means, score_sample, vocabulary
from .runs import with_targets


def collect_vocabulary(targets: DataFrame, text: str = "target", ordinal: str = "ordinal") -> list[str]:
    """Distinct labels, first seen first: the plan's literals, so of the size of a label set."""
    return [r["token"] for r in vocabulary(targets, text, ordinal).orderBy("first").collect()]


def rescore(predictions: DataFrame, targets: DataFrame, vocab: list[str], task_type: str | None) -> DataFrame:
    """predictions (sample_id, ordinal, prediction, error) with target, processed and scores; errors have no scores."""
    parsers, cleaners = plan_offline(vocab, task_type)
    df = with_targets(predictions, targets).withColumn("_post", run_steps(F.coalesce("prediction", F.lit("")), parsers, cleaners))
    kind = F.when(F.col("target").isNull(), "none").otherwise("text")
    scores = score_sample(F.col("_post.text"), F.coalesce("prediction", F.lit("")), kind, F.col("target"), F.split("target", ","), F.lit(task_type))
    return df.select(*predictions.columns, "target", F.col("_post.text").alias("processed"), F.when(F.col("error").isNull(), scores).alias("scores"))


def summary(scored: DataFrame) -> DataFrame:
    """(metric, mean) over all samples, with n_samples and n_errors."""
    n = scored.agg(F.count("*").alias("n_samples"), F.count("error").alias("n_errors"))
    return score_means(scored, "scores").crossJoin(F.broadcast(n))
