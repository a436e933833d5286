"""Rescoring as a stream: each batch appends new samples once; the summary is made from the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.sinks import append_new


def stream_rescore(source: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, key: str = "sample_id") -> StreamingQuery:
    """Score what has arrived and stop; a restart goes on from the checkpoint, and a batch that is run again adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        append_new(score(batch), path, key)

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
