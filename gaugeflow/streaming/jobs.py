"""What the streaming jobs share: starting, naming batches, recording metrics."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from gaugeflow import vocab


def start_batches(
    stream: DataFrame,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    drain: bool,
    every: str = vocab.BATCH_LINGER,
) -> StreamingQuery:
    """Run a handler per micro-batch; ``drain`` stops after what is there now."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if drain else {"processingTime": every}
    return writer.trigger(**trigger).start()


def start_spans(
    spans: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str | None, drain: bool = False
) -> StreamingQuery:
    """Run a handler per closed batch of a feed, as soon as it closes.

    The feed's planner decides when; ``drain`` stops when no message waits any more.
    """
    writer = spans.writeStream.foreachBatch(handle)
    if checkpoint is not None:
        writer = writer.option("checkpointLocation", checkpoint)
    query = writer.trigger(processingTime="0 seconds").start()
    if drain:
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    return query


def batch_name(batch: DataFrame, batch_id: int) -> str:
    """A name that stays the same when the query replays the batch, and is no other's."""
    query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    return f"{query or 'batch'}-{batch_id:09d}"


def utc_now() -> datetime:
    return datetime.now(timezone.utc)
