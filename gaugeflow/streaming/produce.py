"""Produce: landed poll responses to keyed reading messages."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugeflow import vocab
from gaugeflow.operators.metrics import metric_rows
from gaugeflow.session import tune
from gaugeflow.sources.polls import resolve_polls, resolved_readings, to_messages
from gaugeflow.sources.tables import Tables
from gaugeflow.streaming.jobs import batch_name, start_batches, utc_now


@dataclass
class Produce:
    """The producing job. ``sink`` publishes a set of messages, for example to Kafka:
    ``lambda m: messages.write_kafka(m, servers, vocab.READINGS_TOPIC)``.

    A sink that fails loses the readings of its polls, as any poll may be lost: the next
    poll brings newer ones. The loss is counted.
    """

    tables: Tables
    sink: Callable[[DataFrame], None]
    clock: Callable[[], datetime] = utc_now

    def start(self, polls: DataFrame, checkpoint: str, drain: bool = False) -> StreamingQuery:
        return start_batches(polls, self.process, checkpoint, drain)

    def process(self, polls: DataFrame, batch_id: int) -> None:
        self.run_batch(polls, batch_name(polls, batch_id))

    def run_batch(self, polls: DataFrame, batch: str) -> None:
        """Publish the readings of one set of polls and record what became of them."""
        tables = Tables(tune(polls.sparkSession), self.tables.root)
        started, clock_started = self.clock(), time.monotonic()
        # Bodies are resolved once; lost cached rows are resolved again to the same result.
        resolved = resolve_polls(polls).persist()
        try:
            good = F.col("outcome") == "success"
            succeeded, failed, polled = resolved.agg(
                F.count_if(good), F.count_if(~good), F.sum(F.when(good, F.size("_readings")))
            ).first()
            polled, produced = polled or 0, 0
            if polled:
                readings = to_messages(resolved_readings(resolved))
                try:
                    self.sink(readings.select("key", "value", "headers"))
                    produced = polled
                except Exception:  # noqa: BLE001 - a lost poll is counted, not fatal
                    produced = 0
        finally:
            resolved.unpersist()
        values = [
            (vocab.POLL_REQUESTS, {"outcome": "success"}, succeeded),
            (vocab.POLL_REQUESTS, {"outcome": "failure"}, failed),
            (vocab.READINGS_POLLED, {}, polled),
            (vocab.MESSAGES_PRODUCED, {}, produced),
            (vocab.MESSAGES_FAILED, {}, polled - produced),
            (vocab.POLL_DURATION, {}, time.monotonic() - clock_started),
        ]
        rows = metric_rows(tables.spark, [v for v in values if v[2]], started)
        tables.put_batch("metrics", f"produce-{batch}", rows.coalesce(1))
