"""Relay: stored-batch events to whoever listens."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugeflow import vocab
from gaugeflow.functions import instants
from gaugeflow.operators.metrics import metric_rows
from gaugeflow.session import scratch_dir, tune
from gaugeflow.sources import folders
from gaugeflow.sources.feed import Closing, Feed
from gaugeflow.sources.messages import decode_changes, only_new
from gaugeflow.sources.tables import Tables
from gaugeflow.streaming.jobs import batch_name, start_batches, start_spans, utc_now


@dataclass
class Relay:
    """The relaying job: decode, drop what is no event, hand the rest to ``push``.

    Events are signals. A backlog is skipped - Kafka feeds start at the latest offset, feeds of
    files at their end (``start_feed``), and ``since`` cuts landed files - and nothing is
    quarantined or retried.
    """

    tables: Tables
    push: Callable[[DataFrame], None]
    since: datetime | None = None
    clock: Callable[[], datetime] = utc_now

    def start(self, messages: DataFrame, checkpoint: str, drain: bool = False) -> StreamingQuery:
        return start_batches(messages, self.process, checkpoint, drain)

    def start_feed(self, feed: Feed, closing: Closing | None = None) -> StreamingQuery:
        """Run on a feed from its end on, by offsets: what came before is neither read nor pushed.

        How far the relay has got is kept as one mark per partition. What lies between a mark
        and the end the relay starts from came while it was away; it is counted as skipped.
        Progress of an earlier run is not taken up, so each start has a checkpoint of its own.
        """
        last = feed.last_entry()
        heads = feed.heads(last)
        self._count_skipped(feed, heads)
        self._mark(feed, heads)
        handle = feed.handle(
            self.process, lambda spans: self._mark(feed, {r["partition"]: r["until"] for r in spans})
        )
        return start_spans(feed.spans(closing, after=last), handle, scratch_dir(feed.spark, "relay"))

    def marks(self, feed: Feed) -> dict[int, int]:
        """The offset after the last event that was pushed or skipped, per partition."""
        spark, root = self.tables.spark, self._marks_path(feed)
        found = {int(p): folders.children(spark, f"{root}/{p}") for p in folders.children(spark, root)}
        return {p: max(map(int, names)) for p, names in found.items() if names}

    def _marks_path(self, feed: Feed) -> str:
        return f"{self.tables.root.rstrip('/')}/relayed/{feed.topic}"

    def _mark(self, feed: Feed, heads: dict[int, int]) -> None:
        # A mark is a file named by its offset: the new one is there before the old ones go.
        spark, root = self.tables.spark, self._marks_path(feed)
        for partition, head in heads.items():
            folders.mark(spark, f"{root}/{partition}/{head:020d}")
            for name in folders.children(spark, f"{root}/{partition}"):
                if int(name) < head:
                    folders.delete(spark, f"{root}/{partition}/{name}")

    def _count_skipped(self, feed: Feed, heads: dict[int, int]) -> None:
        gaps = {p: heads.get(p, mark) - mark for p, mark in self.marks(feed).items()}
        counts = [
            (vocab.EVENTS_SKIPPED, {"partition": str(p)}, n) for p, n in sorted(gaps.items()) if n > 0
        ]
        if counts:
            name = f"relay-gap-{uuid.uuid4().hex}"
            self.tables.put_batch("metrics", name, metric_rows(self.tables.spark, counts, self.clock()))

    def process(self, messages: DataFrame, batch_id: int) -> None:
        self.run_batch(messages, batch_name(messages, batch_id))

    def run_batch(self, messages: DataFrame, batch: str) -> None:
        """Push the events of one set of messages and record their age."""
        tables = Tables(tune(messages.sparkSession), self.tables.root, may_be_new=True)
        now = self.clock()
        events = decode_changes(messages)
        if self.since is not None:
            events = only_new(events, self.since)
        # Decoded once for the push, the count and the ages; lost rows are decoded again.
        events = events.persist()
        try:
            self._push(tables, events, messages.count(), now, batch)
        finally:
            events.unpersist()

    def _push(
        self, tables: Tables, events: DataFrame, consumed: int, now: datetime, batch: str
    ) -> None:
        self.push(events)

        age = (F.lit(instants.micros_of(now)) - F.unix_micros("published_at")) / 1_000_000.0
        ages = events.select(
            instants.instant(now).alias("ts"),
            F.lit(vocab.EVENT_LAG).alias("name"),
            F.create_map().cast("map<string,string>").alias("labels"),
            age.alias("value"),
        ).filter(F.col("value") >= 0)
        counts = [
            (vocab.EVENTS_CONSUMED, {}, consumed),
            (vocab.EVENTS_PUSHED, {}, events.count()),
        ]
        counted = metric_rows(tables.spark, [c for c in counts if c[2]], now)
        tables.put_batch("metrics", f"relay-{batch}", ages.unionByName(counted))
