"""Live signals: bursts of change events while they come in, and a running view with state.

The file form in ``changes`` reads all landed events again. Here a stateful operator holds the
open end of every hour's chain of events: its key is the hour, so a backfill of many hours
is spread over tasks, and a timer closes a burst when the quiet time is over. A burst that reaches
an hour's end may go on in the next hour, so the operator gives parts of bursts; the parts at
hour ends are joined when the signals are read, from two rows an hour at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from gaugeflow import vocab
from gaugeflow.functions import instants
from gaugeflow.session import ship
from gaugeflow.streaming.changes import QUIET_MS

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PARTS = "hour long, opened long, last long, events long, readings long"
HOUR_US = 3_600_000_000


class Bursts(StatefulProcessor):
    """The bursts of one hour: a part is given once, when nothing can join it any more.

    State is the list of the parts that are still open, in the order of time. Events that come
    late, but not later than the watermark, find their part or join two of them.
    """

    def __init__(self, quiet_us: int) -> None:
        self.quiet_us = quiet_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "opened long, last long, events long, readings long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = [tuple(p) for p in self.open.get()]
        for frame in rows:
            # A tick only moves time on.
            real = frame[frame["readings"].notna()]
            for at, readings in zip(real["at"].tolist(), real["readings"].astype("int64").tolist()):
                parts.append((at, at, 1, readings))
        if parts:
            parts = self._joined(sorted(parts))
            self.open.put(parts)
            self._wait(parts)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now_us = timerValues.getCurrentWatermarkInMs() * 1000
        parts = [tuple(p) for p in self.open.get()]
        done = [p for p in parts if p[1] + self.quiet_us <= now_us]
        rest = [p for p in parts if p[1] + self.quiet_us > now_us]
        if rest:
            self.open.put(rest)
            self._wait(rest)
        else:
            self.open.clear()
        if done:
            opened, last, events, readings = zip(*done)
            yield pd.DataFrame(
                {"hour": [int(key[0])] * len(done), "opened": opened, "last": last, "events": events, "readings": readings}
            )
        else:
            yield pd.DataFrame()

    def _joined(self, parts: list[tuple]) -> list[tuple]:
        out: list[tuple] = []
        for part in parts:
            if out and part[0] - out[-1][1] < self.quiet_us:
                before = out[-1]
                out[-1] = (before[0], max(before[1], part[1]), before[2] + part[2], before[3] + part[3])
            else:
                out.append(part)
        return out

    def _wait(self, parts: list[tuple]) -> None:
        """One timer: for the first part that will be complete."""
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        # A timer counts milliseconds: the next one, so that the quiet time is over.
        self.handle.registerTimer((parts[0][1] + self.quiet_us) // 1000 + 1)

    def close(self) -> None:
        pass


@dataclass(frozen=True)
class LiveSignals:
    """Writes every burst of an event stream once, to the table at ``path``.

    ``late`` is how much later than the newest event one may come. Time is the events': the stream
    moves on when later events, or ticks, come; ticks are rows without a reading count.
    """

    spark: SparkSession
    path: str
    checkpoint: str
    quiet_ms: int = QUIET_MS
    late: str = "10 seconds"

    def start(self, events: DataFrame, drain: bool = False) -> StreamingQuery:
        """Run on events with published_at and reading_count."""
        ship(self.spark)
        at = F.unix_micros("published_at")
        timed = events.withWatermark("published_at", self.late).select(
            "published_at",
            at.alias("at"),
            F.col("reading_count").cast("long").alias("readings"),
            instants.floor_div(at, HOUR_US).alias("hour"),
        )
        parts = timed.groupBy("hour").transformWithStateInPandas(
            statefulProcessor=Bursts(self.quiet_ms * 1000),
            outputStructType=PARTS,
            outputMode="Append",
            timeMode="EventTime",
        )
        writer = (
            parts.writeStream.format("parquet")
            .option("path", self.path)
            .option("checkpointLocation", self.checkpoint)
            .outputMode("append")
        )
        trigger = {"availableNow": True} if drain else {"processingTime": vocab.BATCH_LINGER}
        # A query takes its settings with it when it starts; the caller's stay as they were.
        conf, name = self.spark.conf, "spark.sql.streaming.stateStore.providerClass"
        before = conf.get(name)
        conf.set(name, STATE_STORE)
        try:
            return writer.trigger(**trigger).start()
        finally:
            conf.set(name, before)

    def parts(self) -> DataFrame:
        """The parts of bursts that are complete within their hour."""
        return self.spark.read.schema(PARTS).parquet(self.path)

    def signals(self) -> DataFrame:
        """One refresh per burst, parts that go on over an hour's end joined."""
        return joined_parts(self.parts(), self.quiet_ms)


def joined_parts(parts: DataFrame, quiet_ms: int = QUIET_MS) -> DataFrame:
    """Bursts from the parts of hours.

    Only the first and the last part of an hour can touch another hour. Those, two rows an hour
    at most, are chained in their order; all other parts are bursts as they are.
    """
    quiet_us = quiet_ms * 1000
    ends = parts.groupBy("hour").agg(F.min("opened").alias("first"), F.max("opened").alias("final"))
    marked = parts.join(ends, "hour")
    outer = (F.col("opened") == F.col("first")) | (F.col("opened") == F.col("final"))
    in_order = Window.orderBy("opened")
    gap = F.col("opened") - F.lag("last").over(in_order)
    chained = (
        marked.filter(outer)
        .withColumn("opens", F.when(gap < quiet_us, 0).otherwise(1))
        .withColumn("burst", F.sum("opens").over(in_order))
        .groupBy("burst")
        .agg(
            F.min("opened").alias("opened"),
            F.max("last").alias("last"),
            F.sum("events").alias("events"),
            F.sum("readings").alias("readings"),
        )
        .drop("burst")
    )
    inner = marked.filter(~outer).select("opened", "last", "events", "readings")
    return inner.unionByName(chained).select(
        F.timestamp_micros("opened").alias("first_event_at"),
        F.timestamp_micros(F.col("last") + quiet_us).alias("refresh_at"),
        "events",
        "readings",
    )


# --- running view -------------------------------------------------------------------------

VIEW = (
    "events_seen bigint, last_event struct<published_at: timestamp, reading_count: int, "
    "newest_collected_at: timestamp, sensors: array<struct<location: string, sensorType: string>>>"
)


def start_view(events: DataFrame, path: str, checkpoint: str, drain: bool = False) -> StreamingQuery:
    """Keep the running view of an event stream: how many events, and the last of them.

    The aggregate is Spark's own streaming state in complete mode: one row, reduced per task
    before it moves, and restored from the checkpoint after a restart. Every batch writes the row
    to a folder of its number; a replayed batch writes the same folder again.
    """
    last = F.max(F.struct("published_at", "reading_count", "newest_collected_at", "sensors"))
    view = events.agg(F.count("*").alias("events_seen"), last.alias("last_event"))

    def keep(rows: DataFrame, batch: int) -> None:
        rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    writer = view.writeStream.outputMode("complete").foreachBatch(keep)
    trigger = {"availableNow": True} if drain else {"processingTime": vocab.BATCH_LINGER}
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def current_view(spark: SparkSession, path: str) -> DataFrame:
    """The row of the newest batch."""
    views = spark.read.schema(f"{VIEW}, batch bigint").parquet(path)
    newest = views.agg(F.max_by(F.struct("events_seen", "last_event"), "batch").alias("view"))
    return newest.select("view.*").filter("events_seen IS NOT NULL")
