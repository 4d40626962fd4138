"""Change signals: bursts of events to one refresh, and a running view of them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugeflow import vocab
from gaugeflow.functions import instants, labels

QUIET_MS = 400
_LANDED = "published_at timestamp, reading_count int, hour timestamp"
# Slots of one quiet time each that are chained together in one task: about an hour.
_CHAINED = 9000


def refresh_signals(events: DataFrame, quiet_ms: int = QUIET_MS) -> DataFrame:
    """One refresh per burst of a bounded set of events, ``quiet_ms`` after its last event.

    Events closer together than the quiet time belong to one burst. All events share one
    feed, so a session window would order them all in one task. Instead, events are first
    reduced to slots as wide as the quiet time - events in one slot are in one burst - then
    slots are chained inside hours, and last the bursts that cross an hour's end, found from
    one row per hour, are joined.
    """
    quiet_us = quiet_ms * 1000
    slot = instants.floor_div(F.unix_micros("published_at"), quiet_us)
    slots = events.groupBy(slot.alias("slot")).agg(
        F.min(F.unix_micros("published_at")).alias("opened"),
        F.max(F.unix_micros("published_at")).alias("last"),
        F.count("*").alias("events"),
        F.sum("reading_count").alias("readings"),
    )

    hour = instants.floor_div(F.col("slot"), _CHAINED).alias("hour")
    in_hour = Window.partitionBy("hour").orderBy("slot")
    gap = F.col("opened") - F.lag("last").over(in_hour)
    opens = F.when(gap < quiet_us, 0).otherwise(1)
    bursts = (
        slots.select("*", hour)
        .withColumn("opens", opens)
        .withColumn("burst", F.sum("opens").over(in_hour))
        .groupBy("hour", "burst")
        .agg(*_merged())
    )

    # One row per hour that has events, so ordering them all is cheap.
    hours = bursts.groupBy("hour").agg(
        F.min("opened").alias("first_opened"),
        F.max("last").alias("last_event"),
        F.max("burst").alias("bursts"),
    )
    in_order = Window.orderBy("hour")
    since = F.col("first_opened") - F.lag("last_event").over(in_order)
    goes_on = F.coalesce(since < quiet_us, F.lit(False))
    own_last = F.struct("hour", F.col("bursts").alias("burst"))
    # The burst an hour ends in began in that hour, or in an earlier one if it never paused.
    ending = F.last(
        F.when(~(F.col("goes_on") & (F.col("bursts") == 1)), own_last), ignorenulls=True
    ).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    joined = (
        hours.withColumn("goes_on", goes_on)
        .withColumn("ending", ending)
        .withColumn("begun", F.lag("ending").over(in_order))
        .filter("goes_on")
        .select("hour", F.lit(1).cast("bigint").alias("burst"), "begun")
    )
    return (
        bursts.join(joined, ["hour", "burst"], "left")
        .groupBy(F.coalesce("begun", F.struct("hour", "burst")).alias("root"))
        .agg(*_merged())
        .select(
            F.timestamp_micros("opened").alias("first_event_at"),
            F.timestamp_micros(F.col("last") + quiet_us).alias("refresh_at"),
            "events",
            "readings",
        )
    )


def _merged() -> list[Column]:
    return [
        F.min("opened").alias("opened"),
        F.max("last").alias("last"),
        F.sum("events").alias("events"),
        F.sum("readings").alias("readings"),
    ]


def land_events(
    events: DataFrame, path: str, checkpoint: str, drain: bool = False
) -> StreamingQuery:
    """Append an event stream to files by hour, exactly once, as the file sink guarantees.

    No state is kept and nothing is late: an event goes to its hour whenever it comes, from
    any task, so neither one feed's key nor a watermark stands in the way.
    """
    hour = F.date_trunc("hour", "published_at").alias("hour")
    writer = (
        events.select("published_at", "reading_count", hour)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy("hour")
    )
    trigger = {"availableNow": True} if drain else {"processingTime": vocab.BATCH_LINGER}
    return writer.trigger(**trigger).start()


def landed_signals(
    spark: SparkSession, path: str, since: datetime | None = None, quiet_ms: int = QUIET_MS
) -> DataFrame:
    """One refresh per burst of the landed events, the open last one included.

    ``since`` reads the hours from then on only; a burst that began before is reported from
    its first event in them.
    """
    events = spark.read.schema(_LANDED).parquet(path)
    if since is not None:
        events = events.filter(F.col("hour") >= F.date_trunc("hour", instants.instant(since)))
    return refresh_signals(events, quiet_ms)


def running_view(events: DataFrame) -> DataFrame:
    """One row: how many events were seen, and the last of them."""
    last = F.max(
        F.struct("published_at", "reading_count", "newest_collected_at", "sensors")
    )
    return events.agg(F.count("*").alias("events_seen"), last.alias("last_event"))


def arrivals(view: DataFrame, now: datetime) -> DataFrame:
    """The sensors of the last event as the arrivals list shows them, in event order."""
    return view.select(
        F.col("last_event.published_at").alias("published_at"),
        F.posexplode("last_event.sensors").alias("position", "sensor"),
    ).select(
        "position",
        F.upper("sensor.location").alias("location"),
        labels.type_label(F.col("sensor.sensorType")).alias("type"),
        instants.age_label(F.col("published_at"), now).alias("age"),
    )
