"""What a stored batch tells others: counts, change events, offsets, traces, lag."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow import vocab
from gaugeflow.functions import instants


def number_spans(messages: DataFrame) -> DataFrame:
    """Where each topic partition's messages begin in a batch: ``before``, ``low``, ``width``.

    Positions follow (topic, partition, offset), need not be consecutive, and take one small
    aggregate - a row per topic partition - instead of ranking the messages.
    """
    spans = messages.groupBy("topic", "partition").agg(
        F.min("offset").alias("low"), (F.max("offset") - F.min("offset") + 1).alias("width")
    )
    order = Window.orderBy("topic", "partition")
    return spans.withColumn("before", F.sum("width").over(order) - F.col("width"))


def with_announcement(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """The rows of a batch with the announcement each belongs to: 500 positions make one.

    One rule for any batch: a hand-sized one is one announcement, and no event ever lists
    more sensors than 500 messages can name.
    """
    position = F.col("before") + F.col("offset") - F.col("low")
    block = instants.floor_div(position, vocab.BATCH_MESSAGES).cast("string")
    return (
        rows.join(spans.drop("width"), ["topic", "partition"])
        .withColumn("announcement", block)
        .drop("before", "low")
    )


def change_events(
    decoded: DataFrame, inserted: DataFrame, published_at: datetime | Column
) -> DataFrame:
    """One event per announcement that stored something.

    ``decoded`` holds every decoded reading with its ``announcement``, ``inserted`` the
    number stored per announcement (``reading_count``). The newest instant and the sensors -
    each pair once, in the order first seen - are taken over all decoded readings, stored or
    not. Pairs are reduced before they are listed.
    """
    pairs = decoded.groupBy("announcement", "name", "sensor_type").agg(
        F.min(F.struct("topic", "partition", "offset")).alias("seen"),
        F.max("collected_at").alias("newest"),
    )
    listed = pairs.groupBy("announcement").agg(
        F.max("newest").alias("newest_collected_at"),
        F.array_sort(
            F.collect_list(
                F.struct(
                    "seen",
                    F.col("name").alias("location"),
                    F.col("sensor_type").alias("sensorType"),
                )
            )
        ).alias("seen"),
    )
    at = published_at if isinstance(published_at, Column) else instants.instant(published_at)
    return (
        listed.join(inserted.filter(F.col("reading_count") > 0), "announcement")
        .select(
            "announcement",
            at.alias("published_at"),
            F.col("reading_count").cast("int").alias("reading_count"),
            "newest_collected_at",
            F.transform(
                "seen",
                lambda s: F.struct(
                    s["location"].alias("location"), s["sensorType"].alias("sensorType")
                ),
            ).alias("sensors"),
        )
    )


def stored_events(stored: DataFrame, sensors: DataFrame, published_at: datetime) -> DataFrame:
    """The events of a batch again, from its stored readings: ids follow the order of arrival."""
    named = sensors.select(F.col("id").alias("sensor_id"), "name")
    rows = stored.join(named, "sensor_id").select(
        F.substring_index("ingest_batch", "/", -1).alias("announcement"),
        "name",
        "sensor_type",
        "collected_at",
        F.lit("").alias("topic"),
        F.lit(0).alias("partition"),
        F.col("id").alias("offset"),
    )
    inserted = rows.groupBy("announcement").agg(F.count("*").alias("reading_count"))
    return change_events(rows, inserted, published_at)


def event_value(events: DataFrame) -> DataFrame:
    """Change events as unkeyed JSON messages."""
    body = F.struct(
        instants.wire_instant(F.col("published_at")).alias("publishedAt"),
        F.col("reading_count").alias("readingCount"),
        instants.wire_instant(F.col("newest_collected_at")).alias("newestCollectedAt"),
        F.col("sensors"),
    )
    return events.withColumn("value", F.to_json(body).cast("binary"))


def batch_summary(total: Column, inserted: Column) -> list[Column]:
    """Inserted and skipped counts; repeats in the batch and in the table count alike."""
    return [inserted.alias("inserted"), (total - inserted).alias("duplicates_skipped")]


def next_offsets(messages: DataFrame) -> DataFrame:
    """Per topic partition, the offset after the last one read."""
    return messages.groupBy("topic", "partition").agg(
        (F.max("offset") + 1).alias("next_offset")
    )


def upstream_traces(messages: DataFrame) -> DataFrame:
    """Distinct trace ids named by the last ``traceparent`` header of each message."""
    last = F.try_element_at(
        F.filter("headers", lambda h: h["key"] == "traceparent"), F.lit(-1)
    )["value"].cast("string")
    trace = F.regexp_extract(last, r"^[0-9a-f]{2}-([0-9a-f]{32})-[0-9a-f]{16}-[0-9a-f]{2}", 1)
    return (
        messages.select(trace.alias("trace_id"))
        .filter((F.col("trace_id") != "") & (F.col("trace_id") != "0" * 32))
        .distinct()
    )


def newest_lag(rows: DataFrame, now: datetime, at: str = "collected_at") -> DataFrame:
    """Seconds from the newest instant to now; no row if it lies in the future."""
    newest = rows.agg(F.max(F.unix_micros(at)).alias("_newest"))
    lag = (F.lit(instants.micros_of(now)) - F.col("_newest")) / F.lit(1_000_000.0)
    return newest.select(lag.alias("lag_s")).filter(F.col("lag_s") >= 0)


def dead_letters(
    rejected: DataFrame, reason: str | Column, at: datetime, detail: str = "error_detail"
) -> DataFrame:
    """Rejected messages for the dead-letter feed.

    Key, value and headers stay as they were; six headers say where the message came from,
    why it was rejected, and when.
    """

    def header(key: str, value: Column) -> Column:
        return F.struct(F.lit(key).alias("key"), value.cast("string").cast("binary").alias("value"))

    stamp = F.date_format(instants.utc_wall(instants.instant(at)), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    added = F.array(
        header(vocab.DLQ_TOPIC, F.col("topic")),
        header(vocab.DLQ_PARTITION, F.col("partition")),
        header(vocab.DLQ_OFFSET, F.col("offset")),
        header(vocab.DLQ_REASON, reason if isinstance(reason, Column) else F.lit(reason)),
        header(vocab.DLQ_DETAIL, F.substring(F.col(detail), 1, vocab.DLQ_DETAIL_LENGTH)),
        header(vocab.DLQ_TIMESTAMP, F.concat(stamp, F.lit("0+00:00"))),
    )
    kept = F.coalesce("headers", F.array().cast(rejected.schema["headers"].dataType))
    return rejected.select("key", "value", F.concat(kept, added).alias("headers"))
