"""Sensor tables derived from an ``events`` table with (event_id, ts, user_id, event_type,
value, props).

Every event is one reading: the user is the location, the kind of event the sensor type.
Event times are UTC; the session must be, too (``session.tune``).
The same events also appear as wire messages and landed polls, where the number in ``props``
decides which of them are damaged, and as recorded metrics.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeflow import vocab
from gaugeflow.functions import instants
from gaugeflow.schemas import MESSAGES, READING_COLUMNS

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)

# The first moment after the events; stands in for the clock.
NOW = datetime.fromisoformat("2024-01-31T00:00:00+00:00")

POLL_SIZE = 20

# A value member of a payload, to put its value in quotes.
_VALUE = r'("co2"|"motionDetected"|"energy"):([^,}]+)'


def events(
    spark: SparkSession,
    folder: str,
    start: datetime | None = None,
    end: datetime | None = None,
) -> DataFrame:
    """The events, optionally of a range of instants that the scan can prune by."""
    rows = spark.read.schema(EVENTS).parquet(f"{folder}/events.parquet")
    if start is not None:
        rows = rows.filter(F.col("ts") >= _wall(start))
    if end is not None:
        rows = rows.filter(F.col("ts") < _wall(end))
    return rows


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events as a file stream."""
    return (
        spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(folder)
    )


def with_reading(rows: DataFrame) -> DataFrame:
    """Add the reading behind each event: all columns of the readings table, the sensor's
    name, and ``k``, the number in ``props``."""
    kind = _sensor_type()
    rank = F.when(kind == vocab.AIR_QUALITY, 1).when(kind == vocab.MOTION, 2).otherwise(3)
    air, motion, energy = (kind == known for known in vocab.SENSOR_TYPES)
    value = F.col("value")
    return rows.withColumns(
        {
            "id": F.col("event_id"),
            "sensor_id": (F.col("user_id") * 10 + rank).cast("int"),
            "name": F.concat(F.lit("loc-"), F.col("user_id").cast("string")),
            "collected_at": F.col("ts").cast("timestamp"),
            "sensor_type": kind,
            "co2": F.when(air, F.floor(value * 5).cast("int")),
            "pm25": F.when(air, F.floor(value / 10).cast("int")),
            "humidity": F.when(air, F.floor(value).cast("int") % 100),
            "energy_kwh": F.when(energy, value),
            "motion_detected": F.when(motion, F.col("event_type") == "signup"),
            "k": F.get_json_object("props", "$.k").cast("int"),
        }
    )


def readings(
    spark: SparkSession,
    folder: str,
    start: datetime | None = None,
    end: datetime | None = None,
) -> DataFrame:
    """The readings table."""
    return with_reading(events(spark, folder, start, end)).select(*READING_COLUMNS)


def sensors(spark: SparkSession, folder: str) -> DataFrame:
    """The sensor catalogue: every sensor any reading came from."""
    return (
        with_reading(events(spark, folder))
        .select(F.col("sensor_id").alias("id"), "name", "sensor_type")
        .distinct()
    )


def with_message(rows: DataFrame) -> DataFrame:
    """The wire messages of events: the columns of a feed, ``event_id`` beside them.

    One reading in a hundred each, by the number in ``props``, is sent twice, misspelt,
    truncated or otherwise damaged, as listed below.
    """
    k = F.col("k")
    full = with_reading(rows)
    payload = F.struct(
        "co2",
        "pm25",
        F.when(k != 23, F.col("humidity")).alias("humidity"),
        F.col("motion_detected").alias("motionDetected"),
        F.when(k != 23, F.col("energy_kwh")).alias("energy"),
    )
    kind = F.when(k == 3, F.lit("temperature")).otherwise(F.col("sensor_type"))
    sound = F.to_json(
        F.struct(
            kind.alias("type"),
            F.when(k == 53, F.lit("  ")).when(k != 19, F.col("name")).alias("name"),
            F.when(k != 37, payload).alias("payload"),
            instants.wire_instant(F.col("collected_at")).alias("collectedAt"),
        )
    )
    text = (
        F.when(k == 7, F.expr("substring(sound, 1, length(sound) - 5)"))
        .when(k == 11, "null")
        .when(k == 17, "")
        .when(k == 29, F.regexp_replace("sound", _VALUE, '$1:"$2"'))
        .when(k == 31, F.regexp_replace("sound", r'"payload":\{[^}]*\}', '"payload":[1]'))
        .when(k == 41, F.concat(F.col("sound"), F.lit(" {}")))
        .when(k == 43, F.regexp_replace("sound", r'"name":"[^"]*"', '"name":42'))
        .when(k == 47, F.regexp_replace("sound", r'"collectedAt":"[^"]*"', '"collectedAt":"noon"'))
        .when(k == 59, F.regexp_replace("sound", '"name":', '"NAME":'))
        .otherwise(F.col("sound"))
    )
    not_text = F.concat(F.col("sound").cast("binary"), F.expr("X'FF'"))
    copies = F.when(k == 61, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    trace = F.concat(F.lit("00-"), F.lpad(F.hex(F.col("event_id") + 1), 32, "0"), F.lit("-00f067aa0ba902b7-01"))
    return (
        full.withColumn("sound", sound)
        .withColumn("body", F.when(k == 13, not_text).otherwise(text.cast("binary")))
        .select("*", F.explode(copies).alias("copy"))
        .select(
            "event_id",
            F.concat_ws(":", "sensor_type", "name").cast("binary").alias("key"),
            F.col("body").alias("value"),
            F.array(
                F.struct(
                    F.lit("traceparent").alias("key"), F.lower(trace).cast("binary").alias("value")
                )
            ).alias("headers"),
            F.lit(vocab.READINGS_TOPIC).alias("topic"),
            F.pmod(F.col("user_id"), F.lit(3)).cast("int").alias("partition"),
            (F.col("event_id") * 2 + F.col("copy")).alias("offset"),
            F.col("collected_at").alias("timestamp"),
        )
    )


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """The events as wire messages."""
    return with_message(events(spark, folder)).select(*MESSAGES.fieldNames())


def polls(spark: SparkSession, folder: str) -> DataFrame:
    """Landed poll responses: twenty events each, with ``poll_id``.

    The first event of a poll decides by its number how the upstream answered; the numbers
    of the others damage single readings.
    """
    k = F.col("k")
    payload = F.struct(
        "co2",
        "pm25",
        F.when(k != 23, F.col("humidity")).alias("humidity"),
        F.when(k != 23, F.col("motion_detected")).alias("motionDetected"),
        F.col("energy_kwh").alias("energy"),
    )
    element = F.struct(
        F.when(k == 3, F.lit("temperature")).otherwise(F.col("sensor_type")).alias("type"),
        "name",
        payload.alias("payload"),
    )
    sound = F.col("sound")
    text = (
        F.when(k == 29, F.regexp_replace(sound, r'("co2"|"energy"):([^,}]+)', '$1:"$2"'))
        .when(k == 31, F.regexp_replace(sound, r'"payload":\{[^}]*\}', '"payload":"oops"'))
        .otherwise(sound)
    )
    grouped = (
        with_reading(events(spark, folder))
        .withColumn("sound", F.to_json(element))
        .select(
            instants.floor_div(F.col("event_id"), POLL_SIZE).alias("poll_id"),
            "event_id",
            "k",
            text.alias("text"),
            "collected_at",
        )
        .groupBy("poll_id")
        .agg(
            F.array_sort(F.collect_list(F.struct("event_id", "text"))).alias("parts"),
            F.min_by("k", "event_id").alias("k"),
            F.max("collected_at").alias("fetched_at"),
        )
    )
    k = F.col("k")
    body = F.concat(F.lit("["), F.array_join("parts.text", ","), F.lit("]"))
    return grouped.select(
        "poll_id",
        F.when(k < 5, 429)
        .when(k < 9, 500 + k - 5)
        .when(k < 10, 404)
        .otherwise(200)
        .alias("status"),
        F.when(k < 3, F.lit(120.0)).alias("retry_after_s"),
        F.when(k < 10, "")
        .when(k < 13, '{"error":"data corrupted"}')
        .when(k < 15, "not json at all")
        .when(k == 15, "[]")
        .when(k == 16, "null")
        .otherwise(body)
        .alias("body"),
        "fetched_at",
    )


# Counters and durations that the other recorded metrics spread over.
COUNTERS = (
    vocab.DUPLICATES_SKIPPED, vocab.BATCH_RETRIES, vocab.BATCHES_PROCESSED,
    vocab.EVENTS_PUBLISHED, vocab.MESSAGES_PRODUCED, vocab.MESSAGES_FAILED,
    vocab.READINGS_POLLED, vocab.EVENTS_CONSUMED, vocab.EVENTS_PUSHED,
)
DURATIONS = (vocab.WRITE_DURATION, vocab.CONSUMER_LAG, vocab.POLL_DURATION, vocab.EVENT_LAG)


def instruments(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as one delta of a counter, or for purchases one recorded duration."""
    k, timed = F.col("k"), F.col("event_type") == "purchase"

    def one_of(names: tuple[str, ...]) -> Column:
        return F.get(F.array(*map(F.lit, names)), k % len(names))

    return with_reading(events(spark, folder)).select(
        F.col("collected_at").alias("ts"),
        F.when(timed, one_of(DURATIONS)).otherwise(one_of(COUNTERS)).alias("name"),
        F.create_map().cast("map<string,string>").alias("labels"),
        F.when(timed, F.col("value")).otherwise(k.cast("double")).alias("value"),
    )


def metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded metrics: every event is one delta of a counter or one recorded duration."""
    names = {
        "view": vocab.MESSAGES_CONSUMED,
        "click": vocab.READINGS_INSERTED,
        "signup": vocab.POLL_REQUESTS,
        "error": vocab.DEAD_LETTERED,
        "purchase": vocab.BATCH_DURATION,
    }
    name: Column = F.lit(None).cast("string")
    for kind, counter in names.items():
        name = F.when(F.col("event_type") == kind, counter).otherwise(name)
    k = F.col("k")
    reason = F.when(k < 10, vocab.PERSIST_FAILED).otherwise(vocab.DECODE_FAILED)
    outcome = F.when(k < 20, "failure").otherwise("success")
    labels = (
        F.when(F.col("event_type") == "error", F.create_map(F.lit("reason"), reason))
        .when(F.col("event_type") == "signup", F.create_map(F.lit("outcome"), outcome))
        .otherwise(F.create_map().cast("map<string,string>"))
    )
    amount = F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(k.cast("double"))
    return with_reading(events(spark, folder)).select(
        F.col("collected_at").alias("ts"),
        name.alias("name"),
        labels.alias("labels"),
        amount.alias("value"),
    )


def _sensor_type() -> Column:
    kind = F.col("event_type")
    return (
        F.when(kind.isin("view", "click"), vocab.AIR_QUALITY)
        .when(kind.isin("signup", "error"), vocab.MOTION)
        .otherwise(vocab.ENERGY)
    )


def _wall(at: datetime) -> Column:
    return F.lit(instants.normalize(at).replace(tzinfo=None)).cast("timestamp_ntz")




def with_change(rows: DataFrame) -> DataFrame:
    """The change-event messages of events, a thousand times closer together in time.

    The number in ``props`` is the reading count; some numbers damage the message.
    """
    k = F.col("k")
    base = instants.micros_of(NOW)
    published = F.timestamp_micros(
        F.lit(base) + instants.floor_div(F.unix_micros("collected_at") - F.lit(base), 1000)
    )
    sensor = F.struct(F.col("name").alias("location"), F.col("sensor_type").alias("sensorType"))
    body = F.to_json(
        F.struct(
            instants.wire_instant(published).alias("publishedAt"),
            F.when(k != 2, k).alias("readingCount"),
            instants.wire_instant(F.col("collected_at")).alias("newestCollectedAt"),
            F.when(k != 5, F.array(sensor)).alias("sensors"),
        )
    )
    value = F.when(k == 7, "{ not json").when(k == 11, "null").when(k == 17, "").otherwise(body)
    topic = F.when(F.col("event_id") >= 0, F.lit(vocab.PERSISTED_TOPIC))
    return with_reading(rows).select(
        "event_id", value.cast("binary").alias("value"), topic.alias("topic")
    )


def changes(spark: SparkSession, folder: str) -> DataFrame:
    """The events as change-event messages."""
    return with_change(events(spark, folder))
