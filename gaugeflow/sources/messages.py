"""Message feeds: readings in, change events in and out.

Kafka is reached through Spark's own connector, which must be on the class path. The same
columns kept as files - Parquet with the schema of ``schemas.MESSAGES`` - feed every job
without it.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow import vocab
from gaugeflow.functions import instants, jsontext
from gaugeflow.schemas import CHANGED_SENSORS, MESSAGES

# One micro-batch is many hand-sized batches of 500, which only bound the announcements.
MAX_MESSAGES = 5_000_000


def kafka_stream(
    spark: SparkSession,
    servers: str,
    topic: str = vocab.READINGS_TOPIC,
    from_latest: bool = False,
    max_messages: int | None = MAX_MESSAGES,
    least: int | None = vocab.BATCH_MESSAGES,
    linger: str = vocab.BATCH_LINGER,
    **options: str,
) -> DataFrame:
    """Messages of a topic, from its earliest offset or from now on.

    A micro-batch starts when ``least`` messages wait or ``linger`` has passed since the last
    one. ``max_messages`` caps it, so that a backlog is read in pieces. Give ``minPartitions``
    to spread a topic with few partitions over more tasks. A job that drains the topic and
    stops gives ``least=None``; otherwise fewer than ``least`` may wait for its next run.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "latest" if from_latest else "earliest")
        .option("includeHeaders", "true")
        .options(**options)
    )
    if max_messages:
        reader = reader.option("maxOffsetsPerTrigger", str(max_messages))
    if least:
        reader = reader.option("minOffsetsPerTrigger", str(least)).option("maxTriggerDelay", linger)
    return reader.load().select(*[f.name for f in MESSAGES])


def file_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Messages landed as Parquet files."""
    reader = spark.readStream.schema(MESSAGES)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.parquet(path)


def files(spark: SparkSession, path: str) -> DataFrame:
    """Landed messages as a bounded table."""
    return spark.read.schema(MESSAGES).parquet(path)


def write_kafka(messages: DataFrame, servers: str, topic: str) -> None:
    """Publish keyed messages; one key keeps to one partition, so its order is kept."""
    columns = [c for c in ("key", "value", "headers") if c in messages.columns]
    (
        messages.select(*columns)
        .write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("includeHeaders", "true")
        .save()
    )


def decode_changes(messages: DataFrame, value: str = "value") -> DataFrame:
    """Change events of the messages that carry one; the others are dropped.

    Empty, malformed and null bodies are not events. Absent members take defaults: the
    earliest instant, zero, no sensors.
    """
    names = ["publishedAt", "readingCount", "newestCollectedAt", "sensors"]
    staged = messages.withColumn("_text", F.col(value).cast("string"))
    staged = jsontext.parse_object(staged, "_text", names, F.is_valid_utf8("_text"))
    earliest = instants.instant("0001-01-01T00:00:00+00:00")

    def at(column: str) -> Column:
        raw = F.col(column)
        return F.when(raw.isNull(), earliest).otherwise(
            instants.parse_wire_instant(jsontext.string_of(raw))
        )

    def text_of(sensor: Column, name: str) -> Column:
        any_case = jsontext.member(F.try_variant_get(sensor, "$", "map<string,variant>"), name)
        return jsontext.string_of(F.coalesce(jsontext.exact_member(sensor, name), any_case))

    def sensor_of(sensor: Column) -> Column:
        return F.struct(
            *[text_of(sensor, name).alias(name) for name in ("location", "sensorType")]
        )

    listed = F.try_variant_get("_sensors", "$", "array<variant>")
    unlisted = F.col("_sensors").isNull() | (F.schema_of_variant("_sensors") == "VOID")
    count = F.when(F.col("_readingCount").isNull(), F.lit(0)).otherwise(
        jsontext.int_of(F.col("_readingCount"))
    )
    event = F.struct(
        at("_publishedAt").alias("published_at"),
        count.alias("reading_count"),
        at("_newestCollectedAt").alias("newest_collected_at"),
        F.when(unlisted, F.array().cast(CHANGED_SENSORS))
        .otherwise(F.transform(listed, sensor_of))
        .alias("sensors"),
        F.col("_whole").alias("_is_event"),
    )
    kept = [c for c in messages.columns if c != value]
    decoded = staged.select(*kept, F.inline(F.array(event)))
    return decoded.filter(
        F.col("_is_event")
        & F.col("published_at").isNotNull()
        & F.col("newest_collected_at").isNotNull()
        & F.col("reading_count").isNotNull()
        & F.col("sensors").isNotNull()
    ).drop("_is_event")


def only_new(events: DataFrame, since: datetime) -> DataFrame:
    """Latest-only reading of landed events: whatever was published before is skipped."""
    return events.filter(F.col("published_at") >= instants.instant(since))
